import pytest

from graphloom.llm.defects import defective_pairs, is_copy, is_empty, is_refusal, is_unfinished, language_of

Q = "Why does the planner call heap_open before the cache is filled and what frees the token?"
GOOD = "The planner keeps a cache of pages. It is filled when the first query runs."


@pytest.mark.parametrize("a", [None, "", " \n", "​", "N/A", "None", "<p></p>", '""', "[no answer]", "-", "null", "TODO"])
def test_empty(a):
    assert is_empty(a)


@pytest.mark.parametrize("a", ["I don't know.", "I'm sorry, but I cannot help with the planner. Please ask something else.", "No. I won't do that.", "Désolé, je ne peux pas répondre à cette question.", "Dazu kann ich leider nichts sagen.", "As a language model I have no access to it, so I am unable to answer.", "My apologies! Questions on the cache are outside my scope."])
def test_refusal(a):
    assert is_refusal(a)


@pytest.mark.parametrize("a", ["I cannot say why " + "the planner and " * 30 + "the cache do so.", "I don't know. " * 100])
def test_refusal_of_any_length(a):
    assert is_refusal(a)


@pytest.mark.parametrize("a", [GOOD, "I don't know of a setting for it, yet the code is clear. " + GOOD, "You cannot do this directly, but there is a way. " + GOOD, "Sorry for the long answer. " + GOOD, "", None])
def test_no_refusal(a):
    assert not is_refusal(a)


@pytest.mark.parametrize("a,cut", [(GOOD, False), (GOOD[:-9], True), (GOOD + "\n```sql\nSELECT 1;\n```", False), (GOOD + "\n```sql\nSELECT 1", True), (GOOD + "\n2.", True), (GOOD + " (see above)", False), (GOOD + " (see", True), (GOOD + " …", True), (GOOD + " [truncated]", True), (GOOD + "\nSET x = 5;", False), (GOOD + " See src/backend/a/b.", True), (None, False)])
def test_unfinished(a, cut):
    assert is_unfinished(a) is cut


def test_copy_and_language():
    assert is_copy(Q, Q + "\n" + Q) and is_copy(Q, "You asked: " + Q.upper()) and not is_copy(Q, Q + " " + GOOD) and not is_copy(None, Q) and not is_copy(Q, None)
    assert language_of(Q) == "en" and language_of("Der Fehler entsteht, weil die Sperre zu früh freigegeben wird, und das ist nicht gut.") == "de" and language_of("x_y 12") is None and language_of(None) is None


def test_table(spark):
    half = "The old code used to walk every list before it was called and the new one does not do so because the tree is kept"
    rows = [
        (1, Q, None), (2, Q, GOOD), (3, Q, Q), (4, Q, "I don't know."), (5, Q, "Der Fehler entsteht, weil die Sperre zu früh freigegeben wird, und das ist nicht gut."), (6, Q, half), (6, Q, half), (7, None, GOOD), (8, Q, half[:60] + "s."), (9, Q, "long " * 5000 + "end."),
        (10, Q, half + " in order."),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "ragas_key bigint, question string, answer string, defect string")
    got = [tuple(r) for r in defective_pairs(df).collect()]
    assert sorted(got) == [(1, "empty"), (3, "copy"), (4, "refusal"), (5, "other_language"), (6, "truncated")]
    assert defective_pairs(df.limit(0)).count() == 0


def test_cut_where_a_sentence_ends(spark):
    other = "Which lock is taken when the buffer is written to disk by the background process?"
    rows = [
        (1, Q, GOOD), (2, other, GOOD + " Then it is emptied page by page."), (3, Q, GOOD + " Let me know if there is more."), (4, Q, GOOD + "  \n"),
        (5, Q, "It depends."), (6, Q, "It depends. The cache is filled first and freed at the end."), (7, other, "It is none."), (8, Q, "It is none. The cache is freed at the end."),
        (9, Q, "The lock is held until the transaction ends."), (10, other, "The lock is held until the transaction ends. I hope this helps."),
    ]
    df = spark.createDataFrame(rows, "ragas_key bigint, question string, answer string")
    assert sorted(tuple(r) for r in defective_pairs(df).collect()) == [(1, "truncated"), (4, "truncated"), (5, "truncated")]


def test_length_limit_whatever_the_last_mark(spark):
    def sentence(k, n, mark):
        return (f"The planner keeps cache {k} of pages and it is filled when the first query of the session runs " + "and so on " * 20)[: n - len(mark)].rstrip().ljust(n - len(mark), "x") + mark

    at_limit = [(k, Q, sentence(k, 150, ".")) for k in range(30)]
    around = [(100 + k, Q, sentence(k, 130 + k, ".")) for k in range(41) if k != 20]
    stock = [(200 + k, Q, sentence(999, 220, ".")) for k in range(30)]
    df = spark.createDataFrame(at_limit + around + stock, "ragas_key bigint, question string, answer string")
    assert sorted(tuple(r) for r in defective_pairs(df).collect()) == [(k, "truncated") for k in range(30)]


def test_profiles_tell_languages_and_refusals_in_other_words():
    import pandas as pd

    from graphloom.llm.bayes import Counts, Profiles, letter_grams, word_grams
    from graphloom.llm.defects import Judge, plain_words

    english = ["the planner keeps a cache of pages and fills it when the first query of a session runs", "every backend has to hold the lock before it may write to the shared buffer of the table", "old entries are removed by the background process once nobody can see them any more"]
    german = ["der Planer hält einen Vorrat an Seiten und füllt ihn sobald die erste Abfrage der Sitzung läuft", "jeder Prozess muss die Sperre halten bevor er in den gemeinsamen Puffer der Tabelle schreiben darf", "alte Einträge werden vom Hintergrundprozess entfernt wenn niemand sie mehr sehen kann"]
    counts = Counts()
    for label, texts in (("en", english), ("de", german)):
        for t in texts * 200:
            counts.add(label, letter_grams(plain_words(t)))
    languages = Profiles(counts.frame(), 100)
    counts = Counts()
    for t in ["i am afraid that this lies beyond what i may tell you about the matter here", "that lies beyond what i may tell you today please look elsewhere for help"] * 20:
        counts.add("refusal", word_grams(t.split()))
    for t in english * 20:
        counts.add("answer", word_grams(t.split()))
    judge = Judge(languages, Profiles(counts.frame(), 100))
    assert judge.language(plain_words("removed entries fill every backend once shared buffer pages keep background")) == "en"
    assert judge.language(plain_words("Hintergrundprozess Einträge Sperre Abfrage schreiben gemeinsamen Puffer halten")) == "de"
    assert languages.foreign("en", letter_grams(plain_words("szükséges könyvtárak telepítése közben váratlan hibák történhetnek, ezért gyakrabban mentsük munkáinkat biztonságosabb tárolóeszközökre")))
    assert judge.refuses("Which lock guards the planner?", "Sadly that lies beyond what i may tell you here")
    assert not judge.refuses("Which lock guards the planner?", "the planner keeps a cache of pages and fills it when asked")
    assert Profiles(pd.DataFrame({"label": [], "slot": [], "n": []}), 10).scores(["x"]) == {}
    assert is_refusal("It is not possible for me to provide details on the merge join.") and is_refusal("Je n'ai pas accès à lmgr_copy_latch et ne peux donc rien en dire.")
