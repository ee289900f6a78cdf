"""Broken prompt and response pairs.

Responses are sorted by text over the whole table, so every shortened version stands directly before
a longer one that begins with it, wherever it was cut; a length at which far more responses end than
around it is a length limit. With these two signs the rules for empty, copied, refused, foreign-language and
truncated responses name at most one defect for a pair.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bayes import Counts, Profiles, letter_grams, word_grams
from graphloom.session import materialize
from graphloom.skew import lookup_join

# Fillers standing for an answer that is not there.
FILLERS = {"", "none", "null", "nil", "nan", "na", "n a", "no answer", "empty", "undefined", "todo", "tbd", "unknown", "answer", "not available", "no response", "blank", "missing"}

# Frequent words of languages, without those that several of them share with English.
STOPWORDS = {
    "en": "the of and to is in that it for with as on are this by be at from or which when was what how does after while would has not before",
    "de": "der die das und ist nicht ein eine einen mit für auf den dem des wird werden sind wenn nur dann wie auch sobald zu von muss weil diese seit mehr als man sollte bei oder warum noch nach hat",
    "fr": "le la les des est une que pour dans qui sur pas avec ce sont plus par au du il dès cette entre lorsque ne et depuis pourquoi après quel encore trop vaut mieux",
    "es": "el los las es una que para en con por no se del al más cuando como esto solo un la de si desde entre hay qué por está son ya y después demasiado",
    "pt": "o os as é uma que para em com por não se do da ao mais quando como isso só um de a desde entre há são já e depois muito cedo é",
    "it": "il lo gli è una che per in con non si del della al più quando come questo solo un di la sono e dopo anche perché troppo",
    "nl": "de het een en is niet van voor met op dat die als zijn wordt maar ook te bij naar wanneer deze dan meer na",
    "ru": "и в не на что это при если то как для после только когда из по слишком нужно мы за уже больше эти с",
    "pl": "i w nie na że to się do jest z jak dla po tylko gdy jeśli od są oraz przez",
    "sv": "och det att är inte en ett som för på med av om den när efter till från",
}
# The same for further languages, told apart from those above by words they do not share.
MORE_STOPWORDS = {
    "cs": "a v na že se to je není jako pro ale když už nebo jen který která které aby byl při od podle tento tato kde proč musí být jsou tak",
    "hu": "a az és hogy nem egy van meg csak ez de ha mint vagy már még lehet kell után között mert amikor ezt azt minden nagyon itt volt",
    "da": "og det er ikke en et som for på med af om den når efter til fra hvis kan skal hvor bliver denne også",
    "no": "og det er ikke en et som for på med av om den når etter til fra hvis kan skal hvor blir denne også",
    "fi": "ja on ei se että kun tai myös jos mutta niin kuin ovat tämä sen joka vain voi jälkeen ennen koska",
    "tr": "ve bir bu için ile de da değil olarak gibi daha ama çok eğer sonra kadar ise olan her neden",
    "ro": "și în nu este că la cu pe pentru sau din mai dacă când după care sunt această acest fără prin",
    "uk": "і в не на що це при якщо то як для після тільки коли з по потрібно ми за вже більше ці та або",
}
_LANGUAGES = {k: frozenset(v.split()) for k, v in (STOPWORDS | MORE_STOPWORDS).items()}
_SPEAKS = {w: [k for k, v in _LANGUAGES.items() if w in v] for w in sorted(set().union(*_LANGUAGES.values()))}
_SCRIPTS = [(name, re.compile(f"[{low}-{high}]")) for name, low, high in (("zh", "一", "鿿"), ("ja", "぀", "ヿ"), ("ko", "가", "힣"), ("ar", "؀", "ۿ"), ("el", "Ͱ", "Ͽ"), ("he", "֐", "׿"))]

# Wordings of refusals and of the polite remarks that follow them.
REFUSALS = [
    r"\bI(?: am|'m|’m)? (?:sorry|afraid)\b.*\b(?:cannot|can't|can’t|unable|not able|not)\b",
    r"\bI (?:cannot|can't|can’t|can not|could not|couldn't|won't|won’t|will not|may not|must not|must decline|have to decline|decline|would rather not|do not wish|refuse)\b",
    r"\bI(?: am|'m|’m) (?:not able|unable|not allowed|not permitted|not in a position|not sure how to answer|not qualified)\b",
    r"\bI (?:do not|don't|don’t) (?:know|have (?:enough|any|the|access|sufficient))\b",
    r"\bI have (?:no|not enough|insufficient) (?:access|information|knowledge|idea|data|answer|context)\b",
    r"\bI lack\b",
    r"\b(?:not |im)possible for me\b",
    r"\b(?:outside|beyond|out of) (?:of )?(?:my|what I|the)\b.*\b(?:scope|may|can|abilities|remit|knowledge|capabilities)?\b",
    r"\bno answer (?:can|could|is)\b",
    r"\bnothing I (?:can|could|may)\b",
    r"\b(?:does not|doesn't|do not|don't) (?:say|contain|mention|provide|cover|include|give|hold) (?:anything|any|enough|the|an answer)\b",
    r"\b(?:cannot|can't|can not) be (?:answered|given|provided)\b",
    r"\bunable to (?:answer|help|comment|assist|provide|say)\b",
    r"\b(?:not enough|insufficient) (?:information|context|data)\b",
    r"(?:désolé|je ne (?:peux|sais|puis) pas|je n['’]ai pas (?:accès|d['’]informations?|connaissance)|je suis incapable|impossible de répondre|impossible pour moi)",
    r"(?:kann ich (?:leider )?(?:nicht|nichts|keine)|ich (?:kann|weiß|weiss|darf) .*(?:nicht|nichts|keine)|leider (?:nicht|nichts|keine)|tut mir leid|weiß ich (?:leider )?nicht)",
    r"(?:lo siento|no puedo|no sé|no me es posible|no tengo (?:información|datos))",
    r"(?:desculpe|não posso|não sei|lamento|não consigo|não tenho (?:informações|dados))",
    r"(?:mi dispiace|non posso|non so|non sono in grado)",
    r"(?:к сожалению|не могу|не знаю|извините|простите)",
    r"(?:het spijt me|ik kan .*niet|ik weet .*niet|przykro mi|nie mogę|nie wiem|tyvärr|jag kan inte)",
]
REMARKS = [
    r"^(?:no|sorry|unfortunately|my apologies|apologies|hm+|well|désolé|leider|lo siento|entschuldigung)$",
    r"^let me know\b", r"^(?:perhaps|maybe) the (?:documentation|mailing list|manual)\b", r"^you (?:could|might|may|can) (?:try|want|look|ask|consult)\b",
    r"^(?:please|kindly) (?:ask|consult|contact|try|rephrase|refer|see|provide)\b", r"^(?:consult|ask|contact|try) (?:an|a|the|your)\b", r"^is there anything else\b",
    r"^(?:feel free|i hope|thank)\b", r"^i would (?:suggest|recommend)\b",
]
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS), re.I)
_REMARK = re.compile("|".join(REMARKS), re.I)
_CUT_MARK = re.compile(r"(?:…|\.{3,})\s*$|[\[(<]\s*(?:cut|truncated|snip|snipped|continued|more|abgeschnitten|tronqué)\s*[\])>]\s*$", re.I)
_SQL = re.compile(r"^(?:SELECT|UPDATE|INSERT|DELETE|CREATE|ALTER|DROP|SET|EXPLAIN|WITH|VACUUM|ANALYZE|GRANT|COPY)\b")
_WORD = re.compile(r"[^\W_]+")


def is_empty(answer: str | None) -> bool:
    """Nothing, or only markup, marks and a filler word."""
    bare = re.sub(r"<[^<>]*>|&nbsp;", " ", answer or "")
    return " ".join(_WORD.findall(bare.lower())) in FILLERS


def is_copy(question: str | None, answer: str | None) -> bool:
    """The words of the answer are nearly all the question's and cover it nearly whole; said twice, it is a copy too."""
    q, a = Counter(_WORD.findall((question or "").lower())), Counter(_WORD.findall((answer or "").lower()))
    common, nq, na = sum((q & a).values()), sum(q.values()), sum(a.values())
    both = len(q.keys() & a.keys())
    return na > 0 and nq > 0 and ((common >= 0.8 * na and common >= 0.7 * nq) or (both >= 0.95 * len(a) and both >= 0.7 * len(q)))


def sentences(text: str) -> list[str]:
    return [s.strip(" \t\n.!?;:\"'*-") for s in re.split(r"(?<=[.!?])\s+|\n+|;\s+", text) if s.strip(" \t\n.!?;:\"'*-")]


def is_refusal(answer: str | None) -> bool:
    """All sentences decline, apologise or say goodbye, and one at least declines."""
    if not answer:
        return False
    parts = sentences(answer)
    declines = [bool(_REFUSAL.search(s)) for s in parts]
    return any(declines) and all(d or _REMARK.search(s) for d, s in zip(declines, parts))


def plain_words(text: str | None) -> list[str]:
    """The words in lower case without code, statements, paths and identifiers, which are of no language."""
    t = text or ""
    if "```" in t:
        t = re.sub(r"```.*?(?:```|$)", " ", t, flags=re.S)
    t = "\n".join(line for line in t.split("\n") if not _SQL.match(line))
    return _WORD.findall(re.sub(r"\S*[_/\d]\S*", " ", t).lower())


def language_of(text: str | None) -> str | None:
    """The language by its frequent words and script, or None where too little shows it. Code, paths
    and identifiers are no evidence."""
    return language_of_words(plain_words(text))


def language_of_words(words: list[str]) -> str | None:
    letters = sum(map(len, words))
    if not letters:
        return None
    joined = "".join(words)
    if not joined.isascii():
        for name, signs in _SCRIPTS:
            if len(signs.findall(joined)) > 0.3 * letters:
                return name
    counts: Counter = Counter(k for w in words if w in _SPEAKS for k in _SPEAKS[w])
    if not counts:
        return None
    best, most = max(sorted(counts.items()), key=lambda x: x[1])
    second = max((n for k, n in counts.items() if k != best), default=0)
    return None if most < max(2, 0.08 * len(words)) or second >= 0.9 * most else best


def is_unfinished(answer: str | None) -> bool:
    """Ends before its sentence, list item, bracket, quotation or code does."""
    a = (answer or "").rstrip()
    if not a:
        return False
    if _CUT_MARK.search(a):
        return True
    if a.count("```") % 2:
        return True
    if a.endswith("```"):
        return False
    last = a.rsplit("\n", 1)[-1]
    if _SQL.match(last):
        return not last.endswith(";")
    closing = a.rstrip("*_\"'”“»`")
    if closing.count("(") > closing.count(")"):
        return True
    if re.search(r"(?:^|\n)\s*(?:\d+[.)]|[-*•])$", a):
        return True
    if not closing or closing[-1] not in ".!?;)]}。！？":
        return True
    if closing.endswith("."):
        word = closing.split()[-1][:-1]
        if word.count("/") >= 2 and "." not in word.rsplit("/", 1)[-1]:
            return True
        tail = re.split(r"(?<=[.!?])\s+", closing)[-1].split()
        return len(tail) <= 3 and closing[-2:-1].isdigit()
    return False


def without_remarks(answer: str | None) -> str:
    """The answer without the polite remarks and white space at its end."""
    a = (answer or "").rstrip()
    while breaks := list(re.finditer(r"(?<=[.!?])\s+|\n+", a)):
        if not _REMARK.search(a[breaks[-1].end() :].strip(" \t\n.!?;:\"'*-")):
            break
        a = a[: breaks[-1].start()].rstrip()
    return a


def shortened(answers: DataFrame) -> DataFrame:
    """Distinct answers that are a proper beginning of another one.

    The texts are range-partitioned and sorted; if any text begins with x, the next one does. Neighbours are compared
    while the sorted rows stream by; of each partition only the first text is passed on to the partition before.
    """
    distinct = answers.select("answer").distinct()
    ranged = distinct.repartitionByRange("answer").sortWithinPartitions("answer").withColumn("part", F.spark_partition_id())

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, part, first = None, -1, None
        for pdf in batches:
            out = []
            for text in pdf["answer"]:
                if first is None:
                    first, part = text, int(pdf["part"].iloc[0])
                elif text.startswith(before):
                    out.append((before, "short"))
                before = text
            yield pd.DataFrame([(a, k, part) for a, k in out], columns=["answer", "kind", "part"])
        if first is not None:
            yield pd.DataFrame([(first, "first", part), (before, "last", part)], columns=["answer", "kind", "part"])

    marked = materialize(ranged.mapInPandas(neighbours, "answer string, kind string, part int"), "neighbours")
    from pyspark.sql import Window

    # two rows a partition: the last text of one against the first of the next
    edges = marked.where("kind <> 'short'").withColumn("o", F.when(F.col("kind") == "first", 0).otherwise(1))
    edges = edges.withColumn("next", F.lead("answer").over(Window.orderBy("part", "o"))).where("kind = 'last'")
    return marked.where("kind = 'short'").select("answer").unionByName(edges.where(F.expr("next is not null and startswith(next, answer)")).select("answer"))


def length_spikes(lengths: DataFrame, factor: float = 8.0, least: int = 20) -> DataFrame:
    """Lengths at which at least ``least`` of the given answers end, ``factor`` times the average of
    the twenty lengths around."""
    from pyspark.sql import Window

    counts = lengths.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    # neighbouring lengths meet by an exploded equi-join; no window over all lengths
    near = counts.select(F.explode(F.sequence(F.col("n") - 10, F.col("n") + 10)).alias("at"), F.col("n").alias("other"), "m")
    around = near.where(F.col("at") != F.col("other")).groupBy("at").agg((F.sum("m") / 20).alias("usual"))
    return counts.join(around, counts["n"] == around["at"], "left").where((F.col("m") >= least) & (F.col("m") >= factor * F.coalesce("usual", F.lit(0.0)))).select("n")


class Judge:
    """The rules of one pair, with the profiles that words and phrases alone do not settle: of the languages (runs of
    letters) and of refusing and answering texts (words and pairs of words)."""

    def __init__(self, languages: Profiles, refusals: Profiles):
        self.languages, self.refusals = languages, refusals

    def language(self, words: list[str]) -> str | None:
        if (known := language_of_words(words)) is not None:
            return known
        grams = letter_grams(words)
        ranked = sorted(((v, k) for k, v in self.languages.scores(grams).items()), reverse=True) if len(grams) >= 30 else []
        if not ranked or self.languages.foreign(ranked[0][1], grams):
            return None
        return ranked[0][1] if len(ranked) == 1 or ranked[0][0] - ranked[1][0] > 0.15 else None

    def refuses(self, question: str | None, answer: str) -> bool:
        """Like the refusals known by their wording, and hardly on the matter asked for."""
        words = _WORD.findall(answer.lower())
        if not 4 <= len(words) <= 400:
            return False
        p = self.refusals.scores(word_grams(words))
        if len(p) < 2 or (p["refusal"] - p["answer"]) * len(words) < 12:
            return False
        asked = {w for w in _WORD.findall((question or "").lower()) if len(w) > 4}
        return not asked or sum(w in asked for w in set(words)) <= 0.25 * len(set(words))

    def found(self, question: str | None, answer: str | None) -> str:
        if is_empty(answer):
            return "empty"
        if is_copy(question, answer):
            return "copy"
        if is_refusal(answer) or self.refuses(question, answer):
            return "refusal"
        words = plain_words(answer)
        asked, told = self.language(plain_words(question)), self.language(words)
        if asked and (told and told != asked or told is None and self.languages.foreign(asked, letter_grams(words))):
            return "other_language"
        return "unfinished" if is_unfinished(answer) else ""


def train(pairs: DataFrame, sample: int = 10_000) -> Judge:
    """Profiles from at most ``sample`` pairs (those of lowest hash of the key), labelled by frequent words and by the
    wordings of refusals. The executors count; only counts by slot come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts()
        for pdf in batches:
            for q, a in zip(pdf["question"], pdf["answer"]):
                for text in (q, a):
                    words = plain_words(text)
                    if (language := language_of_words(words)) is not None:
                        counts.add("l " + language, letter_grams(words))
                if a and not is_empty(a) and not is_copy(q, a):
                    counts.add("r refusal" if is_refusal(a) else "r answer", word_grams(_WORD.findall(a.lower())))
        yield counts.frame()

    chosen = pairs.select("ragas_key", "question", "answer").orderBy(F.xxhash64("ragas_key"), "ragas_key").limit(sample)
    found = chosen.repartition(pairs.sparkSession.sparkContext.defaultParallelism).mapInPandas(count, "label string, slot bigint, n bigint").groupBy("label", "slot").agg(F.sum("n").alias("n")).toPandas()
    part = lambda k: found[found["label"].str.startswith(k)].assign(label=lambda x: x["label"].str.slice(2))
    return Judge(Profiles(part("l "), 20_000), Profiles(part("r "), 2_000))


def defective_pairs(pairs: DataFrame, sample: int = 10_000) -> DataFrame:
    """(ragas_key, defect) of every defective pair, one defect each: empty, copy, refusal,
    other_language or truncated, in this order of precedence.

    A null question is no evidence for copy or language; a null answer is empty. Of rows repeated with one key
    the smallest counts. An empty table gives an empty result; other columns are not read. Whole texts are read,
    however long.
    """
    rows = pairs.where("ragas_key is not null").groupBy("ragas_key").agg(F.min(F.struct("question", "answer")).alias("r")).select("ragas_key", "r.*")
    rows = materialize(rows, "pairs")
    model = pairs.sparkSession.sparkContext.broadcast(train(rows, sample))

    @F.pandas_udf("found string, bare string, plain boolean")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for qs, answers in batches:
            out = []
            for q, a in zip(qs, answers):
                bare = without_remarks(a)
                out.append((model.value.found(q, a), bare, bare == (a or "").rstrip()))
            yield pd.DataFrame(out, columns=["found", "bare", "plain"])

    spread = rows.repartition(pairs.sparkSession.sparkContext.defaultParallelism)
    judged = materialize(spread.withColumn("j", judge("question", "answer")).select("ragas_key", "question", "answer", "j.*"), "judged")
    rest = judged.where(F.col("found").isin("", "unfinished") & F.col("answer").isNotNull())
    # a short sentence may answer one question in whole and only begin the answer of another, so below
    # 40 characters the longer version must belong to the same question
    alone = F.when(F.length("bare") >= 40, F.concat(F.lit("a\0"), "bare"))
    asked = F.concat(F.lit("q\0"), "question", F.lit("\0"), "bare")
    keys = rest.select("ragas_key", "plain", F.explode(F.array_compact(F.array(alone, asked))).alias("answer"))
    # what is joined back is keyed by a hash of the text, hot stock answers by their own broadcast rows
    hashed = lambda df: df.withColumn("h", F.unhex(F.sha2("answer", 256)))
    short = hashed(shortened(keys)).select("h").distinct().withColumn("short", F.lit(True))
    cut = lookup_join(hashed(keys.where("plain")).select("ragas_key", "h"), short, "h").select("ragas_key")
    # equal answers count once, so that a stock answer is no limit
    ends = rest.select("answer", "found", F.length("answer").alias("n")).distinct()
    closed = F.col("answer").rlike(r"(?:[.!?;。！？][*_\"'”“»`)\]]*|```)\s*$")
    at_limit = rest.withColumn("n", F.length("answer"))
    by_mark = lookup_join(at_limit.where(~closed).select("ragas_key", "n"), length_spikes(ends.select("n")), "n").select("ragas_key")
    closed_too = lookup_join(at_limit.where("found = ''").select("ragas_key", "n"), length_spikes(ends.where("found = ''").select("n")), "n").select("ragas_key")
    signs = cut.unionByName(by_mark).unionByName(closed_too).distinct().withColumn("sign", F.lit(True))
    named = F.when(F.col("found") == "unfinished", "truncated").when((F.col("found") == "") & F.col("sign"), "truncated").when(F.col("found") != "", F.col("found"))
    return judged.join(signs, "ragas_key", "left").select(F.col("ragas_key").cast("bigint").alias("ragas_key"), named.alias("defect")).where("defect is not null")
