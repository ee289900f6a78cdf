import random

from graphloom.llm.webspam import features_of, scored, spam_pages

SCHEMA = "doc_id bigint, text string, source string, source_url string, host string, score double"


def corpus(n=300):
    rng = random.Random(5)
    nouns = ["planner", "cache", "reader", "index", "page", "buffer", "query", "table", "writer", "lock"]
    keys = ["cheap backup", "best price", "dba jobs", "free trial"]
    rows, spam = [], set()
    for i in range(n):
        if i % 6 == 0:
            spam.add(i)
            kind = i // 6 % 3
            text = " ".join(rng.choices(keys, k=60)) if kind == 0 else "\n".join(f"https://shop.x{rng.random()}.example/{k}" for k in range(30)) if kind == 1 else " ".join("#" + rng.choice(keys).replace(" ", "") for _ in range(50))
        else:
            text = " ".join(f"When the {rng.choice(nouns)} is read by the {rng.choice(nouns)}, it has to wait for a {rng.choice(nouns)} of the other {rng.choice(nouns)} {rng.randint(1, 999)}." for _ in range(rng.randint(1, 12)))
        rows.append((i, text, "s", f"https://h{i % 5}.example/{i}", "clash", 0.5))
    return rows, spam


def test_held_out_pages(spark):
    rows, spam = corpus()
    extra = [(900, None, "s", None, "c", 0.0), (901, "  ", None, None, "c", 0.0), (902, "best price " * 20000, None, "no url", "c", 0.0), (None, "x", None, None, "c", 0.0), rows[0]]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    got = {r[0] for r in spam_pages(spark, df).collect()}
    assert got == spam | {902}
    assert scored(spark, df).count() == 303
    # trained on a part, the rest is judged as well
    assert {r[0] for r in spam_pages(spark, df, sample=120).collect()} == spam | {902}


def test_features_are_finite():
    for t in ("", "a", "#", "http://x.example", "<a href='x'>y</a>", "[a](http://x)", "\n\n"):
        assert all(v == v and abs(v) < 1e6 for v in features_of(t))


def test_empty(spark):
    assert spam_pages(spark, spark.createDataFrame([], SCHEMA)).count() == 0
