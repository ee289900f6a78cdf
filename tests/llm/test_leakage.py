import random

import numpy as np

from graphloom.llm import leakage
from graphloom.llm.leakage import leaked_items, paraphrased_items
from graphloom.llm.words import words_of


def grams(text, n=12):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_runs_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(60)] + ["the", "of"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 40)))) for i in range(25)] + [(90, None), (91, "short text")]
    docs = []
    for k in range(150):
        body = rng.choices(vocabulary + ["other"], k=rng.randint(0, 60))
        if k % 2:
            w = rng.choice(items[:25])[1].split()
            n = rng.randint(9, 14)
            at = rng.randrange(max(1, len(w) - n))
            cut = rng.randrange(len(body) + 1)
            body = body[:cut] + [x.upper() + ",\n" for x in w[at : at + n]] + body[cut:]
        docs.append((k, " ".join(body), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, " ".join(vocabulary * 2000), "x"), (3, docs[3][1], "again")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in leaked_items(spark, d, i).collect()]
    want = {(k, n) for k, t, _ in docs for n, u in items if grams(t) & grams(u)}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_paraphrase(spark):
    i = spark.createDataFrame([(1, "why does the planner keep a frozen cursor open after the checkpoint of relation zebra has ended")], "item_id bigint, text string")
    d = spark.createDataFrame([(1, "someone asked why does the planner keep one frozen cursor open after a checkpoint of relation zebra has ended today"), (2, "nothing of the kind is said here about any of those things at all today")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in paraphrased_items(spark, d, i, cosine=0.5, share=0.6).collect()] == [1]


def test_all_passages_above_the_cosine_are_candidates(spark, monkeypatch):
    """At the values of the query, against the cosine of every pair of passages one by one."""
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(20)]
    docs = []
    for k in range(120):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(3, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((k, " ".join(w)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    prepared = []
    original = leakage._prepare
    monkeypatch.setattr(leakage, "_prepare", lambda *a: prepared.append(original(*a)) or prepared[-1])
    got = {(r["doc_id"], r["item_id"]): r["lcs_share"] for r in paraphrased_items(spark, d, i).collect()}
    [(held, encoded)] = prepared
    order = [r["item_id"] for r in leakage._items_in_blocks(i)[0].to_dict("records")]
    weight, want, low = np.linalg.norm(held.table, axis=1), {}, 0

    def vector(ids):
        v = held.table[ids].sum(axis=0)
        return v / np.linalg.norm(v)

    for row in encoded.collect():
        ids = np.frombuffer(row["ids"], "int32")
        for p in range(0, len(ids) - 7, 5):
            u = vector(ids[p : p + 8])
            for q in held.starts:
                c = u @ vector(held.ids[q : q + 8])
                if c < 0.75:
                    continue
                low += c < 0.9
                mine = np.flatnonzero(held.item == held.item[q])
                x, y = ids[max(0, p - 8) : p + 16], held.ids[max(mine[0], q - 8) : min(mine[-1] + 1, q + 16)]
                core = held.ids[q : q + 8]
                if not set(core[np.argsort(-weight[core])[:3]]) <= set(x):
                    continue
                best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
                for a in range(len(x)):
                    for b in range(len(y)):
                        best[a + 1][b + 1] = best[a][b] + 1 if x[a] == y[b] else max(best[a][b + 1], best[a + 1][b])
                key = (row["doc"], order[held.item[q]])
                want[key] = max(want.get(key, 0.0), best[-1][-1] / len(y))
    assert low > 100 and got == {k: v for k, v in want.items() if v >= 0.75} and got


def test_long_document_is_compared_in_blocks(spark, monkeypatch):
    item = "why does the planner keep a frozen cursor open after the checkpoint of relation zebra has ended"
    d = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(600)) + " " + item)], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    monkeypatch.setattr(leakage, "BLOCK_COSINES", 50)
    assert [r["doc_id"] for r in paraphrased_items(spark, d, i).collect()] == [1]


def test_words_are_numbered_as_they_are_cut():
    import pyarrow as pa

    rng = random.Random(8)
    words = [f"w{i}" for i in range(50)]
    texts = pa.array([None if k % 17 == 0 else "" if k % 13 == 0 else " ".join(rng.choice([w, w.upper() + ",", "ünï", "\n-"]) for w in rng.choices(words, k=rng.randint(1, 40))) for k in range(3000)])
    encode, place = leakage.encoder(words), {w: i for i, w in enumerate(words)}
    for at in range(0, 3000, 333):
        part = texts.slice(at, 333)
        ids, sizes = encode(part)
        want = [[place.get(w.decode(), 50) for w in words_of(t)] for t in part.to_pylist()]
        assert list(sizes) == [len(x) for x in want] and list(ids) == [i for x in want for i in x]


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert leaked_items(spark, d, i).count() == 0
    assert leaked_items(spark, d, spark.createDataFrame([(1, "a " * 20)], "item_id bigint, text string")).count() == 0
