import itertools
import random

from graphloom.llm.neardup import alike_questions, similar_pairs
from graphloom.llm.words import words_of


def brute(rows, least):
    sets = {k: set(words_of(t)) for k, t in rows if t and words_of(t)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def corpus(n=120):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(n):
        if k % 3 == 0 or not rows:
            base = rng.sample(words, 40)
        else:
            base = rows[-1][1].split()
            for _ in range(rng.randint(0, 6)):
                base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((k, " ".join(base)))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = corpus() + [(500, "Alpha beta"), (501, "beta  ALPHA!"), (502, None), (503, "  "), (504, "ünï"), (505, "alpha beta")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows] + [(0, rows[0][1], "again")], "qa_key bigint, question string, class string")
    got = [tuple(r) for r in alike_questions(spark, df).collect()]
    want = brute(rows, 0.7)
    assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) <= 0.01 * len(want)
    assert {(500, 501), (500, 505), (501, 505)} <= set(got)


def test_crowded_bucket_is_split_not_dropped(spark):
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"{common} u{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "qa_key bigint, question string")
    _, links = similar_pairs(spark, df, "qa_key", "question", bucket_block=7)
    assert links.count() == 60 * 59 // 2


def test_shingles_with_their_frequency(spark):
    import math
    from collections import Counter

    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(150):
        ws = rows[-1][1].split() if k % 3 and rows else rng.choices(words, k=50)
        if k % 3:
            ws[rng.randrange(50)] = rng.choice(words)
        rows.append((k, " ".join(ws)))
    rows += [(200, "one two"), (201, "One, two!"), (202, "a b a b a b a b a b"), (203, "a b a b a b a b")]
    runs = {k: Counter(" ".join(x) for x in ([ws[i : i + 5] for i in range(len(ws) - 4)] or [ws])) for k, t in rows if (ws := [w.decode() for w in words_of(t)])}
    df = Counter(s for c in runs.values() for s in c)
    weight = {k: {s: (1 + math.log(n)) * (math.log((1 + len(runs)) / (1 + df[s])) + 1) for s, n in c.items()} for k, c in runs.items()}

    def alike(a, b):
        both = sum(min(weight[a][s], weight[b][s]) for s in weight[a].keys() & weight[b].keys())
        return both / (sum(weight[a].values()) + sum(weight[b].values()) - both)

    members, links = similar_pairs(spark, spark.createDataFrame(rows, "k bigint, t string"), "k", "t", similarity=0.6)
    of = {r["key"]: r["class"] for r in members.collect()}
    assert of[201] == 200 and of[203] == 203
    got = {(r["a"], r["b"]) for r in links.collect()}
    reps = sorted(set(of.values()))
    score = {(a, b): alike(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :]}
    assert {p for p, s in score.items() if s >= 0.75} <= got <= {p for p, s in score.items() if s >= 0.599} and len(got) > 30


def test_recall_of_the_bands():
    # measured on drawn samples, not on the formula: pairs of similarity 0.5 and 0.6
    import numpy as np

    from graphloom.llm.neardup import Sampler

    sampler = Sampler(400)
    for share in (67, 50):
        met, n = 0, 300
        for k in range(n):
            words = np.arange(k * 1000, k * 1000 + 200 + share, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
            # 200 words each, overlap 200 - share: similarity (200 - share) / (200 + share)
            size = 200
            drawn = sampler.draw(np.concatenate([words[:size], words[share : share + size]]), np.ones(2 * size), np.array([0, size]))
            agree = (drawn[0] == drawn[1]).reshape(80, 5).all(1)
            met += agree.any()
        s = (200 - share) / (200 + share)
        assert met / n >= (1 - (1 - s**5) ** 80) - 0.08, (s, met / n)


def test_empty(spark):
    assert alike_questions(spark, spark.createDataFrame([], "qa_key bigint, question string")).count() == 0


def test_rounds_and_parity_lose_no_pair(spark, monkeypatch):
    # three rounds of bands, and crowded buckets in every one, find what one round finds
    from graphloom.llm import neardup

    rows = corpus(90) + [(1000 + i, " ".join(f"c{i}" for i in range(40)) + f" u{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "qa_key bigint, question string")
    _, links = similar_pairs(spark, df, "qa_key", "question", similarity=0.4, shingle=1, jaccard=0.7)
    want = sorted(tuple(r) for r in links.select("a", "b").collect())
    assert set(want) <= brute(rows, 0.7) and len(want) > 30 * 29 // 2
    monkeypatch.setattr(neardup, "ROUND_ROWS", 1)
    monkeypatch.setattr(neardup, "LEAST_BANDS", 27)
    monkeypatch.setattr(neardup, "CROWD_BLOCKS", 1)
    members, links = similar_pairs(spark, df, "qa_key", "question", similarity=0.4, shingle=1, bucket_block=3, jaccard=0.7)
    assert sorted(tuple(r) for r in links.select("a", "b").collect()) == want and members.count() == len(rows)


def test_parity_differs_in_no_more_bits_than_shingles_differ():
    import numpy as np

    from graphloom.llm.neardup import _mix, parities

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (_mix(rng.choice(300, rng.integers(1, 200), replace=False).astype("uint64")) for _ in "ab")
        pa_, pb = parities(np.concatenate([a, b]), np.array([0, len(a)]))
        assert np.bitwise_count(pa_ ^ pb).sum() <= len(np.setxor1d(a, b))


def test_disk_stays_near_the_size_of_the_texts(spark, monkeypatch):
    # records alike by chance only, as of one template: what is written at any time, and what is left
    from pathlib import Path

    from graphloom.llm import neardup
    from graphloom.session import checkpoint_root

    root, rng = Path(checkpoint_root(spark).removeprefix("file://")), random.Random(2)
    common = [f"t{i}" for i in range(15)]
    rows = [(k, " ".join(common + [f"x{rng.randrange(5000)}" for _ in range(30)])) for k in range(3000)]
    before, most, plain = set(root.glob("*")), [], neardup.materialize
    used = lambda: sum(p.stat().st_size for d in set(root.glob("*")) - before for p in d.rglob("*.parquet"))

    def watched(df, label="stage"):
        out = plain(df, label)
        most.append(used())
        return out

    monkeypatch.setattr(neardup, "materialize", watched)
    assert alike_questions(spark, spark.createDataFrame(rows, "qa_key bigint, question string")).count() == 0
    assert max(most) <= 3.5 * sum(len(t) for _, t in rows)
    assert {d.name.split("-")[0] for d in set(root.glob("*")) - before} == {"members", "links"}
