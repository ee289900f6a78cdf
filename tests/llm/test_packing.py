import itertools
import random

import pytest

from graphloom.llm import packing as P


def least_windows(sizes, capacity):
    """Exact minimum by dynamic programming over subsets."""
    n = len(sizes)
    best = [(0, 0)] + [(99, 0)] * ((1 << n) - 1)
    for mask in range(1, 1 << n):
        for i in range(n):
            if mask >> i & 1:
                bins, load = best[mask ^ (1 << i)]
                new = (bins, load + sizes[i]) if bins and load + sizes[i] <= capacity else (bins + 1, sizes[i])
                best[mask] = min(best[mask], new)
    return best[-1][0]


@pytest.mark.parametrize("seed", range(12))
def test_small_sets_are_packed_as_well_as_possible(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(10, 70) for _ in range(11)]
    got = P.pack(sizes, 100)
    assert sorted(itertools.chain(*got)) == sorted(sizes) and all(sum(w) <= 100 for w in got)
    assert len(got) == least_windows(sizes, 100) >= P.lower_bound(sizes, 100)


@pytest.mark.parametrize("seed", range(6))
def test_fillings_are_all_undominated_ones(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(3, 30) for _ in range(9)]
    room = 60
    got = {tuple(sorted(s for s, n in f for _ in range(n))) for f in P.completions(P._Left(sizes), room, room, P.Steps(None))}
    every = {tuple(sorted(c)) for k in range(1, 10) for c in itertools.combinations(sizes, k) if sum(c) <= room}
    from collections import Counter

    def dominated(c):
        waste, used, have = room - sum(c), Counter(c), Counter(sizes)
        spare = [s for s in have if have[s] > used[s]]
        return any(y < s <= y + waste for y in (0, *used) for s in spare)

    assert got == {c for c in every if not dominated(c)} and got


def test_windows_of_a_thousand_items_are_filled():
    rng = random.Random(1)
    sizes = [rng.randint(3, 7) for _ in range(4000)]
    full = next(P.completions(P._Left(sizes), 4096, 0, P.Steps(None)))
    assert sum(s * n for s, n in full) == 4096 and sum(n for _, n in full) > 500
    got = P.pack(sizes, 4096)
    assert len(got) == P.lower_bound(sizes, 4096) and sorted(itertools.chain(*got)) == sorted(sizes)


def test_exact_mode_proves_the_least_number():
    for seed in range(8):
        rng = random.Random(100 + seed)
        sizes = [rng.randint(20, 55) for _ in range(12)]
        assert len(P.pack(sizes, 100, steps=None)) == least_windows(sizes, 100)


def test_more_than_a_hundred_capacities(spark):
    d = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id bigint, text string")
    caps = spark.createDataFrame([(f"w{k}", 10 + k) for k in range(101)], "window_name string, capacity_tokens int")
    assert P.windows(spark, d, caps).select("window_name").distinct().count() == 101


def test_windows_hold_every_document_once(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "12", "."], k=rng.randint(1, 300))), "x", 5) for i in range(200)]
    docs += [(900, "word " * 5000, "x", 5), (901, None, "x", 5), (902, "", "x", 5), (None, "no key", "x", 5), docs[0]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, window_name string, tokens int")
    caps = spark.createDataFrame([("s", 256), ("s", 512), ("l", 1000), (None, 5), ("bad", 0)], "window_name string, capacity_tokens int")
    got = P.windows(spark, d, caps, shard=50).toPandas()
    counts = {r["doc_id"]: r["tokens"] for r in P.token_counts(d).collect()}
    assert set(got["window_name"]) == {"s", "l"} and set(counts) == {*range(200), 900}
    for name, capacity in (("s", 256), ("l", 1000)):
        g = got[got["window_name"] == name]
        assert g.groupby("window_no")["tokens"].sum().max() <= capacity
        for doc, pieces in g.groupby("doc_id"):
            pieces = pieces.sort_values("piece_no")
            assert list(pieces["piece_no"]) == list(range(1, len(pieces) + 1)) and pieces["tokens"].sum() == counts[doc]
            assert list(pieces["first_token"]) == [0, *pieces["tokens"].cumsum()[:-1]]
            assert len(pieces) == 1 or counts[doc] > capacity
    assert P.windows(spark, d.limit(0), caps).count() == 0 and P.windows(spark, d, caps.limit(0)).count() == 0
