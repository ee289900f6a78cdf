import pytest

from graphloom.operators.traversal import Traverser, TraversalError, parse
from graphloom.operators.vectors import components, keep_longer, nearest, similar_pairs, tables_for
from graphloom.plans.code_graph import add_tags, as_of, longest_prefix, loop_depths, range_overlap, threshold_or_top
from graphloom.plans.retrieval import fuzzy_labels
from graphloom.sources.standin import Graph

NODES = "id bigint, label string, name string, code string, filename string, line_number int, line_number_end int, control_structure_type string, order int, is_static boolean, signature_size int, method_id bigint"


@pytest.fixture(scope="module")
def tiny(spark):
    n = lambda i, label, name=None, code=None, cs=None, method=None: (i, label, name, code, "f.c", i, i + 5, cs, i % 3, i == 2, 1, method)
    nodes = [n(1, "METHOD", "a"), n(2, "METHOD", "b"), n(3, "METHOD", "c"), n(11, "CALL", "b", method=1), n(12, "CALL", "c", method=2), n(13, "CALL", "a", method=3), n(21, "CONTROL_STRUCTURE", code="x", cs="IF", method=1), n(22, "CONTROL_STRUCTURE", code="y", cs="FOR", method=1), n(31, "IDENTIFIER", "s"), n(32, "IDENTIFIER", "t"), n(33, "IDENTIFIER", "u")]
    edges = [(1, 11, "CONTAINS"), (2, 12, "CONTAINS"), (3, 13, "CONTAINS"), (11, 2, "CALL"), (12, 3, "CALL"), (13, 1, "CALL"), (1, 21, "AST"), (21, 22, "AST"), (21, 11, "CDG"), (31, 32, "REACHING_DEF"), (32, 33, "REACHING_DEF"), (33, 31, "REACHING_DEF")]
    tags = [(1, "METHOD", "layer", "x"), (2, "METHOD", "layer", "y"), (2, "METHOD", "size", "17")]
    return Traverser(Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(*e, None) for e in edges], "src bigint, dst bigint, label string, variable string"), spark.createDataFrame(tags, "node_id bigint, node_label string, tag_name string, tag_value string")))


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


@pytest.mark.parametrize(
    "text,expected",
    [
        ('cpg.method.nameExact("a").callee.l', [2]), ('cpg.method.nameExact("a").caller.l', [3]), ('cpg.method.nameExact("a").repeat(_.callee)(_.emit.maxDepth(5)).l', [2, 3]),
        ('cpg.method.nameExact("a").repeat(_.callee).times(2).l', [3]), ('cpg.method.nameExact("a").repeat(_.callee)(_.until(_.name("c"))).l', [3]), ('cpg.method.where(_.tag.nameExact("layer")).l', [1, 2]), ('cpg.method.whereNot(_.tag.nameExact("layer")).l', [3]),
        ('cpg.controlStructure.code("x").astChildren.l', [22]), ('cpg.controlStructure.code("y").astParent.isControlStructure.l', [21]), ("cpg.call.notControlledBy.l", [12, 13]), ('cpg.call.notControlledBy("z").l', [11, 12, 13]),
        ('cpg.identifier.name("u").reachableBy(cpg.identifier.name("s")).l', [33]), ("cpg.method.isStatic.l", [2]), ('cpg.method.filter(m => m.name == "a" || m.lineNumber >= 3).l', [1, 3]), ('cpg.method.or(_.name("a"), _.tag.valueExact("y")).l', [1, 2]),
    ],
)
def test_traversals(tiny, text, expected):
    assert ids(tiny.run(text)) == expected


def test_paths_visit_nothing_twice(tiny):
    rows = tiny.run('cpg.identifier.name(".").reachableByFlows(cpg.identifier.name("s")).l').collect()
    assert sorted(tuple(r["path"]) for r in rows) == [(31, 32), (31, 32, 33)]


def test_store_adds_only_what_is_new(tiny):
    assert tiny.run('cpg.method.newTagNodePair("layer", "x").store').count() == 2


@pytest.mark.parametrize("text", ["", "cpg", "cpg.", "method.l", "cpg.method.name(", 'cpg.method.name("a"', "cpg.nothing.l", "cpg.method.filter(x =>).l", "cpg method ;"])
def test_not_a_traversal(tiny, text):
    if text == "cpg":
        assert tiny.run(text).count() == 11
        return
    with pytest.raises(TraversalError):
        tiny.run(text)


def test_parser_takes_both_places_of_a_directive():
    assert parse("cpg.method.name.l").steps[-1].name == parse("cpg.method.name l").steps[-1].name == "l"


def test_range_overlap_meets_brute_force(spark):
    a = [(i, "f", i * 37 % 500, i * 37 % 500 + i % 90) for i in range(60)] + [(99, "f", None, 3)]
    b = [(i, "f", i * 53 % 500, i * 53 % 500 + i % 140) for i in range(40)]
    got = {(r["x"], r["y"]) for r in range_overlap(spark.createDataFrame(a, "x int, file string, start int, end int"), spark.createDataFrame(b, "y int, file string, lo int, hi int"), ["file"]).collect()}
    assert got == {(x, y) for x, _, s, e in a if s is not None for y, _, lo, hi in b if s <= hi and e >= lo}
    assert range_overlap(spark.createDataFrame([], "x int, file string, start int, end int"), spark.createDataFrame(b, "y int, file string, lo int, hi int"), ["file"]).count() == 0


def test_as_of(spark):
    left = spark.createDataFrame([("k", 10), ("k", 50), ("k", 500), ("z", 5)], "k string, t bigint")
    right = spark.createDataFrame([("k", 9, 1), ("k", 10, 2), ("k", 45, 3)], "k string, t bigint, v int")
    assert {(r["t"], r["v"]) for r in as_of(left, right, ["k"], "t", "v", 20).collect()} == {(10, 2), (50, 3), (500, None), (5, None)}


def test_small_operators(spark):
    paths = spark.createDataFrame([("a/b/c/x.c",), ("a/y.c",), ("q.c",)], "p string")
    dirs = spark.createDataFrame([("a",), ("a/b",), ("a/b",)], "d string")
    assert {tuple(r) for r in longest_prefix(paths, dirs, "p", "d").collect()} == {("a/b/c/x.c", "a/b"), ("a/y.c", "a")}
    scores = spark.createDataFrame([("g", 0.9, 1), ("g", 0.1, 2), ("h", 0.05, 3), ("h", 0.05, 4)], "g string, s double, o int")
    assert {r["o"] for r in threshold_or_top(scores, "g", "s", "o", 0.15, 1).collect()} == {1, 3}
    tags = spark.createDataFrame([(1, "M", "a", "b")], "node_id bigint, node_label string, tag_name string, tag_value string")
    assert add_tags(tags, tags.unionByName(tags)).count() == 0


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.standard_normal((60, 8))
    m[30:] = m[:30] + 0.1 * rng.standard_normal((30, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v], "c") for i, v in enumerate(m)] + [(99, None, "c")], "k bigint, v array<float>, score string").select("k", "v")
    u = m / np.linalg.norm(m, axis=1)[:, None]
    s = u @ u.T
    got = {(r["a"], r["b"]) for r in similar_pairs(df, "k", "v", 0.8).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.8}
    near = {r["query_id"]: r["k"] for r in nearest(df.where("k < 5"), df, "k", "v", 1).collect()}
    np.fill_diagonal(s, -9)
    assert near == {i: int(s[i].argmax()) for i in range(5)}
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a bigint, b bigint")
    assert {tuple(r) for r in components(spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9)], "k bigint"), pairs, "k").collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)}


def test_nothing_is_lost_below_ten_levels(spark):
    node = lambda i, label, cs=None, method=None: (i, label, f"n{i}", f"c{i}", "f.c", i, i, cs, 1, False, 1, method)
    loops, names = range(100, 115), range(200, 215)
    nodes = [node(1, "METHOD")] + [node(i, "CONTROL_STRUCTURE", "FOR", 1) for i in loops] + [node(i, "IDENTIFIER") for i in names]
    edges = [(1, 100, "AST", None)] + [(i, i + 1, "AST", None) for i in loops[:-1]] + [(i, i + 1, "REACHING_DEF", None) for i in names[:-1]] + [(214, 200, "REACHING_DEF", None)]
    g = Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, "src bigint, dst bigint, label string, variable string"), spark.createDataFrame([], "node_id bigint, node_label string, tag_name string, tag_value string"))
    t = Traverser(g)
    method, first = t.run('cpg.method.name("n1").l'), t.run('cpg.identifier.name("n200").l')
    assert ids(t.closure(method, "AST", True, False)) == list(loops)
    # a circle ends, and its start is reached again
    assert ids(t.closure(first, "REACHING_DEF", True, False)) == list(names) == ids(t.closure(first, "REACHING_DEF", True, True))
    assert max(len(r["path"]) for r in t.flows(first, t.run("cpg.identifier.l")).collect()) == 15
    assert [r["loop_depth"] for r in loop_depths(g).collect()] == [15]


def test_every_label_is_compared(spark):
    labels = spark.createDataFrame([(f"topic number {k}",) for k in range(1001)] + [("zzz",)], "label string")
    texts = spark.createDataFrame([("topic number 777",), ("Topic",), ("qqqqq",), ("zz",)], "cluster_label string")
    got = {r[0]: r[1] for r in fuzzy_labels(texts, labels, block=100).collect()}
    # one text in another counts 0.7 at least; among equals the smaller label
    assert got == {"topic number 777": "topic number 777", "Topic": "topic number 0", "zz": "zzz"}


def test_hashed_pairs_reach_their_recall_and_prune(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    shares = []
    for n in (400, 1600):
        m = rng.standard_normal((n, 32))
        m[n // 2 :] = m[: n // 2] + 0.45 * rng.standard_normal((n // 2, 32))
        u = m / np.linalg.norm(m, axis=1)[:, None]
        s = np.triu(u @ u.T, 1)
        df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "k bigint, v array<float>")
        want = set(zip(*np.nonzero(s >= 0.85)))
        got = {(r["a"], r["b"]) for r in similar_pairs(df, "k", "v", 0.85, recall=0.95).collect()}
        assert got <= want and len(got) >= 0.9 * len(want) > 20
        bits = max(4, int(np.ceil(np.log2(n / 64))))
        shares.append(2.0**-bits * tables_for(0.85, bits, 0.95))
    assert shares[1] <= shares[0]


def test_keep_longer_is_the_sequential_pass(spark):
    import random

    rng = random.Random(5)
    for n, m in ((30, 25), (40, 90)):
        size = [rng.randrange(4) for _ in range(n)]
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        gone = set()
        for i in range(n):
            if i in gone:
                continue
            for j in range(i + 1, n):
                if (i, j) in pairs and j not in gone:
                    if size[j] > size[i]:
                        gone.add(i)
                        break
                    gone.add(j)
        rows = spark.createDataFrame(list(enumerate(size)), "id bigint, z int")
        left = keep_longer(rows, spark.createDataFrame(sorted(pairs), "a bigint, b bigint"), "id", "z")
        assert {r["id"] for r in left.collect()} == set(range(n)) - gone
