from graphloom.llm.newtext import Ancestors, ancestor_pairs, blocks_of, new_lines, strip_quote

SCHEMA = "msg_key bigint, message_id string, parent_id string, `from` string, date string, body string, line_no string"


def test_quotes():
    assert strip_quote("> > text") == (2, "text") and strip_quote("ZT> text") == (1, "text") and strip_quote("| a | b |") == (0, "| a | b |") and strip_quote("postgres=> x") == (0, "postgres=> x")


def test_blocks_cover_lines_that_are_not_blank():
    body = "Hi all,\n\nnew text here that is long enough.\n\n> old\n-- \nBob\n"
    blocks, x = blocks_of(body, ["old"], "Bob <b@x>", {})
    assert sorted(n for b in blocks for n in b) == [1, 3, 5, 6, 7] and len(x) == len(blocks)
    assert Ancestors(["some earlier words in a row"]).overlap("earlier words in a row") == 1.0 and Ancestors([]).overlap("x") == 0.0


def corpus():
    rows = []
    for i in range(120):
        root, reply = f"<r{i}@h>", f"<a{i}@h>"
        text = f"The planner number {i} keeps a list of pages for every query it runs here.\nIt was slow before the change number {i} came in."
        rows.append((2 * i, root, None, f"Ann Bee <ann{i % 9}@x>", f"2021-01-{i % 27 + 1:02d}T10:00:00Z", f"Hi all,\n{text}\n\nRegards,\nAnn Bee\nConsultant, Firm\n\n____________________\nhackers mailing list\nTo leave: https://l.example/leave", "x"))
        quoted = "\n".join("> " + t for t in text.split("\n"))
        rows.append((2 * i + 1, reply, root, f"Cy Dee <cy{i % 7}@x>", f"2021-01-{i % 27 + 1:02d}T12:00:00Z", f"On 2021-01-01, Ann Bee <ann@x> wrote:\n{quoted}\n\nI think that the answer {i} is in the cache of the reader.\r\n\nThis e-mail is confidential and meant for its recipient.\n\n-- \nCy Dee\nEngineer, Firm\n+1 555 0100 2000", "x"))
    return rows


def test_new_lines(spark):
    rows = corpus() + [(900, "<z@h>", "<z@h>", None, None, "From: now on the reader should be called before the writer.", "x"), (901, None, None, None, None, None, "x"), (902, None, None, "a@x", None, " \n ", "x"), (0, *corpus()[0][1:])]
    df = spark.createDataFrame(rows, SCHEMA)
    got: dict[int, set] = {}
    for r in new_lines(spark, df).collect():
        got.setdefault(r["msg_key"], set()).add(r["line_no"])
    right = sum(got.get(2 * i) == {1, 2, 3} for i in range(120)) + sum(got.get(2 * i + 1) == {5} for i in range(120))
    assert right >= 236 and got.get(900) == {1} and not {901, 902} & set(got)


def test_quotation_from_four_levels_up_and_long_signature(spark):
    rows, said = corpus(), "Somebody once wrote these rather unusual words about reindexing toast chunks."
    for k in range(6):
        text = said if k == 0 else f"{['Vacuum', 'Replay', 'Parser', 'Sorting', 'Locking'][k - 1]} number {k} {['takes', 'needs', 'holds', 'wants', 'keeps'][k - 1]} {['two', 'six', 'ten', 'few', 'all'][k - 1]} {['locks', 'pages', 'files', 'slots', 'nodes'][k - 1]} every {['day', 'hour', 'week', 'time', 'night'][k - 1]}."
        old = "" if k < 5 else said + "\n"
        sign = "" if k < 5 else "\n\nRegards,\n" + "\n".join(f"Line {c} of Cy" for c in "abcdefghij")
        rows.append((1000 + k, f"<d{k}@h>", f"<d{k - 1}@h>" if k else None, f"Cy Dee <cy{k}@x>", f"2021-03-0{k + 1}T10:00:00Z", f"{text}\n\n{old}{sign}", "x"))
    got = {r["line_no"] for r in new_lines(spark, spark.createDataFrame(rows, SCHEMA)).collect() if r["msg_key"] == 1005}
    assert got == {1}


def test_ancestors_of_chains_and_circles(spark):
    links = [(f"m{k}", f"m{k - 1}" if k else None) for k in range(21)] + [("x", "y"), ("y", "z"), ("z", "x"), ("s", "s"), ("o", "gone")]
    got = {}
    for r in ancestor_pairs(spark.createDataFrame(links, "id string, up string")).collect():
        got.setdefault(r["id"], {})[r["ancestor"]] = r["level"]
    assert all(got[f"m{k}"] == {f"m{j}": k - j for j in range(k)} for k in range(1, 21))
    assert got["x"] == {"y": 1, "z": 2} and "s" not in got and got["o"] == {"gone": 1}


def test_empty(spark):
    assert new_lines(spark, spark.createDataFrame([], SCHEMA)).count() == 0
