import json

import pytest

from graphloom.plans.pages import block_comments, page_headings
from graphloom.sources import files
from graphloom.sources.html import anchors_of, matrix_of, message_of, sections_of
from pyspark.sql import functions as F


def test_broken_pages_do_not_stop_the_scan():
    for html in ("", "<", "<a", "</p></p>", "<div>" * 3000 + "x", "<table><tr><th>From", None):
        assert anchors_of(html) == [] and message_of(html) is None and sections_of(html) == [] and matrix_of(html, "17") == []


def test_page_headings(spark):
    texts = ["Chapter 5: MVCC\n5.1 Rules\nPart II: x", "5. Locks and more\n\ntext", "nothing", "x\n" * 10 + "Chapter 3: late", "Part IV. Storage\n2.3: Pages", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", page_headings(F.col("t")).alias("h"))
    got = {r["k"]: tuple(r["h"]) if r["h"] else None for r in rows.collect()}
    assert got == {0: ("Chapter 5: MVCC", "5.1 Rules"), 1: ("Chapter 5: Locks and more", None), 2: (None, None), 3: (None, None), 4: ("Chapter IV: Storage", "2.3 Pages"), 5: None}


def test_block_comments(spark):
    long = "word " * 12
    text = f"int x;\n/* short */\n/*\n * {long}\n */\nint y; /** {long}*/ /* {long} */"
    rows = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(block_comments(F.col("t")).alias("c")).collect()
    assert [(c["line_start"], c["content"]) for c in rows[0]["c"]] == [(3, long.strip()), (6, long.strip()), (6, long.strip())]
    assert not rows[1]["c"] and not rows[2]["c"]


def test_trees_examples_and_sinks(spark, tmp_path):
    root = tmp_path / "pgsrc"
    for name, content in {"README": "top", "src/backend/storage/README.md": "inner", "src/backend/storage/buf.c": "int a;", "build/gen.c": "x", "src/include/utils/y.h": "h"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    assert sorted(r["content"] for r in files.scan_tree(spark, str(root)).collect()) == ["inner", "top"]
    index = {r["relative_path"]: (r["component"], r["language"], r["size_bytes"]) for r in files.source_index(spark, str(root)).collect()}
    assert index == {"src/backend/storage/buf.c": ("storage", "c", 6), "src/include/utils/y.h": ("utils", "h", 1)}
    (tmp_path / "a.json").write_text(json.dumps([{"question": "q", "query": "cpg.l"}, {"other": 1}]))
    (tmp_path / "b.json").write_text(json.dumps({"examples": [{"instruction": "i", "output": "o"}, {"question": "only"}]}))
    assert sorted(map(tuple, files.read_examples(spark, str(tmp_path / "a.json")).collect())) == [("q", "cpg.l")]
    assert sorted(map(tuple, files.read_examples(spark, str(tmp_path / "b.json")).collect())) == [("i", "o")]
    found = spark.createDataFrame([("Row-wise comparison", 1), ("B tree", 2)], "name string, id int")
    files.write_summaries(found, "name", str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("slug=*")) == ["slug=b-tree", "slug=row-wise-comparison"]
    assert [r["id"] for r in files.resumed(found, found.where("id = 1"), "id").collect()] == [2]
    keys = found.select(files.content_key(F.col("name"), F.col("id")).alias("k")).distinct().count()
    assert keys == 2
    files.write_vectors(found, str(tmp_path / "v"), "qa")
    files.write_vectors(found.limit(1), str(tmp_path / "v"), "qa")
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    files.write_vectors(found.limit(1), str(tmp_path / "v"), "qa", replace=True)
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1


@pytest.mark.parametrize("name", ["scan_html_links", "scan_html_sections"])
def test_no_tables_rows(spark, tmp_path, name):
    from graphloom.plans import catalog

    for t in ("mail_raw", "documents"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0
