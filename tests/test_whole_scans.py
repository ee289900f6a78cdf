"""Links and tag pairs come whole, the rare ones too."""

import os
from collections import Counter, defaultdict

import pytest

from graphloom.plans import catalog
from graphloom.sources.standin import graph

SF = "/root/testdata/sf0.001"


def test_links_met_once_are_kept(spark, tmp_path):
    urls = ["http://a.example/1", "http://a.example/1?page=2", "https://a.example/2#end", "ftp://a.example/3", None]
    spark.createDataFrame([(u,) for u in urls], "url string").write.parquet(str(tmp_path / "mail_raw.parquet"))
    got = {r["url"]: r["n"] for r in catalog.QUERIES["scan_html_links"](spark, str(tmp_path)).collect()}
    assert got == {"http://a.example/1": 2, "https://a.example/2": 1}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_rare_tag_pairs_are_kept(spark):
    counts, kinds = Counter(), defaultdict(set)
    for t in graph(spark, SF).tags.collect():
        counts[t["tag_name"], t["tag_value"]] += 1
        kinds[t["tag_name"], t["tag_value"]].add(t["node_label"])
    got = {(r["tag_name"], r["tag_value"]): (r["n"], r["kinds"]) for r in catalog.QUERIES["export_tags"](spark, SF).collect()}
    assert got == {k: (n, len(kinds[k])) for k, n in counts.items()} and min(counts.values()) <= 20
