from graphloom.plans import catalog

PATTERNS = ["system", "exec", "runtime", "import", "os.", "subprocess", "file.write", "file.delete", "process.", "__import__", "eval", "compile"]


def test_safe_as_the_reference_says(spark, tmp_path):
    texts = ["cpg.method.l", "  \n CPG.method.l", "cpg.call.drop(1).l", 'cpg.method.name("delete_all").l', "method.l", "xcpg.method.l", "", None]
    want = [True, True, True, True, False, False, False, False]
    texts += [f"cpg.method.{w}x.l" for p in PATTERNS for w in (p, p.upper(), p.title())]
    want += [False] * (len(texts) - len(want))
    spark.createDataFrame(list(enumerate(texts)), "ragas_key bigint, ground_truth string").write.parquet(str(tmp_path / "ragas_dataset.parquet"))
    got = {r["ragas_key"]: r["safe"] for r in catalog.QUERIES["validate_safe"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want))
