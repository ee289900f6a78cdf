import pytest

from graphloom.sources.json_lines import read_json, read_json_lines, write_csv, write_json_lines
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\nnot json\n{"a": 2}\n\n')
    path = str(tmp_path / "x.jsonl")
    assert sorted(tuple(r) for r in read_json_lines(spark, path, SCHEMA).collect()) == [(1, "x"), (2, None)]
    with pytest.raises(Exception):
        read_json_lines(spark, path, SCHEMA, strict=True).collect()
    df = read_json_lines(spark, path, SCHEMA)
    write_json_lines(df, str(tmp_path / "out"))
    write_json_lines(df, str(tmp_path / "out"), append=True)
    assert read_json_lines(spark, str(tmp_path / "out"), SCHEMA).count() == 4
    write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["a", "b"]


def test_whole_file(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1},\n {"a": 2, "b": "y"}]')
    assert read_json(spark, str(tmp_path / "x.json"), SCHEMA).count() == 2
