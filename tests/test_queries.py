"""Every core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if hasattr(v, "year") else v


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.ORACLES:
        return
    result = con.execute(catalog.ORACLES[name])
    names = [x[0] for x in result.description]
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted(names) == columns and got == want


def test_stream_gives_what_the_batch_does(spark, tmp_path):
    from graphloom.streaming.events import hourly_totals

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.limit(200).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = hourly_totals(stream).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hours").count() == hourly_totals(spark.read.parquet(str(tmp_path / "in"))).count()
