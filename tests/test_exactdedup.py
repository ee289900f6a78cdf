from pyspark.sql import functions as F

from graphloom.operators import exactdedup as X
from graphloom.skew import HOT_SHARE, hot_keys, lookup_join, ranked_in_group

SCHEMA = "delivery_id bigint, batch_id string, message_id string, url string, kept string"


def rows(spark):
    return spark.createDataFrame(
        [
            (1, "b1", "<a.B@Host.example>", None, "x"), (2, "b1", " a.B@host.EXAMPLE \n", "", None), (3, "b2", "<a.b@host.example>", None, None), (4, "b2", None, "https://l.example/message-id/flat/a.B%40host.example?ref=1", None),
            (5, "b2", "<>", "https://l.example/list/since/1/", None), (6, "b3", None, None, None), (7, "b3", "None", "https://l.example/message-id/CA%2Bx%3Dy%40h.example/", None), (8, "b3", "CA+x=y@h.example", "https://l.example/message-id/other@h.example", None),
            (4, "b2", None, "https://l.example/message-id/flat/a.B%40host.example?ref=1", None), (None, "b3", "<a.B@host.example>", None, None),
        ],
        SCHEMA,
    )


def test_surplus(spark):
    got = {tuple(r) for r in X.surplus_deliveries(rows(spark)).collect()}
    assert got == {(1, 2), (1, 4), (7, 8)}
    assert X.surplus_deliveries(rows(spark).limit(0)).count() == 0


def test_first_deliveries_keep_all_columns_and_unidentified_rows(spark):
    kept = X.first_deliveries(rows(spark))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r[0] or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 7]


def test_batches_in_any_order_give_one_table(spark):
    keyed = rows(spark).withColumn("i", X.delivery_identifier(F.col("message_id"), F.col("url")))
    whole = {tuple(r) for r in X.quotient_table(keyed, "i", "delivery_id").collect()}
    a, b = keyed.where("batch_id = 'b3'"), keyed.where("batch_id <> 'b3'")
    split = {tuple(r) for r in X.insert_batch(X.quotient_table(a, "i", "delivery_id"), b, "i", "delivery_id").collect()}
    assert whole == split


def test_hot_identifier(spark):
    n = 5000
    df = spark.range(n).selectExpr("id as delivery_id", "if(id % 3 = 0, '<hot@h>', concat('<', id, '@h>')) as message_id", "cast(null as string) as url")
    got = X.surplus_deliveries(df)
    assert got.count() == len(range(0, n, 3)) - 1 and got.select("kept_delivery_id").distinct().count() == 1


def test_hot_keys_are_few_and_lookup_joins_are_whole(spark):
    df = spark.range(30000).selectExpr("if(id % 2 = 0, 'hot', cast(id as string)) as k", "id")
    assert [r[0] for r in hot_keys(df, "k").collect()] == ["hot"] and HOT_SHARE == 1000
    look = spark.createDataFrame([("hot", 1), ("1", 2)], "k string, v int")
    assert lookup_join(df, look, "k").count() == 15001
    assert lookup_join(df, look, "k", "left").count() == 30000


def test_rank_of_large_groups(spark):
    df = spark.range(1000).selectExpr("if(id < 900, 'big', 'small') as g", "id * 7 % 1000 as v")
    sizes = df.groupBy("g").count().withColumnRenamed("count", "_n")
    got = ranked_in_group(df, "g", ["v"], "r", sizes, limit=100).collect()
    for g in ("big", "small"):
        values = sorted(r["v"] for r in got if r["g"] == g)
        assert {r["v"]: r["r"] for r in got if r["g"] == g} == {v: i for i, v in enumerate(values, 1)}
