from datetime import datetime, timedelta

from graphloom.plans import catalog

DAY = timedelta(days=1)


def test_life_of_an_entry_runs_from_its_set(spark, tmp_path):
    start = datetime(2024, 1, 1)
    # looked up every 14 hours by one user, at the very end of the day by another
    at = [(1, "view", start + k * timedelta(hours=14)) for k in range(30)] + [(1, "buy", start), (2, "view", start), (2, "view", start + DAY), (2, "view", start + DAY + timedelta(microseconds=1))]
    rows = [(n, user, kind, t, 1.0) for n, (user, kind, t) in enumerate(at)]
    # one file in another order than that of time
    spark.createDataFrame(rows[::-1], "event_id bigint, user_id bigint, event_type string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    want, since = {}, {}
    for n, user, kind, t, _ in rows:
        want[n] = (user, kind) in since and t - since[user, kind] <= DAY
        if not want[n]:
            since[user, kind] = t
    got = {r["event_id"]: r["hit"] for r in catalog.QUERIES["cache_lru"](spark, str(tmp_path)).collect()}
    assert got == want and sum(want.values()) == 16
    rates = {r["event_type"]: (r["hit_rate"], r["lookups"]) for r in catalog.QUERIES["cache_metrics"](spark, str(tmp_path)).collect()}
    assert rates == {"view": (round(16 / 33, 6), 33), "buy": (0.0, 1)}


def test_state_is_carried_over_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(n, 1, "view", start + n * timedelta(hours=1), 1.0) for n in range(200)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["event_id"]: r["hit"] for r in catalog.QUERIES["cache_lru"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {n: n % 25 != 0 for n in range(200)}
