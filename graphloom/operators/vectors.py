"""Nearest neighbours, similar pairs and connected groups of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize
from graphloom.skew import hot_keys, lookup_join

#: Query vectors handled at a time; what a task holds is this many vectors and one batch of rows.
QUERY_BLOCK = 2_000


def _matrix(vectors: pd.Series, unit: bool) -> np.ndarray:
    m = np.stack([np.asarray(v, "float64") for v in vectors])
    return m / np.maximum(np.linalg.norm(m, axis=1), 1e-12)[:, None] if unit else m


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, <key>, score, rank) of the ``k`` best rows of each query, itself left out. Score is the
    cosine, or minus the squared distance. Queries go in blocks of bounded size, which are broadcast;
    every task keeps its own best k a query, so the shuffle holds k rows a query and task. Null
    vectors are neither queries nor answers; ties go to the smaller key."""
    spark = rows.sparkSession
    clean_q, clean_r = queries.where(F.col(vector).isNotNull()).select(key, vector), rows.where(F.col(vector).isNotNull()).select(key, vector)
    blocks = max(1, -(-clean_q.count() // QUERY_BLOCK))
    out = spark.createDataFrame([], f"query_id bigint, {key} bigint, score double")
    for b in range(blocks):
        block = clean_q.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toPandas() if blocks > 1 else clean_q.toPandas()
        if block.empty:
            continue
        shared = spark.sparkContext.broadcast((block[key].to_numpy("int64"), _matrix(block[vector], metric == "cosine")))

        def best(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            kept = None
            for pdf in it:
                own, m = pdf[key].to_numpy("int64"), _matrix(pdf[vector], metric == "cosine")
                s = q @ m.T if metric == "cosine" else -((q**2).sum(1)[:, None] + (m**2).sum(1)[None] - 2 * q @ m.T)
                s[ids[:, None] == own[None]] = -np.inf
                frames = [kept] if kept is not None else []
                take = min(k, s.shape[1])
                # a tie at the border must not depend on the order of rows: keep all that tie
                border = -np.partition(-s, take - 1, axis=1)[:, take - 1 : take]
                i, j = np.nonzero((s >= border - 1e-9) & np.isfinite(s))
                frames.append(pd.DataFrame({"query_id": ids[i], key: own[j], "score": s[i, j]}))
                kept = pd.concat(frames).assign(r=lambda x: x["score"].round(9)).sort_values(["query_id", "r", key], ascending=[True, False, True]).groupby("query_id").head(k).drop(columns="r")
            if kept is not None:
                yield kept

        out = out.unionByName(clean_r.mapInPandas(best, f"query_id bigint, {key} bigint, score double"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tables_for(cosine: float, bits: int, recall: float) -> int:
    """Hash tables after which a pair at the threshold has met with a probability of ``recall``."""
    p = (1 - float(np.arccos(np.clip(cosine, -1, 1))) / np.pi) ** bits
    return 1 if p >= 1 else max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - p))))


def similar_pairs(rows: DataFrame, key: str, vector: str, cosine: float, recall: float | None = None, seed: int = 3, block: int = 1_000) -> DataFrame:
    """(a, b, score), a < b, of pairs whose cosine reaches the threshold.

    With a ``recall`` vectors are hashed by random hyperplanes, in as many tables as give a pair at the threshold that
    probability of meeting (closer pairs meet more often); the bits of a code grow with the logarithm of the number
    of vectors, so the share of pairs compared falls as the table grows. Crowded buckets are compared in blocks.
    Without one all blocks are compared as matrices: exact, quadratic, for low thresholds that let no filter work.
    Null vectors have no pairs; rows repeated with one key count once (the smallest vector)."""
    spark = rows.sparkSession
    clean = rows.where(F.col(vector).isNotNull()).groupBy(F.col(key).cast("bigint").alias("k")).agg(F.min(vector).alias("v")).where("k is not null")
    clean = materialize(clean, "vectors")
    n = clean.count()
    if not n:
        return spark.createDataFrame([], "a bigint, b bigint, score double")
    if recall is None:
        placed, bound = clean.withColumn("bucket", F.lit(0).cast("bigint")), n
    else:
        bits = max(4, int(np.ceil(np.log2(max(2, n / 64)))))
        tables = tables_for(cosine, bits, recall)

        def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                m = _matrix(pdf["v"], False)
                planes = np.random.default_rng(seed).standard_normal((m.shape[1], tables, bits))
                side = np.tensordot(m, planes, 1) > 0
                codes = (side * (1 << np.arange(bits))).sum(2) + (np.arange(tables) << bits)
                yield pd.DataFrame({"k": np.repeat(pdf["k"].to_numpy(), tables), "v": [v for v in pdf["v"] for _ in range(tables)], "bucket": codes.ravel()})

        placed = materialize(clean.mapInPandas(place, "k bigint, v array<float>, bucket bigint"), "codes")
        sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        placed = placed.join(sizes, "bucket")
        bound = F.col("n")
    blocks = F.greatest(F.ceil((F.lit(bound) if isinstance(bound, int) else bound) / block), F.lit(1)).cast("int")
    split = placed.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("k"), blocks.cast("bigint")).cast("int")})
    # blocks i <= j meet once: a vector goes to the rows of its block and to the columns of it
    left = split.select("bucket", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("own"), "k", "v")
    right = split.select("bucket", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.lit(False).alias("own"), "k", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["own"]], pdf[~pdf["own"]]
        if a.empty or b.empty:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        s = _matrix(a["v"], True) @ _matrix(b["v"], True).T
        i, j = np.nonzero(s >= cosine)
        x, y = a["k"].to_numpy()[i], b["k"].to_numpy()[j]
        # within one block a pair is met from both sides
        keep = (x < y) | (x != y if pdf["i"].iloc[0] != pdf["j"].iloc[0] else False)
        return pd.DataFrame({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep], "score": s[i, j][keep]})

    met = left.unionByName(right).groupBy("bucket", "i", "j").applyInPandas(compare, "a bigint, b bigint, score double")
    return met.groupBy("a", "b").agg(F.max("score").alias("score"))


def keep_longer(rows: DataFrame, pairs: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` left after the greedy pass over alike pairs: keys in order, each against its later alike keys; the one
    of smaller ``size`` goes, a tie keeps the earlier, and a key that goes is compared no further.

    Keys that are the smallest open ones within two links settle together: nothing one of them decides touches
    another, so each round equals that part of the sequential pass. The state is written every round. Keys must be
    unique; a null size counts as 0."""
    spark = rows.sparkSession
    sized = rows.select(F.col(key).cast("bigint").alias("k"), F.coalesce(size, F.lit(0)).alias("z"))
    links = pairs.select("a", "b").where("a < b").distinct()
    links = links.join(sized.toDF("a", "za"), "a").join(sized.toDF("b", "zb"), "b")
    links = materialize(links, "links")
    gone = spark.createDataFrame([], "k bigint")
    # a link is open while both ends stand and the earlier one has not been through its pass
    while links.take(1):
        both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
        open_ = links.select(F.col("a").alias("k")).distinct()
        near = both.join(open_.select(F.col("k").alias("y")), "y", "left_semi").groupBy("x").agg(F.min("y").alias("least"))
        own = open_.select(F.col("k").alias("x"), F.col("k").alias("own"))
        first = near.join(own, "x", "full").select("x", F.least("least", "own").alias("first"))
        second = both.join(first.toDF("y", "first"), "y").groupBy("x").agg(F.min("first").alias("second"))
        ready = open_.join(second.withColumnRenamed("x", "k"), "k").where("second = k").select(F.col("k").alias("a"))
        ready = materialize(ready, "ready")
        at = links.join(ready, "a", "left_semi")
        stop = at.where("zb > za").groupBy("a").agg(F.min("b").alias("stop"))
        at = at.join(stop, "a", "left")
        lost = materialize(at.where("stop is null or b < stop").select(F.col("b").alias("k")).unionByName(at.where("stop is not null").select(F.col("a").alias("k"))).distinct(), "gone")
        gone = gone.unionByName(lost)
        links = links.join(ready, "a", "left_anti").join(lost.toDF("a"), "a", "left_anti").join(lost.toDF("b"), "b", "left_anti")
        links = materialize(links, "links")
    return rows.join(gone.distinct(), F.col(key) == F.col("k"), "left_anti")


def components(nodes: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(<key>, component): the smallest key of each connected group, by min-label rounds that also jump
    to the label's label, until no label changes; labels are written to the shared folder every round.
    A vertex of very many links gives its label through one row a task (minima are combined first)."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    both = materialize(both.distinct(), "links")
    hot = materialize(hot_keys(both.select("y"), "y"), "hubs")
    labels = materialize(nodes.select(F.col(key).cast("bigint").alias("x"), F.col(key).cast("bigint").alias("component")).distinct(), "labels")
    while True:
        seen = lookup_join(both, labels.withColumnRenamed("x", "y"), "y", hot=hot).groupBy("x").agg(F.min("component").alias("near"))
        step = labels.join(seen, "x", "left").select("x", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("before"))
        step = materialize(step, "labels")
        jump = step.select(F.col("x").alias("component"), F.col("component").alias("next"))
        jumped = materialize(lookup_join(step, jump, "component").select("x", F.least("component", "next").alias("component"), "before"), "labels")
        labels = jumped.select("x", "component")
        if not jumped.where("component <> before").take(1):
            return labels.select(F.col("x").alias(key), "component")
