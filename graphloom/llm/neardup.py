"""Near-duplicate records: improved consistent weighted sampling over TF-IDF shingles, banded.

Document frequencies are counted over all records into a table of bounded size (shingles share a slot by
hash), so the weights can be handed to every task whatever the vocabulary. A record is sampled K
times; two records agree in a sample with the probability of their weighted Jaccard similarity.
Samples are joined in bands, a few bands a round, so that disk holds the meetings of one round only. A sketch
travels with each record and drops chance meetings before the texts are compared: where a plain Jaccard
similarity is asked for, the parity of its shingles in 256 bits, which never drops a pair that reaches it; else one
bit of each sample. Records with the same shingles, as often, are one class: only one representative of a class
is sampled, compared and joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.words import words_column
from graphloom.session import discard, materialize
from graphloom.skew import lookup_join

#: Bounds of the document-frequency table, which is broadcast: 1 MB to 16 MB.
LEAST_SLOTS, MOST_SLOTS = 1 << 18, 1 << 22

#: Rows (class, band) that one round of bands sends to its buckets, and the bands that a round has at least.
ROUND_ROWS, LEAST_BANDS = 4_000_000, 4

#: Blocks that a bucket may fill before it is left to several tasks: below that, its rows need not be written and sent again.
CROWD_BLOCKS = 16


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, vectorised."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _uniforms(words: np.ndarray, samples: np.ndarray, stream: int) -> tuple[np.ndarray, np.ndarray]:
    """Two tables (samples x words) of uniform numbers in (0, 1], functions of word, sample and stream only: the
    halves of one 64-bit hash."""
    with np.errstate(over="ignore"):
        seed = _mix(samples.astype("uint64") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(stream * 0x632BE59B))
        x = _mix(words[None, :] + seed[:, None])
    scale = np.float32(2.0**-32)
    return ((x >> np.uint64(32)).astype("float32") + np.float32(0.5)) * scale, ((x & np.uint64(0xFFFFFFFF)).astype("float32") + np.float32(0.5)) * scale


class Sampler:
    """Improved consistent weighted sampling of weighted word sets."""

    def __init__(self, samples: int):
        self.samples = np.arange(samples)

    def draw(self, words: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Samples (records x samples, uint64) of records whose words begin at ``starts``; equal
        (word, weight) entries are computed once."""
        order = np.lexsort((weights, words))
        new = np.r_[True, (words[order[1:]] != words[order[:-1]]) | (weights[order[1:]] != weights[order[:-1]])]
        back = np.empty(len(words), "int64")
        back[order] = np.cumsum(new) - 1
        h, ln_w = words[order[new]], np.log(weights[order[new]]).astype("float32")
        out = np.empty((len(self.samples), len(starts)), "uint64")
        step = max(1, 200_000 // max(1, len(h)))
        for a in range(0, len(self.samples), step):
            s = self.samples[a : a + step]
            (u1, u2), (u3, u4), (b, _) = (_uniforms(h, s, k) for k in (1, 2, 3))
            r = np.maximum(-np.log(u1 * u2), np.float32(1e-6))
            c = np.maximum(-np.log(u3 * u4), np.float32(1e-6))
            t = np.floor(ln_w / r + b)
            ln_a = np.log(c) - r * (t - b) - r
            # a record's sample is its entry of least ln a: in one number with the entry, the bits of ln a made to sort as it does
            bits = ln_a.view("uint32")
            bits = bits ^ ((bits.view("int32") >> 31).view("uint32") | np.uint32(0x80000000))
            ranked = (bits.astype("uint64") << np.uint64(32)) | np.arange(len(h), dtype="uint64")
            for i in range(len(s)):
                least = (np.minimum.reduceat(ranked[i][back], starts) & np.uint64(0xFFFFFFFF)).astype("int64")
                with np.errstate(over="ignore"):
                    out[a + i] = _mix(h[least] ^ (t[i, least].astype("int64").astype("uint64") * np.uint64(0x9E3779B97F4A7C15)))
        return np.ascontiguousarray(out.T)


def shingles_column(text: Column, size: int) -> Column:
    """The runs of ``size`` words of a text, sorted, repeats kept; a shorter text is one run, one without words none."""
    words = words_column(text)
    if size == 1:
        return F.sort_array(words)

    def runs(ws: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(ws) - size + 1, F.lit(1)))
        return F.when(F.size(ws) > 0, F.transform(starts, lambda i: F.array_join(F.slice(ws, i, size), " "))).otherwise(F.array().cast("array<string>"))

    return F.sort_array(F.flatten(F.transform(F.array(words), runs)))


def frequency_slots(classes: DataFrame) -> int:
    """Slots of the frequency table: four for each different shingle, a power of two within the two bounds. Beyond the
    upper one shingles share slots, which blurs their weights and loses nothing."""
    different = classes.select(F.explode(F.split("words", "\n")).alias("w")).agg(F.approx_count_distinct("w")).first()[0] or 1
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << int(np.ceil(np.log2(4 * different)))))


def document_frequencies(classes: DataFrame, slots: int) -> tuple[np.ndarray, int]:
    """Counts by slot and the number of records, over all records (``slots`` rows at most)."""
    rows = (
        classes.select("n", F.explode(F.array_distinct(F.split("words", "\n"))).alias("w"))
        .groupBy((F.xxhash64("w").bitwiseAND(F.lit(slots - 1))).cast("int").alias("slot"))
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    counts = np.zeros(slots, "int64")
    counts[rows["slot"].to_numpy("int64")] = rows["n"].to_numpy("int64")
    total = classes.agg(F.sum("n")).first()[0] or 0
    return counts, int(total)


def entries_of(shingles: pa.Array | pd.Series, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, hash, weight) of every different shingle of each record: (1 + ln tf) times idf. A record's shingles
    are the lines of its text; equal ones lie next to each other, as they are sorted."""
    lists = pc.split_pattern(shingles if isinstance(shingles, pa.Array) else pa.array(shingles, pa.string()), "\n")
    flat = lists.flatten().dictionary_encode()
    h = np.array([xxhash.xxh64_intdigest(w, seed=42) for w in flat.dictionary.to_pylist()], "uint64")[flat.indices.to_numpy()]
    at = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (at[1:] != at[:-1])]) if len(h) else np.empty(0, int)
    tf = np.diff(np.r_[first, len(h)])
    h, at = h[first], at[first]
    return at, h, np.round((1 + np.log(np.maximum(tf, 1))) * idf[(h & np.uint64(len(idf) - 1)).astype("int64")], 4)


def parities(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each record, whose different shingles begin at ``starts``, how many of them fall on each of 256 bits, modulo
    two (records x 4, uint64). Two records differ in no more bits than they have shingles not in common."""
    bit = h >> np.uint64(56)
    one = np.uint64(1) << (bit & np.uint64(63))
    return np.stack([np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == np.uint64(k), one, np.uint64(0)), starts) for k in range(4)], axis=1)


def classed(records: DataFrame, key: str, text: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """members(class, key) and classes(class, n, words): records with equal shingles, as often. A class's shingles are
    the lines of ``words``; only they pass the shuffle, once, beside keys and hashes."""
    tokens = records.select(F.col(key).cast("bigint").alias("key"), shingles_column(F.col(text), shingle).alias("words"))
    tokens = tokens.where((F.size("words") > 0) & F.col("key").isNotNull()).select("key", F.array_join("words", "\n").alias("words"))
    # 128 bits stand for the text
    tokens = materialize(tokens.withColumn("set", F.substring(F.unhex(F.sha2("words", 256)), 1, 16)), "tokens")
    keys = tokens.select("set", "key").repartition("set").distinct()
    of = keys.groupBy("set").agg(F.min("key").alias("class"), F.count(F.lit(1)).alias("n"))
    texts = tokens.groupBy("set").agg(F.min("words").alias("words"))
    classes = materialize(of.join(texts, "set").select("class", "n", "words"), "classes")
    members = materialize(keys.join(of, "set").select("class", "key"), "members")
    discard(tokens)
    return members, classes


def similar_pairs(
    spark: SparkSession,
    records: DataFrame,
    key: str,
    text: str,
    similarity: float = 0.8,
    shingle: int = 5,
    rows: int = 5,
    bands: int = 80,
    bucket_block: int = 500,
    jaccard: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(classes, links): classes(class, key) has every record with words and its class (the smallest key with
    the same shingles, as often), links(a, b, weighted, jaccard) the pairs of classes a < b whose weighted Jaccard
    similarity over TF-IDF shingles of ``shingle`` words reaches ``similarity``; jaccard is that of the plain sets,
    which reaches the parameter ``jaccard`` where one is given.

    A pair of similarity s meets in some band with probability 1 - (1 - s^rows)^bands. Records whose text is null or
    holds no word are in no class. Repeated rows of one key count once. A band bucket of many classes, more than
    ``CROWD_BLOCKS`` times ``bucket_block``, is joined in parts of that size over several tasks; none is dropped.
    """
    crowded = CROWD_BLOCKS * bucket_block
    members, classes = classed(records, key, text, shingle)
    counts, total = document_frequencies(classes, frequency_slots(classes))
    idf = spark.sparkContext.broadcast((np.log((1 + total) / (1.0 + counts)) + 1.0).astype("float32"))
    samples = rows * bands
    bits = samples // 64 * 64
    at_once = min(bands, max(LEAST_BANDS, ROUND_ROWS // max(1, classes.count())))
    rounds = [range(a, min(a + at_once, bands)) for a in range(0, bands, at_once)]
    if jaccard is None:
        # agreement of 1-bit samples is (1 + similarity) / 2 on average; 3.7 deviations below it are let through
        p = (1 + similarity) / 2
        fixed, share = int(bits * (1 - p) + 3.7 * (bits * p * (1 - p)) ** 0.5), 0.0
    else:
        # sets of sizes x and y with this similarity have no more than so large a share of x + y not in common
        fixed, share = 1e-6, (1 - jaccard) / (1 + jaccard)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for whole in batches:
            for begin in range(0, whole.num_rows, 4000):
                # a copy that starts at its own first byte: string kernels may cut a slice in place wrongly
                part = whole.take(pa.array(np.arange(begin, min(begin + 4000, whole.num_rows))))
                at, h, weights = entries_of(part["words"], idf.value)
                starts = np.searchsorted(at, np.arange(part.num_rows))
                drawn = sampler.draw(h, weights, starts)
                if jaccard is None:
                    # one bit of each sample makes the sketch, so it costs no draws of its own
                    sketch = np.packbits(((drawn[:, :bits] >> np.uint64(17)) & np.uint64(1)).astype("uint8"), axis=1).view("uint64")
                else:
                    sketch = parities(h, starts)
                with np.errstate(over="ignore"):
                    acc = _mix(np.arange(1, bands + 1, dtype="uint64"))[None, :].repeat(part.num_rows, 0)
                    for i in range(rows):
                        acc = _mix(acc * np.uint64(31) + drawn[:, i:samples:rows])
                # 32 bits a band are enough: a chance meeting is dropped by the sketch
                bucket = (acc >> np.uint64(32)).astype("uint32").view("int32")
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(bucket[:, r.start : r.stop].ravel()), len(r)).cast(pa.list_(pa.int32())) for r in rounds]
                size = pa.array(np.diff(np.r_[starts, len(h)]).astype("int32"))
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(sketch.shape[1] * 8), part.num_rows, [None, pa.py_buffer(np.ascontiguousarray(sketch).tobytes())])
                yield pa.RecordBatch.from_arrays([part["class"], size, raw.cast(pa.binary()), *lists], ["class", "size", "sketch", *(f"round{k}" for k in range(len(rounds)))])

    # spread small inputs over the cores: the sampling is arithmetic, not reading
    spread, tasks = classes.select("class", "words"), spark.sparkContext.defaultParallelism * 2
    if spread.rdd.getNumPartitions() < tasks:
        spread = spread.repartition(tasks)
    sampled = spread.mapInArrow(sample, "class bigint, size int, sketch binary" + "".join(f", round{k} array<int>" for k in range(len(rounds))))
    sampled = materialize(sampled, "bands")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of each bucket, whose rows come one after the other; rows of a crowded one are handed on."""
        held, crowd = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at, classes_, size = (batch[c].to_numpy() for c in ("bucket", "class", "size"))
            sketch = np.frombuffer(b"".join(batch["sketch"].to_pylist()), "uint64").reshape(batch.num_rows, -1)
            now = [at, classes_, size, sketch] if held is None else [np.concatenate(x) for x in zip(held, [at, classes_, size, sketch])]
            # the last bucket may go on in the next batch; of one that is crowded already nothing has to be kept
            end = np.searchsorted(now[0], now[0][-1])
            tail = len(now[0]) - end > crowded or now[0][-1] == crowd
            held = None if tail else [x[end:] for x in now]
            yield from paired([x if tail else x[:end] for x in now], crowd)
            crowd = now[0][-1] if tail else None
        if held is not None:
            yield from paired(held, crowd)

    def paired(now: list[np.ndarray], crowd: int | None) -> Iterator[pa.RecordBatch]:
        at = now[0]
        if not len(at):
            return
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        count = np.diff(np.r_[first, len(at)])
        hot = (count > crowded) | (at[first] == crowd if crowd is not None else False)
        _, own, size, sketch = now
        stop = np.repeat(np.where(hot, 0, first + count), count)
        met, i, d = [], np.arange(len(at)), 1
        while len(i := i[i + d < stop[i]]):
            j = i + d
            near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= fixed + share * (size[i] + size[j])
            x, y = own[i[near]], own[j[near]]
            met.append(np.stack([np.minimum(x, y), np.maximum(x, y)])[:, x != y])
            d += 1
        a, b = np.concatenate([np.empty((2, 0), "int64"), *met], axis=1)
        few = np.repeat(hot, count)
        none = lambda n, t: pa.nulls(n, t)
        words = pa.FixedSizeListArray.from_arrays(pa.array(sketch[few].view("int64").ravel()), sketch.shape[1]).cast(pa.list_(pa.int64()))
        for columns in (
            [pa.array(a), pa.array(b), none(len(a), pa.int64()), none(len(a), pa.int32()), none(len(a), words.type)],
            [pa.array(own[few]), none(few.sum(), pa.int64()), pa.array(at[few]), pa.array(size[few]), words],
        ):
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "bucket", "size", "sketch"])

    meetings = []
    for k, r in enumerate(rounds):
        # the band is part of the bucket's number
        buckets = sampled.select("class", "size", "sketch", F.posexplode(f"round{k}").alias("band", "value"))
        bucket = ((F.col("band") + r.start).cast("bigint") * (1 << 32) + F.col("value").cast("bigint")).alias("bucket")
        sorted_rows = buckets.select(bucket, "class", "size", "sketch").repartition("bucket").sortWithinPartitions("bucket")
        meetings.append(materialize(sorted_rows.mapInArrow(meet, "a bigint, b bigint, bucket bigint, size int, sketch array<bigint>"), "met"))
        del buckets, sorted_rows
        discard()
    discard(sampled)
    every = meetings[0]
    for m in meetings[1:]:
        every = every.unionByName(m)
    candidates = every.where(F.col("b").isNotNull()).select("a", "b")
    rows_in = every.where(F.col("b").isNull())
    if rows_in.take(1):
        crowds = rows_in.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / crowded).cast("int").alias("blocks"))
        rows_in = rows_in.select("bucket", F.col("a").alias("class"), "size", "sketch").join(crowds, "bucket")
        block = F.pmod(F.xxhash64("class"), F.col("blocks").cast("bigint")).cast("int")
        left = rows_in.select("bucket", F.col("class").alias("a"), F.col("sketch").alias("sa"), F.col("size").alias("na"), block.alias("block"))
        right = rows_in.select("bucket", F.col("class").alias("b"), F.col("sketch").alias("sb"), F.col("size").alias("nb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        apart = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(bits // 64 if jaccard is None else 4)), F.lit(0))
        near = apart <= F.lit(float(fixed)) + F.lit(share) * (F.col("na") + F.col("nb"))
        candidates = candidates.unionByName(left.join(right, ["bucket", "block"]).where((F.col("a") < F.col("b")) & near).select("a", "b"))
    words_a = classes.select(F.col("class").alias("a"), F.col("words").alias("wa"))
    words_b = classes.select(F.col("class").alias("b"), F.col("words").alias("wb"))

    @F.pandas_udf("double")
    def weighted(xs: pd.Series, ys: pd.Series) -> pd.Series:
        # the sets of all pairs at once: entries (pair, shingle) of both sides, those met twice are common
        at, h, w = (np.concatenate(c) for c in zip(entries_of(xs, idf.value), entries_of(ys, idf.value)))
        sums = np.bincount(at, w, len(xs))
        order = np.lexsort((h, at))
        at, h, w = at[order], h[order], w[order]
        twice = np.flatnonzero((at[1:] == at[:-1]) & (h[1:] == h[:-1]))
        both = np.bincount(at[twice], np.minimum(w[twice], w[twice + 1]), len(xs))
        return pd.Series(both / np.maximum(sums - both, 1e-12))

    sa, sb = (F.array_distinct(F.split(c, "\n")) for c in ("wa", "wb"))
    common = F.size(F.array_intersect(sa, sb))
    compared = candidates.distinct().join(words_a, "a").join(words_b, "b").withColumn("jaccard", common / (F.size(sa) + F.size(sb) - common))
    if jaccard is not None:
        compared = compared.where(F.col("jaccard") >= jaccard - 1e-12)
    links = compared.withColumn("weighted", weighted("wa", "wb")).where(F.col("weighted") >= similarity).select("a", "b", "weighted", "jaccard")
    links = materialize(links, "links")
    discard(classes, *meetings)
    return members, links


def alike_questions(spark: SparkSession, records: DataFrame, jaccard: float = 0.7) -> DataFrame:
    """(qa_key_a, qa_key_b), a < b: records whose distinct words have a Jaccard similarity of at
    least ``jaccard``; links of classes by sampling over single words, checked exactly, spread over their members.
    Rare words weigh more than common ones, so the weighted similarity asked of the samples lies well below."""
    members, links = word_links(spark, records, jaccard)
    every = links.select("a", "b").unionByName(members.select(F.col("class").alias("a"), F.col("class").alias("b")).distinct())
    ma, mb = members.select(F.col("class").alias("a"), F.col("key").alias("x")), members.select(F.col("class").alias("b"), F.col("key").alias("y"))
    pairs = every.join(ma, "a").join(mb, "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("qa_key_a"), F.greatest("x", "y").alias("qa_key_b"))


def word_links(spark: SparkSession, records: DataFrame, jaccard: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Classes and links of questions over single words, as their definition counts distinct words."""
    return similar_pairs(spark, records, "qa_key", "question", similarity=0.4, shingle=1, jaccard=jaccard)


def class_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, class, links): one row per record with its class and how many other classes that one is linked to."""
    ends = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class")))
    counts = ends.groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    return lookup_join(members, counts, "class", "left").select("key", "class", F.coalesce("links", F.lit(0)).alias("links"))
