"""Held-out texts inside a training corpus.

Passages of a few words are TF-IDF vectors over the words of the held-out texts (any other word is
one further axis). A randomised singular value decomposition, computed by two passes over all
passages of the corpus, gives a latent space. For common runs, passages of the corpus look up the held-out passages
near them by hyperplane codes and keep those whose cosine is high enough; equal passages have equal
vectors, hence equal codes, so no verbatim passage is missed, and the runs are then measured exactly.
For paraphrases they are compared with all held-out passages, by blocked matrix products; these are
measured by their longest common subsequence and the rare words of the answer.

Passages of eight words are taken every five words from the corpus and everywhere from the held-out
texts: whatever run of twelve common words there is, it holds a whole passage of both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.words import words_column, words_of
from graphloom.session import materialize

WINDOW, STRIDE = 8, 5
#: Words of held-out text handled at a time: bounds what is broadcast; larger sets go in blocks.
BLOCK_WORDS = 200_000
#: Cosines computed at a time where passages are compared with all held-out ones (32 MB).
BLOCK_COSINES = 4_000_000


def _passage_sums(ids: np.ndarray, starts: np.ndarray, table: np.ndarray, window: int = WINDOW) -> np.ndarray:
    out = table[ids[starts]].copy()
    for j in range(1, window):
        out += table[ids[starts + j]]
    return out


def _starts(lengths: np.ndarray, stride: int, window: int = WINDOW) -> np.ndarray:
    """Starts of the passages of texts that lie one after the other."""
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    counts = np.maximum(0, (lengths - window) // stride + 1)
    at = np.repeat(np.arange(len(lengths)), counts)
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return begins[at] + k * stride


@dataclass
class HeldOut:
    """The held-out passages of one block in the latent space, with their hyperplane codes."""

    vocabulary: dict[bytes, int]
    ids: np.ndarray  # words of all items one after the other, a -1 after each
    item: np.ndarray  # item of each word
    starts: np.ndarray  # passages
    table: np.ndarray  # word -> weighted latent vector
    vectors: np.ndarray  # passages, of length 1
    planes: np.ndarray
    codes: list[np.ndarray]  # by table, sorted
    order: list[np.ndarray]
    tables: int
    bits: int

    def code(self, vectors: np.ndarray) -> list[np.ndarray]:
        side = (vectors @ self.planes) > 0
        weights = 1 << np.arange(self.bits)
        return [side[:, t * self.bits : (t + 1) * self.bits] @ weights for t in range(self.tables)]

    def latent(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Vectors of passages, of length 1."""
        v = _passage_sums(ids, starts, self.table)
        v /= np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
        return v

    def all_near(self, ids: np.ndarray, starts: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """As ``near``, but of all pairs with such a cosine: none is left out. Products are of single precision,
        so the border is drawn a little lower."""
        left, right = [np.empty(0, int)], [np.empty(0, int)]
        step = max(1, BLOCK_COSINES // max(1, len(self.vectors)))
        turned = np.ascontiguousarray(self.vectors.T, dtype="float32")
        for a in range(0, len(starts), step):
            i, j = np.nonzero(self.latent(ids, starts[a : a + step]).astype("float32") @ turned >= np.float32(cosine - 1e-5))
            left.append(i + a)
            right.append(j)
        return np.concatenate(left), np.concatenate(right)

    def near(self, ids: np.ndarray, starts: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """(index of the corpus passage, index of the held-out passage) of pairs with such a cosine
        that also share a code; equal passages always do."""
        v = self.latent(ids, starts)
        found = []
        for t, code in enumerate(self.code(v)):
            lo, hi = np.searchsorted(self.codes[t], code, "left"), np.searchsorted(self.codes[t], code, "right")
            rows = np.flatnonzero(hi > lo)
            # in pieces, so that a crowded code does not fill the memory
            ends = np.cumsum(hi[rows] - lo[rows])
            a = 0
            while a < len(rows):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 1_000_000, "right")))
                part, n = rows[a:b], (hi - lo)[rows[a:b]]
                left = np.repeat(part, n)
                right = self.order[t][np.repeat(lo[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                close = np.einsum("ij,ij->i", v[left], self.vectors[right]) >= cosine
                found.append(np.stack([left[close], right[close]]))
                a = b
        if not found:
            return np.empty(0, int), np.empty(0, int)
        pairs = np.unique(np.concatenate(found, 1), axis=1)
        return pairs[0], pairs[1]


def encoder(vocabulary: list[str]):
    """Texts as numbers of their words (vocabulary order; one number more for any other word), by Arrow's own kernels."""
    values, other = pa.array(vocabulary, pa.string()), len(vocabulary)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of words of each)."""
        # a copy that starts at its own first byte: lower-casing a slice in place of it gives wrong text
        own = pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
        words = pc.split_pattern_regex(pc.ascii_lower(own), "[^a-z0-9]+")
        flat, sizes = words.flatten(), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype("int64")
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        ids = pc.fill_null(pc.index_in(flat, value_set=values.cast(pa.large_string())), other).to_numpy(zero_copy_only=False).astype("int32")
        ends = np.concatenate([[0], np.cumsum(full)])
        stops = np.cumsum(sizes)
        return ids[full], ends[stops] - ends[stops - sizes]

    return encode


def _word_frequencies(encoded: DataFrame, words: int) -> np.ndarray:
    """Documents holding each held-out word, counted over all documents; a task gives one row a word at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(words + 1, "int64")
        for pdf in batches:
            rows = [np.frombuffer(b, "int32") for b in pdf["ids"]]
            doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            pairs = np.unique(doc * (words + 1) + np.concatenate(rows)) if rows else np.empty(0, "int64")
            n += np.bincount(pairs % (words + 1), minlength=words + 1)
        used = np.flatnonzero(n[:words])
        yield pd.DataFrame({"w": used, "n": n[used]})

    found = encoded.mapInPandas(count, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(words + 1)
    out[found["w"].to_numpy("int64")] = found["n"].to_numpy("int64")
    return out


def latent_space(spark: SparkSession, encoded: DataFrame, own: np.ndarray, own_starts: np.ndarray, idf: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF passages of the corpus and of the held-out
    texts. Each pass sums what its rows give to every word; the sums are combined before the shuffle
    and have one row a held-out word."""
    words, width = len(idf), min(rank + 8, len(idf))
    rng = np.random.default_rng(seed)

    def products(ids: np.ndarray, starts: np.ndarray, basis: np.ndarray) -> np.ndarray:
        return _passage_sums(ids, starts, idf[:, None] * basis)

    def to_words(ids: np.ndarray, starts: np.ndarray, y: np.ndarray, acc: np.ndarray) -> None:
        for j in range(WINDOW):
            w = ids[starts + j]
            order = np.argsort(w, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(w[order]) > 0]) if len(w) else np.empty(0, int)
            if len(first):
                acc[w[order][first]] += np.add.reduceat(y[order], first, axis=0) * idf[w[order][first], None]

    def batches_of(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = [np.frombuffer(b, "int32") for b in pdf["ids"]]
        ids, lengths = np.concatenate(rows), np.array([len(r) for r in rows])
        starts = _starts(lengths, WINDOW)
        for a in range(0, len(starts), 100_000):
            yield ids, starts[a : a + 100_000]

    omega = rng.standard_normal((words, width))
    sent = spark.sparkContext.broadcast(omega)

    def first_pass(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((words, width))
        for pdf in it:
            for ids, starts in batches_of(pdf):
                to_words(ids, starts, products(ids, starts, sent.value), acc)
        used = np.flatnonzero(np.abs(acc).sum(1) > 0)
        yield pd.DataFrame({"w": used, **{f"c{j}": acc[used, j] for j in range(width)}})

    sums = encoded.mapInPandas(first_pass, "w bigint, " + ", ".join(f"c{j} double" for j in range(width))).groupBy("w").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(width)]).toPandas()
    z = np.zeros((words, width))
    to_words(own, own_starts, products(own, own_starts, omega), z)
    if len(sums):
        z[sums["w"].to_numpy("int64")] += sums[[f"c{j}" for j in range(width)]].to_numpy("float64")
    q, _ = np.linalg.qr(z)
    sent_q = spark.sparkContext.broadcast(q)
    n = q.shape[1]

    def second_pass(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((n, n))
        for pdf in it:
            for ids, starts in batches_of(pdf):
                b = products(ids, starts, sent_q.value)
                acc += b.T @ b
        yield pd.DataFrame({"w": np.arange(n), **{f"c{j}": acc[:, j] for j in range(n)}})

    gram = encoded.mapInPandas(second_pass, "w bigint, " + ", ".join(f"c{j} double" for j in range(n))).groupBy("w").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(n)]).orderBy("w").toPandas()
    m = products(own, own_starts, q)
    m = m.T @ m
    if len(gram):
        m = m + gram[[f"c{j}" for j in range(n)]].to_numpy("float64")
    values, vectors = np.linalg.eigh(m)
    return (q @ vectors[:, np.argsort(-values)[:rank]]).astype("float64")


def _prepare(spark: SparkSession, documents: DataFrame, items: pd.DataFrame, rank: int, tables: int, bits: int, seed: int) -> tuple[HeldOut, DataFrame] | None:
    texts = [words_of(t) for t in items["text"]]
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in texts for w in ws}))}
    if not vocabulary:
        return None
    lengths = np.array([len(ws) for ws in texts])
    own = np.concatenate([np.array([vocabulary[w] for w in ws], "int32") for ws in texts])
    shared = spark.sparkContext.broadcast([w.decode() for w in vocabulary])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_in = encoder(shared.value)
        # few texts at a time, so that long ones do not fill the memory
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            ids, sizes = words_in(batch.column("text"))
            kept = sizes > 0
            begins = np.concatenate([[0], np.cumsum(sizes)])
            rows = [ids[begins[i] : begins[i + 1]].tobytes() for i in np.flatnonzero(kept)]
            yield pa.RecordBatch.from_arrays([batch.column("doc").filter(pa.array(kept)), pa.array(rows, pa.binary())], ["doc", "ids"])

    encoded = materialize(documents.mapInArrow(encode, "doc bigint, ids binary"), "encoded")
    df = _word_frequencies(encoded, len(vocabulary))
    idf = np.log((1 + documents.count()) / (1 + df)) + 1
    starts = _starts(lengths, 1)
    space = latent_space(spark, encoded, own, _starts(lengths, WINDOW), idf, rank, seed)
    table = idf[:, None] * space
    planes = np.random.default_rng(seed + 1).standard_normal((space.shape[1], tables * bits))
    held = HeldOut(vocabulary, own, np.repeat(np.arange(len(texts)), lengths), starts, table, np.empty(0), planes, [], [], tables, bits)
    held.vectors = held.latent(own, starts)
    for code in held.code(held.vectors):
        order = np.argsort(code, kind="stable")
        held.order.append(order)
        held.codes.append(code[order])
    return held, encoded


def _runs(held: HeldOut, ids: np.ndarray, doc: np.ndarray, p: np.ndarray, q: np.ndarray, least: int) -> np.ndarray:
    """Which pairs of positions (p in the corpus words, q in the held-out words) lie in a common run
    of ``least`` words within one document and one item."""
    other = len(held.vocabulary)

    def same(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        inside = (i >= 0) & (i < len(ids)) & (j >= 0) & (j < len(held.ids))
        i, j = np.where(inside, i, 0), np.where(inside, j, 0)
        return inside & (ids[i] == held.ids[j]) & (ids[i] != other) & (doc[i] == doc[p]) & (held.item[j] == held.item[q])

    right = np.zeros(len(p), int)
    going = np.ones(len(p), bool)
    for k in range(least):
        going &= same(p + k, q + k)
        right += going
    left = np.zeros(len(p), int)
    going = right > 0
    for k in range(1, least):
        going &= same(p - k, q - k)
        left += going
    return left + right >= least


class _Blocks(Sequence):
    """The held-out texts in blocks of about BLOCK_WORDS words; a block is fetched when it is asked for."""

    def __init__(self, items: DataFrame):
        self.clean = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null").distinct()
        words = self.clean.agg(F.sum(F.size(words_column(F.col("text"))))).first()[0] or 0
        self.blocks = int(-(-words // BLOCK_WORDS)) or 1

    def __len__(self) -> int:
        return self.blocks

    def __getitem__(self, b: int) -> pd.DataFrame:
        if not 0 <= b < self.blocks:
            raise IndexError(b)
        return self.clean.where(F.pmod(F.xxhash64("item_id"), F.lit(self.blocks)) == b).toPandas()


def _items_in_blocks(items: DataFrame) -> _Blocks:
    return _Blocks(items)


def leaked_items(spark: SparkSession, documents: DataFrame, items: DataFrame, least: int = 12, cosine: float = 0.95, rank: int = 48, tables: int = 2, bits: int = 14, seed: int = 5) -> DataFrame:
    """(doc_id, item_id) of documents and held-out items that share a run of ``least`` (12 or more)
    consecutive words.

    Null texts and keys give nothing; texts shorter than a run match nothing; repeated rows and
    passages give one row a pair. Whole texts are read. Empty tables give an empty result.
    """
    if least < WINDOW + STRIDE - 1:
        raise ValueError(f"least must be at least {WINDOW + STRIDE - 1}")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc"), "text").where("doc is not null and text is not null")
    out = spark.createDataFrame([], "doc_id bigint, item_id bigint")
    for block in _items_in_blocks(items):
        prepared = _prepare(spark, docs, block, rank, tables, bits, seed)
        if prepared is None:
            continue
        held, encoded = prepared
        shared = spark.sparkContext.broadcast((held, block["item_id"].to_numpy("int64")))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, names = shared.value
            for pdf in batches:
                rows = [np.frombuffer(b, "int32") for b in pdf["ids"]]
                ids, lengths = np.concatenate(rows), np.array([len(r) for r in rows])
                doc = np.repeat(np.arange(len(rows)), lengths)
                starts = _starts(lengths, STRIDE)
                for a in range(0, len(starts), 100_000):
                    part = starts[a : a + 100_000]
                    i, j = held.near(ids, part, cosine)
                    ok = _runs(held, ids, doc, part[i], held.starts[j], least)
                    found = pd.DataFrame({"doc_id": pdf["doc"].to_numpy("int64")[doc[part[i[ok]]]], "item_id": names[held.item[held.starts[j[ok]]]]})
                    yield found.drop_duplicates()

        out = out.unionByName(encoded.mapInPandas(search, "doc_id bigint, item_id bigint"))
    return out.distinct()


def common_subsequence(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of x with that row of y (at most 60 words wide): the rows
    of the dynamic program are bits of one number, all pairs go at once."""
    width = y.shape[1]
    row = np.full(len(x), (1 << width) - 1, "uint64")
    for i in range(x.shape[1]):
        match = np.zeros(len(x), "uint64")
        for j in range(width):
            match |= (y[:, j] == x[:, i]).astype("uint64") << np.uint64(j)
        hit = row & match
        row = (row + hit) | (row - hit)
    row &= np.uint64((1 << width) - 1)
    return width - np.bitwise_count(row).astype("int64")


def paraphrased_items(spark: SparkSession, documents: DataFrame, items: DataFrame, cosine: float = 0.75, share: float = 0.75, rank: int = 48, seed: int = 5) -> DataFrame:
    """(doc_id, item_id, lcs_share): documents with a passage that says what an item's does in other
    words: at a high latent cosine the longest common subsequence of the 24 words around both
    reaches ``share``, and the three rarest words of the item's passage - its answer - all occur.
    Every passage taken from a document is compared with all held-out passages."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc"), "text").where("doc is not null and text is not null")
    out = spark.createDataFrame([], "doc_id bigint, item_id bigint, lcs_share double")
    for block in _items_in_blocks(items):
        prepared = _prepare(spark, docs, block, rank, 0, 0, seed)
        if prepared is None:
            continue
        held, encoded = prepared
        weight = np.linalg.norm(held.table, axis=1)
        shared = spark.sparkContext.broadcast((held, block["item_id"].to_numpy("int64"), weight))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, names, weight = shared.value
            edges = np.searchsorted(held.item, np.arange(len(names) + 1))
            # of each held-out passage the words around it and its three rarest words
            at = held.starts[:, None] + np.arange(-8, 16)
            inside = (at >= edges[held.item[held.starts]][:, None]) & (at < edges[held.item[held.starts] + 1][:, None])
            around = np.where(inside, held.ids[np.clip(at, 0, len(held.ids) - 1)], -1)
            core = held.ids[held.starts[:, None] + np.arange(WINDOW)]
            rare = np.take_along_axis(core, np.argsort(-weight[core], axis=1, kind="stable")[:, :3], 1)
            for pdf in batches:
                rows = [np.frombuffer(b, "int32") for b in pdf["ids"]]
                ids, lengths = np.concatenate(rows), np.array([len(r) for r in rows])
                begins = np.concatenate([[0], np.cumsum(lengths)])
                doc = np.repeat(np.arange(len(rows)), lengths)
                starts = _starts(lengths, STRIDE)
                best: dict[tuple[int, int], float] = {}
                for a in range(0, len(starts), 20_000):
                    part = starts[a : a + 20_000]
                    i, j = held.all_near(ids, part, cosine)
                    for c in range(0, len(i), 200_000):
                        p, q = part[i[c : c + 200_000]], j[c : c + 200_000]
                        place = p[:, None] + np.arange(-8, 16)
                        own = (place >= begins[doc[p]][:, None]) & (place < begins[doc[p] + 1][:, None])
                        x = np.where(own, ids[np.clip(place, 0, len(ids) - 1)], -2)
                        told = (x[:, None, :] == rare[q][:, :, None]).any(2).all(1)
                        p, q, x = p[told], q[told], x[told]
                        y = around[q]
                        score = common_subsequence(x, y) / np.maximum((y >= 0).sum(1), 1)
                        for d, k, v in zip(doc[p][score >= share], held.item[held.starts[q]][score >= share], score[score >= share]):
                            best[d, k] = max(best.get((d, k), 0.0), float(v))
                docs = pdf["doc"].to_numpy("int64")
                yield pd.DataFrame([(docs[d], names[k], v) for (d, k), v in best.items()], columns=["doc_id", "item_id", "lcs_share"])

        out = out.unionByName(encoded.mapInPandas(search, "doc_id bigint, item_id bigint, lcs_share double"))
    return out.groupBy("doc_id", "item_id").agg(F.max("lcs_share").alias("lcs_share"))
