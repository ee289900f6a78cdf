"""Filling fixed-capacity windows with documents by bin completion.

Sizes are tokens of a public tokenizer. Documents are dealt to shards of bounded size by hash; each
shard is packed on its own, which costs at most one window that is not full a shard. In a shard the
windows are completed one after the other around the largest document left: all fillings that no other
one dominates are tried in turn, a branch ends when its waste exceeds what any better solution may waste,
and best-fit decreasing gives the first solution to beat. A document above the capacity is cut into
full windows and a rest; no other is cut.
"""

from __future__ import annotations

import base64
import bisect
import copy
import importlib.util
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import materialize

#: Documents of a shard, on average.
SHARD = 4000


def tokenizer_folder() -> str:
    """Where the public tokenizers lie: /opt/tokenizers, or the installed package of them."""
    if Path("/opt/tokenizers").exists():
        return "/opt/tokenizers"
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None or not spec.submodule_search_locations:
        raise FileNotFoundError("no folder of public tokenizers; give tokenizer_path")
    return list(spec.submodule_search_locations)[0]


def token_counts(documents: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, tokens) of every document with a text; texts are read whole. Rows repeated with one
    doc_id count once (the longest); null keys and texts and texts without tokens are left out."""
    path = tokenizer_path or f"{tokenizer_folder()}/byte_bpe_50k.tiktoken"

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        try:
            from public_tokenizers import PATTERN
        except ImportError:  # the public pattern of this vocabulary
            PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield texts.map(lambda t: len(encoding.encode_ordinary(t))).astype("int64")

    known = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null and text <> ''")
    return known.select("doc_id", count("text").alias("tokens")).groupBy("doc_id").agg(F.max("tokens").alias("tokens")).where("tokens > 0")


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Windows that any packing needs: by volume, and with large items that cannot share."""
    total = sum(sizes)
    best = -(-total // capacity)
    for k in (capacity // 2, capacity // 3):
        large = [s for s in sizes if s > capacity - k]
        middle = [s for s in sizes if capacity / 2 < s <= capacity - k]
        small = sum(s for s in sizes if k <= s <= capacity / 2)
        room = len(middle) * capacity - sum(middle)
        best = max(best, len(large) + len(middle) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the fullest window with room takes the next item."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(rooms, (s, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(s)
        bisect.insort(rooms, (room - s, b))
    return bins


class _Left:
    """The items left, as sorted distinct sizes with counts."""

    def __init__(self, sizes: list[int]):
        self.count = Counter(sizes)
        self.distinct = sorted(self.count)
        self.total = sum(sizes)

    def take(self, chosen: list[tuple[int, int]]) -> None:
        for s, n in chosen:
            self.total -= s * n
            self.count[s] -= n
            if not self.count[s]:
                del self.distinct[bisect.bisect_left(self.distinct, s)]
                del self.count[s]

    def give(self, chosen: list[tuple[int, int]]) -> None:
        for s, n in chosen:
            self.total += s * n
            if s not in self.count:
                bisect.insort(self.distinct, s)
            self.count[s] += n


class Steps:
    """How many steps a search may still take; None is without end."""

    def __init__(self, most: int | None):
        self.left = most

    def take(self) -> bool:
        if self.left is None:
            return True
        self.left -= 1
        return self.left >= 0


def _dominated(left: _Left, chosen: list[tuple[int, int]], waste: int) -> bool:
    """Whether an item left fits into the waste, or a larger item left could stand in for one of the filling's."""
    used = dict(chosen)
    for y in (0, *used):
        at = bisect.bisect_right(left.distinct, y + waste) - 1
        while at >= 0 and left.distinct[at] > y:
            if left.count[left.distinct[at]] > used.get(left.distinct[at], 0):
                return True
            at -= 1
    return False


def completions(left: _Left, room: int, most_waste: int, steps: Steps) -> Iterator[list[tuple[int, int]]]:
    """All undominated fillings of ``room`` by items left, as (size, number) from the largest size down, fullest
    choices first. The search goes over distinct sizes with a stack of its own, so neither the number of items in
    a filling nor its depth is limited; it ends early only when ``steps`` are used up."""
    distinct = left.distinct
    # a level of the stack: index of the size, room before it, number still to be tried of it
    stack: list[list[int]] = []
    chosen: list[tuple[int, int]] = []
    at, free = bisect.bisect_right(distinct, room) - 1, room
    while True:
        # descend: of every size as many as fit
        while at >= 0 and free >= distinct[0] and steps.take():
            s = distinct[at]
            n = min(left.count[s], free // s)
            stack.append([at, free, n])
            if n:
                chosen.append((s, n))
                free -= n * s
            at = min(at - 1, bisect.bisect_right(distinct, free) - 1)
        if steps.left is not None and steps.left < 0:
            return
        if free <= most_waste and not _dominated(left, chosen, free):
            yield list(chosen)
        # climb to the last level where one fewer can be tried; what smaller sizes are left bounds the waste
        while stack:
            level = stack[-1]
            at, before, n = level
            s = distinct[at]
            if n:
                chosen.pop()
            if n > 0 and steps.take():
                level[2] = n - 1
                if n > 1:
                    chosen.append((s, n - 1))
                free = before - (n - 1) * s
                below = 0
                for k in range(at):
                    below += distinct[k] * left.count[distinct[k]]
                    if free - below <= most_waste:
                        break
                if free - below <= most_waste:
                    at = min(at - 1, bisect.bisect_right(distinct, free) - 1)
                    break
                if n > 1:
                    chosen.pop()
                level[2] = 0
                stack.pop()
                continue
            stack.pop()
        else:
            return


def pack(sizes: list[int], capacity: int, steps: int | None = 50_000) -> list[list[int]]:
    """Windows of item sizes, each at most ``capacity`` in sum: branch and bound over the fillings around the largest
    item left. A branch ends when it wastes more than any better packing may. Best-fit decreasing is the first
    incumbent; after ``steps`` steps the best packing met is given, with None the search goes on until no better one
    can be, which may take exponential time."""
    best = best_fit(sizes, capacity)
    least = lower_bound(sizes, capacity)
    total = sum(sizes)
    left, budget = _Left(sizes), Steps(steps)
    bins: list[list[tuple[int, int]]] = []
    options: list[Iterator[list[tuple[int, int]]]] = []
    wasted = 0

    def opened() -> Iterator[list[tuple[int, int]]]:
        """Fillings of the next window, if a better packing may still come of it, made one at a time on a copy."""
        allowed = (len(best) - 1) * capacity - total - wasted
        if allowed < 0 or len(bins) + -(-left.total // capacity) >= len(best):
            return iter(())
        large, own = left.distinct[-1], copy.deepcopy(left)
        own.take([(large, 1)])
        return ([(large, 1), *filling] for filling in completions(own, capacity - large, allowed, budget))

    def back() -> None:
        nonlocal wasted
        gone = bins.pop()
        wasted -= capacity - sum(s * n for s, n in gone)
        left.give(gone)

    if len(best) > least and sizes:
        options.append(opened())
    while options and len(best) > least and (budget.left is None or budget.left >= 0):
        filling = next(options[-1], None)
        if filling is None:
            options.pop()
            if bins:
                back()
            continue
        left.take(filling)
        bins.append(filling)
        wasted += capacity - sum(s * n for s, n in filling)
        if left.count:
            options.append(opened())
        else:
            if len(bins) < len(best):
                best = [[s for s, n in b for _ in range(n)] for b in bins]
            back()
    if len(best) > least and bins:
        rest = [[s for s, n in b for _ in range(n)] for b in bins] + best_fit([s for s, n in left.count.items() for _ in range(n)], capacity)
        if len(rest) < len(best):
            best = rest
    return best


def windows(spark: SparkSession, documents: DataFrame, capacities: DataFrame, tokenizer_path: str | None = None, shard: int = SHARD) -> DataFrame:
    """(window_name, window_no, doc_id, piece_no, first_token, tokens): where each document, or each
    piece of one above the capacity, lies. piece_no counts from 1, first_token from 0; window_no is
    unique within a window_name. Of the capacities null and non-positive ones are left
    out and repeated names take their smallest. Documents without tokens lie nowhere."""
    counted = materialize(token_counts(documents, tokenizer_path), "tokens")
    caps = capacities.where("window_name is not null and capacity_tokens > 0").groupBy("window_name").agg(F.min("capacity_tokens").alias("c"))
    listed = caps.agg(F.sort_array(F.collect_list(F.struct(F.col("window_name").alias("name"), F.col("c").cast("bigint").alias("cap")))))
    shards = max(1, counted.count() // shard)
    sizes = counted.withColumn("w", F.explode(listed.scalar()))
    sizes = sizes.select(F.col("w.name").alias("window_name"), F.col("w.cap").alias("cap"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "doc_id", "tokens")

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, cap, at = key
        rows, number = [], 0
        waiting: dict[int, list[tuple[int, int, int]]] = {}
        for doc, tokens in zip(pdf["doc_id"], pdf["tokens"]):
            full = tokens // cap if tokens > cap else 0
            for k in range(full):
                rows.append((number, doc, k + 1, k * cap, cap))
                number += 1
            if tokens - full * cap:
                waiting.setdefault(tokens - full * cap, []).append((doc, full + 1, full * cap))
        for window in pack([s for s, v in waiting.items() for _ in v], cap):
            for s in window:
                doc, piece, first = waiting[s].pop()
                rows.append((number, doc, piece, first, s))
            number += 1
        out = pd.DataFrame(rows, columns=["window_no", "doc_id", "piece_no", "first_token", "tokens"]).astype("int64")
        out["window_no"] += at << 32
        out.insert(0, "window_name", name)
        return out

    # shards are small in bytes and long in work: an explicit number keeps them from being put together
    tasks = min(shards * max(1, caps.count()), 8 * spark.sparkContext.defaultParallelism)
    return sizes.repartition(tasks, "window_name", "cap", "shard").groupBy("window_name", "cap", "shard").applyInPandas(fill, "window_name string, window_no bigint, doc_id bigint, piece_no bigint, first_token bigint, tokens bigint")
