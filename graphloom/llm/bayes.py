"""Naive Bayes over hashed grams: profiles counted by the executors from weakly labelled rows of a bounded sample."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd

#: Slots that grams are hashed to; with the labels it bounds what is counted, collected and broadcast.
SLOTS = 1 << 15


def slots_of(grams: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(g.encode()) & (SLOTS - 1) for g in grams), "int64", len(grams))


def letter_grams(words: list[str]) -> list[str]:
    """Runs of three letters of words, their ends marked."""
    return [f" {w} "[i : i + 3] for w in words for i in range(len(w))]


def word_grams(words: list[str]) -> list[str]:
    """Words and pairs of words next to each other."""
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


class Counts:
    """Counts by (label, slot) of one task."""

    def __init__(self):
        self.n: Counter = Counter()

    def add(self, label: str, grams: list[str]) -> None:
        for s, n in zip(*np.unique(slots_of(grams), return_counts=True)):
            self.n[label, int(s)] += int(n)

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame([(k, s, n) for (k, s), n in self.n.items()], columns=["label", "slot", "n"]).astype({"slot": "int64", "n": "int64"})


class Profiles:
    """Log probabilities of slots by label, with what a text of that label is expected to score; a label of fewer
    than ``least`` grams is too thin for a profile and left out."""

    def __init__(self, counts: pd.DataFrame, least: int):
        self.log: dict[str, np.ndarray] = {}
        self.expected: dict[str, tuple[float, float]] = {}
        for label, own in counts.groupby("label"):
            n = np.zeros(SLOTS)
            n[own["slot"].to_numpy("int64")] = own["n"].to_numpy("float64")
            if n.sum() >= least:
                p = (n + 0.05) / (n.sum() + 0.05 * SLOTS)
                log = np.log(p)
                mean = float((p * log).sum())
                self.log[str(label)] = log.astype("float32")
                self.expected[str(label)] = (mean, float(np.sqrt(max(0.0, (p * log**2).sum() - mean**2))))

    def scores(self, grams: list[str]) -> dict[str, float]:
        """Mean log probability of the grams by label."""
        at = slots_of(grams)
        return {k: float(v[at].mean()) for k, v in self.log.items()} if len(at) else {}

    def foreign(self, label: str, grams: list[str]) -> bool:
        """Whether a text scores far below what texts of the label do. Grams overlap, so a third of them counts."""
        if label not in self.log or len(set(grams)) < 40:
            return False
        mean, deviation = self.expected[label]
        score = float(self.log[label][slots_of(grams)].mean())
        return mean - score > max(1.0, 8 * deviation / (len(grams) / 3) ** 0.5)
