"""Words: maximal runs of ASCII letters and digits, letter case ignored."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = re.compile(rb"[a-z0-9]+")
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words_column(text: Column) -> Column:
    """All words of a text in order; null text gives an empty array."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[^a-z0-9]+"), lambda w: w != "")


def words_of(text: str | None) -> list[bytes]:
    """The same in Python, as bytes."""
    return _WORD.findall((text or "").encode("utf-8", "replace").translate(_FOLD))
