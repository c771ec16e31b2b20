"""Deterministic draws and hash folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_SPAN = 1 << 32


def draw(*parts) -> Column:
    """A 32-bit number from the md5 of the parts joined by '|'; the same on every engine."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def long_draw(*parts) -> Column:
    """The same with 60 bits, for row numbers of large tables."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """A number in [0, 1) from `draw`."""
    return draw(*parts) / F.lit(float(DRAW_SPAN))


def fold_tokens(tokens: Column, bits: int) -> Column:
    """Sorted distinct bit positions set by an array of tokens."""
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: draw(t) % bits)))


def fold_tokens_fast(tokens: Column, bits: int) -> Column:
    """The same with xxhash64, for keys that need no twin outside Spark."""
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(bits)))))
