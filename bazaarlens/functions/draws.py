"""Reproducible draws taken from md5, so a draw depends on its labels only.

The same labels give the same integer whatever the partitioning, after a task
retry, and in any other SQL engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["hash60", "draw_index", "HASH_SPACE"]

HASH_SPACE = 1 << 60


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def hash60(*parts) -> Column:
    """60-bit non-negative integer from the first 15 hex digits of md5."""
    text = F.concat_ws("|", *[_text(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def draw_index(n: Column, *parts) -> Column:
    """Uniform index in 0..n-1."""
    return hash60(*parts) % n
