"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def seeded(seed: int, *keys: str | Column) -> Column:
    """A text to order by, the same in every run and engine: the SHA-256 of the seed and the keys."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]), 256)
