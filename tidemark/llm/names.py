"""Columns of the input whose names an operator gives to results of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keeping(df: DataFrame, used: Iterable[str], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of f(df) with df's own columns. Columns that bear one of the used names go through f
    under another name and come back as they were."""
    taken = {x.lower() for x in used}
    aside = {c: f"_own_{c}" for c in df.columns if c.lower() in taken}
    return f(df.withColumnsRenamed(aside)).select(*[F.col(aside.get(c, c)).alias(c) for c in df.columns])
