"""Columns that ride along while an operator works, whatever their names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def riding(df: DataFrame, *without: str, replaced: Iterable[str] = ()) -> tuple[list[str], Column]:
    """Names of ``df`` that the result keeps, and all of them but ``without`` as one struct."""
    names = [c for c in df.columns if c not in set(replaced)]
    inside = [F.col(f"`{c}`").alias(c) for c in names if c not in without]
    return names, F.struct(*inside, F.lit(0).alias("__")).alias("_row")  # a struct needs a field


def unpacked(names: Iterable[str], **others: str) -> list[Column]:
    """The columns of a ridden row in their order; ``others`` maps names to columns that were kept outside."""
    return [F.col(others[c]).alias(c) if c in others else F.col(f"_row.`{c}`").alias(c) for c in names]
