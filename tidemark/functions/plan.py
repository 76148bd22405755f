"""Plan-shaping helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def materialize(df: DataFrame, **cols: Column) -> DataFrame:
    """Add computed columns behind a Generate node so the optimizer cannot
    inline them into their consumers.

    ``CollapseProject`` inlines a producer whose consumers only extract from it
    (``v[i]``), which would re-evaluate an expensive expression (e.g. a text
    encoder) once per extracted component.  A one-element ``inline`` costs one
    generated row per input row and keeps the value computed exactly once."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
