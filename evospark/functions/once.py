"""Evaluate costly columns once per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluated_once(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Same rows and columns, but later filters and projections read the results
    of ``columns`` instead of repeating their expressions.

    The values pass through a one-element explode. The optimizer does not move
    predicates or merge projections across it.
    """
    kept = [c for c in df.columns if c not in columns]
    packed = df.select(*kept, F.explode(F.array(F.struct(*columns))).alias("_once"))
    out = packed.select(*kept, *[F.col(f"_once.{c}").alias(c) for c in columns])
    return out.select(*df.columns)
