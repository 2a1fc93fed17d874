"""Exact quantiles of groups of any size, without gathering a group.

Spark's built-in ``percentile`` keeps one counter per distinct value of a group
in a single task, which fails when one experiment holds a third of all rows.
Here the values are counted once (hash-distributed over all tasks) and the
wanted ranks are found by narrowing two monotone histograms over those counts.
Every window below runs over histogram buckets of a bounded number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSE_PER_LOG = 512  # coarse buckets per factor e; log is monotone, so is the bucket
COARSE_SHIFT = 400_000  # keeps the bucket number of every positive double positive
FINE_STEPS = float(2**30)  # fine buckets per unit of relative width


def _coarse(v: Column) -> Column:
    size = F.floor(F.ln(F.abs(v)) * COARSE_PER_LOG) + COARSE_SHIFT
    finite = F.abs(v) < F.lit(float("inf"))
    return (
        F.when(v == 0, F.lit(0).cast("bigint"))
        .when(finite, F.when(v > 0, size).otherwise(-size))
        .otherwise(F.when(v > 0, F.lit(10_000_000)).otherwise(F.lit(-10_000_000)))
    )


def _fine(v: Column, coarse: Column) -> Column:
    relative = F.abs(v) * F.exp(-(F.abs(coarse) - COARSE_SHIFT) / COARSE_PER_LOG)
    step = F.floor((relative - 1) * FINE_STEPS)
    usual = (F.abs(v) > 1e-300) & (F.abs(v) < F.lit(float("inf")))
    return F.when(usual, F.when(v > 0, step).otherwise(-step)).otherwise(F.lit(0).cast("bigint"))


def _narrow(hist: DataFrame, parent: DataFrame | None, path: list[str], bucket: str) -> DataFrame:
    """Buckets of ``hist`` that hold a wanted rank, with the ranks they hold."""
    running = (
        Window.partitionBy(*path)
        .orderBy(bucket)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    if parent is None:
        spread = hist
        base = F.lit(0)
    else:
        spread = hist.join(parent, path)
        base = F.col("_before")
    spread = spread.withColumn("_upto", F.sum("_n").over(running) + base)
    return (
        spread.withColumn("_start", F.col("_upto") - F.col("_n"))
        .withColumn(
            "_want",
            F.filter(
                "_want",
                lambda w: (w["rank"] >= F.col("_start")) & (w["rank"] < F.col("_upto")),
            ),
        )
        .where(F.size("_want") > 0)
        .select(*path, bucket, F.col("_start").alias("_before"), "_want")
    )


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Linearly interpolated percentiles per group.

    ``probs`` maps output column names to probabilities in [0, 1]. NULL and NaN
    values do not count. A group without values has no row.
    """
    names = list(probs)
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    number = F.col(value).cast("double")
    counts = (
        df.select(key.alias("_k"), number.alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .withColumn("_b0", _coarse(F.col("_v")))
        .withColumn("_b1", _fine(F.col("_v"), F.col("_b0")))
        .groupBy("_k", "_b0", "_b1", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    whole = Window.partitionBy("_k")

    def wanted(i: int, p: float) -> list[Column]:
        pos = (F.col("_total") - 1) * F.lit(float(p))
        return [
            F.struct(F.lit(2 * i).alias("slot"), F.floor(pos).alias("rank")),
            F.struct(F.lit(2 * i + 1).alias("slot"), F.ceil(pos).alias("rank")),
        ]

    coarse = (
        counts.groupBy("_k", "_b0")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_want", F.array(*[s for i, n in enumerate(names) for s in wanted(i, probs[n])]))
    )
    level0 = _narrow(coarse, None, ["_k"], "_b0")
    fine = counts.groupBy("_k", "_b0", "_b1").agg(F.sum("_n").alias("_n"))
    level1 = _narrow(fine, level0, ["_k", "_b0"], "_b1")
    level2 = _narrow(counts, level1, ["_k", "_b0", "_b1"], "_v")

    totals = counts.groupBy("_k").agg(F.sum("_n").alias("_total"))
    hits = level2.select("_k", "_v", F.explode("_want").alias("_w"))
    picked = hits.groupBy("_k").agg(
        *[
            F.max(F.when(F.col("_w.slot") == slot, F.col("_v"))).alias(f"_s{slot}")
            for slot in range(2 * len(names))
        ]
    )

    def blend(i: int, p: float) -> Column:
        pos = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")
        return F.when(low == high, low).otherwise(low + (high - low) * (pos - F.floor(pos)))

    result = picked.join(totals, "_k")
    return result.select(
        *[F.col("_k")[k].alias(k) for k in keys],
        *[blend(i, probs[n]).alias(n) for i, n in enumerate(names)],
    )


def wide_percentiles(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, Mapping[str, float]]
) -> DataFrame:
    """Percentiles of several columns at once: one pass over long rows.

    ``columns`` maps a value column to its outputs (name to probability).
    """
    probs = sorted({p for outs in columns.values() for p in outs.values()})
    marks = {f"_p{i}": p for i, p in enumerate(probs)}
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "_column", "_value")
    found = exact_percentiles(long, [*keys, "_column"], "_value", marks)
    outs = [
        F.max(F.when(F.col("_column") == c, F.col(f"_p{probs.index(p)}"))).alias(name)
        for c, wanted in columns.items()
        for name, p in wanted.items()
    ]
    return found.groupBy(*keys).agg(*outs)


def with_group_median(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Attach group medians to every row. ``columns`` maps value column to output name."""
    med = wide_percentiles(df, keys, {c: {out: 0.5} for c, out in columns.items()})
    return df.join(med, list(keys), "left")
