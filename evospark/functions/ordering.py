"""Top-k and complete rankings of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evospark.session import cut_lineage


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every group with their 1-based position.

    Spark turns ``row_number() <= k`` into a per-task limit before the shuffle,
    so a hot group sends at most ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def rank_all(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    rank: str = "rank",
    partitions: int | None = None,
) -> DataFrame:
    """1-based position of *every* row in its group, also for a hot group.

    The rows are range-partitioned by (group, order), so one group spreads over
    many tasks; each task numbers its own rows and adds the number of rows the
    group has in earlier tasks. The order must be total (end it with a unique
    key), and the ranged rows are checkpointed so both uses see one split.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn(
            "_task", F.spark_partition_id()
        )
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_task")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranged.groupBy(*keys, "_task")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_task").orderBy(*order)
    return (
        ranged.withColumn("_pos", F.row_number().over(inside))
        .join(offsets, [*keys, "_task"])
        .withColumn(rank, F.col("_pos") + F.col("_offset"))
        .drop("_pos", "_offset", "_task")
    )
