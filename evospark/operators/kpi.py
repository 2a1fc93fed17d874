"""Headline numbers of every experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evospark.functions.ordering import top_k
from evospark.functions.quantiles import exact_percentiles
from evospark.operators.metrics import ACTIVITY, MUTATION_SYN, MUTATION_TOTAL, latest_metrics


def common_mutations(variants: DataFrame, mutations: DataFrame, k: int = 3) -> DataFrame:
    """The most frequent protein changes of each experiment as one text."""
    counts = (
        mutations.where(
            (F.col("mutation_type") == "protein") & F.col("original").isNotNull()
            & F.col("mutated").isNotNull() & F.col("position").isNotNull()
        )
        .join(variants.select("variant_id", "experiment_id"), "variant_id")
        .groupBy(
            "experiment_id",
            F.concat("original", F.col("position").cast("string"), "mutated").alias("label"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = top_k(counts, ["experiment_id"], [F.col("n").desc(), F.col("label").asc()], k)
    items = F.array_sort(
        F.collect_list(F.struct("rank", F.concat("label", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("text")))
    )
    return best.groupBy("experiment_id").agg(
        F.array_join(F.transform(items, lambda i: i["text"]), ", ").alias("most_common_mutations")
    )


def experiment_kpis(
    variants: DataFrame, metrics: DataFrame, mutations: DataFrame, analysis: DataFrame
) -> DataFrame:
    """One row per experiment with all headline numbers."""
    latest = latest_metrics(
        metrics, {"activity_score": ACTIVITY, "_total": MUTATION_TOTAL, "_syn": MUTATION_SYN}
    )
    analysed = analysis.select("variant_id").distinct().withColumn("_analysed", F.lit(1))
    nonsyn = (
        mutations.where("mutation_type = 'protein'")
        .groupBy("variant_id")
        .agg(F.count(F.lit(1)).alias("_protein_rows"))
    )
    wide = (
        variants.select("experiment_id", "generation_number", "variant_id")
        .join(latest, "variant_id", "left")
        .join(analysed, "variant_id", "left")
        .join(nonsyn, "variant_id", "left")
    )
    base = wide.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min("generation_number").alias("_g0"),
        F.max("generation_number").alias("_g1"),
        F.avg("activity_score").alias("activity_mean"),
        F.max("activity_score").alias("activity_best"),
        F.count("_analysed").alias("_analysed"),
        F.count_if(F.col("_total") > 0).alias("_mutated"),
        F.coalesce(F.sum("_syn"), F.lit(0.0)).cast("bigint").alias("_syn"),
        F.coalesce(F.sum("_protein_rows"), F.lit(0)).alias("_nonsyn"),
    )
    median = exact_percentiles(wide, ["experiment_id"], "activity_score", {"activity_median": 0.5})
    ratio = (
        F.when(
            F.col("_nonsyn") > 0,
            F.format_string("%d:%d (%.2f)", "_syn", "_nonsyn", F.try_divide(F.col("_syn"), F.col("_nonsyn"))),
        )
        .when(F.col("_syn") > 0, F.format_string("%d:0", "_syn"))
    )
    return (
        base.join(median, "experiment_id", "left")
        .join(common_mutations(variants, mutations), "experiment_id", "left")
        .select(
            "experiment_id",
            "total_records",
            F.format_string("G%d to G%d", "_g0", "_g1").alias("generations_covered"),
            "activity_mean",
            "activity_median",
            "activity_best",
            F.when(F.col("_analysed") > 0, F.bround(F.col("_mutated") / F.col("_analysed") * 100, 1)).alias("mutated_percent"),
            "most_common_mutations",
            ratio.alias("syn_non_syn_ratio"),
        )
    )


def completeness(
    variants: DataFrame, analysis: DataFrame, experiments: DataFrame, *, force: bool = False
) -> DataFrame:
    """How far the sequence analysis of each experiment has come, and whether
    it has to run again."""
    rows = analysis.groupBy("variant_id").agg(F.count(F.lit(1)).alias("_rows"))
    counts = (
        variants.join(rows, "variant_id", "left")
        .groupBy("experiment_id")
        .agg(
            F.count(F.lit(1)).alias("total_variants"),
            F.count("_rows").alias("analysed_variants"),
            F.coalesce(F.sum("_rows"), F.lit(0)).alias("analysis_rows"),
            F.count_if(F.trim(F.coalesce("protein_sequence", F.lit(""))) != "").alias("protein_ready"),
        )
    )
    numbers = ["total_variants", "analysed_variants", "analysis_rows", "protein_ready"]
    state = experiments.select("experiment_id", "status").join(counts, "experiment_id", "left").fillna(0, numbers)
    has = F.col("total_variants") > 0
    backfill = has & (
        F.col("status").isNull() | (F.col("status") == "FAILED")
        | (F.col("analysis_rows") < F.col("total_variants")) | (F.col("protein_ready") == 0)
    )
    return state.withColumn(
        "outputs_complete", has & (F.col("analysed_variants") >= F.col("total_variants"))
    ).withColumn("needs_backfill", F.lit(force) | backfill)
