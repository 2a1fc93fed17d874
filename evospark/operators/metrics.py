"""Long (name, type, value) metrics: latest values, pivots, baselines, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evospark.functions.coerce import float_or_null, not_nan, record_bool, record_int, with_number_fields
from evospark.functions.keys import control_key, generation_key
from evospark.functions.quantiles import exact_percentiles

# Metric names and types.
DNA_NAMES = ["dna_yield_raw", "dna_yield"]
PROTEIN_NAMES = ["protein_yield_raw", "protein_yield"]
ACTIVITY = ("activity_score", "derived")
MUTATION_TOTAL = ("mutation_total_count", "derived")
MUTATION_SYN = ("mutation_synonymous_count", "derived")
MUTATION_NONSYN = ("mutation_nonsynonymous_count", "derived")


def _value_named(names: Sequence[str]) -> Column:
    return F.when(F.col("metric_name").isin(list(names)), F.col("value"))


def latest_metrics(metrics: DataFrame, wanted: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Newest value (highest ``metric_id``) per variant for several metrics at
    once: one shuffle for all of them, no self-join."""
    match = {
        out: (F.col("metric_name") == name) & (F.col("metric_type") == kind)
        for out, (name, kind) in wanted.items()
    }
    keep = None
    for cond in match.values():
        keep = cond if keep is None else keep | cond
    return (
        metrics.where(keep & F.col("variant_id").isNotNull())
        .groupBy("variant_id")
        .agg(*[F.max_by("value", F.when(cond, F.col("metric_id"))).alias(out) for out, cond in match.items()])
    )


def latest_metric(metrics: DataFrame, name: str, kind: str, out: str = "value") -> DataFrame:
    """Newest value per variant of one metric; variants without it are absent."""
    return (
        metrics.where(
            (F.col("metric_name") == name)
            & (F.col("metric_type") == kind)
            & F.col("variant_id").isNotNull()
        )
        .groupBy("variant_id")
        .agg(F.max_by("value", "metric_id").alias(out))
    )


def raw_yields(variants: DataFrame, metrics: DataFrame) -> DataFrame:
    """Raw DNA and protein yield of every variant; both metric spellings count."""
    pivot = (
        metrics.where(
            (F.col("metric_type") == "raw")
            & F.col("metric_name").isin(DNA_NAMES + PROTEIN_NAMES)
            & F.col("variant_id").isNotNull()
        )
        .groupBy("variant_id")
        .agg(
            F.max(_value_named(DNA_NAMES)).alias("dna_yield_raw"),
            F.max(_value_named(PROTEIN_NAMES)).alias("protein_yield_raw"),
        )
    )
    columns = [
        c
        for c in ("experiment_id", "variant_id", "generation_id", "generation_number", "plasmid_variant_index")
        if c in variants.columns
    ]
    return variants.select(*columns).join(pivot, "variant_id", "left")


def wt_baselines(metrics: DataFrame) -> DataFrame:
    """Mean raw control yields per generation; only complete ones are usable."""
    return (
        metrics.where(
            F.col("wt_control_id").isNotNull()
            & (F.col("metric_type") == "raw")
            & F.col("metric_name").isin(DNA_NAMES + PROTEIN_NAMES)
        )
        .groupBy("generation_id")
        .agg(
            F.avg(not_nan(_value_named(DNA_NAMES))).alias("dna_wt"),
            F.avg(not_nan(_value_named(PROTEIN_NAMES))).alias("prot_wt"),
        )
        .where(F.col("dna_wt").isNotNull() & F.col("prot_wt").isNotNull())
    )


def generations_without_baseline(generations: DataFrame, baselines: DataFrame) -> DataFrame:
    """Generations that have no usable control baseline (NaN counts as missing)."""
    usable = baselines.where(
        not_nan(F.col("dna_wt")).isNotNull() & not_nan(F.col("prot_wt")).isNotNull()
    )
    return generations.join(usable, "generation_id", "left_anti")


def control_means(records: DataFrame) -> DataFrame:
    """Control replicates of an upload, averaged per generation, as long rows."""
    records = with_number_fields(records)
    means = (
        records.where(F.coalesce(record_bool("control"), F.lit(False)))
        .groupBy(
            "experiment_id",
            F.coalesce(record_int("generation"), F.lit(0)).alias("generation_number"),
        )
        .agg(
            F.avg(float_or_null(F.col("dna_yield"))).alias("dna_yield_raw"),
            F.avg(float_or_null(F.col("protein_yield"))).alias("protein_yield_raw"),
        )
    )
    long = means.unpivot(
        ["experiment_id", "generation_number"],
        ["dna_yield_raw", "protein_yield_raw"],
        "metric_name",
        "value",
    ).where(F.col("value").isNotNull())
    return long.select(
        "experiment_id",
        generation_key("experiment_id", "generation_number").alias("generation_id"),
        "generation_number",
        control_key("experiment_id", "generation_number").alias("wt_control_id"),
        "metric_name",
        F.lit("raw").alias("metric_type"),
        "value",
        F.when(F.col("metric_name") == "dna_yield_raw", "fg").otherwise("pg").alias("unit"),
    )


def distribution_rows(variants: DataFrame, metrics: DataFrame) -> DataFrame:
    """(experiment, generation, activity) rows behind the distribution plot."""
    scores = latest_metric(metrics, *ACTIVITY, out="activity_score")
    return variants.join(scores, "variant_id").select(
        "experiment_id", "generation_number", "variant_id", "activity_score"
    )


def distribution_summary(rows: DataFrame, keys: Sequence[str], value: str = "activity_score") -> DataFrame:
    """Count, min, max, mean, median and quartiles per group."""
    clean = rows.withColumn(value, not_nan(F.col(value).cast("double"))).where(
        F.col(value).isNotNull()
    )
    plain = clean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("mean_value"),
    )
    quart = exact_percentiles(clean, keys, value, {"q1": 0.25, "median_value": 0.5, "q3": 0.75})
    return plain.join(quart, list(keys))


def numeric_profile(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """min, p1, p5, p25, median, p75, p95, max and n of a numeric column."""
    marks = {"min_value": 0.0, "p1": 0.01, "p5": 0.05, "p25": 0.25, "median_value": 0.5,
             "p75": 0.75, "p95": 0.95, "p99": 0.99, "max_value": 1.0}
    n = (
        rows.where(not_nan(F.col(value).cast("double")).isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    prof = exact_percentiles(rows, keys, value, marks)
    return prof.join(n, list(keys)) if keys else prof.crossJoin(n)


def scored_counts(variants: DataFrame, metrics: DataFrame) -> DataFrame:
    """Number of scored rows per experiment; experiments without any are absent."""
    rows = metrics.where(
        (F.col("metric_name") == ACTIVITY[0]) & (F.col("metric_type") == ACTIVITY[1])
    ).select("variant_id")
    return (
        rows.join(variants.select("variant_id", "experiment_id"), "variant_id")
        .groupBy("experiment_id")
        .agg(F.count(F.lit(1)).alias("scored_rows"))
    )


def generation_of_metric(metrics: DataFrame, variants: DataFrame, controls: DataFrame) -> DataFrame:
    """Derive ``generation_id`` from the owner of the metric (variant or control)."""
    by_variant = variants.select("variant_id", F.col("generation_id").alias("_gv"))
    by_control = controls.select("wt_control_id", F.col("generation_id").alias("_gc"))
    return (
        metrics.drop("generation_id")
        .join(by_variant, "variant_id", "left")
        .join(by_control, "wt_control_id", "left")
        .withColumn("generation_id", F.coalesce("_gv", "_gc"))
        .drop("_gv", "_gc")
    )


def fill_definition_ids(metrics: DataFrame, definitions: DataFrame) -> DataFrame:
    """Fill missing ``metric_definition_id`` by metric name."""
    names = definitions.select(
        F.col("name").alias("metric_name"), F.col("metric_definition_id").alias("_def")
    )
    return (
        metrics.join(names, "metric_name", "left")
        .withColumn("metric_definition_id", F.coalesce("metric_definition_id", "_def"))
        .drop("_def")
    )


def metric_violations(metrics: DataFrame) -> DataFrame:
    """Rows that break the integrity rules of the metrics table."""
    owner = metrics.where(
        F.col("variant_id").isNull() == F.col("wt_control_id").isNull()
    ).select("generation_id", "variant_id", "wt_control_id", "metric_name", "metric_type",
             F.lit("owner").alias("rule"))
    kind = metrics.where(
        ~F.col("metric_type").isin("raw", "normalized", "derived")
    ).select("generation_id", "variant_id", "wt_control_id", "metric_name", "metric_type",
             F.lit("metric_type").alias("rule"))
    twice = (
        metrics.groupBy("generation_id", "variant_id", "wt_control_id", "metric_name", "metric_type")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
        .withColumn("rule", F.lit("unique"))
    )
    return owner.unionByName(kind).unionByName(twice)
