"""Activity scores: wild-type-normalised, median-normalised, and mode choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evospark.functions.coerce import finite, not_nan
from evospark.functions.quantiles import with_group_median

# Fixed value: normalised protein yields at or below this are not divided by.
SMALLEST_PROTEIN_NORM = 1e-9

SCORED = ["dna_yield_norm", "protein_yield_norm", "activity_score", "qc_stage4"]


def score_against_wt(variants: DataFrame, baselines: DataFrame) -> DataFrame:
    """Score every variant against the control baseline of its generation.

    Adds ``dna_yield_norm``, ``protein_yield_norm``, ``activity_score`` and the
    reason code ``qc_stage4`` (``ok`` when scored).
    """
    base = baselines.select("generation_id", "dna_wt", "prot_wt", F.lit(True).alias("_has_wt"))
    dna, prot = not_nan(F.col("dna_yield_raw")), not_nan(F.col("protein_yield_raw"))
    dna_wt, prot_wt = not_nan(F.col("dna_wt")), not_nan(F.col("prot_wt"))
    reason = (
        F.when(dna.isNull() | prot.isNull(), "missing_raw_metrics")
        .when((dna <= 0) | (prot <= 0), "nonpositive_raw_metrics")
        .when(F.col("_has_wt").isNull(), "missing_wt_baseline")
        .when(
            dna_wt.isNull() | prot_wt.isNull() | (dna_wt <= 0) | (prot_wt <= 0),
            "invalid_wt_baseline",
        )
        .when(prot / prot_wt <= SMALLEST_PROTEIN_NORM, "protein_norm_too_small")
        .otherwise("ok")
    )
    normed = F.col("qc_stage4").isin("ok", "protein_norm_too_small")
    return (
        variants.join(base, "generation_id", "left")
        .withColumn("qc_stage4", reason)
        .withColumn("dna_yield_norm", F.when(normed, F.try_divide("dna_yield_raw", "dna_wt")))
        .withColumn("protein_yield_norm", F.when(normed, F.try_divide("protein_yield_raw", "prot_wt")))
        .withColumn(
            "activity_score",
            F.when(
                F.col("qc_stage4") == "ok", F.try_divide("dna_yield_norm", "protein_yield_norm")
            ),
        )
        .drop("_has_wt", "dna_wt", "prot_wt")
    )


def score_against_medians(variants: DataFrame) -> DataFrame:
    """Score every variant against the median yields of its generation."""
    yields = {"dna_yield_raw": "dna_med", "protein_yield_raw": "prot_med"}

    def ratio(top: str, bottom: str) -> Column:
        return finite(F.try_divide(not_nan(F.col(top)), F.nullif(not_nan(F.col(bottom)), F.lit(0.0))))

    return (
        with_group_median(variants, ["generation_id"], yields)
        .withColumn("dna_yield_norm", ratio("dna_yield_raw", "dna_med"))
        .withColumn("protein_yield_norm", ratio("protein_yield_raw", "prot_med"))
        .withColumn("activity_score", ratio("dna_yield_norm", "protein_yield_norm"))
        .withColumn(
            "qc_stage4",
            F.when(F.col("activity_score").isNull(), "invalid_fallback").otherwise("ok"),
        )
        .drop("dna_med", "prot_med")
    )


def scoring_modes(generations: DataFrame, baselines: DataFrame, mode: str = "auto") -> DataFrame:
    """Mode of each experiment and the number of generations without baseline.

    ``auto``: wild-type mode if any generation has a baseline, else medians.
    ``wt``: wild-type mode always. ``fallback``: medians always.
    """
    if mode not in {"auto", "wt", "fallback"}:
        raise ValueError("mode must be auto, wt or fallback")
    flagged = generations.join(
        baselines.select("generation_id", F.lit(1).alias("_has_wt")), "generation_id", "left"
    )
    counts = flagged.groupBy("experiment_id").agg(
        F.count("_has_wt").alias("generations_with_baseline"),
        (F.count(F.lit(1)) - F.count("_has_wt")).alias("generations_without_baseline"),
    )
    if mode == "auto":
        chosen = F.when(F.col("generations_with_baseline") > 0, "wt").otherwise("fallback")
    else:
        chosen = F.lit(mode)
    return counts.withColumn("scoring_mode", chosen)


def strict_mode_failures(modes: DataFrame) -> DataFrame:
    """Experiments that strict wild-type mode must refuse."""
    return modes.where(
        (F.col("scoring_mode") == "wt") & (F.col("generations_without_baseline") > 0)
    )


def score_experiments(
    variants: DataFrame, baselines: DataFrame, generations: DataFrame, mode: str = "auto",
    *, strict: bool = False,
) -> DataFrame:
    """Score all experiments, each in its own mode (column ``scoring_mode``).

    With ``strict`` an experiment in wild-type mode that lacks a baseline in any
    generation is an error.
    """
    modes = scoring_modes(generations, baselines, mode)
    if strict:
        bad = strict_mode_failures(modes).select("experiment_id").limit(20).collect()
        if bad:
            raise ValueError(f"missing wild-type baselines in experiments {[r[0] for r in bad]}")
    tagged = variants.join(modes.select("experiment_id", "scoring_mode"), "experiment_id")
    wt = score_against_wt(tagged.where("scoring_mode = 'wt'"), baselines)
    med = score_against_medians(tagged.where("scoring_mode = 'fallback'"))
    return wt.unionByName(med)


def scoring_labels(modes: DataFrame) -> DataFrame:
    """Texts a report shows for the chosen mode."""
    wt = F.col("scoring_mode") == "wt"
    return modes.withColumn(
        "baseline_used", F.when(wt, "WT=1.0").otherwise("Generation median=1.0")
    ).withColumn(
        "scoring_method",
        F.when(wt, "WT-normalized ratio").otherwise("Fallback ratio (DNA_norm/Protein_norm)"),
    )


def score_metric_rows(scored: DataFrame) -> DataFrame:
    """Three long metric rows (two norms, one score) per variant that passed."""
    rows = scored.where("qc_stage4 = 'ok'").unpivot(
        ["generation_id", "variant_id"],
        ["dna_yield_norm", "protein_yield_norm", "activity_score"],
        "metric_name",
        "value",
    )
    return rows.select(
        "generation_id",
        "variant_id",
        F.lit(None).cast("bigint").alias("wt_control_id"),
        "metric_name",
        F.when(F.col("metric_name") == "activity_score", "derived")
        .otherwise("normalized")
        .alias("metric_type"),
        "value",
        F.lit("ratio").alias("unit"),
        F.lit(None).cast("bigint").alias("metric_definition_id"),
    )


def qc_histogram(scored: DataFrame, keys: tuple[str, ...] = ("experiment_id",)) -> DataFrame:
    """How many variants carry each reason code."""
    return scored.groupBy(*keys, "qc_stage4").agg(F.count(F.lit(1)).alias("variants"))


def formula_violations(scored: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Scored rows whose score is not the ratio of their norms (should be none)."""
    ok = scored.where("qc_stage4 = 'ok'")
    gap = F.abs(F.col("activity_score") - F.try_divide("dna_yield_norm", "protein_yield_norm"))
    return ok.where(
        F.col("activity_score").isNull() | (gap > tolerance * F.greatest(F.lit(1.0), F.abs("activity_score")))
    )


def top10_violations(top10: DataFrame, scored: DataFrame) -> DataFrame:
    """Experiments in which an unlisted variant beats the worst listed one."""
    worst = top10.groupBy("experiment_id").agg(
        F.min("activity_score").alias("_worst"), F.count(F.lit(1)).alias("_listed")
    )
    rest = scored.where(F.col("activity_score").isNotNull()).join(
        top10.select("variant_id"), "variant_id", "left_anti"
    )
    return (
        rest.groupBy("experiment_id")
        .agg(F.max("activity_score").alias("_best_unlisted"))
        .join(worst, "experiment_id", "left")
        .where(
            F.col("_worst").isNull()
            | (F.col("_listed") < 10)
            | (F.col("_best_unlisted") > F.col("_worst"))
        )
        .select("experiment_id")
    )
