"""Top-10 reports, rank flags and performance rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evospark.functions.coerce import int_or_null, not_nan
from evospark.functions.ordering import rank_all, top_k
from evospark.operators.metrics import ACTIVITY, MUTATION_NONSYN, MUTATION_SYN, MUTATION_TOTAL, latest_metrics


def best_first(score: str = "activity_score", tie: str = "variant_id") -> list[Column]:
    """Score descending, NULL/NaN last, ties by id."""
    return [not_nan(F.col(score)).desc_nulls_last(), F.col(tie).asc()]


def flag_top(
    nodes: DataFrame, k: int = 10, keys: tuple[str, ...] = ("experiment_id",),
    score: str = "activity_score", flag: str = "is_top10",
) -> DataFrame:
    """Add a 0/1 flag for the best ``k`` scored rows of each experiment."""
    scored = nodes.where(not_nan(F.col(score)).isNotNull()).select(*keys, "variant_id", score)
    best = top_k(scored, keys, best_first(score), k).select("variant_id", F.lit(1).alias(flag))
    return (
        nodes.drop(flag).join(best, "variant_id", "left").withColumn(flag, F.coalesce(flag, F.lit(0)))
    )


def similarity_nodes(variants: DataFrame, metrics: DataFrame) -> DataFrame:
    """Network nodes: every variant with its latest score and top-10 flag."""
    scores = latest_metrics(metrics, {"activity_score": ACTIVITY})
    nodes = variants.join(scores, "variant_id", "left")
    return flag_top(nodes)


def mutation_total(json_size: Column | None, json_count: Column | None, metric: Column) -> Column:
    """Mutation total from three sources, in order of trust."""
    sources = [c for c in (json_size, json_count) if c is not None]
    return F.coalesce(*[c.cast("double") for c in sources], metric.cast("double")).cast("int")


def with_totals(variants: DataFrame, metrics: DataFrame) -> DataFrame:
    """Variants with latest score, mutation counts and the resolved total."""
    latest = latest_metrics(
        metrics,
        {
            "activity_score": ACTIVITY,
            "_total": MUTATION_TOTAL,
            "synonymous_count": MUTATION_SYN,
            "nonsynonymous_count": MUTATION_NONSYN,
        },
    )
    df = variants.join(latest, "variant_id", "left")
    size = count = None
    if "sequence_analysis" in variants.columns:
        muts = F.col("sequence_analysis.mutations")
        size = F.when(muts.isNotNull(), F.size(muts))
        count = F.col("sequence_analysis.mutation_counts.total")
    return df.withColumn("total_mutations", mutation_total(size, count, F.col("_total"))).drop("_total")


def top_variants(variants: DataFrame, metrics: DataFrame, k: int = 10) -> DataFrame:
    """Best ``k`` variants of every experiment with their mutation totals."""
    rows = with_totals(variants, metrics).where(not_nan(F.col("activity_score")).isNotNull())
    return top_k(rows, ["experiment_id"], best_first(), k).select(
        "experiment_id", "rank", "variant_id", "generation_number", "plasmid_variant_index",
        "activity_score", "total_mutations",
    )


def mutation_label(total: Column, syn: Column, nonsyn: Column) -> Column:
    """Class of a variant by its mutation counts (missing counts are zero)."""
    syn_n, nonsyn_n = F.coalesce(syn, F.lit(0)), F.coalesce(nonsyn, F.lit(0))
    return (
        F.when(total == 0, "No mutation detected")
        .when((nonsyn_n > 0) & (syn_n > 0), "Mixed (synonymous + non-synonymous)")
        .when(nonsyn_n > 0, "Non-synonymous")
        .when(syn_n > 0, "Synonymous-only")
        .otherwise("Unknown")
    )


def change_lists(mutations: DataFrame) -> DataFrame:
    """Ordered text lists of the protein changes and sites of each variant."""
    protein = mutations.where("mutation_type = 'protein'").withColumn(
        "_label",
        F.concat(F.coalesce("original", F.lit("")), F.coalesce(F.col("position").cast("string"), F.lit("")),
                 F.coalesce("mutated", F.lit(""))),
    )
    items = F.array_sort(F.collect_list(F.struct("position", "mutation_id", "_label")))
    return protein.groupBy("variant_id").agg(items.alias("_items")).select(
        "variant_id",
        F.array_join(F.transform("_items", lambda i: i["_label"]), ", ").alias("aa_changes"),
        F.array_join(F.transform("_items", lambda i: i["position"].cast("string")), ", ").alias("aa_sites"),
    )


def enriched_top_variants(
    variants: DataFrame, metrics: DataFrame, mutations: DataFrame, qc: DataFrame | None = None, k: int = 10
) -> DataFrame:
    """Top-k with counts, class label, change lists and quality flag.

    The change lists are built for the selected variants only.
    """
    rows = with_totals(variants, metrics).where(not_nan(F.col("activity_score")).isNotNull())
    best = top_k(rows, ["experiment_id"], best_first(), k)
    lists = change_lists(mutations.join(best.select("variant_id"), "variant_id", "left_semi"))
    out = best.join(lists, "variant_id", "left").withColumn(
        "mutation_class",
        mutation_label(F.col("total_mutations"), F.col("synonymous_count"), F.col("nonsynonymous_count")),
    )
    if qc is not None:
        notes = qc.select("variant_id", "qc_stage4")
        out = out.join(notes, "variant_id", "left").withColumn(
            "qc_flagged", F.coalesce(F.col("qc_stage4") != "ok", F.lit(False))
        )
    return out


def performance_rankings(metrics: DataFrame, partitions: int | None = None) -> DataFrame:
    """Position of every variant in its (generation, metric) by latest value."""
    latest = (
        metrics.where(F.col("variant_id").isNotNull())
        .groupBy("generation_id", "variant_id", "metric_name", "metric_type")
        .agg(F.max_by("value", "metric_id").alias("value"))
        .where(not_nan(F.col("value")).isNotNull())
    )
    return rank_all(
        latest,
        ["generation_id", "metric_name", "metric_type"],
        [F.col("value").desc(), F.col("variant_id").asc()],
        partitions=partitions,
    )


def top_per_generation(nodes: DataFrame, k: int) -> DataFrame:
    """Best ``k`` scored variants of each generation of each experiment."""
    scored = nodes.where(not_nan(F.col("activity_score")).isNotNull())
    return top_k(scored, ["experiment_id", "generation_number"], best_first(), k)


def group_sizes(nodes: DataFrame, keys: tuple[str, ...] = ("experiment_id", "generation_number")) -> DataFrame:
    """Rank inside the generation (0-based, by id) and generation size."""
    ranked = rank_all(nodes, list(keys), [F.col("variant_id").asc()], rank="_rank")
    sizes = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"))
    return (
        ranked.withColumn("group_rank", F.col("_rank") - 1).drop("_rank").join(sizes, list(keys))
    )


def natural_order(index: str = "plasmid_variant_index") -> list[Column]:
    """Numeric indices first by value, then the text ones."""
    digits = F.when(F.col(index).rlike("^[0-9]+$"), int_or_null(F.col(index)))
    return [digits.asc_nulls_last(), F.col(index).asc_nulls_last()]


def fallback_variants(variants: DataFrame, mutations: DataFrame, k: int = 1) -> DataFrame:
    """Per generation the variants with the most protein changes that are not
    known to be synonymous; the newest id wins ties."""
    counts = (
        mutations.where("mutation_type = 'protein'")
        .groupBy("variant_id")
        .agg(F.count_if(~F.coalesce("is_synonymous", F.lit(False))).alias("nonsyn_count"))
    )
    rows = (
        variants.select("experiment_id", "generation_id", "variant_id")
        .join(counts, "variant_id", "left")
        .withColumn("nonsyn_count", F.coalesce("nonsyn_count", F.lit(0)))
    )
    return top_k(
        rows, ["generation_id"], [F.col("nonsyn_count").desc(), F.col("variant_id").desc()], k
    )


def latest_generation(generations: DataFrame) -> DataFrame:
    """Newest generation of every experiment."""
    return generations.groupBy("experiment_id").agg(
        F.max_by("generation_id", F.struct("generation_number", "generation_id")).alias("generation_id"),
        F.max("generation_number").alias("generation_number"),
    )


def top_of_generation(variants: DataFrame, metrics: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` of each generation id; the newest id wins ties."""
    scores = latest_metrics(metrics, {"activity_score": ACTIVITY})
    rows = variants.join(scores, "variant_id").where(not_nan(F.col("activity_score")).isNotNull())
    return top_k(
        rows, ["generation_id"], [F.col("activity_score").desc(), F.col("variant_id").desc()], k
    )


def resolve_variant_ids(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """Back-fill the variant id of rows known by (generation number, index)."""
    ids = variants.groupBy("experiment_id", "generation_number", "plasmid_variant_index").agg(
        F.max("variant_id").alias("_found")
    )
    keys = ["experiment_id", "generation_number", "plasmid_variant_index"]
    return (
        rows.join(ids, keys, "left")
        .withColumn("variant_id", F.coalesce("variant_id", "_found"))
        .drop("_found")
    )


def owned_variants(variants: DataFrame, experiments: DataFrame, user_id: int) -> DataFrame:
    """Variants of the experiments of one user."""
    own = experiments.where(F.col("user_id") == user_id).select("experiment_id")
    return variants.join(own, "experiment_id", "left_semi")


def protein_windows(variants: DataFrame, first_positions: DataFrame, radius: int = 10) -> DataFrame:
    """Residues within ``radius`` of each variant's first mutation
    (``first_positions``: variant_id, position)."""
    seq = F.trim("protein_sequence")
    left = F.greatest(F.col("position") - radius, F.lit(1))
    right = F.least(F.length(seq), F.col("position") + radius)
    return (
        variants.select("variant_id", "protein_sequence")
        .join(first_positions.where("position > 0"), "variant_id")
        .where(F.coalesce(seq, F.lit("")) != "")
        .select("variant_id", "position", F.substring(seq, left, F.greatest(right - left + 1, F.lit(0))).alias("window"))
    )
