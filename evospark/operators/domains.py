"""Mutations against protein features, and mutation frequencies by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evospark.functions.ordering import top_k

BIN_WIDTH = 64  # residues per bin of the interval join


def strictly_nonsynonymous() -> Column:
    """``is_synonymous`` known to be false."""
    return F.col("is_synonymous").eqNullSafe(F.lit(False))


def not_synonymous() -> Column:
    """``is_synonymous`` false or unknown."""
    return ~F.coalesce(F.col("is_synonymous"), F.lit(False))


def position_counts(variants: DataFrame, mutations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Protein mutation counts per position. This runs before any join with
    features, so a generation contributes at most one row per residue."""
    return (
        mutations.where("mutation_type = 'protein'")
        .join(variants.select("variant_id", *keys), "variant_id")
        .groupBy(*keys, "position")
        .agg(
            F.count_if(strictly_nonsynonymous()).alias("nonsyn"),
            F.count_if(F.col("is_synonymous").eqNullSafe(F.lit(True))).alias("syn"),
            F.count(F.lit(1)).alias("hits"),
        )
    )


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], width: int = BIN_WIDTH) -> DataFrame:
    """Rows of ``points`` (column ``position``) inside ``intervals`` (columns
    ``start_position``, ``end_position``, both inclusive).

    Both sides meet in fixed-width bins, an equi-join; the bin of the point
    decides, so no pair appears twice.
    """
    binned = intervals.where("start_position > 0 and end_position >= start_position").withColumn(
        "_bin",
        F.explode(
            F.sequence(
                F.floor(F.col("start_position") / width), F.floor(F.col("end_position") / width)
            )
        ),
    )
    return (
        points.withColumn("_bin", F.floor(F.col("position") / width))
        .join(binned, [*keys, "_bin"])
        .where("position between start_position and end_position")
        .drop("_bin")
    )


def interval_sums(points: DataFrame, intervals: DataFrame, groups: Sequence[str], keys: Sequence[str],
                  values: Sequence[str]) -> DataFrame:
    """Sums of ``values`` over the points (column ``position``) inside every
    interval, per group of points.

    Running sums over a group's positions are read at both ends of the interval,
    so the work doesn't depend on its length.
    """
    at_end = F.struct(F.col("end_position").alias("position"), F.lit(1).alias("_sign"))
    before = F.struct((F.col("start_position") - 1).alias("position"), F.lit(-1).alias("_sign"))
    names = [c for c in intervals.columns if c not in keys]
    ends = points.select(*groups, *keys).distinct().join(intervals, list(keys)).withColumn(
        "_end", F.explode(F.array(at_end, before))).select("*", "_end.*").drop("_end")
    rows = points.select(*groups, *keys, "position", *values).unionByName(ends, allowMissingColumns=True)
    so_far = Window.partitionBy(*groups, *keys).orderBy("position").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumns({v: F.coalesce(F.sum(v).over(so_far), F.lit(0)) for v in values}).where("_sign is not null")
    return running.groupBy(*groups, *keys, *names).agg(*[F.sum(F.col("_sign") * F.col(v)).alias(v) for v in values])


def domain_enrichment(
    variants: DataFrame, mutations: DataFrame, experiments: DataFrame, features: DataFrame,
    types: Sequence[str] | None = None,
) -> DataFrame:
    """Mutation counts per (generation, protein feature).

    Features belong to the wild type of the experiment; ``types`` restricts the
    feature types (the report uses Domain and Region).
    """
    scoped = variants.join(experiments.select("experiment_id", "wt_id"), "experiment_id")
    counts = position_counts(scoped, mutations, ["generation_id", "wt_id"])
    wanted = features if types is None else features.where(F.col("feature_type").isin(list(types)))
    named = wanted.select(
        "wt_id", "feature_type", "start_position", "end_position",
        F.coalesce("description", "feature_type").alias("domain_label"),
    )
    length = F.col("end_position") - F.col("start_position") + 1
    feature = ["feature_type", "domain_label", "start_position", "end_position"]
    return (
        interval_sums(counts, named.where("start_position > 0 and end_position >= start_position"),
                      ["generation_id"], ["wt_id"], ["nonsyn", "syn", "hits"])
        .where("hits > 0")
        .select("generation_id", "wt_id", *feature, F.col("nonsyn").alias("nonsyn_count"), F.col("syn").alias("syn_count"),
                F.col("hits").alias("total_protein_mutations"))
        .withColumn("domain_length", length)
        .withColumn("nonsyn_per_residue", F.try_divide("nonsyn_count", F.nullif("domain_length", F.lit(0))))
    )


def generation_columns(generations: DataFrame) -> list[int]:
    """Generation numbers of a campaign in order: the columns of a matrix."""
    rows = generations.where("generation_number is not null").select("generation_number").distinct().collect()
    return sorted(int(r[0]) for r in rows)


def enrichment_matrix(enrichment: DataFrame, generations: DataFrame, metric: str) -> DataFrame:
    """Heat matrix: feature label x generation, mean over duplicates, zero fill,
    with the row total. Every generation has a column ``g<number>``."""
    generation_numbers = generation_columns(generations)
    numbered = enrichment.join(
        generations.select("generation_id", "generation_number"), "generation_id"
    )
    wide = (
        numbered.groupBy("domain_label")
        .pivot("generation_number", generation_numbers)
        .agg(F.avg(metric))
    )
    cells = [F.coalesce(F.col(f"`{g}`"), F.lit(0.0)).alias(f"g{g}") for g in generation_numbers]
    total = sum((F.col(f"g{g}") for g in generation_numbers), F.lit(0.0))
    return wide.select("domain_label", *cells).withColumn("total", total)


def top_domains(enrichment: DataFrame, metric: str = "nonsyn_count", k: int = 25) -> DataFrame:
    """The ``k`` strongest features of each generation."""
    return top_k(
        enrichment, ["generation_id"],
        [F.col(metric).desc(), F.col("domain_label").asc(), F.col("start_position").asc(),
         F.col("end_position").asc(), F.col("wt_id").asc(), F.col("feature_type").asc()],
        k,
    )


def mutation_frequency(variants: DataFrame, mutations: DataFrame) -> DataFrame:
    """Changes that are not known to be synonymous, per position and generation."""
    return (
        mutations.where((F.col("mutation_type") == "protein") & not_synonymous())
        .join(variants.select("variant_id", "experiment_id", "generation_number"), "variant_id")
        .groupBy("experiment_id", "generation_number", "position")
        .agg(F.count(F.lit(1)).alias("mutations"))
    )


def position_totals(frequency: DataFrame) -> DataFrame:
    """Totals over the generations, with each experiment's largest position."""
    return frequency.groupBy("experiment_id", "position").agg(F.sum("mutations").alias("total"))


def frequency_matrix(frequency: DataFrame, generations: DataFrame) -> DataFrame:
    """Position x generation matrix with zero fill; every generation that the
    table or the frequencies hold has a column ``g<number>``."""
    numbers = generations.select("generation_number").union(frequency.select("generation_number"))
    generation_numbers = generation_columns(numbers)
    wide = (
        frequency.groupBy("experiment_id", "position")
        .pivot("generation_number", generation_numbers)
        .agg(F.sum("mutations"))
    )
    return wide.select(
        "experiment_id", "position",
        *[F.coalesce(F.col(f"`{g}`"), F.lit(0)).alias(f"g{g}") for g in generation_numbers],
    )


def hotspots(totals: DataFrame, k: int = 5) -> DataFrame:
    """Most mutated positions of every experiment."""
    return top_k(totals, ["experiment_id"], [F.col("total").desc(), F.col("position").asc()], k)


def domain_regions(features: DataFrame, types: Sequence[str] = ("Domain", "Region")) -> DataFrame:
    """Distinct labelled regions that a frequency plot shades."""
    return (
        features.where(F.col("feature_type").isin(list(types)))
        .select("wt_id", F.coalesce("description", "feature_type").alias("domain_label"),
                "start_position", "end_position")
        .distinct()
    )


def protein_mutation_counts(variants: DataFrame, mutations: DataFrame) -> DataFrame:
    """Protein mutations per variant (all, and known non-synonymous); 0 if none."""
    counts = (
        mutations.where("mutation_type = 'protein'")
        .groupBy("variant_id")
        .agg(
            F.count(F.lit(1)).alias("protein_mutations"),
            F.count_if(strictly_nonsynonymous()).alias("nonsyn_mutations"),
        )
    )
    return (
        variants.select("experiment_id", "variant_id")
        .join(counts, "variant_id", "left")
        .withColumn("protein_mutations", F.coalesce("protein_mutations", F.lit(0)))
        .withColumn("nonsyn_mutations", F.coalesce("nonsyn_mutations", F.lit(0)))
    )


def position_range(variants: DataFrame, mutations: DataFrame) -> DataFrame:
    """Smallest and largest mutated protein position per experiment."""
    return (
        mutations.where("mutation_type = 'protein'")
        .join(variants.select("variant_id", "experiment_id"), "variant_id")
        .groupBy("experiment_id")
        .agg(F.min("position").alias("min_position"), F.max("position").alias("max_position"))
    )


def variant_position_counts(mutations: DataFrame) -> DataFrame:
    """Protein mutation rows per (variant, position)."""
    return (
        mutations.where("mutation_type = 'protein'")
        .groupBy("variant_id", "position")
        .agg(F.count(F.lit(1)).alias("mutations"))
    )


def feature_summary(features: DataFrame) -> DataFrame:
    """Per wild type: number of features, the three most frequent types and the
    first three distinct highlights, as report texts."""
    kind = F.nullif(F.trim("feature_type"), F.lit(""))
    text = F.nullif(F.trim("description"), F.lit(""))
    start, end = F.col("start_position"), F.col("end_position")
    place = (
        F.when((start > 0) & (end > 0), F.when(start == end, start.cast("string"))
               .otherwise(F.concat_ws("-", start.cast("string"), end.cast("string"))))
        .when(start > 0, F.concat(start.cast("string"), F.lit("+")))
    )
    label = F.coalesce(text, kind, F.lit("Feature"))
    rows = features.select(
        "wt_id", "feature_id", kind.alias("_type"),
        F.when(place.isNotNull(), F.concat(label, F.lit(" ("), place, F.lit(")"))).otherwise(label).alias("_hl"),
    )
    total = rows.groupBy("wt_id").agg(F.count(F.lit(1)).alias("features"))

    def joined(df: DataFrame, out: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct("rank", "_text")))
        return df.groupBy("wt_id").agg(
            F.array_join(F.transform(items, lambda i: i["_text"]), ", ").alias(out)
        )

    by_type = (
        rows.where("_type is not null")
        .groupBy("wt_id", "_type")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("feature_id").alias("_first"))
    )
    types = top_k(by_type, ["wt_id"], [F.col("_n").desc(), F.col("_first").asc()], 3).withColumn(
        "_text",
        F.when(F.col("_n") > 1, F.concat("_type", F.lit(" ("), F.col("_n").cast("string"), F.lit(")")))
        .otherwise(F.col("_type")),
    )
    firsts = rows.groupBy("wt_id", F.col("_hl").alias("_text")).agg(F.min("feature_id").alias("_first"))
    highlights = top_k(firsts, ["wt_id"], [F.col("_first").asc()], 3)
    return (
        total.join(joined(types, "top_types"), "wt_id", "left")
        .join(joined(highlights, "highlights"), "wt_id", "left")
    )
