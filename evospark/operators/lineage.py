"""Lineage of variants: edges, closure, chains, roots, trajectories, trends."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evospark.functions.coerce import index_number, not_nan
from evospark.functions.ordering import top_k
from evospark.operators.domains import not_synonymous, strictly_nonsynonymous
from evospark.session import cut_lineage, scratch_path


def lineage_edges(variants: DataFrame) -> DataFrame:
    """Parent -> child edges whose both ends belong to one experiment."""
    parents = variants.select(
        F.col("variant_id").alias("parent_variant_id"), F.col("experiment_id").alias("_exp")
    )
    return (
        variants.where(F.col("parent_variant_id").isNotNull())
        .join(parents, "parent_variant_id")
        .where(F.col("experiment_id") == F.col("_exp"))
        .select(
            "experiment_id",
            F.col("parent_variant_id").alias("parent_id"),
            F.col("variant_id").alias("child_id"),
        )
    )


def resolve_parents(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Fill ``parent_variant_id`` from (experiment, generation - 1, parent index).

    Only a non-negative parent index of a later generation resolves.
    """
    lookup = known.select(
        "experiment_id",
        (F.col("generation_number") + 1).alias("generation_number"),
        F.col("plasmid_variant_index").alias("_parent_index"),
        F.col("variant_id").alias("_parent"),
    )
    wanted = F.when(
        (F.col("parent_variant_index") >= 0) & (F.col("generation_number") > 0),
        F.col("parent_variant_index").cast("string"),
    )
    return (
        rows.withColumn("_parent_index", wanted)
        .join(lookup, ["experiment_id", "generation_number", "_parent_index"], "left")
        .withColumn("parent_variant_id", F.col("_parent"))
        .drop("_parent", "_parent_index")
    )


def nearest_index_edges(nodes: DataFrame, max_distance: float = 3.0) -> DataFrame:
    """Edges to the previous-generation variant with the nearest numeric index,
    if it lies within ``max_distance``; the lowest variant id wins ties.

    Equal indices collapse to one row before anything meets. Inside a bin of
    width ``max_distance`` a window finds the closest index on either side; the
    two neighbouring bins only contribute their edge values. No pairs of a hot
    index are ever formed.
    """
    if max_distance <= 0:
        raise ValueError("max_distance must be positive")
    nums = nodes.where(F.col("generation_number").isNotNull()).select(
        "experiment_id", "variant_id", "generation_number",
        index_number(F.col("plasmid_variant_index")).alias("_idx"),
    ).where(F.col("_idx").isNotNull() & (F.abs("_idx") < 1e15))
    bin_of = F.floor(F.col("_idx") / F.lit(float(max_distance)))
    parents = (
        nums.groupBy("experiment_id", (F.col("generation_number") + 1).alias("generation_number"), "_idx")
        .agg(F.min("variant_id").alias("_parent"))
        .withColumn("_bin", bin_of)
    )
    children = (
        nums.select("experiment_id", "generation_number", "_idx").distinct().withColumn("_bin", bin_of)
    )
    place = ["experiment_id", "generation_number", "_bin"]
    spot = F.struct(F.col("_idx").alias("at"), F.col("_parent").alias("id"))
    both = parents.withColumn("_spot", spot).unionByName(
        children.withColumn("_spot", F.lit(None).cast("struct<at:double,id:bigint>")), True
    )
    left = Window.partitionBy(*place).orderBy("_idx").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    right = Window.partitionBy(*place).orderBy("_idx").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    # In a range frame the peers of the current row count, so a parent with the
    # very same index is always seen; its order among the peers is irrelevant.
    inside = (
        both.withColumn("_left", F.max(F.col("_spot")).over(left))
        .withColumn("_right", F.min(F.col("_spot")).over(right))
        .where(F.col("_parent").isNull())
        .drop("_parent", "_spot")
    )
    edges_of_bin = parents.groupBy(*place).agg(
        F.max(spot).alias("_last"), F.min(spot).alias("_first")
    )
    below = edges_of_bin.select(*place[:2], (F.col("_bin") + 1).alias("_bin"), F.col("_last").alias("_below"))
    above = edges_of_bin.select(*place[:2], (F.col("_bin") - 1).alias("_bin"), F.col("_first").alias("_above"))
    candidates = F.filter(
        F.transform(
            F.array("_left", "_right", "_below", "_above"),
            lambda s: F.struct(F.abs(s["at"] - F.col("_idx")).alias("gap"), s["id"].alias("id")),
        ),
        lambda c: c["gap"] <= F.lit(float(max_distance)),
    )
    matched = (
        inside.join(below, place, "left")
        .join(above, place, "left")
        .withColumn("_best", F.array_min(candidates))
        .where(F.col("_best").isNotNull())
        .select("experiment_id", "generation_number", "_idx", F.col("_best.id").alias("parent_id"))
    )
    return nums.join(matched, ["experiment_id", "generation_number", "_idx"]).select(
        "experiment_id", "parent_id", F.col("variant_id").alias("child_id")
    )


def lineage_closure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) pairs of a forest, self rows at 0.

    Pointer doubling: every round joins the paths of full length 2^k with all
    known paths, so a forest of depth d needs log2(d) rounds. Each round is
    checkpointed; a cycle is an error.
    """
    paths = cut_lineage(
        edges.select(
            F.col("parent_id").alias("ancestor_id"),
            F.col("child_id").alias("descendant_id"),
            F.lit(1).alias("distance"),
        ).distinct()
    )
    longest, reach = paths, 1
    while True:
        upper = paths.select(
            F.col("descendant_id").alias("_mid"), "ancestor_id", F.col("distance").alias("_more")
        )
        grown = cut_lineage(
            longest.select(F.col("ancestor_id").alias("_mid"), "descendant_id")
            .join(upper, "_mid")
            .select("ancestor_id", "descendant_id", (F.col("_more") + reach).alias("distance"))
        )
        if grown.isEmpty():
            break
        if not grown.where("ancestor_id = descendant_id").isEmpty():
            raise ValueError("the parent links contain a cycle")
        paths = paths.unionByName(grown)
        reach *= 2
        longest = grown.where(F.col("distance") == reach)
    self_rows = nodes.select(
        F.col("variant_id").alias("ancestor_id"),
        F.col("variant_id").alias("descendant_id"),
        F.lit(0).alias("distance"),
    ).distinct()
    return paths.unionByName(self_rows)


def reparented(old: DataFrame, new: DataFrame) -> DataFrame:
    """Variants whose parent differs between two snapshots (not allowed)."""
    before = old.select("variant_id", F.col("parent_variant_id").alias("old_parent_id"))
    return (
        new.select("variant_id", "parent_variant_id")
        .join(before, "variant_id")
        .where(~F.col("parent_variant_id").eqNullSafe(F.col("old_parent_id")))
    )


def ancestor_chains(closure: DataFrame, variants: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Leaf-to-root chain of every target (or every variant), with depth."""
    rows = closure.withColumnRenamed("descendant_id", "target_id")
    if targets is not None:
        rows = rows.join(targets.select(F.col("variant_id").alias("target_id")), "target_id", "left_semi")
    info = variants.select(
        F.col("variant_id").alias("ancestor_id"), "experiment_id", "generation_number"
    )
    return rows.join(info, "ancestor_id").select(
        "target_id", F.col("ancestor_id").alias("variant_id"), F.col("distance").alias("depth"),
        "experiment_id", "generation_number",
    )


def lineage_roots(closure: DataFrame) -> DataFrame:
    """Root of every variant: its farthest ancestor."""
    return closure.groupBy(F.col("descendant_id").alias("variant_id")).agg(
        F.max_by("ancestor_id", "distance").alias("root_id"), F.max("distance").alias("depth")
    )


def with_ancestors(closure: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seeds together with all their ancestors, as distinct ids."""
    picked = seeds.select(F.col("variant_id").alias("descendant_id"))
    return (
        closure.join(picked, "descendant_id", "left_semi")
        .select(F.col("ancestor_id").alias("variant_id"))
        .distinct()
    )


def edges_within(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose two ends are both kept."""
    ids = kept.select("variant_id")
    return edges.join(
        ids.withColumnRenamed("variant_id", "parent_id"), "parent_id", "left_semi"
    ).join(ids.withColumnRenamed("variant_id", "child_id"), "child_id", "left_semi")


def consecutive_edges(edges: DataFrame, variants: DataFrame) -> DataFrame:
    """Edges from one generation to the very next."""
    gens = variants.select("variant_id", "generation_number")
    return (
        edges.join(gens.select(F.col("variant_id").alias("parent_id"), F.col("generation_number").alias("_gp")), "parent_id")
        .join(gens.select(F.col("variant_id").alias("child_id"), F.col("generation_number").alias("_gc")), "child_id")
        .where("_gc - _gp = 1")
        .drop("_gp", "_gc")
    )


def subtree(closure: DataFrame, variants: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """Nodes below each root down to ``max_depth``."""
    below = closure.where(F.col("distance") <= max_depth).join(
        roots.select(F.col("variant_id").alias("ancestor_id")), "ancestor_id", "left_semi"
    )
    info = variants.select(
        F.col("variant_id").alias("descendant_id"), "parent_variant_id", "generation_number"
    )
    return below.join(info, "descendant_id").select(
        F.col("ancestor_id").alias("root_id"), F.col("descendant_id").alias("variant_id"),
        "parent_variant_id", "generation_number", F.col("distance").alias("depth"),
    )


def _coded_changes(chains: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per chain row and code of a change, dealt by target, and the table of codes.

    Changes pass the shuffle as one array of codes per chain row. They are exploded
    behind it, where a grouping by (target, code) needs no other shuffle. They take
    far more room there than in the shuffle, so the parts are not merged. The codes
    are written once, so that Spark knows their size when it plans the joins.
    """
    spark = chains.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    what = ["position", "original", "mutated"]
    path = scratch_path(spark, "changes")
    changes.select(*what).distinct().withColumn("code", F.monotonically_increasing_id()).write.parquet(path)
    codes = spark.read.parquet(path)
    same = functools.reduce(lambda x, y: x & y, [changes[c].eqNullSafe(codes[c]) for c in what])
    of_variant = changes.join(codes, same).groupBy("variant_id").agg(F.collect_set("code").alias("_codes"))
    dealt = chains.join(of_variant, "variant_id").repartition(parts, "target_id")
    return dealt.withColumn("code", F.explode("_codes")).drop("_codes"), codes


def introduction_events(chains: DataFrame, mutations: DataFrame) -> DataFrame:
    """For every target and mutation on its chain: where it first appeared
    (the ancestor closest to the root)."""
    changes = mutations.where((F.col("mutation_type") == "protein") & not_synonymous()).select(
        "variant_id", "position", "original", "mutated"
    )
    first = F.max_by(F.struct("variant_id", "generation_number"), "depth")
    carried, codes = _coded_changes(chains, changes)
    return (
        carried.groupBy("target_id", "code")
        .agg(first.alias("_first"))
        .join(codes, "code")
        .select(
            "target_id", "position", "original", "mutated",
            F.col("_first.variant_id").alias("introduced_variant_id"),
            F.col("_first.generation_number").alias("introduced_generation"),
            F.concat("original", F.lit(">"), "mutated").alias("label"),
            F.concat("original", F.col("position").cast("string"), "mutated").alias("full_label"),
        )
    )


def cumulative_trajectory(chains: DataFrame, mutations: DataFrame) -> DataFrame:
    """Running number of distinct known non-synonymous changes, root to leaf."""
    changes = mutations.where((F.col("mutation_type") == "protein") & strictly_nonsynonymous()).select(
        "variant_id", "position", "original", "mutated"
    )
    new_here = (
        _coded_changes(chains, changes)[0]
        .groupBy("target_id", "code")
        .agg(F.max("depth").alias("depth"))
        .groupBy("target_id", "depth")
        .agg(F.count(F.lit(1)).alias("_new"))
    )
    run = (
        Window.partitionBy("target_id")
        .orderBy(F.col("depth").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        chains.join(new_here, ["target_id", "depth"], "left")
        .withColumn("cumulative_nonsyn", F.sum(F.coalesce("_new", F.lit(0))).over(run))
        .drop("_new")
    )


def chain_nonsyn_counts(chains: DataFrame, mutations: DataFrame) -> DataFrame:
    """Distinct known non-synonymous changes of each node on a chain."""
    counts = (
        mutations.where((F.col("mutation_type") == "protein") & strictly_nonsynonymous())
        .select("variant_id", "position", "original", "mutated")
        .distinct()
        .groupBy("variant_id")
        .agg(F.count(F.lit(1)).alias("nonsyn_count"))
    )
    return chains.join(counts, "variant_id", "left").withColumn(
        "nonsyn_count", F.coalesce("nonsyn_count", F.lit(0))
    )


def _two_sided_p(r: float, n: int) -> float | None:
    """p-value of a correlation: Student t with n - 2 degrees of freedom,
    through the continued fraction of the incomplete beta function."""
    dof = n - 2
    if dof <= 0 or r is None or math.isnan(r):
        return None
    if abs(r) >= 1.0:
        return 0.0
    a, b, x = dof / 2.0, 0.5, 1.0 - r * r
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(p: float, q: float, z: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1.0 / max(1.0 - (p + q) * z / (p + 1.0), tiny)
        h = d
        for m in range(1, 500):
            for num in (
                m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1.0 + num * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = 1.0 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1.0) < 1e-14:
                break
        return h

    if x < (a + 1.0) / (a + b + 2.0):
        return front * fraction(a, b, x) / a
    return 1.0 - front * fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """p-values of per-experiment correlations (one row per experiment)."""
    return pd.Series([_two_sided_p(float(a), int(b)) if pd.notna(a) else None for a, b in zip(r, n)], dtype="float64")


def linear_trend(rows: DataFrame, keys: Sequence[str], x: str, y: str, min_points: int = 3) -> DataFrame:
    """Line through the points of each group, correlation and its p-value.

    ``trend_ready`` needs ``min_points`` points and variation on both axes.
    """
    pts = rows.where(F.col(x).isNotNull() & not_nan(F.col(y).cast("double")).isNotNull()).select(
        *keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    fit = pts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.min("_x").alias("_x0"), F.max("_x").alias("_x1"),
        F.min("_y").alias("_y0"), F.max("_y").alias("_y1"),
        F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"),
        F.covar_pop("_x", "_y").alias("_cov"),
        F.stddev_pop("_x").alias("_sx"), F.stddev_pop("_y").alias("_sy"),
    )
    # Ratios by hand: corr() fails on a constant side when ANSI mode is on.
    fit = fit.withColumn("slope", F.try_divide(F.col("_cov"), F.col("_sx") * F.col("_sx")))
    fit = fit.withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx")).withColumn(
        "r_value", F.try_divide(F.col("_cov"), F.col("_sx") * F.col("_sy"))
    )
    ready = (F.col("points") >= min_points) & (F.col("_x0") < F.col("_x1")) & (F.col("_y0") < F.col("_y1"))
    fit = fit.withColumn("trend_ready", ready)
    for c in ("slope", "intercept", "r_value"):
        fit = fit.withColumn(c, F.when(F.col("trend_ready"), F.col(c)))
    return (
        fit.withColumn("p_value", correlation_p("r_value", "points"))
        .withColumn("line_start", F.when(F.col("trend_ready"), F.col("slope") * F.col("_x0") + F.col("intercept")))
        .withColumn("line_end", F.when(F.col("trend_ready"), F.col("slope") * F.col("_x1") + F.col("intercept")))
        .drop("_x0", "_x1", "_y0", "_y1", "_mx", "_my", "_cov", "_sx", "_sy")
    )


def branch_trend(nodes: DataFrame, closure: DataFrame, top_n: int = 10, min_points: int = 3) -> DataFrame:
    """Trend of activity over generations along the branches of each
    experiment's best ``top_n`` variants."""
    scored = nodes.where(not_nan(F.col("activity_score")).isNotNull())
    best = top_k(
        scored, ["experiment_id"], [F.col("activity_score").desc(), F.col("variant_id").asc()], top_n
    )
    branch = with_ancestors(closure, best)
    points = scored.join(branch, "variant_id", "left_semi")
    return linear_trend(points, ["experiment_id"], "generation_number", "activity_score", min_points)


def generation_trend(nodes: DataFrame) -> DataFrame:
    """Trend line through the per-generation mean activities."""
    means = (
        nodes.where(not_nan(F.col("activity_score")).isNotNull())
        .groupBy("experiment_id", "generation_number")
        .agg(F.avg("activity_score").alias("mean_activity"))
    )
    return linear_trend(means, ["experiment_id"], "generation_number", "mean_activity", 2)


def highlighted_subgraph(nodes: DataFrame, edges: DataFrame, closure: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Best ``k`` per generation with all ancestors, and the edges among them."""
    from evospark.operators.ranking import top_per_generation

    kept = with_ancestors(closure, top_per_generation(nodes, k))
    return nodes.join(kept, "variant_id", "left_semi"), edges_within(edges, kept)


def connected_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that touch at least one edge."""
    ends = edges.select(F.explode(F.array("parent_id", "child_id")).alias("variant_id")).distinct()
    return nodes.join(ends, "variant_id", "left_semi")
