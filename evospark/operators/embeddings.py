"""Mutation features, two-dimensional PCA and interpolated activity surfaces.

All groups (experiments or generations) are fitted together. The feature-by-feature
moments of a group of up to ``MAX_FEATURES`` features meet in one task; wider
groups are fitted by subspace iteration, as joins of the sparse rows with a table of axes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evospark.functions.coerce import not_nan
from evospark.functions.keys import surrogate
from evospark.operators.metrics import ACTIVITY, MUTATION_TOTAL, latest_metrics
from evospark.session import cut_lineage

MAX_FEATURES = 5_000
"""Widest group whose moment matrix is built; a wider one is iterated."""

BLOCK = 8
"""Axes that are iterated together; more of them converge in fewer rounds."""

TOLERANCE = 1e-12
MAX_ROUNDS = 300


def mutation_features(variants: DataFrame, mutations: DataFrame, keys: Sequence[str], kind: str = "residue") -> DataFrame:
    """Sparse feature rows (group, variant, feature, value).

    ``residue``: presence of ``<position>_<new residue>``. ``position``: number
    of mutations at a position. A variant without features has no row and is a
    zero vector.
    """
    protein = mutations.where("mutation_type = 'protein'").join(
        variants.select("variant_id", *keys), "variant_id")
    if kind == "residue":
        name = F.concat(F.col("position").cast("string"), F.lit("_"), "mutated")
        return protein.groupBy(*keys, "variant_id", name.alias("feature")).agg(F.lit(1.0).alias("value"))
    if kind == "position":
        return protein.groupBy(*keys, "variant_id", F.col("position").cast("string").alias("feature")).agg(
            F.count(F.lit(1)).cast("double").alias("value"))
    raise ValueError("kind must be residue or position")


def feature_index(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dense 0-based column number of every feature, in text order."""
    from evospark.functions.ordering import rank_all

    names = features.select(*keys, "feature").distinct()
    ranked = rank_all(names, list(keys), [F.col("feature").asc()], rank="_r")
    return ranked.select(*keys, "feature", (F.col("_r") - 1).cast("int").alias("column"))


def feature_vectors(variants: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sparse vectors as (size, indices, values); zero vectors included."""
    index = feature_index(features, keys)
    sizes = index.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("size"))
    cells = features.join(index, [*keys, "feature"]).groupBy(*keys, "variant_id").agg(
        F.array_sort(F.collect_list(F.struct("column", "value"))).alias("_cells"))
    none = F.array().cast("array<struct<column:int,value:double>>")
    return (
        variants.select(*keys, "variant_id")
        .join(cells, [*keys, "variant_id"], "left")
        .join(sizes, list(keys), "left")
        .withColumn("_cells", F.coalesce("_cells", none))
        .select(*keys, "variant_id", F.coalesce("size", F.lit(0)).alias("size"),
                F.transform("_cells", lambda c: c["column"]).alias("indices"),
                F.transform("_cells", lambda c: c["value"]).alias("values"))
    )


def _leading_axes(rows: pd.DataFrame) -> pd.DataFrame:
    """First two principal axes of one group from its feature moments."""
    names = np.unique(np.concatenate([rows["a"].to_numpy(str), rows["b"].to_numpy(str)]))
    d, n = len(names), float(rows["variants"].iloc[0])
    i = np.searchsorted(names, rows["a"].to_numpy(str))
    j = np.searchsorted(names, rows["b"].to_numpy(str))
    second, mean = np.zeros((d, d)), np.zeros(d)
    second[i, j] = rows["dot"].to_numpy(float)
    second[j, i] = second[i, j]
    own = i == j
    mean[i[own]] = rows["total"].to_numpy(float)[own] / n
    spread = second - n * np.outer(mean, mean)
    weights, axes = np.linalg.eigh(spread)
    axes = axes[:, ::-1][:, :2]
    if axes.shape[1] < 2:
        axes = np.hstack([axes, np.zeros((d, 2 - axes.shape[1]))])
    if d > 1 and weights[-2] <= 1e-9 * max(weights[-1], 1e-300):
        axes[:, 1] = 0.0
    if weights[-1] <= 0:
        axes[:, 0] = 0.0
    for k in (0, 1):  # the largest loading is positive, so runs agree
        top = np.argmax(np.round(np.abs(axes[:, k]), 9))
        if axes[top, k] < 0:
            axes[:, k] = -axes[:, k]
    keep = rows.columns.difference(["a", "b", "dot", "total", "variants"], sort=False)
    out = pd.DataFrame({"feature": names, "axis_x": axes[:, 0], "axis_y": axes[:, 1], "mean": mean})
    for k in keep:
        out[k] = rows[k].iloc[0]
    return out[[*keep, "feature", "axis_x", "axis_y", "mean"]]


def _axes_by_moments(features: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, axis_x, axis_y, mean) from the moments of all feature pairs, summed before the shuffle."""
    cells = features.groupBy(*keys, "variant_id").agg(
        F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("_c"))
    pairs = cells.select(*keys, F.explode("_c").alias("p"), "_c").select(
        *keys, "p", F.explode(F.filter("_c", lambda q: q["feature"] >= F.col("p.feature"))).alias("q"))
    moments = pairs.groupBy(*keys, F.col("p.feature").alias("a"), F.col("q.feature").alias("b")).agg(
        F.sum(F.col("p.value") * F.col("q.value")).alias("dot"), F.sum("p.value").alias("total"))
    scoped = moments.join(sizes, keys)
    key_types = ", ".join(f"{k} {dict(scoped.dtypes)[k]}" for k in keys)
    return scoped.groupBy(*keys).applyInPandas(
        _leading_axes, f"{key_types}, feature string, axis_x double, axis_y double, mean double")


def _sums(column: str, factor: Column | None = None) -> Column:
    """Sum of an array column (times ``factor``) element by element."""
    values = F.col(column)
    return F.array(*(F.sum(values[i] * factor if factor is not None else values[i]) for i in range(BLOCK)))


def _rotations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per group, from the axes' images: their Gram matrix and their products with the axes, to the matrix that
    turns the images into orthonormal axes in the order of their variance."""
    for rows in batches:
        turn, top = [], []
        for gram, product in zip(rows["gram"], rows["product"], strict=True):
            gram, product = (np.asarray(m, dtype=float).reshape(BLOCK, BLOCK) for m in (gram, product))
            ritz, mix = np.linalg.eigh((product + product.T) / 2)  # within the space of the current axes
            ritz, mix = ritz[::-1], mix[:, ::-1]
            gram = mix.T @ gram @ mix
            # Orthonormal columns, the leading ones changed least; directions without variance become zero.
            basis = np.zeros((BLOCK, BLOCK))
            for c in range(BLOCK):
                v = np.eye(BLOCK)[c]
                for _ in range(2):
                    for b in range(c):
                        v = v - basis[:, b] * (basis[:, b] @ gram @ v)
                size = v @ gram @ v
                if size > 1e-18 * max(gram[0, 0], 1e-300):
                    basis[:, c] = v / np.sqrt(size)
            turn.append((mix @ basis).ravel().tolist())
            top.append(ritz[:2].tolist())
        yield rows.drop(columns=["gram", "product"]).assign(turn=turn, ritz=top)


def _axes_by_iteration(features: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, axis_x, axis_y, mean) by subspace iteration: a round is one join of the sparse rows with
    the axes, one with the variants' coordinates, and a small matrix per group. No task holds a group.

    Rounds end when the variances of the two axes stay as they are in every group, or after ``MAX_ROUNDS``.
    """
    rows = cut_lineage(features.join(sizes, keys).select(*keys, "variant_id", "feature", "value", "variants"))
    columns = cut_lineage(rows.groupBy(*keys, "feature").agg((F.sum("value") / F.first("variants")).alias("mean")))
    seeds = F.array(*(F.xxhash64("feature", F.lit(i)) / F.lit(float(2**63)) for i in range(BLOCK)))
    axes = cut_lineage(columns.withColumn("axes", seeds))
    key_types = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)
    before = None
    for _ in range(MAX_ROUNDS):
        origin = axes.groupBy(*keys).agg(_sums("axes", F.col("mean")).alias("origin"))
        placed = rows.join(axes.select(*keys, "feature", "axes"), [*keys, "feature"]).groupBy(*keys, "variant_id").agg(
            _sums("axes", F.col("value")).alias("raw"))
        at = placed.join(origin, keys).select(
            *keys, "variant_id", F.zip_with("raw", "origin", lambda a, b: a - b).alias("at"))
        # Centred coordinates sum to zero over all variants, so the rows need no centring on the way back.
        image = rows.join(at, [*keys, "variant_id"]).groupBy(*keys, "feature").agg(_sums("at", F.col("value")).alias("back"))
        shift = at.groupBy(*keys).agg(_sums("at").alias("rest"), F.count(F.lit(1)).alias("seen"))
        # Variants without features lie at minus the origin and are part of that sum.
        lost = shift.join(origin, keys).join(sizes, keys).select(*keys, F.zip_with(
            "rest", "origin", lambda r, o: r - (F.col("variants") - F.col("seen")) * o).alias("rest"))
        images = cut_lineage(axes.join(image, [*keys, "feature"]).join(lost, keys).select(
            *keys, "feature", "mean", "axes", F.zip_with("back", "rest", lambda b, r: b - F.col("mean") * r).alias("image")))
        cross = lambda a, b: F.array(*(F.sum(F.col(a)[i] * F.col(b)[j]) for i in range(BLOCK) for j in range(BLOCK)))
        turns = cut_lineage(images.groupBy(*keys).agg(cross("image", "image").alias("gram"), cross("axes", "image").alias("product"))
                            .mapInPandas(_rotations, f"{key_types}, turn array<double>, ritz array<double>"))
        turned = F.array(*(functools.reduce(Column.__add__, (F.col("image")[i] * F.col("turn")[i * BLOCK + j] for i in range(BLOCK))) for j in range(BLOCK)))
        axes = cut_lineage(images.join(turns.select(*keys, "turn"), keys).select(*keys, "feature", "mean", turned.alias("axes")))
        now = turns.select(*keys, F.col("ritz").alias("now"))
        if before is not None:
            moved = now.join(before, keys).where(F.exists(
                F.zip_with("now", "before", lambda a, b: F.abs(a - b) > TOLERANCE * F.abs(F.col("now")[0])), lambda x: x))
            if moved.limit(1).count() == 0:
                break
        before = now.withColumnRenamed("now", "before")
    # The largest loading is positive, so runs agree.
    sign = axes.groupBy(*keys).agg(*(
        F.signum(F.max_by(F.col("axes")[i], F.struct(F.round(F.abs(F.col("axes")[i]), 9), "feature"))).alias(f"_s{i}") for i in (0, 1)))
    return axes.join(sign, keys).select(
        *keys, "feature", *((F.col("axes")[i] * F.coalesce(F.nullif(f"_s{i}", F.lit(0.0)), F.lit(1.0))).alias(a) for i, a in enumerate(("axis_x", "axis_y"))), "mean")


def pca_points(variants: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Centred two-dimensional PCA coordinates of every variant of every group.

    Groups without features get (0, 0); groups of fewer than two variants are
    left out. The axes come from the moments of the feature pairs, or by
    iteration in groups of more than ``MAX_FEATURES`` features.
    """
    keys = list(keys)
    sizes = variants.groupBy(*keys).agg(F.count(F.lit(1)).alias("variants")).where("variants >= 2")
    width = cut_lineage(features.groupBy(*keys, "feature").agg(F.lit(1)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_width")))
    narrow, wide = (width.where(c).select(*keys) for c in (F.col("_width") <= MAX_FEATURES, F.col("_width") > MAX_FEATURES))
    if wide.limit(1).count():
        axes = cut_lineage(_axes_by_iteration(features.join(wide, keys, "left_semi"), sizes, keys))
        if narrow.limit(1).count():
            axes = axes.unionByName(_axes_by_moments(features.join(narrow, keys, "left_semi"), sizes, keys))
    else:
        axes = _axes_by_moments(features, sizes, keys)
    origin = axes.groupBy(*keys).agg(
        F.sum(F.col("mean") * F.col("axis_x")).alias("_ox"), F.sum(F.col("mean") * F.col("axis_y")).alias("_oy"))
    placed = features.join(axes, [*keys, "feature"]).groupBy(*keys, "variant_id").agg(
        F.sum(F.col("value") * F.col("axis_x")).alias("_x"), F.sum(F.col("value") * F.col("axis_y")).alias("_y"))
    zero = F.lit(0.0)
    return (
        variants.select(*keys, "variant_id")
        .join(sizes.select(*keys), keys, "left_semi")
        .join(placed, [*keys, "variant_id"], "left")
        .join(origin, keys, "left")
        .select(*keys, "variant_id",
                (F.coalesce("_x", zero) - F.coalesce("_ox", zero)).alias("pca_x"),
                (F.coalesce("_y", zero) - F.coalesce("_oy", zero)).alias("pca_y"))
    )


def coordinate_metrics(points: DataFrame) -> DataFrame:
    """PCA coordinates as derived metric rows (``pca_x``, ``pca_y``)."""
    return points.unpivot(["generation_id", "variant_id"], ["pca_x", "pca_y"], "metric_name", "value").withColumn(
        "metric_type", F.lit("derived"))


def embedding_run(points: DataFrame, scores: DataFrame, feature: str) -> tuple[DataFrame, DataFrame]:
    """Run rows (one per experiment) and points (height = activity) to store."""
    run_id = surrogate(F.lit("embedding"), "experiment_id", F.lit("pca"), F.lit("activity_score"), F.lit("derived"), F.lit(feature))
    runs = points.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("_n")).select(
        run_id.alias("embedding_run_id"), "experiment_id", F.lit("pca").alias("method"),
        F.lit("activity_score").alias("metric_name"), F.lit("derived").alias("metric_type"),
        F.create_map(F.lit("feature"), F.lit(feature), F.lit("variants"), F.col("_n").cast("string")).alias("params"))
    rows = points.join(scores, "variant_id").select(
        run_id.alias("embedding_run_id"), "variant_id", F.col("pca_x").alias("x"), F.col("pca_y").alias("y"),
        F.col("activity_score").alias("z"))
    return runs, rows


def activity_landscape(variants: DataFrame, metrics: DataFrame, points: DataFrame) -> DataFrame:
    """Variant, generation, coordinates, latest activity and mutation total; rows
    without an activity or coordinates are left out."""
    latest = latest_metrics(metrics, {"activity_score": ACTIVITY, "_total": MUTATION_TOTAL})
    df = variants.join(latest, "variant_id").join(points.select("variant_id", "pca_x", "pca_y"), "variant_id")
    metric_total = F.col("_total").cast("int")
    total = metric_total
    if "sequence_analysis" in variants.columns:
        total = F.coalesce(F.col("sequence_analysis.mutation_counts.total"), metric_total)
    return df.where(not_nan(F.col("activity_score")).isNotNull()).select(
        "experiment_id", "variant_id", "generation_number", "plasmid_variant_index",
        F.col("pca_x").alias("x"), F.col("pca_y").alias("y"), "activity_score", total.alias("mutation_total"),
        F.coalesce(total.cast("string"), F.lit("N/A")).alias("mutation_total_label"),
    )


def latest_generation_only(landscape: DataFrame) -> DataFrame:
    """Landscape rows of each experiment's newest generation."""
    newest = landscape.groupBy("experiment_id").agg(F.max("generation_number").alias("generation_number"))
    return landscape.join(newest, ["experiment_id", "generation_number"], "left_semi")


def landscape_view(runs: DataFrame, points: DataFrame, variants: DataFrame, metrics: DataFrame, mutations: DataFrame) -> DataFrame:
    """Stored embedding points with activity (height, else the run's metric) and
    the number of known non-synonymous protein changes."""
    changes = mutations.where("mutation_type = 'protein' and is_synonymous = false").groupBy("variant_id").agg(
        F.count(F.lit(1)).alias("protein_mutations"))
    values = metrics.where(F.col("variant_id").isNotNull()).select("variant_id", "metric_name", "metric_type", "value")
    return (
        points.join(runs.select("embedding_run_id", "experiment_id", "method", "metric_name", "metric_type"), "embedding_run_id")
        .join(variants.select("variant_id", "generation_id", "plasmid_variant_index"), "variant_id")
        .join(values, ["variant_id", "metric_name", "metric_type"], "left")
        .join(changes, "variant_id", "left")
        .select("embedding_run_id", "experiment_id", "method", "variant_id", "generation_id", "plasmid_variant_index",
                "x", "y", F.coalesce("z", "value").alias("activity_score"),
                F.coalesce("protein_mutations", F.lit(0)).alias("protein_mutations"))
    )


def idw_surface(points: DataFrame, keys: Sequence[str], grid: int = 60, power: float = 2.0) -> DataFrame:
    """Inverse-distance-weighted surface on a regular grid over each group.

    Points at one place count once with their weight; every point adds to the
    ``grid`` x ``grid`` cells, which are summed inside the tasks before the
    shuffle, so a task sends at most one row per cell and group.
    """
    if grid < 2:
        raise ValueError("grid must be at least 2")
    keys = list(keys)
    spots = points.where("x is not null and y is not null and z is not null").groupBy(*keys, "x", "y").agg(
        F.sum("z").alias("_z"), F.count(F.lit(1)).alias("_n"))
    frame = spots.groupBy(*keys).agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    cells = spots.join(frame, keys).withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(grid * grid - 1))))
    steps = float(grid - 1)
    gx = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * (F.col("_cell") % grid) / steps
    gy = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * F.floor(F.col("_cell") / grid) / steps
    near = (F.col("x") - F.col("grid_x")) * (F.col("x") - F.col("grid_x")) + (F.col("y") - F.col("grid_y")) * (F.col("y") - F.col("grid_y")) + 1e-12
    weight = 1.0 / near if power == 2.0 else 1.0 / F.pow(near, F.lit(power / 2.0))
    return (
        cells.withColumn("grid_x", gx)
        .withColumn("grid_y", gy)
        .withColumn("_w", weight)
        .groupBy(*keys, "_cell")
        .agg(F.first("grid_x").alias("grid_x"), F.first("grid_y").alias("grid_y"),
             (F.sum(F.col("_w") * F.col("_z")) / F.sum(F.col("_w") * F.col("_n"))).alias("grid_z"))
        .select(*keys, (F.col("_cell") % grid).alias("column"), F.floor(F.col("_cell") / grid).cast("int").alias("row"),
                "grid_x", "grid_y", "grid_z")
    )
