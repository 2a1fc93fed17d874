"""Upserts of stored tables as snapshot merges, and versioned snapshot folders."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evospark.functions.coerce import float_or_null, record_bool, record_int, with_number_fields
from evospark.functions.keys import control_key, generation_key, surrogate, variant_key
from evospark.operators.lineage import resolve_parents
from evospark.operators.metrics import control_means


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return functools.reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def without_keys(df: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``removed`` (NULL equals NULL)."""
    gone = removed.select(*keys).distinct()
    return df.join(gone, _same(df, gone, keys), "left_anti")


def merge_snapshot(old: DataFrame, new: DataFrame, keys: Sequence[str], policy: str = "latest") -> DataFrame:
    """Merge new rows into a snapshot.

    ``latest``: a new row replaces the old row of its key. ``set_once``: an
    existing row stays.
    """
    if policy == "latest":
        return new.unionByName(without_keys(old, new, keys), allowMissingColumns=True)
    if policy == "set_once":
        return old.unionByName(without_keys(new, old, keys), allowMissingColumns=True)
    raise ValueError("policy must be latest or set_once")


def replace_where(old: DataFrame, new: DataFrame, condition: Column) -> DataFrame:
    """Delete the rows that match, then insert the new ones."""
    return old.where(~F.coalesce(condition, F.lit(False))).unionByName(new, allowMissingColumns=True)


def variant_metrics(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """Metric rows with their key; the generation comes from the variant."""
    gens = variants.select("variant_id", F.col("generation_id").alias("_gen"))
    return (
        rows.join(gens, "variant_id", "left")
        .withColumn("generation_id", F.coalesce("_gen", "generation_id") if "generation_id" in rows.columns else F.col("_gen"))
        .withColumn("metric_id", surrogate(F.lit("metric"), "variant_id", "metric_name", "metric_type"))
        .drop("_gen")
    )


def upsert_variant_metrics(metrics: DataFrame, rows: DataFrame, variants: DataFrame) -> DataFrame:
    """Upsert by (variant, name, type); the generation comes from the variant."""
    return merge_snapshot(metrics, variant_metrics(rows, variants), ["variant_id", "metric_name", "metric_type"])


def upsert_complete_metrics(metrics: DataFrame, rows: DataFrame, variants: DataFrame, done: DataFrame, replaced: Column) -> DataFrame:
    """``upsert_variant_metrics`` of rows that hold, for every variant in ``done``, each (name, type) that ``replaced``
    is true for, and nothing else: only such stored rows move, by their variant; the others stay where they are."""
    counts = F.coalesce(replaced, F.lit(False))
    new = variant_metrics(rows, variants)
    return (new.unionByName(without_keys(metrics.where(counts), done, ["variant_id"]), allowMissingColumns=True)
            .unionByName(metrics.where(~counts), allowMissingColumns=True))


def acceptable_mutations(called: DataFrame, scope: str = "protein") -> DataFrame:
    """Called mutations the mutations table takes: substitutions with complete
    fields; synonymous ones only in DNA scope."""
    kinds = ["NONSYNONYMOUS", "NONSENSE", "AMBIGUOUS"] + ([] if scope == "protein" else ["SYNONYMOUS"])
    original, mutated = ("wt_aa", "var_aa") if scope == "protein" else ("wt_codon", "var_codon")
    position = "aa_position_1based" if scope == "protein" else "codon_index_1based"
    return called.where(
        F.col("mutation_type").isin(kinds) & F.col(position).isNotNull()
        & F.col(original).isNotNull() & F.col(mutated).isNotNull()
    ).select(
        surrogate(F.lit("mutation"), "variant_id", F.lit(scope), position, original, mutated).alias("mutation_id"),
        "variant_id",
        F.lit(scope).alias("mutation_type"),
        F.col(position).alias("position"),
        F.col(original).alias("original"),
        F.col(mutated).alias("mutated"),
        F.when(F.col("mutation_type") != "AMBIGUOUS", F.col("mutation_type") == "SYNONYMOUS").alias("is_synonymous"),
        F.col("notes").alias("annotation"),
    )


MUTATION_KEYS = ["variant_id", "mutation_type", "position", "original", "mutated"]


def write_mutations(old: DataFrame, new: DataFrame, *, overwrite: bool) -> DataFrame:
    """Store mutation rows. ``overwrite`` drops all old rows of the variant and
    type first; otherwise existing rows stay."""
    keys = MUTATION_KEYS
    new = new.dropDuplicates(keys)
    if overwrite:
        return new.unionByName(without_keys(old, new, ["variant_id", "mutation_type"]), allowMissingColumns=True)
    return merge_snapshot(old, new, keys, "set_once")


def replace_embedding_run(runs: DataFrame, points: DataFrame, new_run: DataFrame, new_points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace the embedding runs of the same experiment, method, metric and
    feature, together with their points."""
    feature = F.coalesce(F.try_element_at("params", F.lit("feature")), F.lit(""))
    keys = ["experiment_id", "method", "metric_name", "metric_type", "_feature"]
    old_f, new_f = runs.withColumn("_feature", feature), new_run.withColumn("_feature", feature)
    gone = old_f.join(new_f.select(*keys).distinct(), keys, "left_semi").select("embedding_run_id")
    kept_runs = runs.join(gone, "embedding_run_id", "left_anti")
    kept_points = points.join(gone, "embedding_run_id", "left_anti").join(
        new_run.select("embedding_run_id"), "embedding_run_id", "left_anti")
    return kept_runs.unionByName(new_run), kept_points.unionByName(new_points)


def purge_experiments(tables: dict[str, DataFrame], experiments: DataFrame) -> dict[str, DataFrame]:
    """Remove the variants of the given experiments with everything below them."""
    gone = tables["variants"].join(experiments.select("experiment_id"), "experiment_id", "left_semi").select("variant_id")
    out = {}
    for name, df in tables.items():
        out[name] = df.join(gone, "variant_id", "left_anti") if "variant_id" in df.columns else df
    return out


def merged_metadata(old: Column, new: Column) -> Column:
    """Metadata after a re-upload: new keys win, stale analysis is dropped."""
    fresh = F.coalesce(new, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(
        F.coalesce(old, F.create_map().cast("map<string,string>")),
        lambda k, v: (k != "sequence_analysis") & ~F.map_contains_key(fresh, k),
    )
    merged = F.map_concat(kept, fresh)
    return F.when(F.size(merged) > 0, merged)


def upsert_uploads(records: DataFrame, variants: DataFrame, metrics: DataFrame) -> dict[str, DataFrame]:
    """Merge accepted upload records into the stored variants and metrics.

    ``records`` carry ``experiment_id``. The key of a variant is (experiment,
    generation, index). An update replaces sequence and yields, merges the
    metadata and clears everything derived; the parent of an existing variant
    stays. Control rows become one averaged baseline per generation and remove
    a variant stored under their key. Returns the new ``variants`` and
    ``metrics``, the rows of the upload's ``generations`` and ``controls``, the
    ``cleared`` variant ids and the ``counts``.
    """
    keys = ["experiment_id", "generation_number", "plasmid_variant_index"]
    records = with_number_fields(records)
    typed = records.select(
        "experiment_id",
        F.coalesce(record_int("generation"), F.lit(0)).cast("int").alias("generation_number"),
        F.coalesce(record_int("variant_index"), F.lit(0)).cast("string").alias("plasmid_variant_index"),
        record_int("parent_variant_index").alias("parent_variant_index"),
        "assembled_dna_sequence",
        float_or_null(F.col("dna_yield")).alias("dna_yield_raw"),
        float_or_null(F.col("protein_yield")).alias("protein_yield_raw"),
        F.coalesce(record_bool("control"), F.lit(False)).alias("is_control"),
        "metadata",
        "file_path",
        "_row_number",
    )
    order = F.struct("file_path", "_row_number")
    rows = (
        typed.where(~F.col("is_control"))
        .groupBy(*keys)
        .agg(
            F.max_by(F.struct("assembled_dna_sequence", "dna_yield_raw", "protein_yield_raw"), order).alias("_last"),
            F.max_by("metadata", order).alias("metadata"),
            F.min_by("parent_variant_index", order).alias("parent_variant_index"),
            F.count(F.lit(1)).alias("_times"),
        )
        .select(*keys, "_last.*", "metadata", "parent_variant_index", "_times")
    )
    control_slots = typed.where("is_control").select(*keys).distinct()
    kept_old = without_keys(variants, control_slots, keys)
    stored = kept_old.select(
        *keys, F.col("variant_id").alias("_old_id"), F.col("parent_variant_id").alias("_old_parent"),
        F.col("extra_metadata").alias("_old_meta"),
    )
    matched = rows.join(stored, keys, "left").withColumn("_is_new", F.col("_old_id").isNull())
    keyed = matched.withColumn(
        "variant_id", F.coalesce("_old_id", variant_key(*[F.col(k) for k in keys]))
    )
    known = kept_old.select(*keys, "variant_id").unionByName(keyed.where("_is_new").select(*keys, "variant_id"))
    fresh = (
        resolve_parents(keyed, known)
        .withColumn("parent_variant_id", F.when(F.col("_is_new"), F.col("parent_variant_id")).otherwise(F.col("_old_parent")))
        .withColumn("generation_id", generation_key("experiment_id", "generation_number"))
        .withColumn("extra_metadata", merged_metadata(F.col("_old_meta"), F.col("metadata")))
        .withColumn("protein_sequence", F.lit(None).cast("string"))
    )
    stored_cols = [c for c in variants.columns if c in fresh.columns]
    new_variants = fresh.select(*stored_cols).unionByName(
        without_keys(kept_old, rows, keys), allowMissingColumns=True)

    raw = fresh.unpivot(
        ["generation_id", "variant_id"], ["dna_yield_raw", "protein_yield_raw"], "metric_name", "value"
    ).where("value is not null").select(
        surrogate(F.lit("metric"), "variant_id", "metric_name", F.lit("raw")).alias("metric_id"),
        "generation_id", "variant_id", F.lit(None).cast("bigint").alias("wt_control_id"), "metric_name",
        F.lit("raw").alias("metric_type"), "value",
        F.when(F.col("metric_name") == "dna_yield_raw", "fg").otherwise("pg").alias("unit"),
    )
    means = control_means(records).select(
        surrogate(F.lit("control metric"), "wt_control_id", "metric_name").alias("metric_id"),
        "generation_id", F.lit(None).cast("bigint").alias("variant_id"), "wt_control_id", "metric_name",
        "metric_type", "value", "unit",
    )
    stale = variants.join(control_slots, keys, "left_semi").select("variant_id")
    cleared = stale.unionByName(keyed.where(~F.col("_is_new")).select("variant_id")).distinct()
    control_gens = typed.where("is_control").select(
        "experiment_id", "generation_number").distinct().withColumn(
        "wt_control_id", control_key("experiment_id", "generation_number"))
    kept_metrics = metrics.join(cleared, "variant_id", "left_anti").join(
        control_gens.select("wt_control_id"), "wt_control_id", "left_anti")
    new_metrics = raw.unionByName(means).unionByName(kept_metrics, allowMissingColumns=True)

    had = metrics.select("wt_control_id").distinct().withColumn("_had", F.lit(1))
    control_counts = control_gens.join(had, "wt_control_id", "left").groupBy("experiment_id").agg(
        F.count_if(F.col("_had").isNull()).alias("inserted"), F.count("_had").alias("updated"))
    variant_counts = keyed.groupBy("experiment_id").agg(
        F.count_if("_is_new").alias("inserted"),
        F.sum(F.when(F.col("_is_new"), F.col("_times") - 1).otherwise(F.col("_times"))).alias("updated"))
    generations = typed.select("experiment_id", "generation_number").distinct().select(
        generation_key("experiment_id", "generation_number").alias("generation_id"), "experiment_id", "generation_number")
    controls = control_gens.select(
        "wt_control_id", generation_key("experiment_id", "generation_number").alias("generation_id"))
    counts = variant_counts.unionByName(control_counts).groupBy("experiment_id").agg(
        F.sum("inserted").alias("inserted"), F.sum("updated").alias("updated"))
    return {"variants": new_variants, "metrics": new_metrics, "generations": generations, "controls": controls,
            "cleared": cleared, "counts": counts}


def with_parent_index(variants: DataFrame) -> DataFrame:
    """Variants with the index of their parent (``parent_index``). Rows without a
    parent are dealt by their own id, so they don't meet in one task."""
    names = variants.select(
        F.col("variant_id").alias("parent_variant_id"), F.xxhash64("variant_id").alias("_place"),
        F.col("plasmid_variant_index").alias("parent_index"))
    placed = variants.withColumn("_place", F.xxhash64(F.coalesce("parent_variant_id", "variant_id")))
    return placed.join(names, ["parent_variant_id", "_place"], "left").drop("_place")


def clear_derived(tables: dict[str, DataFrame], cleared: DataFrame) -> dict[str, DataFrame]:
    """Stored tables (mutations, sequence analysis) without the rows of re-uploaded variants."""
    return {name: df.join(cleared.select("variant_id").distinct(), "variant_id", "left_anti") for name, df in tables.items()}


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Version numbers of the finished snapshots below a folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(base)]
    found = [int(n.split("=")[1]) for n in names if n.startswith("snapshot=")]
    return sorted(v for v in found if fs.exists(hadoop.Path(f"{root}/snapshot={v}/_SUCCESS")))


def write_snapshot(df: DataFrame, root: str, partition_by: Sequence[str] = ()) -> str:
    """Write the next version of a table. Readers see it when it is complete;
    the version it was computed from stays untouched."""
    done = _versions(df.sparkSession, root)
    path = f"{root}/snapshot={(done[-1] if done else 0) + 1}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Newest finished version of a table."""
    done = _versions(spark, root)
    if not done:
        raise FileNotFoundError(f"no snapshot below {root}")
    return spark.read.parquet(f"{root}/snapshot={done[-1]}")
