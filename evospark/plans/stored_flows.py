"""The flows over a campaign store: each is one commit of every table it changes."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evospark.operators import metrics as M, qc
from evospark.plans import flows
from evospark.schemas import METRIC_DEFINITIONS, struct_of
from evospark.session import SIZES_IN_MEMORY, Scratch, cut_lineage, settings
from evospark.sources import snapshots, uploads
from evospark.sources.stores import CampaignStore, Version

TABLES = ["experiments", "generations", "variants", "wild_type_controls", "metrics", "mutations", "variant_sequence_analysis",
          "upload_files"]
"""Tables of a store; the ones without an experiment of their own carry ``experiment_id`` as well."""


def create_store(store: CampaignStore, tables: dict[str, DataFrame] | None = None) -> Version:
    """The first version: the given tables, the others empty."""
    given = tables or {}
    spark = store.spark

    def empty(name: str) -> DataFrame:
        out = spark.createDataFrame([], struct_of(name))
        return out if "experiment_id" in out.columns else out.withColumn("experiment_id", F.lit(None).cast("bigint"))

    return store.commit(store.head(), {name: given[name] if name in given else empty(name) for name in TABLES})


def metric_definitions(store: CampaignStore) -> DataFrame:
    return store.spark.createDataFrame(METRIC_DEFINITIONS, struct_of("metric_definitions"))


def _by_variant(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """``rows`` with the experiment of their variant."""
    return rows.drop("experiment_id").join(variants.select("variant_id", "experiment_id"), "variant_id")


def _by_generation(metrics: DataFrame, generations: DataFrame) -> DataFrame:
    """Metric rows with the experiment of their generation (variants and controls alike)."""
    owner = generations.select("generation_id", F.col("experiment_id").alias("_owner"))
    return metrics.join(owner, "generation_id", "left").withColumn("experiment_id", F.coalesce("_owner", "experiment_id")).drop("_owner")


def store_upload(store: CampaignStore, records: DataFrame, batch: tuple[str, int] | None = None,
                 definitions: DataFrame | None = None, files: DataFrame | None = None) -> Version:
    """Merge accepted records (with ``experiment_id``) into the store as one commit.

    Variants, metrics, generations and controls are merged; mutations and
    analyses of re-uploaded variants go. ``files`` are rows of ``upload_files``,
    also of files without accepted records; the newest row of a file counts. Only the buckets of the uploaded
    experiments are read and written. A batch that the store has seen, and an
    upload without records, change nothing.
    """
    base = store.head()
    if base.applied(batch):
        return base
    parts = store.parts_of(records, base) | (store.parts_of(files, base) if files is not None else set())
    if not parts:
        return store.commit(base, {}, parts, batch) if batch else base
    old = {t: store.read(t, base, parts) for t in TABLES}
    merged = snapshots.upsert_uploads(records, old["variants"], old["metrics"])
    cleared = cut_lineage(merged["cleared"])
    derived = snapshots.clear_derived({t: old[t] for t in ("mutations", "variant_sequence_analysis")}, cleared)
    generations = cut_lineage(snapshots.merge_snapshot(old["generations"], merged["generations"], ["generation_id"], "set_once"))
    controls = merged["controls"].join(generations.select("generation_id", "experiment_id"), "generation_id")
    metrics = M.fill_definition_ids(_by_generation(merged["metrics"], generations), definitions or metric_definitions(store))
    changes = {
        "variants": merged["variants"], "generations": generations, **derived,
        "wild_type_controls": snapshots.merge_snapshot(old["wild_type_controls"], controls, ["wt_control_id"]),
        "metrics": metrics,
    }
    if files is not None:
        changes["upload_files"] = snapshots.merge_snapshot(old["upload_files"], files, ["experiment_id", "file_path"])
    return store.commit(base, {t: df.select(*old[t].columns) for t, df in changes.items()}, parts, batch)


def store_files(store: CampaignStore, names: list[str], experiment_of: Callable[[Column], Column],
                options: qc.QualityOptions = qc.QualityOptions(), batch: tuple[str, int] | None = None) -> Version:
    """Read, check and merge upload files (TSV, CSV and JSON, by extension in any case) as one commit.

    ``experiment_of`` turns the file path into the experiment id. Every file gets
    a row of ``upload_files``: accepted, rejected (with its findings), fatal
    (with the reason) or unknown_format. Accepted files are merged into the tables.
    """
    spark, base = store.spark, store.head()
    if base.applied(batch):
        return base
    delimited = [n for n in names if n.lower().endswith((".tsv", ".csv"))]
    documents = [n for n in names if n.lower().endswith(".json")]
    read = ([uploads.read_delimited(spark, delimited)] if delimited else []) + ([uploads.read_json(spark, documents)] if documents else [])
    files = spark.createDataFrame([(n,) for n in names], "file_path string")  # a batch of names
    if not read:
        unread = files.select(experiment_of(F.col("file_path")).alias("experiment_id"), "file_path", F.lit("unknown_format").alias("status"),
                              *(F.lit(None).cast(t).alias(c) for c, t in _report_columns() if c not in ("experiment_id", "file_path", "status")))
        return store_upload(store, _no_records(spark), batch, files=unread)
    records = cut_lineage(functools.reduce(DataFrame.unionByName, read))
    checked = cut_lineage(qc.check_records(records, options=options))
    crossed = cut_lineage(qc.cross_record_findings(records))
    fatal = cut_lineage(uploads.file_errors(spark, delimited, documents, records))
    accepted, _ = qc.upload_gate(checked, crossed, fatal)
    accepted = cut_lineage(accepted.withColumn("experiment_id", experiment_of(F.col("file_path"))))
    return store_upload(store, accepted, batch, files=_file_reports(files, checked, crossed, fatal, experiment_of))


def _report_columns() -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in struct_of("upload_files").fields]


def _no_records(spark: SparkSession) -> DataFrame:
    text = ", ".join(f"{c} string" for c in ("file_path", *uploads.KNOWN_FIELDS))
    return spark.createDataFrame([], f"experiment_id bigint, _row_number bigint, number_fields array<string>, metadata map<string,string>, {text}")


def _file_reports(files: DataFrame, checked: DataFrame, crossed: DataFrame, fatal: DataFrame,
                  experiment_of: Callable[[Column], Column]) -> DataFrame:
    """Rows of ``upload_files``: findings of records are counted per code, cross-record ones come with their own count."""
    of_records = functools.reduce(DataFrame.unionByName, (
        checked.select("file_path", F.lit(level).alias("level"), F.explode(column).alias("code"))
        for level, column in (("error", "errors"), ("warning", "warnings")))).groupBy("file_path", "level", "code").agg(F.count("*").alias("occurrences"))
    of_files = crossed.select("file_path", "level", F.col("rule").alias("code"), F.col("findings").cast("bigint").alias("occurrences"))
    findings = of_records.unionByName(of_files).groupBy("file_path").agg(
        F.array_sort(F.collect_list(F.struct("level", "code", "occurrences"))).alias("findings"))  # one entry per code
    counts = checked.groupBy("file_path").agg(F.count("*").alias("record_count"))
    known = F.lower("file_path").rlike(r"\.(tsv|csv|json)$")
    status = (F.when(~known, "unknown_format").when(F.col("error").isNotNull(), "fatal")
              .when(F.exists(F.coalesce("findings", F.array()), lambda f: f["level"] == "error"), "rejected").otherwise("accepted"))
    return (files.join(fatal, "file_path", "left").join(counts, "file_path", "left").join(findings, "file_path", "left")
            .select(experiment_of(F.col("file_path")).alias("experiment_id"), "file_path", status.alias("status"), "error",
                    F.coalesce("record_count", F.lit(0)).cast("bigint").alias("record_count"), "findings"))


def run_sequences(store: CampaignStore, mappings: DataFrame, *, force: bool = False, definitions: DataFrame | None = None,
                  **options) -> Version:
    """Analyse every pending variant of the store and commit proteins, mutations, count metrics, analyses and the
    status of the experiments together.

    Returns the new version, or the newest one unchanged when nothing is pending. A run that dies leaves the store
    as it was; run again, it does the same work.
    """
    base = store.head()
    with Scratch(store.spark) as run, settings(store.spark, SIZES_IN_MEMORY):
        todo = run.keep(flows.pending_variants(store.read("variants", base), store.read("variant_sequence_analysis", base), force=force)
                        .select("experiment_id", "variant_id"))
        parts = store.parts_of(todo, base)
        if not parts:
            return base
        old = {t: store.read(t, base, parts) for t in TABLES}
        pending = old["variants"].join(todo.select("variant_id"), "variant_id", "left_semi")
        with Scratch(store.spark) as steps:
            found = flows.store_sequence_run(
                flows.analyse_sequences(pending, mappings, force=True, keep=steps.keep, **options), old["variants"], old["mutations"],
                old["metrics"], old["variant_sequence_analysis"], old["experiments"], definitions or metric_definitions(store),
                keep=run.keep, owned=lambda rows: _by_variant(rows, old["variants"]))
        changes = {
            # Written in this order: the largest shuffle first, while the disk holds least.
            "mutations": found["mutations"], "variant_sequence_analysis": found["analyses"],
            "metrics": _by_generation(found["metrics"], old["generations"]), "variants": found["variants"], "experiments": found["experiments"],
        }
        return store.commit(base, {t: df.select(*old[t].columns) for t, df in changes.items()}, parts)


def store_scores(store: CampaignStore, mode: str = "auto", definitions: DataFrame | None = None, **options) -> Version:
    """Score all experiments of the store and commit the metric rows with their definition."""
    base = store.head()
    variants, metrics = store.read("variants", base), store.read("metrics", base)
    scored = flows.activity_report(variants, metrics, store.read("generations", base), mode, **options)["metrics"]
    placed = _by_generation(scored, store.read("generations", base))
    filled = M.fill_definition_ids(placed, definitions or metric_definitions(store))
    return store.commit(base, {"metrics": filled.select(*metrics.columns)})
