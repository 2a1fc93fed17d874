"""The three flows: upload, sequence analysis, activity report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evospark.operators import metrics as M, mutations as U, qc, ranking as R, scoring as S, sequences as Q
from evospark.session import cut_lineage
from evospark.sources import snapshots, uploads


def ingest_folder(spark: SparkSession, folder: str, experiments: DataFrame, variants: DataFrame,
                  metrics: DataFrame, options: qc.QualityOptions = qc.QualityOptions(),
                  derived: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Read a folder of uploads, check them, and merge the accepted files.

    ``experiments`` maps ``file_path`` to ``experiment_id``. ``derived`` are
    stored tables by variant (mutations, sequence analysis): they come back
    without the rows that the upload made stale.
    """
    records = cut_lineage(uploads.read_uploads(spark, folder))
    checked = qc.check_records(records, options=options)
    findings = qc.cross_record_findings(records)
    fatal = uploads.fatal_file_errors(spark, folder, records)
    accepted, rejected = qc.upload_gate(checked, findings, fatal)
    scoped = accepted.join(experiments.select("file_path", "experiment_id"), "file_path")
    merged = snapshots.upsert_uploads(scoped, variants, metrics)
    merged |= snapshots.clear_derived(derived or {}, merged["cleared"])
    return {**merged, "rejected": rejected, "fatal": fatal, "summary": qc.upload_summary(checked, findings)}


def pending_variants(variants: DataFrame, analyses: DataFrame | None = None, *, force: bool = False) -> DataFrame:
    """Variants a run has to process: those without a protein, or all. With the
    stored ``analyses``, variants that were processed and failed are not repeated."""
    if force:
        return variants
    todo = variants.where(F.col("protein_sequence").isNull())
    return todo if analyses is None else todo.join(analyses.select("variant_id"), "variant_id", "left_anti")


STORED_OF_A_RUN = [
    "experiment_id", "variant_id", "strand", "frame", "cds_start", "cds_end", "cds_dna", "protein_aa", "has_frameshift", "has_premature_stop",
    "has_ambiguous_bases", "qc_notes", "mutations", "mutation_counts"]
"""What the stored tables take from a run's rows; its plasmids and wild types are stored already."""


def store_sequence_run(guarded: DataFrame, variants: DataFrame, mutations: DataFrame, metrics: DataFrame,
                       analyses: DataFrame, experiments: DataFrame, definitions: DataFrame, *,
                       keep: Callable[[DataFrame], DataFrame] = cut_lineage,
                       owned: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> dict[str, DataFrame]:
    """The stored tables after a sequence run: proteins and analysis in
    ``variants``, the run's ``mutations``, count ``metrics`` with their definition,
    ``analyses`` and the status of the ``experiments``. Rows of other variants stay.

    ``keep`` stores the run's rows until the tables are written. ``owned`` adds what mutations and analyses have of
    their variant; it is a join by variant, put where the rows are dealt by variant already."""
    guarded = keep(guarded.select(*STORED_OF_A_RUN))
    done = guarded.select("variant_id")
    found = guarded.select("variant_id", F.col("protein_aa").alias("_protein"), F.struct("mutations", "mutation_counts").alias("_analysis"), F.lit(True).alias("_ran"))
    columns = {"protein_sequence": F.when(F.col("_ran"), F.col("_protein")).otherwise(F.col("protein_sequence"))}
    if "sequence_analysis" in variants.columns:
        columns["sequence_analysis"] = F.when(F.col("_ran"), F.col("_analysis")).otherwise(F.col("sequence_analysis"))
    called = snapshots.acceptable_mutations(U.mutation_rows(guarded))
    kept = owned(mutations.join(done, "variant_id", "left_anti"))
    fresh = called.repartition("variant_id").dropDuplicates(snapshots.MUTATION_KEYS)  # dealt as ``owned`` needs it
    # The run's variants have no row in ``kept``: only rows without a variant may be stored already.
    homeless = mutations.where("variant_id is null")
    if not homeless.isEmpty():
        fresh = snapshots.without_keys(fresh, homeless, snapshots.MUTATION_KEYS)
    counted = snapshots.upsert_complete_metrics(metrics, U.count_metric_rows(guarded), variants, done, U.is_count_metric())
    analysed = U.analysis_rows(guarded)
    status = U.run_status(guarded).withColumnRenamed("status", "_status")
    return {
        "variants": variants.join(found, "variant_id", "left").withColumns(columns).select(*variants.columns),
        "mutations": kept.unionByName(owned(fresh), allowMissingColumns=True),
        "metrics": M.fill_definition_ids(counted, definitions),
        "analyses": owned(analysed).unionByName(owned(snapshots.without_keys(analyses, done, ["variant_id"])), allowMissingColumns=True),
        "experiments": experiments.join(status, "experiment_id", "left").withColumn(
            "status", F.coalesce("_status", "status")).drop("_status"),
    }


def analyse_sequences(variants: DataFrame, mappings: DataFrame, *, force: bool = False,
                      stop_policy: str = "truncate", fallback_search: bool = True,
                      analyses: DataFrame | None = None,
                      keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Extract, translate and compare every pending variant of all experiments.

    ``mappings`` holds the wild-type mapping per experiment. Variants whose
    extraction is unreliable are searched once more with a mapping found in the
    variant's own plasmid. ``keep`` stores what is used more than once.
    """
    todo = pending_variants(variants, analyses, force=force).select("experiment_id", "variant_id", "assembled_dna_sequence")
    mapping = mappings.select("experiment_id", "strand", "frame", "cds_start", "cds_end", "wt_cds", "wt_protein")
    extracted = Q.extract_cds(todo.join(mapping, "experiment_id"), stop_policy)
    # The wild-type CDS stays the reference even when a variant is remapped.
    if fallback_search:
        extracted = keep(extracted)
        weak = extracted.where(Q.needs_remap())
        own = keep(Q.locate_wild_type(
            weak.select("variant_id", "wt_protein", "assembled_dna_sequence"), ["variant_id"],
            plasmid="assembled_dna_sequence",
        ).withColumnRenamed("wt_cds", "_own_cds").drop("wt_protein", "match_identity_pct"))
        again = (
            weak.select("experiment_id", "variant_id", "assembled_dna_sequence", "wt_protein", F.col("wt_cds").alias("_ref"))
            .join(own, "variant_id")
            .withColumnRenamed("_own_cds", "wt_cds")
        )
        remapped = Q.extract_cds(again, stop_policy).drop("wt_cds").withColumnRenamed("_ref", "wt_cds")
        mapped = own.select("variant_id")
        good = extracted.where(~F.coalesce(Q.needs_remap(), F.lit(False)))
        # Rows that were good move only if one of them shares its id with a remapped one.
        if not good.select("variant_id").join(mapped, "variant_id", "left_semi").isEmpty():
            good = good.join(mapped, "variant_id", "left_anti")
        extracted = good.unionByName(weak.join(mapped, "variant_id", "left_anti")).unionByName(remapped)
    return U.guard_profiles(U.call_mutations(extracted))


def activity_report(variants: DataFrame, metrics: DataFrame, generations: DataFrame, mode: str = "auto", *,
                    strict: bool = False) -> dict[str, DataFrame]:
    """Score all experiments, store the metric rows, and build the top-10."""
    scored = S.score_experiments(
        M.raw_yields(variants, metrics), M.wt_baselines(metrics), generations, mode, strict=strict)
    stored = snapshots.upsert_variant_metrics(metrics, S.score_metric_rows(scored), variants)
    return {
        "scored": scored,
        "metrics": stored,
        "top10": R.top_variants(variants, stored),
        "distribution": M.distribution_rows(variants, stored),
    }


def refresh_views(views: dict[str, DataFrame], store: str) -> dict[str, str | None]:
    """Rewrite materialised report tables (landscape, domain enrichment). One
    failing view does not stop the others: the result maps each name to None or
    to its error."""
    outcome: dict[str, str | None] = {}
    for name, df in views.items():
        try:
            snapshots.write_snapshot(df, f"{store}/{name}")
            outcome[name] = None
        except Exception as exc:  # the caller decides what a failed view means
            outcome[name] = f"{type(exc).__name__}: {exc}"
    return outcome
