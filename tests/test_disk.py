"""What a stored sequence run leaves on disk, and what its merges move."""

import os
import time
from pathlib import Path

from pyspark.sql import functions as F

from evospark.functions import dna as D
from evospark.operators import mutations as U
from evospark.plans import flows, stored_flows
from evospark.schemas import METRIC_DEFINITIONS, struct_of
from evospark.session import SIZES_IN_MEMORY, Scratch, scratch_path, settings
from evospark.sources import snapshots
from evospark.sources.stores import CampaignStore

GENE = "ATGGCTAAAGAACTGGATCGTTTCAAAGGTCTGGCTGAAATTCGTAACCTGGTTAAAGCT" * 3
BACKBONE = "CCGTTAGCCATGCAATTGGC"


def plasmid(gene):
    return BACKBONE + gene + "TAA" + "GGATCCAAGCTT"


def mappings(spark):
    rows = [(e, "PLUS", len(BACKBONE) % 3, len(BACKBONE), len(BACKBONE) + len(GENE), GENE) for e in (1, 2)]
    return spark.createDataFrame(rows, "experiment_id long, strand string, frame int, cds_start int, cds_end int, wt_cds string").withColumn(
        "wt_protein", D.translate(F.col("wt_cds")))


def tables(spark):
    """Repeated variants (4, 5), rows without a variant, rows of unknown variants, old count metrics and mutations of every kind."""
    changed, silent = GENE[:9] + "TGG" + GENE[12:], GENE[:5] + "C" + GENE[6:]
    rows = [(1, 1, changed, None), (2, 1, silent, None), (3, 1, GENE, "DONE"), (4, 2, changed, None), (4, 2, changed, None), (5, 2, GENE, "DONE"),
            (5, 2, GENE, "DONE"), (6, 2, GENE[:30] + "TAA" + GENE[33:], None), (7, 2, changed[:-90], None)]
    variants = spark.createDataFrame(
        [(v, e, e * 10, 0, None, str(v), plasmid(g), p, None) for v, e, g, p in rows],
        "variant_id long, experiment_id long, generation_id long, generation_number int, parent_variant_id long, plasmid_variant_index string, "
        "assembled_dna_sequence string, protein_sequence string, extra_metadata map<string,string>")
    mutations = spark.createDataFrame(
        [(i, v, "protein", 4 + i, "A", "C", False, None, 1) for i, v in enumerate((1, 3, 3, 4, 5, 99, None))], struct_of("mutations").add("experiment_id", "long"))
    names = ["activity_score", *U.COUNT_METRICS]
    metrics = spark.createDataFrame(
        [(100 * v + k, 10, v, None, n, t, 9.0, None, None, 1) for v in (1, 3, 4, 5, 99) for k, (n, t) in enumerate([(n, "derived") for n in names] + [(names[1], "raw")])]
        + [(7, 10, None, 5, names[1], "derived", 1.0, None, None, 1), (8, 10, 1, None, None, "derived", 1.0, None, None, 1), (9, 10, 1, None, names[1], None, 1.0, None, None, 1)],
        struct_of("metrics").add("experiment_id", "long"))
    experiments = spark.createDataFrame([(1, "RAW"), (2, "RAW")], "experiment_id long, status string")
    generations = spark.createDataFrame([(10, 1, 0), (20, 2, 0)], struct_of("generations"))
    return {"variants": variants, "mutations": mutations, "metrics": metrics, "experiments": experiments, "generations": generations}


def make_store(spark, root):
    store = CampaignStore(spark, f"file://{root}/store", parts=8)
    stored_flows.create_store(store, tables(spark))
    return store


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def none_left(spark, before, seconds=20):
    until = time.time() + seconds  # files are deleted in the background
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return not left


def test_a_commit_leaves_compressed_files_and_no_shuffle(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 4).select((F.col("id") % 7).alias("experiment_id"), F.col("id").cast("string").alias("name"))
    held = rows.groupBy("experiment_id").agg(F.max("name").alias("name"))
    store, before = CampaignStore(spark, f"file://{tmp_path}/store", parts=64), shuffle_files(spark)
    version = store.commit(store.head(), {"names": rows, "last": held})
    assert none_left(spark, before)
    files = [f for _, _, names in os.walk(tmp_path / "store" / "names") for f in names if f.endswith(".parquet")]
    assert files and all(".zstd." in f for f in files)
    assert store.read("names", version).count() == 4000 and held.count() == 7


def test_a_run_leaves_nothing_but_the_store(spark, tmp_path):
    store = make_store(spark, tmp_path)
    shared = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    there = lambda: {p for p in shared.rglob("*") if p.name.startswith(("rdd-", "scratch-"))}
    before = there()
    first = stored_flows.run_sequences(store, mappings(spark))
    assert first.number == 2 and there() == before
    assert stored_flows.run_sequences(store, mappings(spark)) == first and there() == before
    assert all(spark.conf.get(k) != v for k, v in SIZES_IN_MEMORY.items())


def test_scratch_goes_with_its_run_also_after_a_failure(spark):
    try:
        with Scratch(spark) as scratch:
            kept = scratch.keep(spark.range(5).select("id", F.array(F.struct(F.lit("a").alias("b"))).alias("x")))
            assert kept.count() == 5 and kept.schema.simpleString() == "struct<id:bigint,x:array<struct<b:string>>>"
            raise KeyError("run")
    except KeyError:
        pass
    assert not Path(scratch.root.removeprefix("file:")).exists()


def test_settings_hold_for_a_while(spark):
    spark.conf.set("evospark.probe", "one")
    with settings(spark, {"evospark.probe": "two", "evospark.other": "x"}):
        assert (spark.conf.get("evospark.probe"), spark.conf.get("evospark.other")) == ("two", "x")
    assert spark.conf.get("evospark.probe") == "one" and spark.conf.get("evospark.other", None) is None


def plain_run(guarded, variants, mutations, metrics, analyses, generations):
    """The merges by all their keys, as plainly as they can be written."""
    kept = mutations.join(guarded, "variant_id", "left_anti")
    called = snapshots.acceptable_mutations(U.mutation_rows(guarded))
    merged = snapshots.write_mutations(kept, called, overwrite=False)
    counted = snapshots.upsert_variant_metrics(metrics, U.count_metric_rows(guarded), variants)
    analysed = snapshots.merge_snapshot(analyses, U.analysis_rows(guarded), ["variant_id"])
    return {"mutations": stored_flows._by_variant(merged, variants), "metrics": stored_flows._by_generation(counted, generations),
            "variant_sequence_analysis": stored_flows._by_variant(analysed, variants)}


def rows_of(df, skip=("created_at", "updated_at", "metric_definition_id")):
    return sorted(repr([r[c] for c in sorted(df.columns) if c not in skip]) for r in df.collect())


def test_a_run_merges_as_by_all_keys(spark, tmp_path):
    store = make_store(spark, tmp_path)
    base = store.head()
    old = {t: store.read(t, base) for t in stored_flows.TABLES}
    pending = old["variants"].where("protein_sequence is null")
    guarded = flows.analyse_sequences(pending, mappings(spark), force=True)
    want = plain_run(guarded, old["variants"], old["mutations"], old["metrics"], old["variant_sequence_analysis"], old["generations"])
    stored_flows.run_sequences(store, mappings(spark))
    for table, df in want.items():
        got = store.read(table)
        assert rows_of(got) == rows_of(df.select(*got.columns)) and got.count() > 0, table
    # Repeated variants repeat their rows, a run's own rows among them.
    assert store.read("variant_sequence_analysis").where("variant_id = 4").count() == 4
    assert store.read("mutations").where("variant_id = 5").count() == 2 and store.read("mutations").where("variant_id = 99").count() == 0


def test_rows_without_a_variant_are_stored_once(spark):
    given, definitions = tables(spark), spark.createDataFrame(METRIC_DEFINITIONS, struct_of("metric_definitions"))
    nobody = given["variants"].where("variant_id = 1").withColumn("variant_id", F.lit(None).cast("long")).withColumn(
        "assembled_dna_sequence", F.lit(plasmid(GENE[:150] + "TGG" + GENE[153:])))
    variants = given["variants"].where("variant_id = 3").unionByName(nobody)
    guarded = flows.analyse_sequences(nobody, mappings(spark), force=True)
    called = snapshots.acceptable_mutations(U.mutation_rows(guarded))
    empty = spark.createDataFrame([], struct_of("variant_sequence_analysis"))
    stored = lambda mutations: flows.store_sequence_run(
        guarded, variants, mutations, given["metrics"].drop("experiment_id"), empty, given["experiments"], definitions)
    out = stored(called)
    assert called.count() == 1 == out["mutations"].count() and stored(called.limit(0))["mutations"].count() == 1
    assert out["metrics"].where("variant_id is null and metric_type = 'derived'").count() == 3


def test_only_rows_that_may_change_pass_a_shuffle(spark):
    given, definitions = tables(spark), spark.createDataFrame(METRIC_DEFINITIONS, struct_of("metric_definitions"))
    empty = spark.createDataFrame([], struct_of("variant_sequence_analysis").add("experiment_id", "long"))
    with Scratch(spark) as scratch, settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        at = {t: scratch.keep(given[t]) for t in ("variants", "metrics")} | {
            "mutations": scratch.keep(given["mutations"].where("variant_id is not null"))}
        found = flows.store_sequence_run(
            flows.analyse_sequences(at["variants"].where("protein_sequence is null"), mappings(spark), force=True), at["variants"], at["mutations"],
            at["metrics"], empty, given["experiments"], definitions, keep=scratch.keep, owned=lambda rows: stored_flows._by_variant(rows, at["variants"]))
        plan = found["mutations"]._jdf.queryExecution().executedPlan().toString()
        moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        # The stored rows, the run's variants, the run's mutations, and the owners twice.
        assert len(moves) == 5 and all("hashpartitioning(variant_id" in line for line in moves), plan
        stay = found["metrics"].where("metric_name = 'activity_score'").select("metric_name")
        assert found["metrics"].count() > stay.count() == 5


def test_a_good_row_that_shares_its_id_with_a_remapped_one_goes(spark):
    """A repeated id: one row is good, the other ends early and is mapped anew."""
    rows = [(1, 1, plasmid(GENE)), (1, 1, plasmid(GENE[:30] + "TAA" + GENE[33:])), (1, 2, plasmid(GENE))]
    variants = spark.createDataFrame(rows, "experiment_id long, variant_id long, assembled_dna_sequence string").withColumn(
        "protein_sequence", F.lit(None).cast("string"))
    with Scratch(spark) as scratch:
        got = flows.analyse_sequences(variants, mappings(spark), keep=scratch.keep).select("variant_id", F.length("cds_dna").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(1, 30), (2, 180)]
