import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evospark.plans import flows, stored_flows
from evospark.sources.stores import CampaignStore, CommitConflict

GENE = "ATGGCTAAAGAACTGGATCGTTTCAAAGGTCTGGCTGAAATTCGTAACCTGGTTAAAGCT" * 3
BACKBONE = "CCGTTAGCCATGCAATTGGC"


def plasmid(gene):
    return BACKBONE + gene + "TAA" + "GGATCCAAGCTT"


def record(experiment, generation, index, gene=GENE, control=False, dna=500.0, row=None, parent=None):
    return (f"e{experiment}", row or index, experiment, str(index), str(generation), parent, plasmid(gene), str(dna), "50", str(control), {})


SCHEMA = ("file_path string, _row_number long, experiment_id long, variant_index string, generation string, parent_variant_index string, "
          "assembled_dna_sequence string, dna_yield string, protein_yield string, control string, metadata map<string,string>")


@pytest.fixture
def store(spark, tmp_path):
    out = CampaignStore(spark, f"file://{tmp_path}/store", parts=8)
    experiments = spark.createDataFrame([(e, "RAW") for e in range(6)], "experiment_id long, status string")
    stored_flows.create_store(out, {"experiments": experiments})
    return out


def upload(spark, store, rows, batch=None):
    return stored_flows.store_upload(store, spark.createDataFrame(rows, SCHEMA), batch)


def files(store, version):
    return {t: dict(f) for t, f in version.folders.items()}


def mappings(spark, experiments=range(6)):
    from evospark.functions import dna as D
    rows = [(e, "PLUS", len(BACKBONE) % 3, len(BACKBONE), len(BACKBONE) + len(GENE), GENE) for e in experiments]
    return spark.createDataFrame(rows, "experiment_id long, strand string, frame int, cds_start int, cds_end int, wt_cds string").withColumn(
        "wt_protein", D.translate(F.col("wt_cds")))


def test_only_touched_buckets_are_rewritten(spark, store):
    first = upload(spark, store, [record(e, 0, i) for e in (1, 2, 3) for i in (1, 2)])
    second = upload(spark, store, [record(2, 1, 7, parent="1")])
    part = {e: next(iter(store.parts_of(spark.createDataFrame([(e,)], "experiment_id long"), second))) for e in (1, 2, 3)}
    for table in ("variants", "metrics", "generations"):
        for e in (1, 3):
            assert part[e] != part[2] and files(store, first)[table][part[e]] == files(store, second)[table][part[e]]
        assert files(store, first)[table][part[2]] != files(store, second)[table][part[2]]
    assert store.read("variants").groupBy("experiment_id").count().orderBy("experiment_id").collect() == [(1, 2), (2, 3), (3, 2)]
    # An old version stays readable until it is forgotten.
    assert store.read("variants", first).count() == 6
    ids = {r["metric_definition_id"] for r in store.read("metrics").collect()}
    assert ids == {1, 2}


def test_a_lost_race_is_detected_and_changes_nothing(spark, store):
    base = store.head()
    ours = store.read("experiments", base).withColumn("status", F.lit("ours"))
    store.commit(base, {"experiments": ours})
    with pytest.raises(CommitConflict):
        store.commit(base, {"experiments": ours.withColumn("status", F.lit("theirs"))})
    assert {r.status for r in store.read("experiments").collect()} == {"ours"}
    assert store.head().number == base.number + 1
    commits = Path(store.root.removeprefix("file://")) / "_commits"
    assert not [p for p in commits.iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_a_crash_between_tables_leaves_the_old_state(spark, store):
    upload(spark, store, [record(1, 0, 1), record(4, 0, 1)])
    before = store.head()
    good = store.read("variants", before).withColumn("plasmid_variant_index", F.lit("changed"))
    bad = store.read("metrics", before).withColumn("value", F.raise_error(F.lit("executor lost")).cast("double"))
    with pytest.raises(Exception, match="executor lost"):
        store.commit(before, {"variants": good, "metrics": bad})
    assert store.head() == before
    assert {r.plasmid_variant_index for r in store.read("variants").collect()} == {"1"}
    after = store.commit(before, {"variants": good})
    assert {r.plasmid_variant_index for r in store.read("variants").collect()} == {"changed"}
    assert store.vacuum(keep=1) > 0 and store.head() == after
    assert store.read("variants").count() == 2 and store.read("metrics").count() == 4


def test_a_repeated_batch_changes_nothing(spark, store):
    first = upload(spark, store, [record(1, 0, 1)], ("intake", 0))
    assert upload(spark, store, [record(1, 0, 2)], ("intake", 0)) == first
    assert store.read("variants").count() == 1
    third = upload(spark, store, [record(1, 0, 2)], ("intake", 1))
    assert third.batches == {"intake": 1} and store.read("variants").count() == 2
    assert upload(spark, store, [], ("intake", 2)).batches == {"intake": 2}


def test_sequence_run_is_one_commit_and_then_empty(spark, store):
    silent = GENE[:5] + ("C" if GENE[5] != "C" else "T") + GENE[6:]
    changed = GENE[:9] + "TGG" + GENE[12:]
    upload(spark, store, [record(1, 0, 1), record(1, 0, 2, silent), record(1, 0, 3, changed), record(2, 0, 1, changed),
                          record(3, 0, 1, GENE[:30] + "TAA" + GENE[33:]), record(1, 0, 9, control=True)])
    before = store.head()
    after = stored_flows.run_sequences(store, mappings(spark))
    assert after.number == before.number + 1
    assert {t for t in after.folders if after.folders[t] != before.folders[t]} == {
        "variants", "metrics", "mutations", "variant_sequence_analysis", "experiments"}
    variants = {(r.experiment_id, r.plasmid_variant_index): r for r in store.read("variants").collect()}
    assert variants[1, "1"].protein_sequence and variants[1, "3"].protein_sequence != variants[1, "1"].protein_sequence
    called = [(variants[e, i].variant_id, e) for e, i in ((1, "3"), (2, "1"))]
    assert sorted((r.variant_id, r.experiment_id, r.position, r.mutated) for r in store.read("mutations").where("experiment_id < 3").collect()) == sorted(
        (v, e, 4, "W") for v, e in called)
    counts = {(r.variant_id, r.metric_name): r.value for r in store.read("metrics").where("metric_type = 'derived'").collect()}
    assert counts[variants[1, "2"].variant_id, "mutation_synonymous_count"] == 1.0
    assert counts[variants[1, "3"].variant_id, "mutation_total_count"] == 1.0
    assert len(counts) == 15 and store.read("metrics").where("wt_control_id is not null").count() == 2
    assert store.read("variant_sequence_analysis").count() == 5
    status = {r.experiment_id: r.status for r in store.read("experiments").collect()}
    assert status[1] == "ANALYSED" and status[2] == "ANALYSED" and status[3] == "ANALYSED_WITH_ERRORS" and status[4] == "RAW"
    # Nothing is left to do: no version, no files.
    assert stored_flows.run_sequences(store, mappings(spark)) == after and store.numbers()[-1] == after.number
    # A re-upload makes one variant pending again; the next run touches its bucket only.
    again = upload(spark, store, [record(2, 0, 1, silent)])
    assert store.read("mutations").where("experiment_id = 2").count() == 0
    third = stored_flows.run_sequences(store, mappings(spark))
    own = store.parts_of(spark.createDataFrame([(2,)], "experiment_id long"), third)
    for table in third.folders:
        changed_parts = {k for k in third.folders[table].keys() | again.folders[table].keys() if third.folders[table].get(k) != again.folders[table].get(k)}
        assert changed_parts <= own
    assert store.read("variant_sequence_analysis").count() == 5 and store.read("mutations").where("experiment_id < 3").count() == 1


def test_force_runs_everything_again(spark, store):
    upload(spark, store, [record(1, 0, 1), record(2, 0, 1)])
    one = stored_flows.run_sequences(store, mappings(spark))
    two = stored_flows.run_sequences(store, mappings(spark), force=True)
    assert two.number == one.number + 1 and store.read("metrics").where("metric_type = 'derived'").count() == 6


def test_scores_have_definitions(spark, store):
    upload(spark, store, [record(1, 0, 1, dna=800.0), record(1, 0, 9, control=True, dna=400.0)])
    stored_flows.store_scores(store)
    derived = store.read("metrics").where("metric_name = 'activity_score'").collect()
    assert [r.metric_definition_id for r in derived] == [5] and derived[0].experiment_id == 1


def test_merge_and_purge_by_bucket(spark, store):
    upload(spark, store, [record(e, 0, 1) for e in range(6)])
    base = store.head()
    rows = spark.createDataFrame([(3, "DONE")], "experiment_id long, status string")
    merged = store.merge("experiments", rows, ["experiment_id"])
    assert {r.experiment_id: r.status for r in store.read("experiments").collect()} == {e: "DONE" if e == 3 else "RAW" for e in range(6)}
    assert sum(merged.folders["experiments"].get(k) != p for k, p in base.folders["experiments"].items()) == 1
    store.purge(rows)
    assert sorted(r.experiment_id for r in store.read("variants").collect()) == [0, 1, 2, 4, 5]
    assert store.read("metrics").where("experiment_id = 3").count() == 0 and store.read("experiments").count() == 6
    assert store.merge("experiments", rows.limit(0), ["experiment_id"]) == store.head()


def test_manifest_names_every_table(spark, store):
    path = Path(store.root.removeprefix("file://")) / "_commits" / "000000000001.json"
    assert set(json.loads(path.read_text())["folders"]) == set(stored_flows.TABLES)
    with pytest.raises(KeyError):
        store.read("nothing")
    assert flows.pending_variants(store.read("variants")).count() == 0


def test_few_buckets_are_written_without_another_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([(e, f"{e}-{i}") for e in range(40) for i in range(3)] + [(None, "none")], "experiment_id long, name string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for parts, dealt in ((16, False), (64, True)):
        store = CampaignStore(spark, f"file://{tmp_path}/of-{parts}", parts=parts)
        assert ("Exchange" in plan(store._placed(rows, store.head()))) is dealt
        version = store.commit(store.head(), {"names": rows.repartition(3)})
        assert set(version.folders["names"]) == store.parts_of(rows, version)
        got = store.read("names", version)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.collect()))
        one = store.read("names", version, [k for k in version.folders["names"]][:1])
        assert one.where(store.part_of(F.col("experiment_id"), version) != list(version.folders["names"])[0]).isEmpty()
