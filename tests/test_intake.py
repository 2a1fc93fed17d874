import json

from pyspark.sql import functions as F

from evospark.plans import stored_flows
from evospark.sources import uploads
from evospark.sources.stores import CampaignStore
from evospark.streaming.ingest import start_intake

GOOD = "ACGT" * 30
HEAD = "id\tgen\tparent_id\tdna_yield\tprotein_yield\tsequence\tcontrol\n"


def of_name(path):
    """Experiment 1 or 2, by the first digit of the file's name."""
    return F.regexp_extract(path, r"/e(\d)[^/]*$", 1).try_cast("bigint")


def entry(i, dna=500, **more):
    return {"id": i, "gen": 0, "dna_yield": dna, "protein_yield": 50, "sequence": GOOD, "control": False, **more}


def test_mixed_files_rejects_and_replay(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = CampaignStore(spark, f"file://{tmp_path}/store", parts=4)
    stored_flows.create_store(store)
    checkpoint = str(tmp_path / "cp")

    def run(at=checkpoint):
        q = start_intake(spark, str(folder), store, of_name, at)
        q.awaitTermination()
        assert q.exception() is None

    (folder / "e1-one.tsv").write_text(HEAD + f"1\t0\t\t500\t50\t{GOOD}\tFalse\n2\t0\t\t400\t50\t{GOOD}\tTrue\n")
    (folder / "e2-two.JSON").write_text(json.dumps({"records": [entry(5), entry(6)]}))
    run()
    first = store.head()
    (folder / "e1-more.csv").write_text((HEAD + f"1\t0\t\t700\t70\t{GOOD}\tFalse\n7\t1\t1\t600\t60\t{GOOD}\tFalse\n").replace("\t", ","))
    (folder / "e1-bad.tsv").write_text(HEAD + f"9\t1\t1\t1\t60\t{GOOD}\tFalse\n")
    (folder / "e1-empty.tsv").write_text("")
    (folder / "e1-empty.json").write_text("")
    (folder / "e2-broken.json").write_text("{oops")
    (folder / "e1-head.csv").write_text(HEAD.replace("\t", ","))
    (folder / "e1-notes.md").write_text("no table")
    run()
    rows = store.read("variants").collect()
    assert {(r.experiment_id, r.plasmid_variant_index) for r in rows} == {(1, "1"), (1, "7"), (2, "5"), (2, "6")}
    ids = {r.plasmid_variant_index: r for r in rows}
    assert ids["7"].parent_variant_id == ids["1"].variant_id
    metrics = store.read("metrics").where("experiment_id = 1").collect()
    assert sorted((r.wt_control_id is not None, r.metric_name, r.value) for r in metrics) == [
        (False, "dna_yield_raw", 600.0), (False, "dna_yield_raw", 700.0), (False, "protein_yield_raw", 60.0),
        (False, "protein_yield_raw", 70.0), (True, "dna_yield_raw", 400.0), (True, "protein_yield_raw", 50.0)]
    reports = {r.file_path.rsplit("/", 1)[1]: r for r in store.read("upload_files").collect()}
    assert {n: (r.status, r.error, r.record_count) for n, r in reports.items()} == {
        "e1-one.tsv": ("accepted", None, 2), "e2-two.JSON": ("accepted", None, 2), "e1-more.csv": ("accepted", None, 2),
        "e1-bad.tsv": ("rejected", None, 1), "e1-empty.tsv": ("fatal", "empty_file", 0), "e1-empty.json": ("fatal", "empty_file", 0),
        "e2-broken.json": ("fatal", "invalid_json", 0), "e1-head.csv": ("fatal", "no_data_rows", 0), "e1-notes.md": ("unknown_format", None, 0)}
    assert any(f.level == "error" and f.occurrences == 1 for f in reports["e1-bad.tsv"].findings)
    # A batch that comes again, in a store that has it, changes nothing; nor does a stream without new files.
    (stream, last), = store.head().batches.items()
    names = [r.file_path for r in store.read("upload_files").collect()]
    head = store.head()
    assert stored_flows.store_files(store, names, of_name, batch=(stream, last)) == head
    run()
    assert store.head() == head and head.number == first.number + 1
    # A new checkpoint is another stream: the merge is by key, so rows stay as they are.
    run(str(tmp_path / "cp2"))
    assert store.read("variants").count() == 4 and len(store.head().batches) == 2 and store.read("upload_files").count() == 9


def test_only_unknown_files(spark, tmp_path):
    store = CampaignStore(spark, f"file://{tmp_path}/store", parts=2)
    stored_flows.create_store(store)
    (tmp_path / "e1.md").write_text("x")
    stored_flows.store_files(store, [f"file:{tmp_path}/e1.md"], of_name)
    assert [(r.status, r.experiment_id) for r in store.read("upload_files").collect()] == [("unknown_format", 1)]
    assert store.read("variants").count() == 0


def test_the_last_of_repeated_keys_counts(spark):
    docs = spark.createDataFrame([("a.json", '[{"id": 1, "note": "a", "note": "b"}]')], "file_path string, value string")
    record, = uploads.parse_json_texts(docs).collect()
    assert record.metadata == {"note": "b"} and record.variant_index == "1"
    assert uploads.json_errors(docs).first().error is None
