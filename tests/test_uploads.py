import json

import pytest
from pyspark.sql import functions as F

from evospark.functions import coerce as C
from evospark.operators import qc
from evospark.sources import uploads

GOOD = "ACGT" * 30


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("uploads")
    (d / "a.tsv").write_text(
        "Plasmid_Variant_Index\tgeneration\tparent_id\tdna_yield\tprotein_yield\tAssembled_DNA_Sequence\tnote\n"
        f"1\t0\t\t500\t100.5\t{GOOD.lower()[:60]} {GOOD[60:]}\thi\n"
        "\t\t\t\t\t\t\n"
        "\n"
        '2\tINVALID\t1\tN/A\t50\tATGC123\t"a ""q"" b"\n'
        "2\t3\t9\t6000\t1\t\t\n"
    )
    (d / "b.CSV").write_text(f'id,gen,dna_yield,protein_yield,sequence\n1,0,500,100,{GOOD}\n2,2,"500",100,"{GOOD}"\n')
    (d / "c.json").write_text(json.dumps({"records": [
        {"id": 1, "gen": 0, "dna_yield": 500.5, "protein_yield": "80", "sequence": GOOD.lower(), "control": True, "x": {"a": 1}},
        {"id": 3.7, "gen": "1.5", "dna_yield": None, "protein_yield": 80, "sequence": GOOD},
    ]}))
    (d / "d.json").write_text(json.dumps({"id": 1, "gen": 0}))
    (d / "v.json").write_text(json.dumps({"variants": [{"id": 5, "gen": 1}]}))
    (d / "l.json").write_text(json.dumps([{"id": 6, "gen": 1}, {"id": 7, "gen": 1}]))
    (d / "bad.json").write_text('{"id": 1,')
    (d / "none.json").write_text("[]")
    (d / "header.tsv").write_text("a\tb\n")
    (d / "zero.tsv").write_text("")
    (d / "ignored.txt").write_text("x")
    return str(d)


@pytest.fixture(scope="module")
def records(spark, folder):
    return uploads.read_uploads(spark, folder).withColumn(
        "file", F.element_at(F.split("file_path", "/"), -1)).cache()


def rows_of(records, name):
    return records.where(F.col("file") == name).orderBy("_row_number").collect()


def test_delimited_rows_keep_their_numbers(records):
    rows = rows_of(records, "a.tsv")
    # The all-empty row keeps number 3; the blank line has none.
    assert [r["_row_number"] for r in rows] == [2, 4, 5]
    assert rows[0]["assembled_dna_sequence"] == GOOD
    assert rows[1]["metadata"] == {"note": 'a "q" b'}
    assert "control" not in rows[0]["present"]


def test_comma_files_and_aliases(records):
    rows = rows_of(records, "b.CSV")
    assert [(r["variant_index"], r["generation"], r["dna_yield"]) for r in rows] == [("1", "0", "500"), ("2", "2", "500")]


def test_json_envelopes(records):
    assert [r["_row_number"] for r in rows_of(records, "c.json")] == [1, 2]
    assert rows_of(records, "c.json")[0]["metadata"] == {"x": '{"a":1}'}
    assert [r["variant_index"] for r in rows_of(records, "l.json")] == ["6", "7"]
    assert [r["variant_index"] for r in rows_of(records, "v.json")] == ["5"]
    assert [r["variant_index"] for r in rows_of(records, "d.json")] == ["1"]


def test_fatal_files(spark, folder, records):
    got = {r["file_path"].split("/")[-1]: r["error"] for r in uploads.fatal_file_errors(spark, folder, records).collect()}
    assert got == {"bad.json": "invalid_json", "none.json": "no_records", "header.tsv": "no_data_rows", "zero.tsv": "empty_file"}


def test_record_rules(records):
    checked = {(r["file"], r["_row_number"]): r for r in qc.check_records(records).collect()}
    assert checked["a.tsv", 4]["errors"] == ["not_integer:generation", "not_numeric:dna_yield", "invalid_characters:123"]
    assert checked["a.tsv", 5]["errors"] == [
        "missing_fields:assembled_dna_sequence", "critical_high:dna_yield", "critical_low:protein_yield", "empty_sequence"]
    # A JSON number 3.7 is an integer by truncation, the text "1.5" is not.
    assert checked["c.json", 2]["errors"] == ["missing_fields:dna_yield", "not_integer:generation", "not_numeric:dna_yield"]
    assert checked["b.CSV", 2]["errors"] == []


def test_cross_record_rules(records):
    found = {(r["file_path"].split("/")[-1], r["rule"]): r["findings"] for r in qc.cross_record_findings(records).collect()}
    assert found["a.tsv", "duplicate_index"] == 1
    assert found["a.tsv", "missing_generations"] == 2
    assert found["a.tsv", "orphan_parent"] == 1
    assert found["b.CSV", "missing_generations"] == 1
    assert found["l.json", "no_generation_zero"] == 1


def test_gate_rejects_whole_files(records):
    accepted, rejected = qc.upload_gate(qc.check_records(records), qc.cross_record_findings(records))
    assert {r["file"] for r in accepted.select("file").distinct().collect()} == {"b.CSV"}
    assert "a.tsv" in {r["file"] for r in rejected.select("file").distinct().collect()}


def test_static_limits_and_min_samples(spark, records):
    few = qc.QualityOptions(min_samples=30)
    r = qc.adaptive_thresholds(records.where("file = 'a.tsv'"), ["file"], few).first()
    assert (r["dna_low"], r["dna_high"], r["protein_low"], r["protein_high"]) == (50.0, 2000.0, 40.0, 1000.0)
    free = qc.adaptive_thresholds(records.where("file = 'a.tsv'"), ["file"]).first()
    assert free["dna_low"] == pytest.approx(500 + 0.01 * 5500)


def test_casts(spark):
    cells = ["42", " 7 ", "1_000", "2.9D", "3.0", "N/A", "", "NULL", "None", "inf", "nan", "1e3", "Yes", "f", "0"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = df.select(
        "c", C.int_or_null(F.col("c")).alias("i"), C.float_or_null(F.col("c")).alias("f"),
        C.bool_or_null(F.col("c")).alias("b"), C.canonical_index(F.col("c")).alias("x")).collect()
    by = {r["c"]: r for r in got}
    assert (by["42"]["i"], by[" 7 "]["i"], by["1_000"]["i"], by["3.0"]["i"], by["N/A"]["i"]) == (42, 7, 1000, None, None)
    assert (by["2.9D"]["f"], by["1e3"]["f"], by["inf"]["f"], by["NULL"]["f"]) == (None, 1000.0, float("inf"), None)
    assert (by["Yes"]["b"], by["f"]["b"], by["0"]["b"], by["42"]["b"]) == (True, False, False, None)
    assert (by["3.0"]["x"], by[""]["x"], by["N/A"]["x"]) == ("3", None, "N/A")


def test_line_numbers_across_splits(spark, tmp_path):
    (tmp_path / "big.tsv").write_text("id\tgen\n" + "".join(f"{i}\t0\n" for i in range(2, 3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = uploads.read_delimited(spark, str(tmp_path / "big.tsv"))
        assert df.rdd.getNumPartitions() >= 1
        assert df.where(F.col("_row_number") != F.col("variant_index").cast("int")).count() == 0
        assert df.count() == 2998
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_numbers_empty_records_and_other_items(spark, tmp_path):
    from evospark.operators import qc
    from evospark.schemas import struct_of
    from evospark.sources import snapshots

    good = {"id": 3.7, "gen": 1, "sequence": "acgt " * 60, "dna_yield": 500.5, "protein_yield": 40, "control": 0, "note": 1}
    control = {**good, "id": 4, "control": 2}
    (tmp_path / "good.json").write_text(json.dumps([good, control]))
    (tmp_path / "empty.json").write_text(json.dumps([good, {}]))
    (tmp_path / "other.json").write_text(json.dumps({"records": [good, 5]}))
    records = uploads.read_uploads(spark, str(tmp_path))
    rows = {(r["file_path"].rsplit("/", 1)[1], r["_row_number"]): r for r in records.collect()}
    assert set(rows) == {("good.json", 1), ("good.json", 2), ("empty.json", 1), ("empty.json", 2), ("other.json", 1)}
    assert rows["empty.json", 2]["present"] == [] and rows["good.json", 1]["metadata"] == {"note": "1"}
    fatal = uploads.fatal_file_errors(spark, str(tmp_path), records)
    assert [(r["file_path"].rsplit("/", 1)[1], r["error"]) for r in fatal.collect()] == [("other.json", "record_is_no_object")]
    accepted, rejected = qc.upload_gate(qc.check_records(records), qc.cross_record_findings(records), fatal)
    assert {r["file_path"].rsplit("/", 1)[1] for r in accepted.collect()} == {"good.json"} and rejected.count() == 3
    out = snapshots.upsert_uploads(
        accepted.withColumn("experiment_id", F.lit(1).cast("long")), *(spark.createDataFrame([], struct_of(t)) for t in ("variants", "metrics")))
    assert [r["plasmid_variant_index"] for r in out["variants"].collect()] == ["3"]
    assert out["controls"].count() == 1 and [r["generation_number"] for r in out["generations"].collect()] == [1]
    assert out["metrics"].where("wt_control_id is not null").count() == 2
