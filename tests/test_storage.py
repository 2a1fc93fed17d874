import numpy as np
import pytest
from pyspark.sql import functions as F

from evospark.operators import embeddings as E
from evospark.schemas import DDL, struct_of
from evospark.sources import exports, snapshots

def test_every_schema_parses(spark):
    for name in DDL:
        assert len(struct_of(name)) > 1


def test_merge_policies_with_null_keys(spark):
    old = spark.createDataFrame([(1, None, "a"), (None, 2, "b")], "k1 int, k2 int, v string")
    new = spark.createDataFrame([(None, 2, "B"), (3, None, "C")], "k1 int, k2 int, v string")
    latest = {r["v"] for r in snapshots.merge_snapshot(old, new, ["k1", "k2"]).collect()}
    once = {r["v"] for r in snapshots.merge_snapshot(old, new, ["k1", "k2"], "set_once").collect()}
    assert (latest, once) == ({"a", "B", "C"}, {"a", "b", "C"})


def test_write_mutations_overwrite(spark):
    schema = "variant_id int, mutation_type string, position int, original string, mutated string"
    old = spark.createDataFrame([(1, "protein", 5, "A", "V"), (1, "dna", 5, "A", "V"), (2, "protein", 1, "M", "L")], schema)
    new = spark.createDataFrame([(1, "protein", 7, "G", "D"), (1, "protein", 7, "G", "D")], schema)
    def rows(df):
        return {(r["variant_id"], r["mutation_type"], r["position"]) for r in df.collect()}
    assert rows(snapshots.write_mutations(old, new, overwrite=True)) == {(1, "protein", 7), (1, "dna", 5), (2, "protein", 1)}
    assert len(rows(snapshots.write_mutations(old, new, overwrite=False))) == 4


def test_embedding_run_replacement(spark):
    runs = spark.createDataFrame(
        [(1, 7, "pca", "activity_score", "derived", {"feature": "a"}), (2, 7, "pca", "activity_score", "derived", {"feature": "b"})],
        "embedding_run_id long, experiment_id long, method string, metric_name string, metric_type string, params map<string,string>")
    pts = spark.createDataFrame([(1, 10), (2, 10)], "embedding_run_id long, variant_id long")
    new_run = runs.where("embedding_run_id = 1").withColumn("embedding_run_id", F.lit(9).cast("long"))
    r, p = snapshots.replace_embedding_run(runs, pts, new_run, pts.where("embedding_run_id = 1").withColumn("embedding_run_id", F.lit(9).cast("long")))
    assert {x[0] for x in r.collect()} == {2, 9} and {x[0] for x in p.collect()} == {2, 9}


def test_snapshot_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshots.write_snapshot(spark.range(3), root)
    grown = snapshots.read_snapshot(spark, root).union(spark.range(3, 5))
    snapshots.write_snapshot(grown, root)
    assert snapshots.read_snapshot(spark, root).count() == 5
    (tmp_path / "t" / "snapshot=9").mkdir()  # an unfinished write does not count
    assert snapshots.read_snapshot(spark, root).count() == 5


def test_fasta_lines_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "A" * 75, "M"), (2, "A" * 70, None)], "variant_id long, assembled_dna_sequence string, protein_sequence string")
    got = {r["variant_id"]: r["fasta"] for r in exports.variant_fasta(df).collect()}
    assert got == {1: ">variant_1_dna\n" + "A" * 70 + "\n" + "A" * 5 + "\n", 2: ">variant_2_dna\n" + "A" * 70 + "\n"}
    assert exports.variant_fasta(df, "protein").count() == 1
    exports.write_fasta(exports.variant_fasta(df), str(tmp_path / "f"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "f")).collect()]
    assert len(lines) == 5 and ">variant_2_dna" in lines


def test_mutation_report_keeps_clean_variants(spark):
    variants = spark.createDataFrame([(1, 0, 5, "5", None), (1, 0, 6, "6", None)],
                                     "experiment_id long, generation_number int, variant_id long, plasmid_variant_index string, parent_variant_id long")
    item = F.struct(F.lit("NONSENSE").alias("mutation_type"), F.lit(1).alias("codon_index_1based"), F.lit(1).alias("aa_position_1based"),
                    *[F.lit("A").alias(c) for c in ("wt_codon", "var_codon", "wt_aa", "var_aa", "notes")])
    analysis = variants.select("variant_id", F.struct(F.array_repeat(item, F.when(F.col("variant_id") == 5, 2).otherwise(0)).alias("mutations")).alias("analysis"),
                               F.lit(None).cast("timestamp").alias("updated_at"), F.current_timestamp().alias("created_at"))
    rows = exports.mutation_report(variants, analysis).collect()
    assert sorted((r["variant_id"], r["mutation_type"]) for r in rows if r["mutation_type"]) == [(5, "NONSENSE")] * 2
    assert [r["variant_id"] for r in rows if r["mutation_type"] is None] == [6]
    assert all(r["analysed_at"] for r in rows)


def test_pca_equals_svd(spark):
    rng = np.random.default_rng(4)
    x = (rng.random((30, 6)) < 0.4).astype(float) + np.outer(np.arange(30) % 2, [2, 0, 1, 0, 0, 0])
    muts = [(i, "protein", j + 1, "V") for i in range(30) for j in range(6) for _ in range(int(x[i, j]))]
    variants = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 100), (2, 101), (3, 200)], "experiment_id long, variant_id long")
    mutations = spark.createDataFrame(muts, "variant_id long, mutation_type string, position int, mutated string")
    feats = E.mutation_features(variants, mutations, ["experiment_id"], "position")
    pts = {r["variant_id"]: (r["pca_x"], r["pca_y"]) for r in E.pca_points(variants, feats, ["experiment_id"]).collect()}
    assert pts[100] == (0.0, 0.0) and 200 not in pts
    c = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    got = np.array([pts[i] for i in range(30)])
    for k in (0, 1):
        want = u[:, k] * s[k]
        assert min(np.abs(got[:, k] - want).max(), np.abs(got[:, k] + want).max()) < 1e-8


def test_iterated_axes_equal_the_moments(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = (rng.random((40, 12)) < 0.3).astype(float) + np.outer(np.arange(40) % 3, np.r_[2, 1, np.zeros(10)]) + np.outer(np.arange(40) % 2, np.r_[0, 0, 1, 2, np.zeros(8)])
    rows = [(1, i, f"p{j}", float(x[i, j])) for i in range(40) for j in range(12) if x[i, j]]
    rows += [(2, 100 + i, f"p{j}", 1.0) for i in range(5) for j in range(i + 1)]
    features = spark.createDataFrame(rows, "experiment_id long, variant_id long, feature string, value double")
    variants = spark.createDataFrame([(1, i) for i in range(42)] + [(2, 100 + i) for i in range(6)], "experiment_id long, variant_id long")

    def points():
        return {r.variant_id: (r.pca_x, r.pca_y) for r in E.pca_points(variants, features, ["experiment_id"]).collect()}

    exact = points()
    monkeypatch.setattr(E, "MAX_FEATURES", 5)  # the first group is iterated, the second is not
    iterated = points()
    assert iterated.keys() == exact.keys()
    for i, p in exact.items():
        assert iterated[i] == pytest.approx(p, abs=1e-5)


def test_more_features_than_a_moment_matrix(spark):
    rng = np.random.default_rng(7)
    side = rng.integers(0, 4, 60)
    rows = [(1, i, f"f{j}", 1.0) for i in range(60) for j in range(i * 90, (i + 1) * 90)]
    rows += [(1, i, f"b{side[i]}-{j}", 3.0) for i in range(60) for j in range(40)]
    features = spark.createDataFrame(list(dict.fromkeys(rows)), "experiment_id long, variant_id long, feature string, value double")
    assert features.select("feature").distinct().count() > E.MAX_FEATURES
    variants = spark.createDataFrame([(1, i) for i in range(60)], "experiment_id long, variant_id long")
    got = {r.variant_id: (r.pca_x, r.pca_y) for r in E.pca_points(variants, features, ["experiment_id"]).collect()}
    names = {n: i for i, n in enumerate(sorted({r[2] for r in rows}))}
    x = np.zeros((60, len(names)))
    for _, i, n, v in rows:
        x[i, names[n]] = v
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    found = np.array([got[i] for i in range(60)])
    assert (found**2).sum(axis=0) == pytest.approx(s[:2] ** 2, rel=1e-6)


def test_idw_equals_formula(spark):
    pts = [(1, 0.0, 0.0, 1.0), (1, 1.0, 2.0, 3.0), (1, 1.0, 2.0, 5.0), (1, 0.5, 1.0, 2.0)]
    df = spark.createDataFrame(pts, "g int, x double, y double, z double")
    for power in (2.0, 3.0):
        for r in E.idw_surface(df, ["g"], grid=5, power=power).collect():
            w = [1 / (((x - r["grid_x"]) ** 2 + (y - r["grid_y"]) ** 2 + 1e-12) ** (power / 2)) for _, x, y, _ in pts]
            assert r["grid_z"] == pytest.approx(sum(a * p[3] for a, p in zip(w, pts)) / sum(w))


def test_refresh_isolates_failures(spark, tmp_path):
    from evospark.plans.flows import refresh_views

    bad = spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))
    out = refresh_views({"bad": bad, "good": spark.range(2)}, str(tmp_path))
    assert out["good"] is None and out["bad"] is not None
    assert snapshots.read_snapshot(spark, str(tmp_path / "good")).count() == 2
