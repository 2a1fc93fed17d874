import itertools
import random

import pytest
from pyspark.sql import functions as F

from evospark.operators import domains as D, lineage as L, network as N


def test_cooccurrence_edge(spark):
    muts = spark.createDataFrame(
        [(1, 101, 10, "A", "V"), (1, 101, 22, "G", "D"), (1, 102, 10, "A", "V"), (1, 102, 30, "L", "P"), (1, 103, 50, "Q", "R")],
        "experiment_id long, variant_id long, position int, original string, mutated string")
    nodes = muts.select("experiment_id", "variant_id").distinct()
    edges = N.cooccurrence_edges(nodes, muts, N.NetworkOptions()).collect()
    assert [(e["u"], e["v"], e["shared"]) for e in edges] == [(101, 102, 1)]
    assert edges[0]["jaccard"] == pytest.approx(1 / 3)
    assert edges[0]["pearson"] == pytest.approx((1 * 1 - 1 * 1) / (2 * 2 * 2 * 2) ** 0.5)


def test_min_shared_filters(spark):
    muts = spark.createDataFrame(
        [(1, 201, 5, "M", "I"), (1, 201, 9, "T", "A"), (1, 202, 5, "M", "I")],
        "experiment_id long, variant_id long, position int, original string, mutated string")
    nodes = muts.select("experiment_id", "variant_id").distinct()
    assert N.cooccurrence_edges(nodes, muts, N.NetworkOptions(min_shared=2)).isEmpty()


def test_similar_sequences_equals_all_pairs(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("ACDE") for _ in range(40)) for _ in range(3)]
    seqs = set(base)
    for b in base:
        for _ in range(25):
            s = list(b)
            for _ in range(rng.randint(0, 6)):
                s[rng.randrange(40)] = rng.choice("ACDE")
            seqs.add("".join(s))
    df = spark.createDataFrame([(1, s) for s in seqs], "experiment_id long, seq string")
    got = {(r["seq_a"], r["seq_b"]) for r in N.similar_sequences(df, df, 0.9).collect()}
    limit = int((1.0 - 0.9) * 40 // 1)
    want = {(a, b) for a, b in itertools.product(seqs, seqs) if sum(x != y for x, y in zip(a, b)) <= limit}
    assert got == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 4), (3, 9), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (25, 26)]
    nodes = spark.createDataFrame([(1 if i < 15 else 2, i) for i in [*range(1, 13), *range(20, 28)]], "experiment_id long, variant_id long")
    comp = N.connected_components(nodes, spark.createDataFrame(edges, "u long, v long"))
    by = {r["variant_id"]: r["component"] for r in comp.collect()}
    assert (by[9], by[11], by[4], by[12], by[26], by[27]) == (1, 10, 4, 12, 20, 27)
    assert {r["variant_id"] for r in N.largest_components(comp).where("experiment_id = 1").collect()} == {1, 2, 3, 9}


def test_page_options():
    o = N.page_options(max_nodes=30, min_shared=0, pearson=3.0)
    assert (o.max_nodes, o.min_shared, o.pearson_threshold) == (30, 1, 1.0)
    with pytest.raises(ValueError, match="max_nodes"):
        N.page_options(max_nodes=33)
    assert N.page_options(preset="sparse").jaccard_threshold == 0.20


def test_nearest_index_equals_search(spark):
    rng = random.Random(2)
    rows = [(1, i, rng.randint(0, 3), str(rng.choice([rng.randint(0, 60), rng.randint(0, 60) + 0.5, "x"]))) for i in range(300)]
    df = spark.createDataFrame(rows, "experiment_id long, variant_id long, generation_number int, plasmid_variant_index string")
    got = {r["child_id"]: r["parent_id"] for r in L.nearest_index_edges(df, 3.0).collect()}
    want = {}
    for _, v, g, x in rows:
        if x == "x":
            continue
        near = [(abs(float(y) - float(x)), p) for _, p, h, y in rows if h == g - 1 and y != "x" and abs(float(y) - float(x)) <= 3.0]
        if near:
            want[v] = min(near)[1]
    assert got == want


def test_closure_of_a_long_chain_and_cycles(spark):
    n = 37
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], "variant_id long, parent_variant_id long").withColumn("experiment_id", F.lit(1))
    closure = L.lineage_closure(L.lineage_edges(nodes), nodes)
    got = {(r["ancestor_id"], r["descendant_id"], r["distance"]) for r in closure.collect()}
    assert got == {(a, d, d - a) for a in range(n) for d in range(a, n)}
    cyclic = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "variant_id long, parent_variant_id long").withColumn("experiment_id", F.lit(1))
    with pytest.raises(ValueError):
        L.lineage_closure(L.lineage_edges(cyclic), cyclic)


def test_trend_significance(spark):
    pts = [(1, 0, 1.0), (1, 1, 2.1), (1, 2, 2.9), (1, 3, 4.2), (2, 0, 1.0), (2, 1, 1.0), (2, 2, 1.0), (3, 0, 5.0)]
    df = spark.createDataFrame(pts, "experiment_id long, generation_number int, activity_score double")
    by = {r["experiment_id"]: r for r in L.linear_trend(df, ["experiment_id"], "generation_number", "activity_score").collect()}
    assert by[1]["slope"] == pytest.approx(1.04) and by[1]["r_value"] == pytest.approx(5.2 / (5.0 * 5.45) ** 0.5)
    # Two-sided p of a correlation with n = 4 is 1 - |r|.
    assert by[1]["p_value"] == pytest.approx(1 - by[1]["r_value"], abs=1e-9)
    assert not by[2]["trend_ready"] and by[2]["slope"] is None and not by[3]["trend_ready"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_nested_loops(spark):
    points = spark.range(100).select((F.col("id") % 3).alias("wt_id"), F.col("id").cast("int").alias("position"))
    feats = spark.range(10).select((F.col("id") % 3).alias("wt_id"), (F.col("id") * 10 + 1).cast("int").alias("start_position"), (F.col("id") * 10 + 30).cast("int").alias("end_position"))
    seqs = spark.range(50).select(F.lit(1).alias("experiment_id"), F.md5(F.col("id").cast("string")).alias("seq"))
    idx = spark.range(50).select(F.lit(1).alias("experiment_id"), F.col("id").alias("variant_id"), (F.col("id") % 3).cast("int").alias("generation_number"), F.col("id").cast("string").alias("plasmid_variant_index"))
    for df in (D.interval_join(points, feats, ["wt_id"]), N.similar_sequences(seqs, seqs, 0.9), L.nearest_index_edges(idx)):
        plan = plan_of(df)
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_interval_join_counts_each_pair_once(spark):
    points = spark.createDataFrame([(1, p) for p in (1, 63, 64, 65, 128, 200)], "wt_id int, position int")
    feats = spark.createDataFrame([(1, 1, 200), (1, 64, 64), (1, 0, 5), (1, 10, 3)], "wt_id int, start_position int, end_position int")
    got = sorted((r["position"], r["start_position"]) for r in D.interval_join(points, feats, ["wt_id"]).collect())
    assert got == sorted([(p, 1) for p in (1, 63, 64, 65, 128, 200)] + [(64, 64)])


def test_matrices_have_a_column_for_every_generation(spark):
    frequency = spark.createDataFrame([(1, 9, 5, 2), (1, 0, 5, 1)], "experiment_id long, generation_number int, position int, mutations long")
    generations = spark.createDataFrame([(10, 0), (11, 1)], "generation_id long, generation_number int")
    wide = D.frequency_matrix(frequency, generations)
    assert wide.columns[2:] == ["g0", "g1", "g9"] and wide.first()[2:] == (1, 0, 2)
    rich = spark.createDataFrame([("a", 10, 1.0), ("a", 11, 3.0)], "domain_label string, generation_id long, nonsyn_count double")
    assert D.enrichment_matrix(rich, generations, "nonsyn_count").first()[1:] == (1.0, 3.0, 4.0)
