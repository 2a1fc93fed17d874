import pytest
from pyspark.sql import functions as F

from evospark.functions.ordering import rank_all
from evospark.functions.quantiles import exact_percentiles
from evospark.operators import metrics as M, ranking as R, scoring as S


def test_score_with_and_without_baseline(spark):
    variants = spark.createDataFrame(
        [(1, 10, 20.0, 4.0), (2, 99, 5.0, 5.0), (3, 10, None, 1.0), (4, 10, 0.0, 1.0), (5, 11, 1.0, 1.0), (6, 10, 1.0, 1e-10)],
        "variant_id bigint, generation_id bigint, dna_yield_raw double, protein_yield_raw double")
    base = spark.createDataFrame([(10, 10.0, 2.0), (11, -1.0, 2.0)], "generation_id bigint, dna_wt double, prot_wt double")
    scored = S.score_against_wt(variants, base)
    by = {r["variant_id"]: r for r in scored.collect()}
    assert (by[1]["dna_yield_norm"], by[1]["protein_yield_norm"], by[1]["activity_score"], by[1]["qc_stage4"]) == (2.0, 2.0, 1.0, "ok")
    assert [by[i]["qc_stage4"] for i in (2, 3, 4, 5, 6)] == [
        "missing_wt_baseline", "missing_raw_metrics", "nonpositive_raw_metrics", "invalid_wt_baseline", "protein_norm_too_small"]
    assert by[6]["dna_yield_norm"] == 0.1 and by[6]["activity_score"] is None
    rows = S.score_metric_rows(scored)
    assert rows.count() == 3
    assert S.formula_violations(scored).isEmpty()


def test_baselines_ignore_incomplete_generations(spark):
    rows = [(1, 100, 1, "dna_yield_raw", 10.0), (2, 100, 1, "protein_yield_raw", 5.0), (3, 101, 2, "dna_yield_raw", 12.0),
            (4, 101, 2, "protein_yield_raw", float("nan")), (5, 102, 3, "dna_yield", 8.0), (6, 102, 3, "protein_yield", 4.0)]
    metrics = spark.createDataFrame(
        [(m, g, None, c, n, "raw", v) for m, g, c, n, v in rows],
        "metric_id bigint, generation_id bigint, variant_id bigint, wt_control_id bigint, metric_name string, metric_type string, value double")
    gens = spark.createDataFrame([(100, 1, 0), (101, 1, 1), (102, 1, 2)], "generation_id bigint, experiment_id bigint, generation_number int")
    base = M.wt_baselines(metrics)
    assert {r["generation_id"]: (r["dna_wt"], r["prot_wt"]) for r in base.collect()} == {100: (10.0, 5.0), 102: (8.0, 4.0)}
    missing = M.generations_without_baseline(gens, base)
    assert [r["generation_number"] for r in missing.collect()] == [1]


def test_mode_choice(spark):
    gens = spark.createDataFrame(
        [(100, 1, 0), (101, 1, 1), (200, 2, 0)], "generation_id bigint, experiment_id bigint, generation_number int")
    base = spark.createDataFrame([(100, 10.0, 5.0)], "generation_id bigint, dna_wt double, prot_wt double")
    modes = {r["experiment_id"]: r["scoring_mode"] for r in S.scoring_modes(gens, base).collect()}
    assert modes == {1: "wt", 2: "fallback"}
    variants = spark.createDataFrame(
        [(1, 1, 100, 10.0, 5.0), (1, 2, 101, 9.0, 4.5), (2, 3, 200, 8.0, 2.0), (2, 4, 200, 4.0, 4.0)],
        "experiment_id bigint, variant_id bigint, generation_id bigint, dna_yield_raw double, protein_yield_raw double")
    scored = {r["variant_id"]: (r["scoring_mode"], r["qc_stage4"]) for r in S.score_experiments(variants, base, gens).collect()}
    assert scored == {1: ("wt", "ok"), 2: ("wt", "missing_wt_baseline"), 3: ("fallback", "ok"), 4: ("fallback", "ok")}
    with pytest.raises(ValueError):
        S.score_experiments(variants, base, gens, "wt", strict=True)


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [0.0, -1.0, 3.5, -7.25, 1e-310, 1e300, -1e300, 2.0, 2.0], [float(i % 7) for i in range(100)],
    [1000 + i * 1e-9 for i in range(50)],
])
def test_exact_percentiles_equal_builtin(spark, values):
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None), ("g", float("nan"))], "k string, v double")
    probs = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.99, "f": 1.0}
    got = exact_percentiles(df, ["k"], "v", probs).first()
    want = df.where("v is not null and not isnan(v)").agg(
        *[F.percentile("v", F.lit(p)).alias(n) for n, p in probs.items()]).first()
    for n in probs:
        assert got[n] == pytest.approx(want[n], rel=1e-12, abs=1e-300)


def test_rank_all_spreads_one_hot_group(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), (F.col("id") % 13).alias("v"), "id")
    ranked = rank_all(df, ["g"], [F.col("v").desc(), F.col("id").asc()], partitions=7)
    ids = [r["id"] for r in ranked.orderBy("rank").collect()]
    assert ids == sorted(range(5000), key=lambda i: (-(i % 13), i))
    assert [r["rank"] for r in ranked.orderBy("rank").limit(3).collect()] == [1, 2, 3]


def test_top_flag_ignores_missing_scores(spark):
    nodes = spark.createDataFrame(
        [(1, i, None if i > 12 else float(i)) for i in range(1, 16)] + [(1, 99, float("nan"))],
        "experiment_id bigint, variant_id bigint, activity_score double")
    flagged = {r["variant_id"] for r in R.flag_top(nodes).where("is_top10 = 1").collect()}
    assert flagged == set(range(3, 13))


def test_top_limit_is_taken_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("experiment_id"), F.col("id").alias("variant_id"), F.rand(1).alias("activity_score"))
    plan = R.top_k(df, ["experiment_id"], R.best_first(), 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_top10_check(spark):
    scored = spark.createDataFrame([(1, i, float(i)) for i in range(20)], "experiment_id bigint, variant_id bigint, activity_score double")
    best = R.top_k(scored, ["experiment_id"], R.best_first(), 10)
    assert S.top10_violations(best, scored).isEmpty()
    assert S.top10_violations(best.where("rank > 1"), scored).count() == 1
