"""Plans of the steps that once grew faster than the tables."""

from pyspark.sql import functions as F

from evospark.operators import lineage as L
from evospark.plans import registry
from evospark.session import many_partitions
from evospark.sources import snapshots


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_registered_queries_size_their_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")}
    for k in before:
        spark.conf.set(k, "64m")
    registry.register("scale_probe")(lambda spark, sf: spark.range(1))
    try:
        registry.QUERIES["scale_probe"](spark, "")
        assert [spark.conf.get(k) for k in before] == ["8m", "16m"]
    finally:
        del registry.QUERIES["scale_probe"]
        for k, v in before.items():
            spark.conf.set(k, v)


def test_shuffles_of_registered_queries_outnumber_the_sessions_partitions(spark):
    """A session with few shuffle partitions must not set the size of a task."""
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    registry.register("scale_probe")(lambda spark, sf: many_partitions(spark).range(0, 100_000, 1, 4).groupBy(F.col("id") % 50_000).count())
    try:
        df = registry.QUERIES["scale_probe"](spark, "")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and ", 1000)" in _plan(df)
        assert df.count() == 50_000 and df.rdd.getNumPartitions() < 100  # small ones are merged again
    finally:
        del registry.QUERIES["scale_probe"]
        spark.conf.unset(name)
        if before is not None:
            spark.conf.set(name, before)


def _chains(spark):
    # 1 <- 2 <- 3, and 4 with two parents (2 and 3), as rows of repeated keys give.
    rows = [(1, 1, 0, 0), (2, 2, 0, 1), (2, 1, 1, 0), (3, 3, 0, 2), (3, 2, 1, 1), (3, 1, 2, 0),
            (4, 4, 0, 3), (4, 3, 1, 2), (4, 2, 2, 1), (4, 2, 1, 1), (4, 1, 3, 0), (4, 1, 2, 0)]
    return spark.createDataFrame(rows, "target_id long, variant_id long, depth int, generation_number int").withColumn(
        "experiment_id", F.lit(1))


def _changes(spark):
    return spark.createDataFrame(
        [(1, "protein", 5, "A", "C", False), (2, "protein", 5, "A", "C", False), (2, "protein", 7, "D", None, False),
         (3, "protein", None, "D", "E", None), (3, "protein", 7, "D", None, False), (4, "protein", 9, "AB", "C", False),
         (4, "protein", 9, "A", "BC", False), (4, "dna", 1, "A", "C", False), (None, "protein", 1, "A", "C", False)],
        "variant_id long, mutation_type string, position int, original string, mutated string, is_synonymous boolean")


def test_changes_of_chains_pass_one_shuffle_as_codes(spark):
    events = L.introduction_events(_chains(spark), _changes(spark))
    got = {(r.target_id, r.position, r.original, r.mutated): (r.introduced_variant_id, r.introduced_generation, r.full_label)
           for r in events.collect()}
    a, b, c = (5, "A", "C"), (7, "D", None), (None, "D", "E")
    want = {(t, *a): (1, 0, "A5C") for t in (1, 2, 3, 4)} | {(t, *b): (2, 1, None) for t in (2, 3, 4)} | {
        (t, *c): (3, 2, None) for t in (3, 4)} | {(4, 9, "AB", "C"): (4, 3, "AB9C"), (4, 9, "A", "BC"): (4, 3, "A9BC")}
    assert got == want and events.count() == len(want)
    # No exchange carries one row per change: what is above the explode is grouped in place.
    assert "Exchange hashpartitioning" not in _plan(events).split("Generate explode(_codes")[0].split("BroadcastExchange")[0]


def test_trajectory_counts_codes(spark):
    rows = L.cumulative_trajectory(_chains(spark), _changes(spark)).where("target_id < 4").collect()
    assert {(r.target_id, r.variant_id): r.cumulative_nonsyn for r in rows} == {
        (1, 1): 1, (2, 1): 1, (2, 2): 2, (3, 1): 1, (3, 2): 2, (3, 3): 2}


def test_variants_without_parent_are_dealt_over_the_tasks(spark):
    rows = [(1, None, "a"), (2, 1, "b"), (3, 1, "c"), (4, 2, "d"), (5, 999, "e"), (None, 2, "f")] + [(i, None, "x") for i in range(10, 200)]
    variants = spark.createDataFrame(rows, "variant_id long, parent_variant_id long, plasmid_variant_index string")
    joined = snapshots.with_parent_index(variants.hint("merge"))
    got = {(r.variant_id, r.plasmid_variant_index): r.parent_index for r in joined.collect()}
    assert len(got) == len(rows) == joined.count()
    assert {k: v for k, v in got.items() if v is not None} == {(2, "b"): "a", (3, "c"): "a", (4, "d"): "b", (None, "f"): "b"}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = snapshots.with_parent_index(variants.hint("merge")).where("parent_variant_id is null").select(
            F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks > 1
