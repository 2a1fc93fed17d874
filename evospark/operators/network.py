"""Similarity networks among the selected variants of every experiment.

A network is drawn for a selection of variants (best N, top-10 and their
neighbours): that selection is the feature and it bounds the pairs of
one experiment. All experiments are processed in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evospark.functions.coerce import not_nan
from evospark.functions.ordering import top_k
from evospark.operators.ranking import best_first
from evospark.session import cut_lineage

# Edge presets (shared mutations, Jaccard threshold) and the node
# counts a network page accepts.
EDGE_PRESETS = {"sparse": (4, 0.20), "medium": (2, 0.10), "dense": (1, None)}
PAGE_NODE_COUNTS = (20, 30, 40, 50, 80, 120, 250)


@dataclass(frozen=True)
class NetworkOptions:
    """Parameters of the node selection and of the edge filters."""

    top_n: int = 250
    include_top10: bool = True
    neighbours_per_top10: int = 25
    max_nodes: int | None = None
    identity_threshold: float = 0.95
    min_shared: int = 1
    jaccard_threshold: float | None = None
    pearson_threshold: float | None = None
    universe: str = "all"


def page_options(
    *, max_nodes: int = 20, min_shared: int = 1, jaccard: float | None = None,
    pearson: float | None = 0.20, preset: str | None = None,
) -> NetworkOptions:
    """Options as a network page accepts them: thresholds are clipped, a preset
    replaces the edge filters, and a node count must be one of the page's."""
    if max_nodes not in PAGE_NODE_COUNTS:
        raise ValueError(f"max_nodes must be one of {PAGE_NODE_COUNTS}")
    shared = max(1, int(min_shared))
    if preset in EDGE_PRESETS:
        shared, jaccard = EDGE_PRESETS[preset]
    if pearson is not None:
        pearson = max(-1.0, min(1.0, float(pearson)))
    return NetworkOptions(
        top_n=max_nodes, max_nodes=max_nodes, min_shared=shared, jaccard_threshold=jaccard,
        pearson_threshold=pearson,
    )


def _max_distance(length: Column, threshold: float) -> Column:
    return F.floor(F.lit(1.0 - threshold) * length).cast("int")


def hamming(a: Column, b: Column) -> Column:
    """Number of differing characters of two strings of equal length."""
    return F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)),
        F.lit(0),
        lambda acc, d: acc + d,
    )


def _segments(df: DataFrame, text: str, threshold: float) -> DataFrame:
    """Cut each text into (allowed distance + 1) pieces. Two texts of one length
    within that distance agree on at least one piece, so joining on the pieces
    loses no pair."""
    length = F.length(text)
    pieces = _max_distance(length, threshold) + 1
    cuts = F.transform(
        F.sequence(F.lit(0), pieces - 1),
        lambda i: F.struct(
            i.alias("no"),
            F.substring(
                F.col(text),
                F.floor(i * length / pieces).cast("int") + 1,
                (F.floor((i + 1) * length / pieces) - F.floor(i * length / pieces)).cast("int"),
            ).alias("piece"),
        ),
    )
    return df.withColumn("_len", length).withColumn("_cut", F.explode(cuts))


def similar_sequences(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of distinct texts (columns ``seq``) of one experiment and length
    with Hamming distance within the allowed one.

    Texts are distinct on either side before they meet, so many copies of one
    sequence count once here.
    """
    key = ["experiment_id", "_len", "_no", "_piece"]
    a = _segments(left.select("experiment_id", "seq").distinct(), "seq", threshold).select(
        "experiment_id", "_len", F.col("_cut.no").alias("_no"), F.col("_cut.piece").alias("_piece"),
        F.col("seq").alias("seq_a"),
    )
    b = _segments(right.select("experiment_id", "seq").distinct(), "seq", threshold).select(
        "experiment_id", "_len", F.col("_cut.no").alias("_no"), F.col("_cut.piece").alias("_piece"),
        F.col("seq").alias("seq_b"),
    )
    return (
        a.join(b, key)
        .select("experiment_id", "seq_a", "seq_b")
        .distinct()
        .withColumn("distance", hamming(F.col("seq_a"), F.col("seq_b")))
        .where(F.col("distance") <= _max_distance(F.length("seq_a"), threshold))
    )


def select_nodes(nodes: DataFrame, options: NetworkOptions, *, need_sequence: bool = True) -> DataFrame:
    """Variants shown in each experiment's network: best N, the top-10, their
    nearest unselected neighbours; with ``max_nodes``, the first of them by
    (top-10, activity)."""
    opt = options
    pool = nodes.withColumn("activity_score", not_nan(F.col("activity_score")))
    if need_sequence:
        pool = pool.where(F.coalesce(F.col("protein_sequence"), F.lit("")) != "")
    ids = ["experiment_id", "variant_id"]
    best = top_k(pool, ["experiment_id"], best_first(), opt.top_n).select(*ids)
    chosen = best
    if opt.include_top10:
        chosen = chosen.unionByName(pool.where("is_top10 = 1").select(*ids)).distinct()
    if need_sequence and opt.neighbours_per_top10 > 0:
        # Only top variants that were selected attract neighbours.
        tops = pool.where("is_top10 = 1").join(chosen, ids, "left_semi").select(
            "experiment_id", F.col("variant_id").alias("_top"), F.col("protein_sequence").alias("seq_a")
        )
        rest = pool.join(chosen, ids, "left_anti").select(
            "experiment_id", "variant_id", F.col("protein_sequence").alias("seq_b")
        )
        firsts = rest.groupBy("experiment_id", "seq_b").agg(F.min("variant_id").alias("_first"))
        near = similar_sequences(
            tops.withColumnRenamed("seq_a", "seq"), firsts.withColumnRenamed("seq_b", "seq"),
            opt.identity_threshold,
        ).join(firsts, ["experiment_id", "seq_b"])
        # The k nearest sequences (by distance, then smallest id) hold the k
        # nearest variants, so copies of one sequence are expanded only at the end.
        ranked = top_k(
            tops.join(near, ["experiment_id", "seq_a"]),
            ["_top"], [F.col("distance").asc(), F.col("_first").asc()], opt.neighbours_per_top10,
        ).drop("rank")
        close = top_k(
            rest.join(ranked, ["experiment_id", "seq_b"]),
            ["_top"], [F.col("distance").asc(), F.col("variant_id").asc()], opt.neighbours_per_top10,
        )
        chosen = chosen.unionByName(close.select(*ids)).distinct()
    kept = pool.join(chosen, ids, "left_semi")
    # The selection is small and every edge builder reads it several times, so
    # it is written once instead of being scored and ranked again for each use.
    if opt.max_nodes is not None:
        kept = top_k(
            kept, ["experiment_id"], [F.col("is_top10").desc_nulls_last(), *best_first()], opt.max_nodes
        ).drop("rank")
    return cut_lineage(kept)


def similarity_edges(selected: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs of selected variants whose identity exceeds ``threshold``."""
    seqs = selected.select("experiment_id", "variant_id", F.col("protein_sequence").alias("seq")).where(
        F.length("seq") > 0
    )
    pairs = similar_sequences(seqs, seqs, threshold)
    u = seqs.select("experiment_id", F.col("variant_id").alias("u"), F.col("seq").alias("seq_a"))
    v = seqs.select("experiment_id", F.col("variant_id").alias("v"), F.col("seq").alias("seq_b"))
    identity = 1.0 - F.col("distance") / F.length("seq_a")
    return (
        pairs.join(u, ["experiment_id", "seq_a"])
        .join(v, ["experiment_id", "seq_b"])
        .where("u < v")
        .withColumn("identity", identity)
        .where(F.col("identity") > threshold)
        .select("experiment_id", "u", "v", "identity")
    )


def mutation_labels(mutations: DataFrame) -> DataFrame:
    """Distinct labels such as A42G per variant."""
    return (
        mutations.where(
            F.col("variant_id").isNotNull() & F.col("position").isNotNull()
            & F.col("original").isNotNull() & F.col("mutated").isNotNull()
        )
        .select(
            "experiment_id", "variant_id",
            F.concat("original", F.col("position").cast("string"), "mutated").alias("label"),
        )
        .distinct()
    )


def protein_mutations(variants: DataFrame, mutations: DataFrame) -> DataFrame:
    """Protein mutations of each variant from the table and from the stored
    analysis; a row present in both counts once (the table wins)."""
    scope = variants.select("experiment_id", "variant_id")
    table = (
        mutations.where("mutation_type = 'protein'")
        .join(scope, "variant_id")
        .select("experiment_id", "variant_id", "position", "original", "mutated", F.lit(0).alias("source"))
    )
    if "sequence_analysis" in variants.columns:
        item = variants.select(
            "experiment_id", "variant_id", F.explode("sequence_analysis.mutations").alias("m")
        )
        first = lambda c: F.left(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-")), F.lit(1))
        stored = item.where(F.col("m.aa_position_1based").isNotNull()).select(
            "experiment_id", "variant_id", F.col("m.aa_position_1based").alias("position"),
            first("m.wt_aa").alias("original"), first("m.var_aa").alias("mutated"), F.lit(1).alias("source"),
        )
        table = table.unionByName(stored)
    return table.groupBy("experiment_id", "variant_id", "position", "original", "mutated").agg(
        F.min("source").alias("source")
    )


def cooccurrence_edges(selected: DataFrame, mutations: DataFrame, options: NetworkOptions) -> DataFrame:
    """Pairs of selected variants that share protein mutations, with the number
    of shared labels, the Jaccard index and the phi coefficient."""
    opt = options
    labels = mutation_labels(mutations)
    mine = cut_lineage(
        labels.join(selected.select("experiment_id", "variant_id"), ["experiment_id", "variant_id"], "left_semi")
    )
    universe = labels if opt.universe == "all" else mine
    features = (
        universe.select("experiment_id", "label").distinct()
        .groupBy("experiment_id").agg(F.count(F.lit(1)).alias("_features"))
    )
    sizes = mine.groupBy("experiment_id", "variant_id").agg(F.count(F.lit(1)).alias("_size"))
    shared = (
        mine.withColumnRenamed("variant_id", "u")
        .join(mine.withColumnRenamed("variant_id", "v"), ["experiment_id", "label"])
        .where("u < v")
        .groupBy("experiment_id", "u", "v")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where(F.col("shared") >= opt.min_shared)
    )
    a = F.col("shared").cast("double")
    only_u, only_v = F.col("_nu") - a, F.col("_nv") - a
    union = F.col("_nu") + F.col("_nv") - a
    neither = F.col("_features") - union
    spread = F.col("_nu") * F.col("_nv") * (only_u + neither) * (only_v + neither)
    edges = (
        shared.join(sizes.select("experiment_id", F.col("variant_id").alias("u"), F.col("_size").cast("double").alias("_nu")), ["experiment_id", "u"])
        .join(sizes.select("experiment_id", F.col("variant_id").alias("v"), F.col("_size").cast("double").alias("_nv")), ["experiment_id", "v"])
        .join(features, "experiment_id")
        .withColumn("jaccard", a / union)
        .withColumn("pearson", F.when(spread > 0, (a * neither - only_u * only_v) / F.sqrt(spread)).otherwise(0.0))
    )
    if opt.jaccard_threshold is not None:
        edges = edges.where(F.col("jaccard") >= float(opt.jaccard_threshold))
    if opt.pearson_threshold is not None:
        edges = edges.where(F.col("pearson") >= float(opt.pearson_threshold))
    return edges.select("experiment_id", "u", "v", "shared", "jaccard", "pearson")


def phi_edges(selected: DataFrame, mutations: DataFrame, threshold: float) -> DataFrame:
    """Pairs of selected variants by phi coefficient over the selected labels.

    A pair without a common label has phi <= 0, so a positive threshold only
    needs the pairs that share a label.
    """
    if threshold <= 0:
        raise ValueError("a phi network needs a positive threshold")
    options = NetworkOptions(min_shared=1, pearson_threshold=threshold, universe="selected")
    edges = cooccurrence_edges(selected, mutations, options)
    return edges.select("experiment_id", "u", "v", "pearson")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node id reachable from every node, per experiment.

    Every round passes the smallest known label over the edges and then jumps to
    the label of the label; each round is checkpointed. The minimum is combined
    before the shuffle, so a hub does not collect its neighbours.
    """
    both = cut_lineage(
        edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    )
    nodes = cut_lineage(nodes.select("experiment_id", "variant_id").distinct())
    labels = nodes.select(F.col("variant_id").alias("node"), F.col("variant_id").alias("component"))
    while True:
        heard = (
            both.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("component").alias("_heard"))
        )
        spread = labels.join(heard, "node", "left").select(
            "node", F.col("component").alias("_old"), F.least("component", "_heard").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("_root"))
        new = cut_lineage(
            spread.join(jump, "component", "left").select(
                "node", "_old", F.least("component", "_root").alias("component")
            )
        )
        settled = new.where(F.col("_old") != F.col("component")).isEmpty()
        labels = new.drop("_old")
        if settled:
            break
    return nodes.join(labels.withColumnRenamed("node", "variant_id"), "variant_id")


def largest_components(components: DataFrame) -> DataFrame:
    """Nodes of each experiment's largest component (smallest id wins ties)."""
    sizes = components.groupBy("experiment_id", "component").agg(F.count(F.lit(1)).alias("size"))
    best = sizes.groupBy("experiment_id").agg(
        F.max_by("component", F.struct("size", -F.col("component"))).alias("component"),
        F.max("size").alias("size"),
    )
    return components.join(best, ["experiment_id", "component"])


def focus_on_top10(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """Top-10 nodes and their direct neighbours (all nodes of an experiment
    without any top-10 node)."""
    tops = selected.where("is_top10 = 1").select("experiment_id", "variant_id")
    out = edges.join(tops.select(F.col("variant_id").alias("u")), "u", "left_semi").select(F.col("v").alias("variant_id"))
    back = edges.join(tops.select(F.col("variant_id").alias("v")), "v", "left_semi").select(F.col("u").alias("variant_id"))
    kept = tops.select("variant_id").unionByName(out).unionByName(back).distinct()
    no_top = selected.join(tops.select("experiment_id"), "experiment_id", "left_anti").select("variant_id")
    return selected.join(kept.unionByName(no_top), "variant_id", "left_semi")


def network_diagnostics(variants: DataFrame, mutations: DataFrame) -> DataFrame:
    """Availability counts that explain an empty network."""
    scope = variants.select("experiment_id", "variant_id")
    has_json = "sequence_analysis" in variants.columns
    stored = F.coalesce(F.size("sequence_analysis.mutations"), F.lit(0)) if has_json else F.lit(0)
    per_variant = variants.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("variant_count"),
        F.count("protein_sequence").alias("protein_sequences_available"),
        F.sum(F.greatest(stored, F.lit(0))).cast("bigint").alias("json_mutation_rows"),
    )
    per_mutation = (
        mutations.join(scope, "variant_id")
        .groupBy("experiment_id")
        .agg(
            F.count(F.lit(1)).alias("mutation_rows_total"),
            F.count_if(F.col("mutation_type") == "protein").alias("mutation_rows_protein"),
            F.count_if(F.col("mutation_type") == "dna").alias("mutation_rows_dna"),
        )
    )
    counts = ["mutation_rows_total", "mutation_rows_protein", "mutation_rows_dna"]
    return per_variant.join(per_mutation, "experiment_id", "left").fillna(0, counts)


