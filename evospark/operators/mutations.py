"""Mutation calls of a coding sequence against its wild type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evospark.functions import dna as D
from evospark.functions.once import evaluated_once
from evospark.session import spread
from evospark.schemas import MUTATION_STRUCT

COUNT_METRICS = ["mutation_synonymous_count", "mutation_nonsynonymous_count", "mutation_total_count"]
NONSYNONYMOUS_KINDS = ["NONSYNONYMOUS", "NONSENSE", "INSERTION", "DELETION"]


@dataclass(frozen=True)
class SanityLimits:
    """When a mutation profile is implausible (fixed values)."""

    short_protein: int = 8
    short_mutations: int = 100
    ratio: float = 0.75
    ratio_min_length: int = 30
    absolute: int = 150
    fraction: float = 0.20


def _record(kind: Column | str, index: Column, wt_codon: Column, var_codon: Column, wt_aa: Column,
            var_aa: Column, notes: Column | str | None) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("mutation_type"),
        index.cast("int").alias("codon_index_1based"),
        index.cast("int").alias("aa_position_1based"),
        (text if wt_codon is None else wt_codon).alias("wt_codon"),
        (text if var_codon is None else var_codon).alias("var_codon"),
        (text if wt_aa is None else wt_aa).alias("wt_aa"),
        (text if var_aa is None else var_aa).alias("var_aa"),
        (F.lit(notes) if isinstance(notes, str) else (text if notes is None else notes)).alias("notes"),
    )


def _indices(first: Column, last: Column) -> Column:
    """0-based indices first..last, empty when last < first."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _substitutions(wt: Column, var: Column, differing: Column) -> Column:
    """The codons at the ``differing`` indices of two equally long codon arrays, classified."""
    pairs = F.transform(differing, lambda i: F.struct(i.alias("i"), F.get(wt, i).alias("w"), F.get(var, i).alias("v")))

    def classified(p: Column) -> Column:
        unclear = p["v"].rlike("[^ACGT]")
        wt_aa, var_aa = D.residue(p["w"]), D.residue(p["v"])
        kind = (
            F.when(unclear, "AMBIGUOUS")
            .when(var_aa == "*", "NONSENSE")
            .when(wt_aa == var_aa, "SYNONYMOUS")
            .otherwise("NONSYNONYMOUS")
        )
        return _record(
            kind, p["i"] + 1, p["w"], p["v"], F.when(~unclear, wt_aa), F.when(~unclear, var_aa),
            F.when(unclear, "ambiguous_codon"),
        )

    return F.transform(pairs, classified)


def _moved_block(wt: Column, var: Column, first: Column, last: Column, size: Column) -> Column:
    """-1: ``size`` codons deleted at the first mismatch and others inserted
    before the last; 1: the reverse; NULL: neither explains the difference.

    Everything outside the mismatching span is equal already, so only the codons
    between have to match after a shift by ``size``.
    """
    rest = last - first + 1 - size
    dropped_first = F.slice(wt, first + size + 1, rest) == F.slice(var, first + 1, rest)
    inserted_first = F.slice(wt, first + 1, rest) == F.slice(var, first + size + 1, rest)
    return F.when(rest >= 1, F.when(dropped_first, -1).when(inserted_first, 1))


def call_mutations(rows: DataFrame, wt: str = "wt_cds", var: str = "cds_dna") -> DataFrame:
    """Add ``mutations`` (array of records) and ``mutation_counts``.

    Lengths that are no multiple of three give one FRAMESHIFT record. Equal
    lengths are compared codon by codon, unless moving a block of codons (one
    insertion and one deletion) explains the difference. Other lengths are
    compared on the protein: common start, common end, and the block between.
    ``approximate`` marks rows where that block holds more than one event.
    """
    df = (
        spread(rows)
        .withColumn("_wt", D.normalise_dna(F.col(wt)))
        .withColumn("_var", D.normalise_dna(F.col(var)))
        .withColumn("_w", D.codons(F.col("_wt")))
        .withColumn("_v", D.codons(F.col("_var")))
        .withColumn("_shift", (F.length("_wt") % 3 != 0) | (F.length("_var") % 3 != 0))
        .withColumn("_equal", ~F.col("_shift") & (F.length("_wt") == F.length("_var")))
    )
    w, v = F.col("_w"), F.col("_v")
    differing = F.filter(
        F.transform(w, lambda c, i: F.when(c != F.get(v, i), i)), lambda i: i.isNotNull()
    )
    df = df.withColumn("_diff", F.when(F.col("_equal"), differing))
    first, last = F.array_min("_diff"), F.array_max("_diff")
    many = F.col("_equal") & (F.size("_diff") >= 2)
    # Smallest block whose move costs no more events than the substitutions do.
    sizes = _indices(F.lit(1), F.floor(F.size("_diff") / 2).cast("int"))
    moves = F.transform(
        sizes, lambda k: F.struct(k.alias("size"), _moved_block(w, v, first, last, k).alias("way"))
    )
    df = df.withColumn(
        "_move", F.when(many, F.get(F.filter(moves, lambda m: m["way"].isNotNull()), F.lit(0)))
    )

    k, way = F.col("_move.size"), F.col("_move.way")
    ins_at = F.when(way == 1, first).otherwise(last - k + 1)
    del_at = F.when(way == 1, last - k + 1).otherwise(first)
    inserted = F.transform(
        _indices(ins_at, ins_at + k - 1),
        lambda i: _record("INSERTION", i + 1, None, F.get(v, i), None, D.residue(F.get(v, i)),
                          "moved_codon:insertion"),
    )
    deleted = F.transform(
        _indices(del_at, del_at + k - 1),
        lambda i: _record("DELETION", i + 1, F.get(w, i), None, D.residue(F.get(w, i)), None,
                          "moved_codon:deletion"),
    )

    # Unequal lengths: trim the common start and the common end of the proteins.
    uneven = ~F.col("_shift") & ~F.col("_equal")
    df = (
        df.withColumn("_wa", F.when(uneven, D.residues(F.col("_wt"))))
        .withColumn("_va", F.when(uneven, D.residues(F.col("_var"))))
        .withColumn("_short", F.least(F.size("_w"), F.size("_v")))
    )

    def common(a: Column, b: Column, n: Column) -> Column:
        same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
        at = F.array_position(same, F.lit(False))
        return F.when(at == 0, n).otherwise(at - 1).cast("int")

    df = df.withColumn("_head", F.when(uneven, common(F.col("_wa"), F.col("_va"), F.col("_short"))))
    df = df.withColumn(
        "_tail",
        F.when(uneven, common(F.reverse("_wa"), F.reverse("_va"), F.col("_short") - F.col("_head"))),
    )
    head, tail, short = F.col("_head"), F.col("_tail"), F.col("_short")
    grow = F.size("_v") - F.size("_w")
    pair_end = short - tail - 1  # last index of the paired part of the middle block

    def paired(i: Column, shift: Column) -> Column:
        wc, vc, wa, va = F.get(w, i), F.get(v, i + shift), F.get(F.col("_wa"), i), F.get(F.col("_va"), i + shift)
        kind = F.when(wa == va, "SYNONYMOUS").when(va == "*", "NONSENSE").otherwise("NONSYNONYMOUS")
        note = F.when(wa == va, "aligned:synonymous")
        return F.when(wc != vc, _record(kind, i + 1, wc, vc, wa, va, note))

    zero = F.lit(0)
    before = F.transform(_indices(zero, head - 1), lambda i: paired(i, zero))
    middle = F.transform(_indices(head, pair_end), lambda i: paired(i, zero))
    gained = F.transform(
        _indices(pair_end + 1, F.size("_v") - tail - 1),
        lambda i: _record("INSERTION", i + 1, None, F.get(v, i), None, F.get(F.col("_va"), i),
                          "aligned:insertion"),
    )
    lost = F.transform(
        _indices(pair_end + 1, F.size("_w") - tail - 1),
        lambda i: _record("DELETION", i + 1, F.get(w, i), None, F.get(F.col("_wa"), i), None,
                          "aligned:deletion"),
    )
    after = F.transform(_indices(F.size("_w") - tail, F.size("_w") - 1), lambda i: paired(i, grow))
    aligned = F.array_compact(F.concat(before, middle, F.when(grow > 0, gained).otherwise(lost), after))
    frameshift = F.array(
        _record("FRAMESHIFT", F.lit(None), None, None, None, None, "length_not_in_frame")
    )
    missing = F.coalesce(F.col("_var"), F.lit("")) == ""
    calls = (
        F.when(missing, F.array().cast(f"array<{MUTATION_STRUCT}>"))
        .when(F.col("_shift"), frameshift)
        .when(F.col("_move").isNotNull(), F.concat(inserted, deleted))
        .when(F.col("_equal"), _substitutions(w, v, F.col("_diff")))
        .otherwise(aligned)
    )
    approximate = F.coalesce(
        ~missing & ((uneven & (pair_end >= head)) | (F.col("_move").isNotNull() & (k > 1))), F.lit(False)
    )
    done = (
        df.withColumn("mutations", calls)
        .withColumn("approximate", approximate)
        .drop("_wt", "_var", "_w", "_v", "_shift", "_equal", "_diff", "_move", "_wa", "_va", "_short", "_head", "_tail")
    )
    return evaluated_once(done, ["mutations", "approximate"]).withColumn(
        "mutation_counts", counts_of(F.col("mutations")))


def counts_of(mutations: Column) -> Column:
    """Synonymous, non-synonymous (with indels) and total number of records."""
    return F.struct(
        F.size(F.filter(mutations, lambda m: m["mutation_type"] == "SYNONYMOUS")).alias("synonymous"),
        F.size(F.filter(mutations, lambda m: m["mutation_type"].isin(NONSYNONYMOUS_KINDS))).alias("nonsynonymous"),
        F.size(mutations).alias("total"),
    )


def guard_profiles(called: DataFrame, limits: SanityLimits = SanityLimits()) -> DataFrame:
    """Blank protein, counts and mutations of implausible profiles; a note stays."""
    size, wt = F.length("protein_aa"), F.coalesce(F.length("wt_protein"), F.lit(0))
    total = F.col("mutation_counts.total")
    most = F.when(wt > 0, F.greatest(F.lit(limits.absolute), F.floor(wt * limits.fraction).cast("int"))).otherwise(
        F.lit(limits.absolute))
    bad = (F.coalesce(F.col("protein_aa"), F.lit("")) != "") & (
        ((size <= limits.short_protein) & (total >= limits.short_mutations))
        | (
            (wt > 0)
            & (size <= F.greatest(F.lit(limits.ratio_min_length), F.floor(F.lit(0.10) * wt).cast("int")))
            & (total >= F.floor(wt * limits.ratio))
        )
        | (total > most)
    )
    # Fixed value: the words before the colon.
    note = F.format_string(
        "Mutation sanity guard: profile dropped (mutations=%d, residues=%d, wild_type=%d, outlier_threshold=%d)", total, size, wt, most)
    df = called.withColumn("guarded", F.coalesce(bad, F.lit(False)))
    hit = F.col("guarded")
    return (
        df.withColumn("qc_notes", F.when(hit, F.trim(F.concat(F.coalesce("qc_notes", F.lit("")), F.lit(" "), note))).otherwise(F.col("qc_notes")))
        .withColumn("protein_aa", F.when(~hit, F.col("protein_aa")))
        .withColumn("mutations", F.when(hit, F.array().cast(f"array<{MUTATION_STRUCT}>")).otherwise(F.col("mutations")))
        .withColumn("mutation_counts", counts_of(F.col("mutations")))
    )


def analysis_rows(guarded: DataFrame) -> DataFrame:
    """Rows of the stored sequence analysis."""
    return guarded.select(
        "variant_id",
        F.col("cds_start").alias("cds_start_0based"),
        F.col("cds_end").alias("cds_end_0based_excl"),
        "strand",
        "frame",
        F.coalesce(F.col("cds_end") < F.col("cds_start"), F.lit(False)).alias("is_circular_wrap"),
        F.when(F.col("protein_aa").isNull(), "failed").otherwise("success").alias("status"),
        "qc_notes",
        "has_frameshift",
        "has_premature_stop",
        "has_ambiguous_bases",
        F.struct("mutations", "mutation_counts").alias("analysis"),
        F.current_timestamp().alias("created_at"),
        F.current_timestamp().alias("updated_at"),
    )


def count_metric_rows(guarded: DataFrame) -> DataFrame:
    """The three derived count metrics of every analysed variant, long."""
    wide = guarded.select(
        "variant_id",
        F.col("mutation_counts.synonymous").cast("double").alias("mutation_synonymous_count"),
        F.col("mutation_counts.nonsynonymous").cast("double").alias("mutation_nonsynonymous_count"),
        F.col("mutation_counts.total").cast("double").alias("mutation_total_count"),
    )
    return wide.unpivot(
        ["variant_id"], COUNT_METRICS, "metric_name", "value",
    ).select("variant_id", "metric_name", F.lit("derived").alias("metric_type"), "value", F.lit("count").alias("unit"))


def is_count_metric() -> Column:
    """Of the metric rows that ``count_metric_rows`` makes."""
    return F.col("metric_name").isin(COUNT_METRICS) & (F.col("metric_type") == "derived")


def mutation_rows(guarded: DataFrame) -> DataFrame:
    """One row per called mutation."""
    return guarded.select("variant_id", F.explode("mutations").alias("_m")).select("variant_id", "_m.*")


def run_status(guarded: DataFrame) -> DataFrame:
    """Status of each experiment after a run: with errors if any variant has no
    CDS, no protein, a frameshift or a premature stop."""
    bad = (
        (F.coalesce("cds_dna", F.lit("")) == "") | F.col("protein_aa").isNull()
        | F.col("has_frameshift") | F.col("has_premature_stop")
    )
    return guarded.groupBy("experiment_id").agg(
        F.when(F.bool_or(F.coalesce(bad, F.lit(True))), "ANALYSED_WITH_ERRORS").otherwise("ANALYSED").alias("status")
    )
