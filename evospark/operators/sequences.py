"""From plasmids to coding sequences: wild-type gene, variant CDS, validation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evospark.functions import dna as D
from evospark.functions.once import evaluated_once
from evospark.session import spread

ANCHOR = 30  # bases of an anchor; anchors shorter than half of it do not count
PADDING = 150  # extra bases read after the wild-type length
MIN_IDENTITY = 60.0  # percent identity a wild-type gene must reach
SEED = 4  # residues of a seed
RESIDUES_AT_ONCE = 1 << 20  # of the texts whose seeds are compared together
PAIRS_AT_ONCE = 1 << 22  # pairs of equal seeds that are in memory together

# Search order: forward frames first, then reverse frames.
FRAMES = [("PLUS", 0), ("PLUS", 1), ("PLUS", 2), ("MINUS", 0), ("MINUS", 1), ("MINUS", 2)]


def wt_references(experiments: DataFrame, proteins: DataFrame, metadata: DataFrame) -> DataFrame:
    """Wild-type protein and plasmid of each experiment.

    A staged protein in the experiment metadata (valid JSON) replaces the table
    value; a plasmid override counts only if it is longer.
    """
    staged = (
        metadata.where("field_name = 'uniprot_staging'")
        .groupBy("experiment_id")
        .agg(F.max("field_value").alias("_json"))
        .select("experiment_id", F.get_json_object("_json", "$.protein_sequence").alias("_staged"))
    )
    joined = (
        experiments.select("experiment_id", "wt_id", "extra_metadata")
        .join(proteins.select("wt_id", "amino_acid_sequence", "plasmid_sequence"), "wt_id")
        .join(staged, "experiment_id", "left")
    )
    override = D.normalise_dna(F.try_element_at("extra_metadata", F.lit("wt_plasmid_sequence")))
    protein = F.upper(F.nullif(F.trim("_staged"), F.lit("")))
    return joined.select(
        "experiment_id",
        F.coalesce(protein, F.col("amino_acid_sequence")).alias("wt_protein"),
        F.when(
            F.length(override) > F.length(F.coalesce("plasmid_sequence", F.lit(""))), override
        ).otherwise(F.col("plasmid_sequence")).alias("wt_plasmid"),
    )


def _with_frames(df: DataFrame) -> DataFrame:
    """Adds ``_f0`` to ``_f5``: the doubled plasmid ``_d`` translated in each of ``FRAMES``."""
    both = df.withColumn("_dd", F.concat("_d", "_d")).withColumn("_rr", D.reverse_complement(F.col("_dd")))

    def protein(strand: str, frame: int) -> Column:
        text = F.col("_rr" if strand == "MINUS" else "_dd")
        return D.translate(F.substring(text, F.lit(frame + 1), F.length(text) - frame))

    return both.withColumns({f"_f{i}": protein(s, f) for i, (s, f) in enumerate(FRAMES)}).drop("_dd", "_rr")


def _plasmid_span(n: Column, strand: Column, frame: Column, start_aa: Column, size_aa: Column) -> tuple[Column, Column]:
    """Bases of a hit in the doubled plasmid, on the forward strand."""
    first = frame + start_aa * 3
    last = frame + (start_aa + size_aa) * 3
    minus = strand == "MINUS"
    return F.when(minus, 2 * n - last).otherwise(first), F.when(minus, 2 * n - first).otherwise(last)


def validate_plasmids(rows: DataFrame, protein: str = "wt_protein", plasmid: str = "plasmid") -> DataFrame:
    """Does each plasmid (a circle) encode the protein exactly in one of its six
    frames? Adds validity, strand, 0-based inclusive coordinates and wrapping."""
    df = spread(rows).withColumn("_p", F.upper(F.trim(F.coalesce(protein, F.lit(""))))).withColumn(
        "_d", F.upper(F.trim(F.coalesce(plasmid, F.lit(""))))
    )
    # First frame with a hit, as 8 * position + frame number.
    found = [F.nullif(F.instr(f"_f{i}", F.col("_p")), F.lit(0)) * 8 + i for i in range(len(FRAMES))]
    df = _with_frames(df).withColumn("_code", F.coalesce(*found)).drop(*(f"_f{i}" for i in range(len(FRAMES))))
    df = evaluated_once(df, ["_code"])
    number = F.col("_code") % 8
    df = df.withColumn(
        "_hit",
        F.when(
            F.col("_code").isNotNull(),
            F.struct(
                F.when(number < 3, "PLUS").otherwise("MINUS").alias("strand"),
                (number % 3).alias("frame"),
                F.floor(F.col("_code") / 8).alias("at"),
            ),
        ),
    )
    present = (F.col("_p") != "") & (F.col("_d") != "")
    ok = present & F.col("_hit").isNotNull()
    n = F.length("_d")
    first, last = _plasmid_span(
        n, F.col("_hit.strand"), F.col("_hit.frame"), F.col("_hit.at") - 1, F.length("_p")
    )
    keep = [c for c in rows.columns]
    return df.select(
        *keep,
        ok.alias("is_valid"),
        F.when(ok, 100.0).otherwise(0.0).alias("identity"),
        F.when(ok, 100.0).otherwise(0.0).alias("coverage"),
        F.when(ok, F.when(F.col("_hit.strand") == "MINUS", "-").otherwise("+")).alias("strand"),
        F.when(ok, F.pmod(first, n)).alias("start_nt"),
        F.when(ok, F.pmod(last - 1, n)).alias("end_nt"),
        F.coalesce(ok & (first < n) & (last > n), F.lit(False)).alias("wraps"),
        F.when(F.col("_p") == "", "missing:protein")
        .when(F.col("_d") == "", "missing:plasmid")
        .when(ok, "encoded")
        .otherwise("not_encoded")
        .alias("message"),
    )


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters one after the other, and where each text begins (and the last one ends)."""
    data = [t.encode("utf-32-le") for t in texts.to_pylist()]
    return np.frombuffer(b"".join(data), np.uint32), np.concatenate([[0], np.cumsum([len(d) // 4 for d in data])]).astype(np.int64)


def _seeds(points: np.ndarray, starts: np.ndarray, size: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of all overlapping seeds in their texts, and a number that only equal seeds of one text share."""
    counts = np.maximum(np.diff(starts) - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = starts[owner] + at
    seed = np.zeros(len(owner), dtype=np.int64)
    for k in range(size):
        seed = seed * len(known) + np.searchsorted(known, points[first + k])
    return at, owner * len(known) ** size + seed


def _votes(proteins: pa.Array, frames: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best diagonal of every frame (-1: none) and the residues equal along it, for seeds of ``size`` residues."""
    p, p_starts = _code_points(proteins)
    f, f_starts = _code_points(frames)
    known = np.unique(np.concatenate([p, f]))
    if len(proteins) * float(len(known)) ** size > 2**62:  # many alphabets: fewer texts at a time
        half = len(proteins) // 2
        parts = [_votes(proteins[a:b], frames[a:b], size) for a, b in ((0, half), (half, len(proteins)))]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    placed, protein_seeds = _seeds(p, p_starts, size, known)
    at, frame_seeds = _seeds(f, f_starts, size, known)
    order = np.argsort(protein_seeds, kind="stable")
    placed, protein_seeds = placed[order], protein_seeds[order]
    low = np.searchsorted(protein_seeds, frame_seeds, side="left")
    ends = np.cumsum(np.searchsorted(protein_seeds, frame_seeds, side="right") - low)
    owner = frame_seeds // len(known) ** size
    # A vote is counted at the place where its diagonal begins in the frame; pairs are formed some at a time.
    votes = np.zeros(len(f), dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    for a in range(0, total, PAIRS_AT_ONCE):
        pair = np.arange(a, min(a + PAIRS_AT_ONCE, total))
        seed = np.searchsorted(ends, pair, side="right")
        nth = pair - np.where(seed > 0, ends[seed - 1], 0)
        diagonal = at[seed] - placed[low[seed] + nth]
        seen = diagonal >= 0
        votes += np.bincount(f_starts[owner[seed[seen]]] + diagonal[seen], minlength=len(f))
    best, same = np.full(len(proteins), -1), np.zeros(len(proteins), dtype=np.int64)
    for i in range(len(proteins)):
        counted = votes[f_starts[i]:f_starts[i + 1]]
        if len(counted) and counted.any():
            best[i] = int(counted.argmax())  # the first of the largest
            window = f[f_starts[i] + best[i]:f_starts[i + 1]]
            residues = p[p_starts[i]:p_starts[i + 1]]
            n = min(len(window), len(residues))
            same[i] = np.count_nonzero(window[:n] == residues[:n])
    return best, same


def _diagonals(proteins: pa.Array, frames: pa.Array) -> pa.Array:
    """(diagonal, residues equal along it) of the most votes by seeds that a protein and a frame share."""
    best, same = np.full(len(proteins), -1), np.zeros(len(proteins), dtype=np.int64)
    lengths = pc.utf8_length(proteins).to_numpy(zero_copy_only=False)
    weights = np.cumsum(lengths + pc.utf8_length(frames).to_numpy(zero_copy_only=False)) // RESIDUES_AT_ONCE
    for size in range(1, SEED + 1):  # a protein shorter than a seed is its own seed
        of_size = np.flatnonzero(np.minimum(lengths, SEED) == size)
        for rows in np.split(of_size, np.flatnonzero(np.diff(weights[of_size])) + 1):
            if len(rows):
                best[rows], same[rows] = _votes(proteins.take(pa.array(rows)), frames.take(pa.array(rows)), size)
    none = pa.array(best < 0)
    return pa.StructArray.from_arrays([pa.array(best, pa.int32()), pa.array(same, pa.int32())], names=["diag", "same"], mask=none)


def locate_wild_type(rows: DataFrame, keys: Sequence[str], protein: str = "wt_protein", plasmid: str = "wt_plasmid") -> DataFrame:
    """Coding sequence of the wild-type protein inside each circular plasmid.

    Seeds shared by the protein and a translated frame vote for a diagonal; the
    best diagonals are compared residue by residue (no gaps). The candidate with
    the highest identity of at least 60 % wins; its CDS must be unambiguous.
    Plasmids without a candidate have no row.
    """
    keys = list(keys)
    base = rows.select(
        *keys,
        F.upper(F.trim(protein)).alias("_p"),
        D.normalise_dna(F.col(plasmid)).alias("_d"),
    ).where("_p <> '' and _d <> ''")
    framed = _with_frames(base).withColumn(
        "_frame",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("no"), F.lit(s).alias("strand"), F.lit(f).alias("frame"),
                        F.col(f"_f{i}").alias("protein"),
                    )
                    for i, (s, f) in enumerate(FRAMES)
                ]
            )
        ),
    )
    # As a key of the result, NULL finds nothing.
    frames = framed.select(*keys, "_p", "_d", "_frame.*").where("protein is not null").dropna(subset=keys)
    vote = F.arrow_udf(_diagonals, "diag int, same int", F.ArrowUDFType.SCALAR)
    voted = evaluated_once(frames.withColumn("_best", vote("_p", "protein")), ["_best"]).where("_best is not null").select(
        "*", F.col("_best.diag").alias("_diag"), F.col("_best.same").alias("_same"))
    size = F.length("_p")
    window = F.substring("protein", F.col("_diag") + 1, size)
    n = F.length("_d")
    first, last = _plasmid_span(n, F.col("strand"), F.col("frame"), F.col("_diag"), size)
    text = F.when(
        F.col("strand") == "MINUS", D.reverse_complement(F.concat("_d", "_d"))
    ).otherwise(F.concat("_d", "_d"))
    found = (
        voted.withColumn("match_identity_pct", 100.0 * F.col("_same") / F.length(window))
        .withColumn("wt_cds", F.substring(text, F.col("frame") + F.col("_diag") * 3 + 1, size * 3))
        .where(
            (F.col("match_identity_pct") >= MIN_IDENTITY)
            & (F.length("wt_cds") >= 3)
            & (F.length("wt_cds") % 3 == 0)
            & (F.length("wt_cds") / 3 >= F.greatest(F.lit(1), F.floor(F.lit(0.8) * size)))
            & ~D.has_ambiguous(F.col("wt_cds"))
        )
        .select(
            *keys,
            F.struct(
                "match_identity_pct", (-F.col("no")).alias("order"), "strand", "frame",
                F.pmod(first, n).alias("cds_start"), F.pmod(last, n).alias("cds_end"),
                "wt_cds", F.col("_p").alias("wt_protein"),
            ).alias("_found"),
        )
    )
    return found.groupBy(*keys).agg(F.max("_found").alias("_best")).select(
        *keys, "_best.strand", "_best.frame", "_best.cds_start", "_best.cds_end", "_best.wt_cds",
        "_best.wt_protein", "_best.match_identity_pct",
    )


def extract_cds(variants: DataFrame, stop_policy: str = "truncate") -> DataFrame:
    """Coding sequence, protein and quality flags of every variant.

    Each row carries its plasmid (``assembled_dna_sequence``) and the mapping of
    its wild type (``strand``, ``frame``, ``cds_start``, ``cds_end``, ``wt_cds``,
    ``wt_protein``). The gene is found by anchors of the wild-type CDS, so a
    plasmid may be cut anywhere; without an anchor the mapped coordinates count.
    """
    if stop_policy not in {"truncate", "keep_stops"}:
        raise ValueError("stop_policy must be truncate or keep_stops")
    minus = F.col("strand") == "MINUS"
    df = (
        spread(variants)
        .withColumn("_d", D.normalise_dna(F.coalesce("assembled_dna_sequence", F.lit(""))))
        .withColumn("_wt", D.normalise_dna(F.col("wt_cds")))
        .withColumn("_n", F.length("_d"))
        .withColumn("_len", F.length("_wt"))
        .withColumn("_dd", F.concat("_d", "_d"))
        .withColumn("_genomic", F.when(minus, D.reverse_complement(F.col("_wt"))).otherwise(F.col("_wt")))
    )

    def start_by(quarter: int) -> Column:
        offset = F.floor(F.col("_len") * quarter / 4).cast("int")
        anchor = F.substring("_genomic", offset + 1, F.lit(ANCHOR))
        at = F.when(F.length(anchor) >= ANCHOR // 2, F.nullif(F.instr(F.col("_dd"), anchor), F.lit(0)))
        return F.pmod(at - 1 - offset, F.col("_n"))

    window = F.least(F.col("_len") + PADDING, F.col("_n"))
    df = df.withColumn("_start", F.when(F.col("_n") > 0, F.coalesce(*[start_by(q) for q in range(4)])))
    begin = F.when(minus, F.pmod(F.col("_start") + F.col("_len") - window, F.col("_n"))).otherwise(F.col("_start"))
    piece = F.substring("_dd", begin + 1, window)
    df = df.withColumn("_coding", F.when(minus, D.reverse_complement(piece)).otherwise(piece))
    df = df.withColumn("_stop", F.instr(D.translate(F.col("_coding")), "*"))
    df = df.withColumn(
        "_size", F.when(F.col("_stop") > 0, (F.col("_stop") - 1) * 3).otherwise(F.col("_len"))
    )
    fixed = D.circular_slice(F.col("_d"), F.col("cds_start"), F.col("cds_end"))
    fixed = F.when(minus, D.reverse_complement(fixed)).otherwise(fixed)
    anchored = F.col("_start").isNotNull()
    right = F.pmod(F.col("_start") + F.col("_len"), F.col("_n"))
    df = (
        df.withColumn("cds_dna", F.when(anchored, F.substring("_coding", F.lit(1), F.col("_size"))).otherwise(fixed))
        .withColumn(
            "_from",
            F.when(anchored, F.when(minus, F.pmod(right - F.col("_size"), F.col("_n"))).otherwise(F.col("_start")))
            .otherwise(F.col("cds_start")),
        )
        .withColumn(
            "_to",
            F.when(anchored, F.when(minus, right).otherwise(F.pmod(F.col("_start") + F.col("_size"), F.col("_n"))))
            .otherwise(F.col("cds_end")),
        )
        .withColumn(
            "protein_aa",
            F.when(F.col("cds_dna") != "", D.translate(F.col("cds_dna"), to_stop=stop_policy == "truncate")),
        )
    )
    filled = F.coalesce(F.col("protein_aa"), F.lit("")) != ""
    if stop_policy == "truncate":
        early = filled & (F.length("protein_aa") < F.length("wt_protein"))
        note = "stop:truncated"
    else:
        early = filled & F.col("protein_aa").contains("*")
        note = "stop:kept"
    temp = ["_d", "_wt", "_n", "_len", "_dd", "_genomic", "_start", "_coding", "_stop", "_size"]
    df = evaluated_once(
        df.withColumn("found_by_anchor", anchored).drop(*temp),
        ["cds_dna", "_from", "_to", "protein_aa", "found_by_anchor"],
    )
    return (
        df.withColumn("has_frameshift", F.length("cds_dna") % 3 != 0)
        .withColumn("has_ambiguous_bases", D.has_ambiguous(F.col("cds_dna")))
        .withColumn("has_premature_stop", early)
        .withColumn(
            "qc_notes",
            F.when(early, note).when((F.col("cds_dna") != "") & F.col("protein_aa").isNull(), "Translation failed."),
        )
        .withColumn("cds_start", F.col("_from").cast("int"))
        .withColumn("cds_end", F.col("_to").cast("int"))
        .drop("_from", "_to")
    )


def needs_remap() -> Column:
    """An extraction to repeat with a mapping searched in the variant itself."""
    return (
        F.col("protein_aa").isNull()
        | F.col("has_frameshift")
        | (F.length("protein_aa") < F.greatest(F.lit(1), F.floor(F.lit(0.8) * F.length("wt_protein"))))
    )
