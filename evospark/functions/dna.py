"""DNA and protein text as Spark column expressions.

Whole texts are translated by table lookups on Arrow batches, single codons of
an array by a JVM-side expression.
"""

from __future__ import annotations

import functools
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The bacterial genetic code (table 11), codons in the order of
# the bases T, C, A, G; the ambiguity letters of DNA and of proteins.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
AMBIGUOUS_BASES = {
    "R": "AG", "Y": "CT", "W": "AT", "S": "CG", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
AMBIGUOUS_RESIDUES = {"DN": "B", "EQ": "Z", "IL": "J"}
COMPLEMENT_FROM = "ACGTRYKMBVDHSWNU"
COMPLEMENT_TO = "TGCAYRMKVBHDSWNA"
IUPAC_DNA = "ACGTNRYWSKMBDHV"

CODE = {"".join(c): aa for c, aa in zip(product(BASES, repeat=3), AMINO_ACIDS)}


@cache
def _ambiguous_code() -> dict[str, str]:
    """Codons with ambiguity letters that still name one residue (or one of the
    ambiguous residues); all others are X."""
    letters = {**{b: b for b in BASES}, **AMBIGUOUS_BASES}
    out = {}
    for codon in product(letters, repeat=3):
        text = "".join(codon)
        if text in CODE:
            continue
        found = "".join(sorted({CODE["".join(c)] for c in product(*(letters[x] for x in codon))}))
        residue = found if len(found) == 1 else AMBIGUOUS_RESIDUES.get(found)
        if residue:
            out[text] = residue
    return out


def normalise_dna(col: Column) -> Column:
    """Upper case without whitespace."""
    return F.upper(F.regexp_replace(col, r"\s+", ""))


def has_ambiguous(col: Column) -> Column:
    """Any base other than A, C, G, T."""
    return col.rlike("[^ACGT]")


def reverse_complement(col: Column) -> Column:
    return F.reverse(F.translate(col, COMPLEMENT_FROM, COMPLEMENT_TO))


def codons(col: Column) -> Column:
    """Array of complete codons; a trailing partial codon is dropped."""
    return F.regexp_extract_all(col, F.lit("(.{3})"), F.lit(1))


def _digits(col: Column) -> Column:
    """Bases as digits, so that a codon of plain bases is a small number."""
    return F.translate(col, BASES + "U", "01230")


def _residue_of_digits(code: Column) -> Column:
    """Residue of a codon in digits: an array lookup for plain codons, a map for
    the few ambiguous ones that still name a residue, else X."""
    slots = ["?"] * 334
    for i, aa in enumerate(AMINO_ACIDS):
        slots[100 * (i // 16) + 10 * (i // 4 % 4) + i % 4] = aa
    to_digits = str.maketrans(BASES, "0123")
    unclear = ",".join(f"{k.translate(to_digits)}:{v}" for k, v in _ambiguous_code().items())
    # Both tables are one text literal each, which the optimizer folds.
    table = F.split(F.lit(",".join(slots)), ",")
    return F.coalesce(
        F.get(table, code.try_cast("int")),
        F.try_element_at(F.str_to_map(F.lit(unclear), F.lit(","), F.lit(":")), code),
        F.lit("X"),
    )


def residue(codon: Column) -> Column:
    """Amino acid of one codon; ``*`` is a stop, X unknown."""
    return _residue_of_digits(_digits(codon))


def residues(col: Column) -> Column:
    """Array of the residues of a DNA text's codons."""
    protein = F.arrow_udf(functools.partial(_translated, strict=False), "string", F.ArrowUDFType.SCALAR)(col)
    return F.when(F.length(protein) > 0, F.split(protein, "")).when(protein.isNotNull(), F.array().cast("array<string>"))


TRANSLATED_AT_ONCE = 1 << 20  # bases of a batch whose codons are looked up together


@cache
def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """Number of every base letter (0 for all other bytes), residue by the numbers of three bases."""
    letters = IUPAC_DNA + "U"
    numbers = np.zeros(256, dtype=np.int16)
    numbers[np.frombuffer(letters.encode(), np.uint8)] = np.arange(1, len(letters) + 1)
    known = CODE | _ambiguous_code()
    table = [known.get("".join(c).replace("U", "T"), "X") for c in product("?" + letters, repeat=3)]
    return numbers, np.frombuffer("".join(table).encode(), np.uint8)


def _translated(texts: pa.Array, *, strict: bool = True) -> pa.Array:
    """Proteins of DNA texts; NULL (or, if not ``strict``, X per codon) where a text holds another letter."""
    numbers, table = _lookup()
    if not strict:
        numbers = numbers.copy()
        numbers[np.frombuffer(b"0123", np.uint8)] = numbers[np.frombuffer(BASES.encode(), np.uint8)]  # as in ``_digits``
        texts = pa.array([t if t is None or t.isascii() else t.encode("ascii", "replace").decode() for t in texts.to_pylist()], pa.string())
    base = int(round(len(table) ** (1 / 3)))
    bases = texts.cast(pa.large_binary())
    ends = np.frombuffer(bases.buffers()[1], np.int64)[bases.offset:bases.offset + len(bases) + 1]
    data = np.frombuffer(bases.buffers()[2] or b"", np.uint8)
    sizes = np.diff(ends) // 3
    stops = np.concatenate([[0], np.cumsum(sizes)])
    out, valid = np.empty(stops[-1], dtype=np.uint8), bases.is_valid().to_numpy(zero_copy_only=False).copy()
    a = 0
    while a < len(bases):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + TRANSLATED_AT_ONCE, side="right")) - 1)
        letters = numbers[data[ends[a]:ends[b]]]
        wrong = np.flatnonzero(letters == 0) if strict else np.empty(0, dtype=np.int64)
        valid[a + np.searchsorted(ends[a:b + 1] - ends[a], wrong, side="right") - 1] = False
        at = np.repeat(ends[a:b] - ends[a] - 3 * (stops[a:b] - stops[a]), sizes[a:b]) + 3 * np.arange(stops[b] - stops[a])
        out[stops[a]:stops[b]] = table[(letters[at] * base + letters[at + 1]) * base + letters[at + 2]]
        a = b
    kept = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(bases), pa.py_buffer(stops.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()), kept)


def translate(col: Column, *, to_stop: bool = False) -> Column:
    """Protein of a DNA text (frame 0); NULL when it holds a letter that is not
    an IUPAC base."""
    protein = F.arrow_udf(_translated, "string", F.ArrowUDFType.SCALAR)(col)
    return F.split_part(protein, F.lit("*"), F.lit(1)) if to_stop else protein


def circular_slice(dna: Column, start: Column, end: Column, *, on_equal: str = "empty") -> Column:
    """Bases from ``start`` to ``end`` (0-based, end exclusive) of a circle."""
    if on_equal not in {"empty", "full"}:
        raise ValueError("on_equal must be empty or full")
    n = F.length(dna)
    first, last = F.pmod(start, n), F.pmod(end, n)
    size = F.pmod(last - first, n)
    wrapped = F.substring(F.concat(dna, dna), first + 1, size)
    return (
        F.when(n == 0, "")
        .when(first == last, dna if on_equal == "full" else F.lit(""))
        .otherwise(wrapped)
    )


def translation_with_quality(col: Column, *, stop_policy: str = "truncate", min_length: int = 3) -> Column:
    """Protein of a coding sequence together with quality flags, as a struct."""
    if stop_policy not in {"truncate", "keep_stops"}:
        raise ValueError("stop_policy must be truncate or keep_stops")
    dna = normalise_dna(col)
    full = translate(dna)
    n = F.length(dna)
    short = n < min_length
    stop = F.instr(full, "*")
    usable = ~short & full.isNotNull()
    has_stop = F.coalesce(usable & (stop > 0), F.lit(False))
    protein = F.split_part(full, F.lit("*"), F.lit(1)) if stop_policy == "truncate" else full
    notes = F.concat_ws(
        "; ",
        F.when(n % 3 != 0, "CDS length not divisible by 3."),
        F.when(has_ambiguous(dna), "Ambiguous/non-ACGT base(s) present."),
    )
    return F.struct(
        F.when(usable, protein).alias("protein"),
        n.alias("normalised_len"),
        has_ambiguous(dna).alias("has_ambiguous_bases"),
        has_stop.alias("has_stop_codon"),
        (n % 3 != 0).alias("has_frameshift"),
        (has_stop if stop_policy == "truncate" else F.lit(False)).alias("is_truncated"),
        F.when(has_stop, stop - 1).alias("stop_index"),
        F.when(short, "Sequence too short to translate")
        .when(full.isNull(), "Translation failed")
        .otherwise(F.nullif(notes, F.lit("")))
        .alias("notes"),
    )
