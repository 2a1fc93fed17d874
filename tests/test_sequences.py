import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evospark.functions import dna as D
from evospark.operators import mutations as U, sequences as Q
from evospark.plans import flows as P
from evospark.sources.references import feature_table, parse_fasta, protein_table, read_protein_entries, storable_features

CASES = [
    ("ATGGCTGCC", "ATGGCTAAAGCC", (0, 1, 1), ["INSERTION"]),
    ("ATGGCTAAAGCC", "ATGGCTGCC", (0, 1, 1), ["DELETION"]),
    ("ATGGCTGCC", "ATGGCTGC", (0, 0, 1), ["FRAMESHIFT"]),
    ("ATGGAATTTGCT", "ATGGAGAAATTCGCT", (2, 1, 3), ["SYNONYMOUS", "INSERTION", "SYNONYMOUS"]),
    ("ATGGCTGCC", "ATGAAATTTGCTGCC", (0, 2, 2), ["INSERTION", "INSERTION"]),
    ("ATGGAATTTGCTCCA", "ATGAAAGAAGCTCCA", (0, 2, 2), ["INSERTION", "DELETION"]),
    ("ATGGCTGCC", "ATGGNTGCA", (1, 0, 2), ["AMBIGUOUS", "SYNONYMOUS"]),
    ("ATGGCTGCC", "ATGTAAGCC", (0, 1, 1), ["NONSENSE"]),
    ("ATGGCTGCC", "", (0, 0, 0), []),
]


def test_mutation_calls(spark):
    df = spark.createDataFrame([(i, w, v) for i, (w, v, _, _) in enumerate(CASES)], "i int, wt_cds string, cds_dna string")
    for r in U.call_mutations(df).collect():
        _, _, counts, kinds = CASES[r["i"]]
        assert tuple(r["mutation_counts"]) == counts
        assert [m["mutation_type"] for m in r["mutations"]] == kinds
        assert not r["approximate"]


def brute_force_pair(w, v):
    """First (delete, insert) codon pair that makes the rest equal."""
    mism = [i for i in range(len(w)) if w[i] != v[i]]
    if len(mism) < 2:
        return None
    for d in mism:
        for i in mism:
            if i != d and w[:d] + w[d + 1:] == v[:i] + v[i + 1:]:
                return i, d
    return None


def test_moved_codon_equals_search(spark):
    rng = random.Random(3)
    rows = []
    for n in range(400):
        w = [rng.choice(["AAA", "CCC", "GAT"]) for _ in range(rng.randint(2, 7))]
        v = list(w)
        if rng.random() < 0.7:
            v.pop(rng.randrange(len(v)))
            v.insert(rng.randrange(len(v) + 1), rng.choice(["AAA", "CCC", "GAT"]))
        else:
            v = [rng.choice(["AAA", "CCC", "GAT"]) for _ in v]
        rows.append((n, "".join(w), "".join(v)))
    got = U.call_mutations(spark.createDataFrame(rows, "i int, wt_cds string, cds_dna string")).collect()
    for r in got:
        _, w, v = rows[r["i"]]
        pair = brute_force_pair([w[k:k + 3] for k in range(0, len(w), 3)], [v[k:k + 3] for k in range(0, len(v), 3)])
        kinds = {m["mutation_type"]: m["aa_position_1based"] - 1 for m in r["mutations"]}
        if pair:
            assert (kinds.get("INSERTION"), kinds.get("DELETION")) == pair
        else:
            single = "INSERTION" in kinds and not r["approximate"]
            assert not single


def test_translation_rules(spark):
    cases = {"ATGGCN": "MA", "RAY": "B", "SAR": "Z", "TAR": "*", "NNN": "X", "YTA": "L", "ATGC": "M", "AUG": "M", "AT1": None}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    assert {r["d"]: r["p"] for r in df.select("d", D.translate(F.col("d")).alias("p")).collect()} == cases


def test_translation_quality(spark):
    df = spark.createDataFrame([("atg taa gc",), ("AT",), ("ATGNNN",)], "d string")
    a, b, c = [r["q"] for r in df.select(D.translation_with_quality(F.col("d")).alias("q")).collect()]
    assert (a["protein"], a["normalised_len"], a["has_frameshift"], a["stop_index"], a["is_truncated"]) == ("M", 8, True, 1, True)
    assert b["protein"] is None and b["notes"] == "Sequence too short to translate"
    assert c["has_ambiguous_bases"] and c["protein"] == "MX"


def test_circular_slice(spark):
    df = spark.createDataFrame([("ACGTTT", 4, 2), ("ACGTTT", 1, 3), ("ACGTTT", 2, 2), ("ACGTTT", 8, 9)], "d string, s int, e int")
    got = [r[0] for r in df.select(D.circular_slice(F.col("d"), F.col("s"), F.col("e"))).collect()]
    assert got == ["TTAC", "CG", "", "G"]
    full = df.where("s = e").select(D.circular_slice(F.col("d"), F.col("s"), F.col("e"), on_equal="full")).first()[0]
    assert full == "ACGTTT"


def test_plasmid_validation(spark):
    rows = [("MKT", "GGGATGAAAACCTTT"), ("MKT", "AAAACCGGGGGGATG"), ("MMMM", "ACGTACGTACGT"), ("MKT", "ATGAAAACC"), ("MKT", "GGTTTTCATCC"), ("", "A")]
    found = Q.validate_plasmids(spark.createDataFrame(rows, "wt_protein string, plasmid string")).collect()  # in any order
    by_plasmid = {r["plasmid"]: tuple(r)[2:9] for r in found}
    got = [by_plasmid[plasmid] for _, plasmid in rows]
    assert got[0] == (True, 100.0, 100.0, "+", 3, 11, False)
    assert got[1] == (True, 100.0, 100.0, "+", 12, 5, True)
    assert got[2][0] is False and got[5][0] is False
    assert got[3] == (True, 100.0, 100.0, "+", 0, 8, False)
    assert got[4] == (True, 100.0, 100.0, "-", 0, 8, False)


MAPPED = ("experiment_id long, variant_id long, assembled_dna_sequence string, strand string, frame int, cds_start int, "
          "cds_end int, wt_cds string, wt_protein string")


def test_cds_by_mapped_coordinates(spark):
    rows = [(1, 10, "G" + "ATGGCTGCC" + "T" * 20, "PLUS", 1, 1, 10, "ATGGCTGCC", "MAA"),
            (1, 11, "GG" + "ATGAAAGCC" + "T" * 19, "PLUS", 2, 2, 11, "ATGAAAGCC", "MKA")]
    got = {r["variant_id"]: (r["cds_dna"], r["protein_aa"]) for r in Q.extract_cds(spark.createDataFrame(rows, MAPPED)).collect()}
    assert got == {10: ("ATGGCTGCC", "MAA"), 11: ("ATGAAAGCC", "MKA")}


def random_gene(rng, n):
    codons = [c for c, a in D.CODE.items() if a != "*"]
    return "ATG" + "".join(rng.choice(codons) for _ in range(n))


@pytest.mark.parametrize("strand", ["PLUS", "MINUS"])
def test_cut_anywhere_on_both_strands(spark, strand):
    rng = random.Random(5)
    gene = random_gene(rng, 70)
    comp = str.maketrans("ACGT", "TGCA")
    circle = gene + "TAA" + "".join(rng.choice("ACGT") for _ in range(90))
    if strand == "MINUS":
        circle = circle.translate(comp)[::-1]
    protein = "".join(D.CODE[gene[i:i + 3]] for i in range(0, len(gene), 3))
    found = Q.locate_wild_type(
        spark.createDataFrame([(1, protein, circle)], "experiment_id long, wt_protein string, wt_plasmid string"), ["experiment_id"]).first()
    assert found["wt_cds"] == gene and found["strand"] == strand and found["match_identity_pct"] == 100.0
    rows = [(1, cut, circle[cut:] + circle[:cut], strand, 0, found["cds_start"], found["cds_end"], gene, protein) for cut in range(0, len(circle), 37)]
    got = Q.extract_cds(spark.createDataFrame(rows, MAPPED)).collect()
    assert {r["cds_dna"] for r in got} == {gene}
    for r in got:
        doubled = r["assembled_dna_sequence"] * 2
        size = (r["cds_end"] - r["cds_start"]) % len(circle)
        piece = doubled[r["cds_start"]:r["cds_start"] + size]
        assert (piece if strand == "PLUS" else piece.translate(comp)[::-1]) == gene


def test_guard_and_status(spark):
    rows = [(1, 1, "MAAAA", 874, "M" * 880), (1, 2, "M" * 880, 615, "M" * 880), (2, 3, "M" * 880, 3, "M" * 880)]
    df = spark.createDataFrame(rows, "experiment_id long, variant_id long, protein_aa string, n int, wt_protein string")
    item = F.struct(*[F.lit("NONSYNONYMOUS").alias("mutation_type")], *[F.lit(1).alias(c) for c in ("codon_index_1based", "aa_position_1based")],
                    *[F.lit("A").alias(c) for c in ("wt_codon", "var_codon", "wt_aa", "var_aa", "notes")])
    df = df.withColumn("mutations", F.array_repeat(item, F.col("n"))).withColumn("mutation_counts", U.counts_of(F.col("mutations")))
    df = df.withColumns({"qc_notes": F.lit(None).cast("string"), "cds_dna": F.lit("ATG"), "has_frameshift": F.lit(False), "has_premature_stop": F.lit(False)})
    out = U.guard_profiles(df)
    by = {r["variant_id"]: r for r in out.collect()}
    assert by[1]["protein_aa"] is None and by[1]["mutations"] == [] and by[2]["protein_aa"] is None
    assert "outlier_threshold=176" in by[2]["qc_notes"]
    assert by[3]["mutation_counts"]["total"] == 3
    assert {r["experiment_id"]: r["status"] for r in U.run_status(out).collect()} == {1: "ANALYSED_WITH_ERRORS", 2: "ANALYSED"}


def test_run_processes_pending_variants_and_remaps(spark):
    rng = random.Random(9)
    gene = random_gene(rng, 60)
    protein = "".join(D.CODE[gene[i:i + 3]] for i in range(0, len(gene), 3))
    back = "".join(rng.choice("ACGT") for _ in range(60))
    changed = gene[:30] + ("GCT" if gene[30:33] != "GCT" else "GAT") + gene[33:]
    variants = spark.createDataFrame(
        [(1, 1, back + changed + "TAA", None), (1, 2, back + gene + "TAA", "done"), (1, 3, "ACGT" * 5, None)],
        "experiment_id long, variant_id long, assembled_dna_sequence string, protein_sequence string")
    mapping = spark.createDataFrame(
        [(1, "PLUS", 0, 60, 60 + len(gene), gene, protein)],
        "experiment_id long, strand string, frame int, cds_start int, cds_end int, wt_cds string, wt_protein string")
    got = {r["variant_id"]: r for r in P.analyse_sequences(variants, mapping).collect()}
    assert set(got) == {1, 3}
    assert got[1]["mutation_counts"]["total"] == 1 and got[1]["mutations"][0]["aa_position_1based"] == 11
    assert P.analyse_sequences(variants, mapping, force=True).count() == 3


def test_stored_run_leaves_nothing_to_do(spark):
    from evospark.schemas import struct_of

    rng = random.Random(9)
    gene = random_gene(rng, 60)
    protein = "".join(D.CODE[gene[i:i + 3]] for i in range(0, len(gene), 3))
    back = "".join(rng.choice("ACGT") for _ in range(60))
    changed = gene[:30] + ("GCT" if gene[30:33] != "GCT" else "GAT") + gene[33:]
    rows = [(1, 1, 5, back + changed + "TAA", None), (1, 2, 5, back + gene + "TAA", "done"), (1, 3, 5, "ACGT" * 5, None)]
    variants = spark.createDataFrame(rows, "experiment_id long, variant_id long, generation_id long, assembled_dna_sequence string, protein_sequence string")
    mapping = spark.createDataFrame(
        [(1, "PLUS", 0, 60, 60 + len(gene), gene, protein)],
        "experiment_id long, strand string, frame int, cds_start int, cds_end int, wt_cds string, wt_protein string")
    empty = {t: spark.createDataFrame([], struct_of(t)) for t in ("mutations", "metrics", "variant_sequence_analysis")}
    stale = spark.createDataFrame([(1, 1, "protein", 3, "A", "C", False, None), (2, 2, "protein", 4, "A", "C", False, None)], struct_of("mutations"))
    experiments = spark.createDataFrame([(1, "NEW"), (2, "NEW")], "experiment_id long, status string")
    definitions = spark.createDataFrame([(9, "mutation_total_count", "derived", "count")], struct_of("metric_definitions"))
    out = P.store_sequence_run(
        P.analyse_sequences(variants, mapping), variants, stale, empty["metrics"], empty["variant_sequence_analysis"], experiments, definitions)
    proteins = {r["variant_id"]: r["protein_sequence"] for r in out["variants"].collect()}
    assert proteins[1] != protein and len(proteins[1]) == len(protein) and proteins[2] == "done"
    assert sorted((r["variant_id"], r["position"]) for r in out["mutations"].collect()) == [(1, 11), (2, 4)]
    totals = {r["variant_id"]: (r["value"], r["generation_id"], r["metric_definition_id"])
              for r in out["metrics"].where("metric_name = 'mutation_total_count'").collect()}
    assert totals[1] == (1.0, 5, 9)
    assert {r["experiment_id"]: r["status"] for r in out["experiments"].collect()}[2] == "NEW"
    again = P.analyse_sequences(out["variants"], mapping, analyses=out["analyses"])
    assert again.isEmpty()


def test_fasta_rules(spark):
    texts = [">plasmid\nACGTRYSWKMBDHVN\n", ">p\nAUGCAU", ">p\nACGTZ", "", "ACGT", ">a\nAC\n>b\nGT", ">only\n", ">x\n ac\tgt\nAC gt\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    got = {r["i"]: (r["seq"], r["error"]) for r in parse_fasta(df).collect()}
    assert got[0] == ("ACGTRYSWKMBDHVN", None) and got[1] == ("ATGCAT", None) and got[7] == ("ACGTACGT", None)
    assert got[2][1] == "invalid_characters:Z"
    assert [got[i][1] for i in (3, 4, 5, 6)] == ["empty_file", "no_header", "several_records", "empty_sequence"]


def test_protein_entries(spark, tmp_path):
    import json
    (tmp_path / "e.json").write_text(json.dumps({
        "primaryAccession": "P1", "sequence": {"value": " mkt "}, "organism": {"scientificName": "E. coli"},
        "proteinDescription": {"submittedName": [{"fullName": {"value": "Pol"}}]},
        "features": [
            {"type": "Chain", "description": "c", "location": {"start": {"value": 1}, "end": {"value": 142}}, "evidences": [{"evidenceCode": "ECO:0000269"}]},
            {"type": "Active site", "location": {"start": {"value": "?"}, "end": {"value": 7}}},
            {"description": "no type"}]}))
    entries = read_protein_entries(spark, str(tmp_path))
    p = protein_table(entries).first()
    assert (p["sequence"], p["protein_name"], p["length"]) == ("MKT", "Pol", 3)
    rows = feature_table(entries).orderBy("feature_no").collect()
    assert [(r["feature_type"], r["start_position"], r["end_position"], r["evidence"]) for r in rows] == [
        ("Chain", 1, 142, "ECO:0000269"), ("Active site", None, 7, None)]
    assert storable_features(feature_table(entries)).count() == 1


def test_long_and_odd_texts_are_translated_without_codon_lambdas(spark):
    known = D.CODE | D._ambiguous_code()
    rng = random.Random(5)
    texts = [None, "", "AT", "ATGU", "AUGNNN", "ATGZ", "ATGéAA", "ATGCTN" * 400_000]
    texts += ["".join(rng.choice(D.IUPAC_DNA + "U") for _ in range(rng.randrange(60))) for _ in range(300)]

    def plain(text):
        if text is None or set(text) - set(D.IUPAC_DNA + "U"):
            return None
        text = text.replace("U", "T")
        return "".join(known.get(text[i:i + 3], "X") for i in range(0, len(text) // 3 * 3, 3))

    df = spark.createDataFrame(list(enumerate(texts)), "i int, d string").coalesce(1).select("i", D.translate(F.col("d")).alias("p"))
    assert {r["i"]: r["p"] for r in df.collect()} == {i: plain(t) for i, t in enumerate(texts)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan


def best_diagonal(protein, frame):
    size = min(Q.SEED, len(protein))
    votes = {}
    for a in range(len(frame) - size + 1):
        for b in range(len(protein) - size + 1):
            if a >= b and frame[a:a + size] == protein[b:b + size]:
                votes[a - b] = votes.get(a - b, 0) + 1
    if not votes:
        return None
    at = min(votes, key=lambda d: (-votes[d], d))
    return {"diag": at, "same": sum(x == y for x, y in zip(frame[at:], protein))}


def test_diagonals_equal_counted_votes(monkeypatch):
    rng = random.Random(9)
    rows = [("".join(rng.choice("MKTÄ\U0001d49c"[:k]) for _ in range(rng.randint(1, 12))), "".join(rng.choice("MKT*Ä"[:k]) for _ in range(rng.randint(0, 40))))
            for _ in range(300) for k in [rng.randint(1, 5)]]
    proteins, frames = (pa.array(c) for c in zip(*rows))
    expected = [best_diagonal(p, f) for p, f in rows]
    assert Q._diagonals(proteins, frames).to_pylist() == expected
    monkeypatch.setattr(Q, "PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(Q, "RESIDUES_AT_ONCE", 100)
    assert Q._diagonals(proteins, frames).to_pylist() == expected


def test_wild_type_location_does_not_shuffle_seeds(spark):
    rows = [(1, "MKTAYIAKQR", "GG" + "ATGAAAACTGCTTATATTGCTAAACAACGT" + "TAACC"), (2, "MKTAYIAKQR", "CCCCCCCCCCCC"), (None, "MKT", "ATGAAAACT")]
    found = Q.locate_wild_type(spark.createDataFrame(rows, "k int, wt_protein string, wt_plasmid string"), ["k"])
    assert [(r["k"], r["strand"], r["cds_start"], r["match_identity_pct"]) for r in found.collect()] == [(1, "PLUS", 2, 100.0)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
