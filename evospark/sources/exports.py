"""Report tables as files: results, mutation reports, FASTA, lineage subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evospark.operators.metrics import DNA_NAMES, PROTEIN_NAMES

MUTATION_FIELDS = [
    "mutation_type", "codon_index_1based", "aa_position_1based", "wt_codon", "var_codon", "wt_aa", "var_aa", "notes",
]


def results_table(variants: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per variant with its yields and its activity score."""
    def named(*names: str) -> Column:
        return F.max(F.when(F.col("metric_name").isin(list(names)), F.col("value")))

    pivot = metrics.where(
        F.col("variant_id").isNotNull() & F.col("metric_name").isin([*DNA_NAMES, *PROTEIN_NAMES, "activity_score"])
    ).groupBy("variant_id").agg(
        named(*DNA_NAMES).alias("dna_yield"),
        named(*PROTEIN_NAMES).alias("protein_yield"),
        named("activity_score").alias("activity_score"),
    )
    wanted = ["experiment_id", "generation_number", "variant_id", "parent_variant_id", "plasmid_variant_index",
              "assembled_dna_sequence", "protein_sequence"]
    kept = [c for c in wanted if c in variants.columns]
    return variants.select(*kept).join(pivot, "variant_id", "left").select(
        *kept, "dna_yield", "protein_yield", "activity_score")


def mutation_report(variants: DataFrame, analysis: DataFrame) -> DataFrame:
    """One row per called mutation of every analysed variant; a variant without
    mutations keeps one row with empty mutation fields."""
    info = variants.select("experiment_id", "generation_number", "variant_id", "plasmid_variant_index", "parent_variant_id")
    return (
        analysis.select(
            "variant_id", F.coalesce("updated_at", "created_at").alias("analysed_at"),
            F.explode_outer("analysis.mutations").alias("_m"),
        )
        .join(info, "variant_id")
        .select("experiment_id", "generation_number", "variant_id", "plasmid_variant_index", "parent_variant_id",
                "analysed_at", *[F.col(f"_m.{f}").alias(f) for f in MUTATION_FIELDS])
    )


def variant_mutations(analysis: DataFrame, variant_id: int) -> DataFrame:
    """Mutation rows of one variant."""
    return analysis.where(F.col("variant_id") == variant_id).select(
        F.explode("analysis.mutations").alias("_m")).select("_m.*")


def fasta_text(header: Column, sequence: Column, width: int = 70) -> Column:
    """FASTA record with lines of ``width`` characters."""
    lines = F.regexp_replace(sequence, f"(.{{1,{width}}})", "$1\n")
    return F.concat(F.lit(">"), header, F.lit("\n"), lines)


def variant_fasta(variants: DataFrame, kind: str = "dna") -> DataFrame:
    """FASTA record of every variant that has the sequence."""
    if kind not in {"dna", "protein"}:
        raise ValueError("kind must be dna or protein")
    seq = F.trim("assembled_dna_sequence" if kind == "dna" else "protein_sequence")
    header = F.concat(F.lit("variant_"), F.col("variant_id").cast("string"), F.lit(f"_{kind}"))
    return variants.where(F.coalesce(seq, F.lit("")) != "").select("variant_id", fasta_text(header, seq).alias("fasta"))


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV folder with a header in every part file, globally ordered if asked."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True)


def write_fasta(records: DataFrame, path: str) -> None:
    """Text folder of FASTA records (each record already ends its last line)."""
    records.select(F.rtrim(F.col("fasta"), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def export_results(variants: DataFrame, metrics: DataFrame, path: str) -> None:
    write_csv(results_table(variants, metrics), path, ["experiment_id", "generation_number", "variant_id"])


def export_mutation_report(variants: DataFrame, analysis: DataFrame, path: str) -> None:
    write_csv(mutation_report(variants, analysis), path, ["experiment_id", "generation_number", "variant_id"])


def export_scoring(scored: DataFrame, top10: DataFrame, path: str) -> None:
    """Scoring table with reason codes, and the top-10 table."""
    write_csv(scored, f"{path}/scoring")
    write_csv(top10, f"{path}/top10", ["experiment_id", "rank"])


def export_subtree(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    write_csv(nodes, f"{path}/nodes")
    write_csv(edges, f"{path}/edges")
