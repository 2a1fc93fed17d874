"""Reference inputs: FASTA plasmids and downloaded protein entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evospark.functions.dna import IUPAC_DNA


def parse_fasta(rows: DataFrame, text: str = "value") -> DataFrame:
    """Sequence of a single-record FASTA text, or the reason it is refused.

    Adds ``seq`` (upper case, U read as T), ``bad_characters`` and ``error``.
    """
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    df = rows.withColumn("_t", trimmed)
    headers = F.regexp_count(F.col("_t"), F.lit(r"(?m)^[ \t]*>"))
    body = F.regexp_replace("_t", r"(?m)^[ \t]*>.*$", "")
    df = df.withColumn("_headers", headers).withColumn(
        "seq", F.translate(F.upper(F.regexp_replace(body, r"\s+", "")), "U", "T")
    )
    odd = F.regexp_replace("seq", f"[{IUPAC_DNA}]+", "")
    df = df.withColumn("bad_characters", F.array_join(F.array_sort(F.array_distinct(F.split(odd, ""))), ""))
    error = (
        F.when(F.col("_t") == "", "empty_file")
        .when(~F.col("_t").startswith(">"), "no_header")
        .when(F.col("_headers") > 1, "several_records")
        .when(F.col("seq") == "", "empty_sequence")
        .when(F.col("bad_characters") != "", F.concat(F.lit("invalid_characters:"), "bad_characters"))
    )
    return (
        df.withColumn("error", error)
        .withColumn("seq", F.when(F.col("error").isNull(), F.col("seq")))
        .drop("_t", "_headers")
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """All FASTA files below a path, one row per file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    return parse_fasta(files).drop("value")


ENTRY_SCHEMA = (
    "primaryAccession string, sequence struct<value:string>, organism struct<scientificName:string>, "
    "genes array<struct<geneName:struct<value:string>>>, "
    "proteinDescription struct<recommendedName:struct<fullName:struct<value:string>>, "
    "submittedName:array<struct<fullName:struct<value:string>>>>, "
    "features array<struct<type:string, description:string, "
    "location:struct<start:struct<value:string>, `end`:struct<value:string>>, "
    "evidences:array<struct<evidenceCode:string, source:string>>>>"
)


def read_protein_entries(spark: SparkSession, path: str) -> DataFrame:
    """Downloaded protein entries (one JSON document per file or line group)."""
    return spark.read.schema(ENTRY_SCHEMA).json(path, multiLine=True)


def protein_table(entries: DataFrame) -> DataFrame:
    """Accession, name (recommended, else submitted), gene, organism, sequence."""
    return entries.select(
        F.col("primaryAccession").alias("accession"),
        F.upper(F.trim(F.coalesce("sequence.value", F.lit("")))).alias("sequence"),
        F.coalesce(
            F.nullif(F.col("proteinDescription.recommendedName.fullName.value"), F.lit("")),
            F.get("proteinDescription.submittedName", F.lit(0))["fullName"]["value"],
        ).alias("protein_name"),
        F.get("genes", F.lit(0))["geneName"]["value"].alias("gene_name"),
        F.col("organism.scientificName").alias("organism"),
    ).withColumn("length", F.length("sequence"))


def feature_table(entries: DataFrame) -> DataFrame:
    """Features of each entry; entries without a type are skipped, positions
    that are not plain digits are NULL."""
    def digits(value: Column) -> Column:
        return F.when(value.rlike("^[0-9]+$"), value.try_cast("int"))

    item = entries.select(F.col("primaryAccession").alias("accession"), F.posexplode("features").alias("_at", "f"))
    evidence = F.get("f.evidences", F.lit(0))
    return item.where(F.coalesce("f.type", F.lit("")) != "").select(
        "accession",
        (F.col("_at") + 1).alias("feature_no"),
        F.col("f.type").alias("feature_type"),
        F.col("f.description").alias("description"),
        digits(F.col("f.location.start.value")).alias("start_position"),
        digits(F.col("f.location.end.value")).alias("end_position"),
        F.nullif(F.coalesce(F.nullif(evidence["evidenceCode"], F.lit("")), evidence["source"]), F.lit("")).alias("evidence"),
    )


def storable_features(features: DataFrame) -> DataFrame:
    """Features with a valid interval; position-less ones are not stored."""
    return features.where("start_position > 0 and end_position >= start_position")
