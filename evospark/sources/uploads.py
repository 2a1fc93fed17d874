"""Uploaded variant tables: TSV, CSV and JSON files to one record table.

A record row has the columns of ``RECORD_COLUMNS``: the seven known fields as
text, which of them the record contained, which were JSON numbers, all other
fields as a map, the row number and the file.
"""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evospark.functions.coerce import stripped
from evospark.session import spread

# Known fields and the header names each of them accepts.
REQUIRED_FIELDS = ["variant_index", "generation", "assembled_dna_sequence", "dna_yield", "protein_yield"]
OPTIONAL_FIELDS = ["parent_variant_index", "control"]
KNOWN_FIELDS = REQUIRED_FIELDS + OPTIONAL_FIELDS
FIELD_ALIASES = {
    "variant_index": ["Plasmid_Variant_Index", "variant_index", "variant_id", "id"],
    "parent_variant_index": ["Parent_Plasmid_Variant", "parent_variant_index", "parent_id"],
    "generation": ["Directed_Evolution_Generation", "generation", "gen", "round"],
    "assembled_dna_sequence": ["Assembled_DNA_Sequence", "sequence", "dna_sequence", "plasmid_sequence"],
    "dna_yield": ["DNA_Quantification_fg", "dna_yield", "dna_concentration"],
    "protein_yield": ["Protein_Quantification_pg", "protein_yield", "protein_concentration"],
    "control": ["Control", "control", "is_control"],
}

RECORD_COLUMNS = ["file_path", "_row_number", *KNOWN_FIELDS, "present", "number_fields", "metadata"]


def standard_name(name: Column) -> Column:
    """Standard field name of a header; unknown headers keep their name."""
    out = None
    for field, aliases in FIELD_ALIASES.items():
        hit = name.isin([field, *aliases])
        out = F.when(hit, field) if out is None else out.when(hit, field)
    return out.otherwise(name)


def delimiter_of(header: Column) -> Column:
    """Tab when the header has more tabs than commas, else comma."""
    tabs = F.length(header) - F.length(F.replace(header, F.lit("\t"), F.lit("")))
    commas = F.length(header) - F.length(F.replace(header, F.lit(","), F.lit("")))
    return F.when(tabs > commas, "\t").otherwise(",")


def split_cells(line: Column, delimiter: Column) -> Column:
    """Cells of a delimited line; quoted cells may hold delimiters and doubled
    quotes. Lines without a quote take the cheap path."""
    def quoted(sep: str) -> Column:
        cells = F.regexp_extract_all(
            F.concat(F.lit(sep), line), F.lit(f'{sep}("(?:[^"]|"")*"|[^{sep}]*)'), F.lit(1)
        )
        return F.transform(
            cells,
            lambda c: F.when(
                c.startswith('"') & c.endswith('"') & (F.length(c) >= 2),
                F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')),
            ).otherwise(c),
        )

    plain_tab, plain_comma = F.split(line, "\t", -1), F.split(line, ",", -1)
    tab = delimiter == "\t"
    return (
        F.when(~line.contains('"'), F.when(tab, plain_tab).otherwise(plain_comma))
        .when(tab, quoted("\t"))
        .otherwise(quoted(","))
    )


def _clean(name: Column, value: Column) -> Column:
    """Fields named after a sequence become upper case without spaces."""
    return F.when(
        F.lower(name).contains("sequence"), F.replace(F.upper(value), F.lit(" "), F.lit(""))
    ).otherwise(value)


def _header_layout(headers: DataFrame) -> DataFrame:
    """Where each file keeps its fields: computed once per file, not per row.

    If two headers name one field, the last one wins.
    """
    layout = headers.withColumn("_sep", delimiter_of(F.col("_header"))).withColumn(
        "_names", F.transform(split_cells(F.col("_header"), F.col("_sep")), lambda h: standard_name(stripped(h)))
    )
    last = F.size("_names") - F.array_position(F.reverse("_names"), F.col("_name"))
    columns = (
        layout.select("file_path", "_sep", F.posexplode("_names").alias("_at", "_name"), "_names")
        .where(F.col("_at") == last)
        .drop("_names")
    )
    known = F.col("_name").isin(KNOWN_FIELDS)
    return columns.groupBy("file_path", "_sep").agg(
        *[F.max(F.when(F.col("_name") == f, F.col("_at"))).alias(f"_at_{f}") for f in KNOWN_FIELDS],
        F.array_sort(F.collect_list(F.when(~known, F.struct(F.col("_at").alias("at"), F.col("_name").alias("name"))))).alias("_rest"),
        F.array_sort(F.collect_list(F.when(known, F.col("_name")))).alias("present"),
    )


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files with their 1-based number among the non-blank lines.

    A file may be split over many tasks: lines are numbered inside their split
    and the counts of the earlier splits of the file are added.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
        F.col("value").alias("line"),
    ).where("line <> ''")
    before = Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        raw.groupBy("file_path", "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy("file_path", "_block").orderBy("_seq")
    return (
        raw.withColumn("_pos", F.row_number().over(inside))
        .join(offsets, ["file_path", "_block"])
        .select("file_path", (F.col("_pos") + F.col("_before")).cast("bigint").alias("line_number"), "line")
    )


def read_delimited(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of TSV/CSV files. Rows whose cells are all empty are skipped but
    keep their number; the first data row is number 2."""
    lines = numbered_lines(spark, path)
    layout = _header_layout(
        lines.where("line_number = 1").select("file_path", F.col("line").alias("_header"))
    )
    data = (
        lines.where("line_number > 1")
        .join(layout, "file_path")
        .withColumn("_cells", split_cells(F.col("line"), F.col("_sep")))
        .where(F.exists("_cells", lambda c: c != ""))
    )

    def cell(field: str) -> Column:
        value = stripped(F.get("_cells", F.col(f"_at_{field}")))
        return _clean(F.lit(field), value).alias(field)

    return data.select(
        "file_path",
        F.col("line_number").alias("_row_number"),
        *[cell(f) for f in KNOWN_FIELDS],
        "present",
        F.array().cast("array<string>").alias("number_fields"),
        F.map_from_entries(
            F.transform(
                "_rest",
                lambda r: F.struct(r["name"], _clean(r["name"], stripped(F.get("_cells", r["at"])))),
            )
        ).alias("metadata"),
    )


def _json_body(text: Column) -> Column:
    """The JSON array of records inside one of the accepted envelopes."""
    records = F.get_json_object(text, "$.records")
    variants = F.get_json_object(text, "$.variants")
    is_list = F.ltrim(text).startswith("[")
    return F.when(is_list, text).otherwise(
        F.coalesce(records, variants, F.concat(F.lit("["), text, F.lit("]")))
    )


def read_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of JSON files (array, ``records``, ``variants`` or one object).
    Row numbers start at 1."""
    return parse_json_texts(
        spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    )


def _json_items(text: Column) -> Column:
    """The records of a JSON document as variants; NULL where there is no array of them."""
    return F.from_json(_json_body(text), "array<variant>")


def _is_object(item: Column) -> Column:
    return F.coalesce(F.schema_of_variant(item).startswith("OBJECT"), F.lit(False))


def parse_json_texts(documents: DataFrame) -> DataFrame:
    """Records of JSON documents (columns ``file_path`` and ``value``).

    An empty object is a record without fields. Items that are no objects give
    no record; ``fatal_file_errors`` reports their file. All fields of a record
    are read in its own row. Of a key that a record repeats, the last value counts.
    """
    _last_key_wins(documents)
    texts = documents.select("file_path", stripped(F.col("value")).alias("_text"))
    records = texts.where(F.try_parse_json("_text").isNotNull()).select(
        "file_path", F.posexplode(_json_items(F.col("_text"))).alias("_i", "_rec")
    ).where(_is_object(F.col("_rec")))

    def entry(e: Column) -> Column:
        name = standard_name(e["key"])
        return F.struct(
            name.alias("name"),
            _clean(name, F.try_variant_get(e["value"], "$", "string")).alias("text"),
            F.schema_of_variant(e["value"]).rlike("BIGINT|DOUBLE|DECIMAL|FLOAT").alias("number"),
        )

    # One large file is one task up to here; its records are spread afterwards.
    fields = spread(records).select(
        "file_path", "_i", F.transform(F.map_entries(F.try_variant_get("_rec", "$", "map<string,variant>")), entry).alias("_fields"))
    known = lambda e: e["name"].isin(KNOWN_FIELDS)
    # If two names mean one field, the last one wins.
    last = lambda f: F.try_element_at(F.filter("_fields", lambda e: e["name"] == f), F.lit(-1))["text"].alias(f)
    rest = F.filter("_fields", lambda e: ~known(e))
    return fields.select(
        "file_path", (F.col("_i") + 1).cast("bigint").alias("_row_number"), *[last(f) for f in KNOWN_FIELDS],
        F.array_sort(F.array_distinct(F.transform(F.filter("_fields", known), lambda e: e["name"]))).alias("present"),
        F.array_distinct(F.transform(F.filter("_fields", lambda e: known(e) & e["number"]), lambda e: e["name"])).alias("number_fields"),
        F.map_from_entries(F.transform(rest, lambda e: F.struct(e["name"], e["text"]))).alias("metadata"),
    )


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """All uploads below a folder; the extension (any case) picks the format."""
    parts = []
    if _has_files(spark, folder, DELIMITED_GLOB):
        parts.append(read_delimited(spark, f"{folder}/{DELIMITED_GLOB}"))
    if _has_files(spark, folder, JSON_GLOB):
        parts.append(read_json(spark, f"{folder}/{JSON_GLOB}"))
    if not parts:
        raise FileNotFoundError(f"no .tsv, .csv or .json files in {folder}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


DELIMITED_GLOB = "*.{[tT][sS][vV],[cC][sS][vV]}"
JSON_GLOB = "*.[jJ][sS][oO][nN]"


def _has_files(spark: SparkSession, folder: str, glob: str) -> bool:
    try:
        spark.read.text(f"{folder}/{glob}")
    except AnalysisException:
        return False
    return True


def _last_key_wins(documents: DataFrame) -> None:
    """Repeated keys of a JSON object are no parse error in this session."""
    documents.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def json_errors(documents: DataFrame) -> DataFrame:
    """(file_path, error) of every JSON document; NULL where its records can be read."""
    _last_key_wins(documents)
    text = stripped(F.col("value"))
    return documents.select(
        "file_path",
        F.when(text == "", "empty_file")
        .when(F.try_parse_json("value").isNull(), "invalid_json")
        .when(F.exists(_json_items(text), lambda v: ~_is_object(v)), "record_is_no_object")
        .alias("error"),
    )


def fatal_file_errors(spark: SparkSession, folder: str, records: DataFrame) -> DataFrame:
    """Files of a folder that cannot be used at all, with the reason (see ``file_errors``)."""
    delimited, documents = f"{folder}/{DELIMITED_GLOB}", f"{folder}/{JSON_GLOB}"
    return file_errors(spark, [delimited] if _has_files(spark, folder, DELIMITED_GLOB) else [],
                       [documents] if _has_files(spark, folder, JSON_GLOB) else [], records)


def file_errors(spark: SparkSession, delimited: list[str], documents: list[str], records: DataFrame) -> DataFrame:
    """(file_path, error) of the files that cannot be used at all, from paths or globs of both formats.

    ``empty_file``, ``invalid_json``, ``record_is_no_object``, ``no_records`` or
    ``no_data_rows``.
    """
    counts = records.groupBy("file_path").agg(F.count(F.lit(1)).alias("_records"))
    found = []
    if documents:
        read = json_errors(spark.read.text(documents, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value"))
        found.append(_file_names(spark, documents).join(read.withColumn("_seen", F.lit(True)), "file_path", "left")
                     .join(counts, "file_path", "left").select("file_path", F.when(F.col("_seen").isNull(), "empty_file").otherwise(
                         F.coalesce("error", F.when(F.col("_records").isNull(), "no_records"))).alias("error")))
    if delimited:
        first = numbered_lines(spark, delimited).where("line_number = 1").select("file_path", (stripped(F.col("line")) == "").alias("_blank"))
        found.append(_file_names(spark, delimited).join(first, "file_path", "left").join(counts, "file_path", "left").select(
            "file_path", F.when(F.coalesce("_blank", F.lit(True)), "empty_file").when(F.col("_records").isNull(), "no_data_rows").alias("error")))
    if not found:
        return spark.createDataFrame([], "file_path string, error string")
    return functools.reduce(DataFrame.unionByName, found).where("error is not null")


def _file_names(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file; contents are not read. Spark's scans leave out empty files, so those are listed."""
    named = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file_path"))
    empty = [n for p in paths for n in empty_files(spark, p)]
    return named.unionByName(spark.createDataFrame([(n,) for n in empty], "file_path string"))


def empty_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the empty files that a path or glob matches."""
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    found = new_path(path).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(new_path(path)) or []
    # A path made from its own text has the slashes that file names have in Spark's metadata.
    return [new_path(s.getPath().toString()).toUri().toString() for s in found if s.isFile() and s.getLen() == 0]
