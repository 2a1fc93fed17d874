"""Quality rules for uploaded records."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evospark.functions.coerce import FLOAT_LITERAL, INT_TEXT, float_or_null, not_nan, record_int, stripped
from evospark.functions.quantiles import wide_percentiles
from evospark.session import spread
from evospark.sources.uploads import REQUIRED_FIELDS


@dataclass(frozen=True)
class QualityOptions:
    """Limits of the record rules (fixed values unless a campaign changes them).

    Explicit percentiles always apply; ``min_samples`` 0 computes them for any
    number of values, a larger number keeps the static limits below it.
    """

    percentile_mode: bool = True
    percentile_low: float = 1.0
    percentile_high: float = 99.0
    min_samples: int = 0
    dna_low: float = 50.0
    dna_high: float = 2000.0
    protein_low: float = 40.0
    protein_high: float = 1000.0
    dna_critical: tuple[float, float] = (300.0, 5000.0)
    protein_critical: tuple[float, float] = (20.0, 2000.0)
    sequence_min: int = 100
    sequence_max: int = 10000
    allowed: str = "ACGNT"
    frameshift_warning: bool = False

    def with_rules(self, **rules) -> "QualityOptions":
        """Copy with some rules replaced."""
        return replace(self, **rules)


def adaptive_thresholds(records: DataFrame, keys: list[str], options: QualityOptions = QualityOptions()) -> DataFrame:
    """Warning limits per file (or experiment) from the data's own percentiles."""
    low, high = options.percentile_low / 100.0, options.percentile_high / 100.0
    static = {"dna_low": options.dna_low, "dna_high": options.dna_high,
              "protein_low": options.protein_low, "protein_high": options.protein_high}
    values = records.select(
        *keys, float_or_null(F.col("dna_yield")).alias("_dna"), float_or_null(F.col("protein_yield")).alias("_prot"))
    limits = wide_percentiles(values, keys, {
        "_dna": {"dna_low": low, "dna_high": high}, "_prot": {"protein_low": low, "protein_high": high}})
    if options.min_samples <= 0:
        return limits
    sizes = values.groupBy(*keys).agg(
        F.count(not_nan(F.col("_dna"))).alias("_n_dna"), F.count(not_nan(F.col("_prot"))).alias("_n_protein"))
    limits = limits.join(sizes, keys)
    for name, value in static.items():
        enough = F.col(f"_n_{name.split('_')[0]}") >= options.min_samples
        limits = limits.withColumn(name, F.when(enough, F.col(name)).otherwise(F.lit(value)))
    return limits.drop("_n_dna", "_n_protein")


def _has(field: str) -> Column:
    return F.array_contains("present", field)


def _is_int(field: str) -> Column:
    text = F.col(field)
    number = F.array_contains("number_fields", field) & text.rlike(FLOAT_LITERAL)
    return F.coalesce(stripped(text).rlike(INT_TEXT) | number, F.lit(False))


def check_records(
    records: DataFrame, keys: list[str] | None = None, options: QualityOptions = QualityOptions(),
    thresholds: DataFrame | None = None,
) -> DataFrame:
    """Add ``errors`` and ``warnings`` (arrays of rule codes) to every record.

    In percentile mode the warning limits come from the records themselves, per
    ``keys`` (the file by default).
    """
    keys = keys or ["file_path"]
    opt = options
    records = spread(records)
    df = records
    if opt.percentile_mode:
        limits = thresholds if thresholds is not None else adaptive_thresholds(records, keys, opt)
        df = df.join(limits, keys, "left")
    else:
        df = df.withColumns({n: F.lit(None).cast("double") for n in ("dna_low", "dna_high", "protein_low", "protein_high")})
    df = (
        df.withColumn("_dna", float_or_null(F.col("dna_yield")))
        .withColumn("_prot", float_or_null(F.col("protein_yield")))
        .withColumn("_odd", F.regexp_replace("assembled_dna_sequence", f"[{opt.allowed}]+", ""))
    )
    absent = F.filter(
        F.array(*[F.when(~_has(f) | F.col(f).isNull() | (F.col(f) == ""), F.lit(f)) for f in REQUIRED_FIELDS]),
        lambda x: x.isNotNull(),
    )
    parent_given = _has("parent_variant_index") & F.col("parent_variant_index").isNotNull() & ~F.col(
        "parent_variant_index"
    ).isin("", "NULL")
    seq = F.col("assembled_dna_sequence")
    empty_seq = _has("assembled_dna_sequence") & (F.coalesce(seq, F.lit("")) == "")
    odd = F.array_sort(F.array_distinct(F.split("_odd", "")))
    dna, prot = not_nan(F.col("_dna")), not_nan(F.col("_prot"))

    def code(condition: Column, text: str | Column) -> Column:
        return F.when(condition, F.lit(text) if isinstance(text, str) else text)

    errors = [
        code(F.size(absent) > 0, F.concat(F.lit("missing_fields:"), F.array_join(absent, ","))),
        code(_has("variant_index") & ~_is_int("variant_index"), "not_integer:variant_index"),
        code(_has("generation") & ~_is_int("generation"), "not_integer:generation"),
        code(parent_given & ~_is_int("parent_variant_index"), "not_integer:parent_variant_index"),
        code(_has("dna_yield") & F.col("_dna").isNull(), "not_numeric:dna_yield"),
        code(_has("protein_yield") & F.col("_prot").isNull(), "not_numeric:protein_yield"),
        code(dna < opt.dna_critical[0], "critical_low:dna_yield"),
        code(dna > opt.dna_critical[1], "critical_high:dna_yield"),
        code(prot < opt.protein_critical[0], "critical_low:protein_yield"),
        code(prot > opt.protein_critical[1], "critical_high:protein_yield"),
        code(empty_seq, "empty_sequence"),
        code(F.col("_odd") != "", F.concat(F.lit("invalid_characters:"), F.array_join(odd, ""))),
    ]
    limit = lambda name, static: F.coalesce(F.col(name), F.lit(static))
    has_seq = F.coalesce(seq, F.lit("")) != ""
    warnings = [
        code(dna < limit("dna_low", opt.dna_low), "low:dna_yield"),
        code(dna > limit("dna_high", opt.dna_high), "high:dna_yield"),
        code(prot < limit("protein_low", opt.protein_low), "low:protein_yield"),
        code(prot > limit("protein_high", opt.protein_high), "high:protein_yield"),
        code(has_seq & (F.length(seq) < opt.sequence_min), "short_sequence"),
        code(has_seq & (F.length(seq) > opt.sequence_max), "long_sequence"),
    ]
    if opt.frameshift_warning:
        warnings.append(code(has_seq & (F.length(seq) % 3 != 0), "frameshift"))
    return (
        df.withColumn("errors", F.array_compact(F.array(*errors)))
        .withColumn("warnings", F.array_compact(F.array(*warnings)))
        .drop("_dna", "_prot", "_odd", "dna_low", "dna_high", "protein_low", "protein_high")
    )


def duplicate_indices(records: DataFrame, scope: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Every record whose variant index occurs more than once in its scope
    (add ``generation`` to the scope for the storage key)."""
    keys = [*scope, "variant_index"]
    given = records.where(F.col("variant_index").isNotNull())
    twice = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
    return given.join(twice, keys).select(*keys, "_row_number", "occurrences")


def generation_gaps(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ranges of generation numbers missing between the smallest and largest."""
    keys = keys or ["file_path"]
    gens = records.select(*keys, record_int("generation").alias("_g")).where("_g is not null").distinct()
    step = Window.partitionBy(*keys).orderBy("_g")
    return (
        gens.withColumn("_next", F.lead("_g").over(step))
        .where("_next > _g + 1")
        .select(*keys, (F.col("_g") + 1).alias("missing_from"), (F.col("_next") - 1).alias("missing_to"))
    )


def without_generation_zero(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Files that have generations but no generation 0."""
    keys = keys or ["file_path"]
    return (
        records.select(*keys, record_int("generation").alias("_g"))
        .groupBy(*keys)
        .agg(F.count("_g").alias("_n"), F.count_if(F.col("_g") == 0).alias("_zero"))
        .where("_n > 0 and _zero = 0")
        .select(*keys)
    )


def orphan_parents(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Records outside generation 0 whose parent index is not in the file."""
    keys = keys or ["file_path"]
    ids = records.select(*keys, record_int("variant_index").alias("_parent")).where("_parent is not null").distinct()
    wanted = records.select(
        *keys, "_row_number", "parent_variant_index",
        record_int("parent_variant_index").alias("_parent"), record_int("generation").alias("_g"),
    ).where("_parent is not null and (_g is null or _g <> 0)")
    return wanted.join(ids, [*keys, "_parent"], "left_anti").select(*keys, "_row_number", "parent_variant_index")


def cross_record_findings(records: DataFrame) -> DataFrame:
    """Cross-record errors and warnings per file as (level, rule, findings)."""
    keys = ["file_path"]

    def counted(df: DataFrame, level: str, rule: str, n: Column = F.count(F.lit(1))) -> DataFrame:
        return df.groupBy(*keys).agg(n.cast("bigint").alias("findings")).select(
            *keys, F.lit(level).alias("level"), F.lit(rule).alias("rule"), "findings")

    dups = duplicate_indices(records).select("file_path", "variant_index").distinct()
    gaps = generation_gaps(records)
    return (
        counted(dups, "error", "duplicate_index")
        .unionByName(counted(without_generation_zero(records), "warning", "no_generation_zero"))
        .unionByName(counted(gaps, "warning", "missing_generations", F.sum(F.col("missing_to") - F.col("missing_from") + 1)))
        .unionByName(counted(orphan_parents(records), "warning", "orphan_parent"))
    )


def upload_gate(checked: DataFrame, findings: DataFrame, fatal: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Split the records into accepted and rejected: one error anywhere in a
    file rejects the whole file, warnings pass."""
    bad = checked.where(F.size("errors") > 0).select("file_path").distinct()
    bad = bad.unionByName(findings.where("level = 'error'").select("file_path"))
    if fatal is not None:
        bad = bad.unionByName(fatal.select("file_path"))
    bad = bad.distinct()
    return checked.join(bad, "file_path", "left_anti"), checked.join(bad, "file_path", "left_semi")


def upload_summary(checked: DataFrame, findings: DataFrame) -> DataFrame:
    """Per file: records, detected fields, number of errors and warnings."""
    fields = (
        checked.select("file_path", F.explode(F.concat("present", F.map_keys("metadata"))).alias("_f"))
        .distinct()
        .groupBy("file_path")
        .agg(F.array_join(F.array_sort(F.collect_list("_f")), ",").alias("detected_fields"))
    )
    base = checked.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.sum(F.size("errors")).alias("_e"), F.sum(F.size("warnings")).alias("_w"),
    )
    cross = findings.groupBy("file_path").agg(
        F.count_if(F.col("level") == "error").alias("_ce"), F.count_if(F.col("level") == "warning").alias("_cw"))
    return (
        base.join(fields, "file_path", "left").join(cross, "file_path", "left").fillna(0, ["_ce", "_cw"])
        .select("file_path", "total_records", "detected_fields",
                (F.col("_e") + F.col("_ce")).alias("error_count"), (F.col("_w") + F.col("_cw")).alias("warning_count"))
    )


def message_histogram(checked: DataFrame, column: str = "warnings", examples: int = 5) -> DataFrame:
    """How often each rule fired, with the first few row numbers as examples."""
    hits = checked.select("file_path", "_row_number", F.explode(column).alias("_c")).withColumn(
        "rule", F.split_part("_c", F.lit(":"), F.lit(1)))
    hits = hits.withColumn("field", F.when(F.col("_c").contains(":"), F.split_part("_c", F.lit(":"), F.lit(2))))
    counts = hits.groupBy("rule", "field").agg(F.count(F.lit(1)).alias("occurrences"))
    from evospark.functions.ordering import top_k

    first = top_k(hits.select("rule", "field", "file_path", "_row_number"), ["rule", "field"],
                  [F.col("file_path").asc(), F.col("_row_number").asc()], examples)
    shown = first.groupBy("rule", "field").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_row_number"))),
                                 lambda s: s["_row_number"].cast("string")), ",").alias("example_rows"))
    same = counts["rule"].eqNullSafe(shown["rule"]) & counts["field"].eqNullSafe(shown["field"])
    return counts.join(shown, same, "left").select(counts["rule"], counts["field"], "occurrences", "example_rows")
