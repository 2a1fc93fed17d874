"""Upload, quality and merge queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evospark.functions import coerce as C
from evospark.operators import metrics as M, qc
from evospark.plans.registry import register
from evospark.plans.reports import rounded
from evospark.plans.views import table, view
from evospark.schemas import struct_of
from evospark.session import cut_lineage, scratch_path
from evospark.sources import exports, references, snapshots, uploads


def records_of(spark, sf: str) -> DataFrame:
    """Upload records as the readers return them."""
    return view(spark, sf, "records").select(
        "file_path", F.col("row_number").alias("_row_number"), *uploads.KNOWN_FIELDS,
        F.array(*[F.lit(f) for f in uploads.KNOWN_FIELDS]).alias("present"),
        F.array().cast("array<string>").alias("number_fields"),
        F.create_map(F.lit("priority"), F.col("priority")).alias("metadata"),
    )


NUMS = """
nums as (select *, case when regexp_full_match(dna_yield, '[0-9.eE+-]+') then try_cast(dna_yield as double) end as dna,
                case when regexp_full_match(protein_yield, '[0-9.eE+-]+') then try_cast(protein_yield as double) end as prot from {records}),
limits as (select file_path, quantile_cont(dna, 0.01) as d0, quantile_cont(dna, 0.99) as d1, quantile_cont(prot, 0.01) as p0, quantile_cont(prot, 0.99) as p1 from nums group by 1)"""

CHECKED = NUMS + """,
checked as (
  select n.*, concat_ws(',',
    case when coalesce(variant_index, '') = '' or coalesce(generation, '') = '' or coalesce(assembled_dna_sequence, '') = '' or coalesce(dna_yield, '') = '' or coalesce(protein_yield, '') = ''
         then concat('missing_fields:', concat_ws(',', case when coalesce(variant_index, '') = '' then 'variant_index' end, case when coalesce(generation, '') = '' then 'generation' end,
              case when coalesce(assembled_dna_sequence, '') = '' then 'assembled_dna_sequence' end, case when coalesce(dna_yield, '') = '' then 'dna_yield' end,
              case when coalesce(protein_yield, '') = '' then 'protein_yield' end)) end,
    case when not regexp_full_match(variant_index, '[+-]?[0-9]+') then 'not_integer:variant_index' end,
    case when not regexp_full_match(generation, '[+-]?[0-9]+') then 'not_integer:generation' end,
    case when parent_variant_index not in ('', 'NULL') and not regexp_full_match(parent_variant_index, '[+-]?[0-9]+') then 'not_integer:parent_variant_index' end,
    case when dna is null then 'not_numeric:dna_yield' end, case when prot is null then 'not_numeric:protein_yield' end,
    case when dna < 300 then 'critical_low:dna_yield' end, case when dna > 5000 then 'critical_high:dna_yield' end,
    case when prot < 20 then 'critical_low:protein_yield' end, case when prot > 2000 then 'critical_high:protein_yield' end,
    case when assembled_dna_sequence = '' then 'empty_sequence' end,
    case when regexp_matches(assembled_dna_sequence, '[^ACGTN]') then concat('invalid_characters:',
         array_to_string(list_sort(list_distinct(list_filter(string_split(assembled_dna_sequence, ''), lambda c: not regexp_full_match(c, '[ACGTN]')))), '')) end) as errors,
    concat_ws(',', case when dna < d0 then 'low:dna_yield' end, case when dna > d1 then 'high:dna_yield' end, case when prot < p0 then 'low:protein_yield' end,
    case when prot > p1 then 'high:protein_yield' end, case when assembled_dna_sequence <> '' and length(assembled_dna_sequence) < 100 then 'short_sequence' end,
    case when length(assembled_dna_sequence) > 10000 then 'long_sequence' end) as warnings
  from nums n join limits l on l.file_path = n.file_path)"""


@register("adaptive_thresholds", "with " + NUMS + " select file_path, round(d0, 6) as dna_low, round(d1, 6) as dna_high, round(p0, 6) as protein_low, round(p1, 6) as protein_high from limits")
def adaptive_thresholds(spark, sf):
    df = qc.adaptive_thresholds(records_of(spark, sf), ["file_path"])
    return rounded(df, "dna_low", "dna_high", "protein_low", "protein_high")


@register("record_quality", "with " + CHECKED + " select file_path, row_number, errors, warnings from checked")
def record_quality(spark, sf):
    return qc.check_records(records_of(spark, sf)).select(
        "file_path", F.col("_row_number").alias("row_number"), F.array_join("errors", ",").alias("errors"),
        F.array_join("warnings", ",").alias("warnings"))


@register("duplicate_indices", """
select r.file_path, r.variant_index, r.row_number, d.occurrences from {records} r
join (select file_path, variant_index, count(*) as occurrences from {records} where variant_index is not null group by 1, 2 having count(*) > 1) d
  on d.file_path = r.file_path and d.variant_index = r.variant_index""")
def duplicate_indices(spark, sf):
    return qc.duplicate_indices(records_of(spark, sf)).withColumnRenamed("_row_number", "row_number")


@register("generation_gaps", """
with g as (select distinct file_path, try_cast(generation as bigint) as g from {records} where try_cast(generation as bigint) is not null),
n as (select file_path, g, lead(g) over (partition by file_path order by g) as nx from g)
select file_path, g + 1 as missing_from, nx - 1 as missing_to from n where nx > g + 1""")
def generation_gaps(spark, sf):
    return qc.generation_gaps(records_of(spark, sf))


@register("orphan_parents", """
select file_path, row_number, parent_variant_index from {records} r
where try_cast(parent_variant_index as bigint) is not null and coalesce(try_cast(generation as bigint), -1) <> 0
  and not exists (select 1 from {records} o where o.file_path = r.file_path and try_cast(o.variant_index as bigint) = try_cast(r.parent_variant_index as bigint))""")
def orphan_parents(spark, sf):
    return qc.orphan_parents(records_of(spark, sf)).withColumnRenamed("_row_number", "row_number")


@register("cross_record_findings", """
with g as (select distinct file_path, try_cast(generation as bigint) as g from {records} where try_cast(generation as bigint) is not null),
n as (select file_path, g, lead(g) over (partition by file_path order by g) as nx from g),
d as (select file_path, variant_index from {records} where variant_index is not null group by 1, 2 having count(*) > 1)
select file_path, 'error' as level, 'duplicate_index' as rule, count(*) as findings from d group by 1
union all select file_path, 'warning', 'no_generation_zero', 1 from g group by 1 having count(*) filter (where g = 0) = 0
union all select file_path, 'warning', 'missing_generations', cast(sum(nx - g - 1) as bigint) from n where nx > g + 1 group by 1
union all select file_path, 'warning', 'orphan_parent', count(*) from {records} r
  where try_cast(parent_variant_index as bigint) is not null and coalesce(try_cast(generation as bigint), -1) <> 0
  and not exists (select 1 from {records} o where o.file_path = r.file_path and try_cast(o.variant_index as bigint) = try_cast(r.parent_variant_index as bigint)) group by 1""")
def cross_record_findings(spark, sf):
    return qc.cross_record_findings(records_of(spark, sf))


@register("upload_gate", "with " + CHECKED + """,
bad as (select distinct file_path from checked where errors <> '' union select file_path from checked where variant_index is not null group by file_path, variant_index having count(*) > 1)
select c.file_path, case when b.file_path is null then 'accepted' else 'rejected' end as outcome, count(*) as records
from checked c left join bad b on b.file_path = c.file_path group by 1, 2""")
def upload_gate(spark, sf):
    records = records_of(spark, sf)
    accepted, rejected = qc.upload_gate(qc.check_records(records), qc.cross_record_findings(records))
    both = accepted.select("file_path", F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("file_path", F.lit("rejected").alias("outcome")))
    return both.groupBy("file_path", "outcome").agg(F.count(F.lit(1)).alias("records"))


@register("upload_summary")
def upload_summary(spark, sf):
    records = records_of(spark, sf)
    return qc.upload_summary(qc.check_records(records), qc.cross_record_findings(records))


@register("warning_histogram", "with " + CHECKED + """,
hits as (select file_path, row_number, unnest(string_split(warnings, ',')) as w from checked where warnings <> ''),
named as (select *, split_part(w, ':', 1) as rule, nullif(split_part(w, ':', 2), '') as field,
                 row_number() over (partition by w order by file_path, row_number) as rn from hits)
select rule, field, count(*) as occurrences, string_agg(cast(row_number as varchar(20)), ',' order by rn) filter (where rn <= 5) as example_rows from named group by 1, 2""")
def warning_histogram(spark, sf):
    return qc.message_histogram(qc.check_records(records_of(spark, sf)), "warnings")


@register("typed_cells", """
select row_number, case when variant_index not in ('', 'NULL', 'null', 'None') and regexp_full_match(variant_index, '[+-]?[0-9]+') then cast(variant_index as bigint) end as variant_index,
       case when generation not in ('', 'NULL', 'null', 'None') and regexp_full_match(generation, '[+-]?[0-9]+') then cast(generation as bigint) end as generation,
       case when regexp_full_match(dna_yield, '[0-9.eE+-]+') then try_cast(dna_yield as double) end as dna_yield,
       case lower(control) when 'true' then true when 'no' then false end as control,
       case when variant_index = '' then null else variant_index end as index_text,
       cast(to_json({{'priority': priority}}) as varchar) as additional_metadata
from {records}""")
def typed_cells(spark, sf):
    return records_of(spark, sf).select(
        F.col("_row_number").alias("row_number"),
        C.int_or_null(F.col("variant_index")).alias("variant_index"),
        C.int_or_null(F.col("generation")).alias("generation"),
        C.float_or_null(F.col("dna_yield")).alias("dna_yield"),
        C.bool_or_null(F.col("control")).alias("control"),
        C.canonical_index(F.col("variant_index")).alias("index_text"),
        F.when(F.size("metadata") > 0, F.to_json("metadata")).alias("additional_metadata"),
    )


@register("control_means", """
select cast(split_part(file_path, '-', 2) as bigint) as experiment_id, coalesce(try_cast(generation as bigint), 0) as generation_number, metric_name,
       round(case metric_name when 'dna_yield_raw' then avg(try_cast(dna_yield as double)) else avg(try_cast(protein_yield as double)) end, 6) as value,
       case metric_name when 'dna_yield_raw' then 'fg' else 'pg' end as unit
from {records} cross join (select unnest(['dna_yield_raw', 'protein_yield_raw']) as metric_name) where control = 'True' group by 1, 2, 3""")
def control_means(spark, sf):
    records = records_of(spark, sf).withColumn(
        "experiment_id", F.split_part("file_path", F.lit("-"), F.lit(2)).cast("bigint"))
    return rounded(M.control_means(records).select(
        "experiment_id", "generation_number", "metric_name", "value", "unit"), "value")


@register("delimited_scan", """
select coalesce(variant_index, '') as variant_index, coalesce(generation, '') as generation, coalesce(parent_variant_index, '') as parent_variant_index,
       coalesce(dna_yield, '') as dna_yield, coalesce(protein_yield, '') as protein_yield, assembled_dna_sequence, control, priority from {records}""")
def delimited_scan(spark, sf):
    """Write the records as tab-separated uploads, then scan the folder."""
    path = scratch_path(spark, "uploads")
    headers = {"variant_index": "Plasmid_Variant_Index", "generation": "gen", "parent_variant_index": "parent_id",
               "dna_yield": "DNA_Quantification_fg", "protein_yield": "protein_concentration",
               "assembled_dna_sequence": "dna_sequence", "control": "is_control", "priority": "priority"}
    view(spark, sf, "records").select(*[F.col(c).alias(h) for c, h in headers.items()]).write.csv(
        path, sep="\t", header=True, emptyValue="", nullValue="")
    rows = uploads.read_uploads(spark, path)
    return rows.select(*uploads.KNOWN_FIELDS, F.col("metadata")["priority"].alias("priority"))


@register("json_scan", """
select conv_id, turn, row_number() over (partition by conv_id order by turn) as row_number, cast(turn as varchar(20)) as variant_index,
       replace(upper(replace(text, 'ß', 'SS')), ' ', '') as assembled_dna_sequence, role from {conversations}""")
def json_scan(spark, sf):
    """Conversations as JSON uploads: one document each, a record per turn."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
    docs = turns.select(
        F.col("conv_id").cast("string").alias("file_path"),
        F.to_json(F.struct(F.transform(
            "_t", lambda t: F.struct(t["turn"].alias("id"), t["text"].alias("sequence"), t["role"].alias("role"))
        ).alias("records"))).alias("value"))
    return uploads.parse_json_texts(docs).select(
        F.col("file_path").cast("bigint").alias("conv_id"), F.col("variant_index").cast("bigint").alias("turn"),
        F.col("_row_number").alias("row_number"), "variant_index", "assembled_dna_sequence",
        F.col("metadata")["role"].alias("role"))


@register("fasta_scan", """
with t as (select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: not starts_with(ltrim(l, ' ' || chr(9)), '>')), '') as body,
                  len(list_filter(string_split(text, chr(10)), lambda l: starts_with(ltrim(l, ' ' || chr(9)), '>'))) as extra from {documents}),
s as (select doc_id, extra, replace(upper(regexp_replace(replace(body, 'ß', 'SS'), '\\s+', '', 'g')), 'U', 'T') as seq from t),
b as (select *, array_to_string(list_sort(list_distinct(string_split(regexp_replace(seq, '[ACGTNRYWSKMBDHV]', '', 'g'), ''))), '') as bad_characters from s)
select doc_id, bad_characters, case when extra > 0 then 'several_records' when seq = '' then 'empty_sequence'
       when bad_characters <> '' then concat('invalid_characters:', bad_characters) end as error from b""")
def fasta_scan(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit(">doc\n"), "text").alias("value"))
    return references.parse_fasta(docs).select("doc_id", "bad_characters", "error")


def _stored(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """Older half of the campaign: what earlier uploads stored."""
    old = view(spark, sf, "variants").where("generation_number <= 3").select(
        "variant_id", "experiment_id", F.col("generation_number").cast("int").alias("generation_number"),
        "generation_id", "plasmid_variant_index", F.lit(None).cast("bigint").alias("parent_variant_id"),
        F.lit("ACGT").alias("assembled_dna_sequence"), "protein_sequence",
        F.create_map(F.lit("sequence_analysis"), F.lit("stale"), F.lit("origin"), F.lit("first")).alias("extra_metadata"))
    return old, view(spark, sf, "metrics")


def _uploaded(spark, sf: str) -> dict[str, DataFrame]:
    old, metrics = _stored(spark, sf)
    fresh = view(spark, sf, "variants").where("generation_number >= 2").select(
        F.lit("upload").alias("file_path"), F.col("variant_id").alias("_row_number"), "experiment_id",
        F.col("plasmid_variant_index").alias("variant_index"), F.col("generation_number").cast("string").alias("generation"),
        F.col("parent_variant_index").cast("string").alias("parent_variant_index"),
        F.lit("GGGG").alias("assembled_dna_sequence"), F.lit("500.5").alias("dna_yield"), F.lit("40").alias("protein_yield"),
        F.when(F.col("variant_id") % 11 == 0, "True").otherwise("False").alias("control"),
        F.create_map(F.lit("lab"), F.lit("b")).alias("metadata"))
    return snapshots.upsert_uploads(fresh, old, metrics)


@register("upsert_counts", """
with fresh as (select * from {variants} where generation_number >= 2),
c as (select experiment_id, generation_number, generation_id from fresh where variant_id % 11 = 0 group by 1, 2, 3),
v as (select experiment_id, count(*) filter (where generation_number > 3) as inserted, count(*) filter (where generation_number <= 3) as updated from fresh where variant_id % 11 <> 0 group by 1)
select v.experiment_id, cast(v.inserted + count(c.generation_number) as bigint) as inserted, cast(v.updated as bigint) as updated
from v left join c on c.experiment_id = v.experiment_id group by v.experiment_id, v.inserted, v.updated""")
def upsert_counts(spark, sf):
    return _uploaded(spark, sf)["counts"]


@register("upsert_variants", """
select v.experiment_id, v.generation_number, v.plasmid_variant_index,
       case when v.generation_number >= 2 then 'GGGG' else 'ACGT' end as assembled_dna_sequence,
       case when v.generation_number >= 2 then null else v.protein_sequence end as protein_sequence,
       case when v.generation_number < 2 then 'origin=first,sequence_analysis=stale' when v.generation_number <= 3 then 'lab=b,origin=first' else 'lab=b' end as extra_metadata,
       case when v.generation_number > 3 then p.plasmid_variant_index end as parent_index
from {variants} v left join {variants} p on p.experiment_id = v.experiment_id and p.generation_number = v.generation_number - 1
  and p.plasmid_variant_index = cast(v.parent_variant_index as varchar(20)) and not (p.generation_number >= 2 and p.variant_id % 11 = 0)
where not (v.generation_number >= 2 and v.variant_id % 11 = 0)""")
def upsert_variants(spark, sf):
    df = cut_lineage(_uploaded(spark, sf)["variants"])
    text = F.array_join(F.array_sort(F.transform(F.map_entries("extra_metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return snapshots.with_parent_index(df.withColumn("extra_metadata", text)).select(
        "experiment_id", "generation_number", "plasmid_variant_index", "assembled_dna_sequence", "protein_sequence",
        "extra_metadata", "parent_index")


MERGE = """
with o as (select variant_id, metric_name, metric_type, value from {derived} where cast(floor(metric_id / 1000000000) as bigint) % 100 < 50),
n as (select variant_id, metric_name, metric_type, value + 1 as value from {derived} where cast(floor(metric_id / 1000000000) as bigint) % 100 >= 40)"""


def _merge_sides(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf, "derived")
    cols = ["variant_id", "metric_name", "metric_type"]
    return (rows.where("cast(floor(metric_id / 1000000000) as bigint) % 100 < 50").select(*cols, "value"),
            rows.where("cast(floor(metric_id / 1000000000) as bigint) % 100 >= 40").select(*cols, (F.col("value") + 1).alias("value")))


@register("merge_latest", MERGE + """
select * from n union all select * from o where (variant_id, metric_name, metric_type) not in (select variant_id, metric_name, metric_type from n)""")
def merge_latest(spark, sf):
    old, new = _merge_sides(spark, sf)
    return snapshots.merge_snapshot(old, new, ["variant_id", "metric_name", "metric_type"], "latest")


@register("merge_set_once", MERGE + """
select * from o union all select * from n where (variant_id, metric_name, metric_type) not in (select variant_id, metric_name, metric_type from o)""")
def merge_set_once(spark, sf):
    old, new = _merge_sides(spark, sf)
    return snapshots.merge_snapshot(old, new, ["variant_id", "metric_name", "metric_type"], "set_once")


@register("replace_generation_metrics", """
select generation_id, variant_id, metric_name, value from {derived} where not (metric_name = 'mutation_total_count' and generation_id = 102)
union all select generation_id, variant_id, metric_name, value * 2 from {derived} where metric_name = 'mutation_total_count' and generation_id = 102""")
def replace_generation_metrics(spark, sf):
    old = view(spark, sf, "derived").select("generation_id", "variant_id", "metric_name", "value")
    hit = (F.col("metric_name") == "mutation_total_count") & (F.col("generation_id") == 102)
    return snapshots.replace_where(old, old.where(hit).withColumn("value", F.col("value") * 2), hit)


@register("purge_experiment", """
select v.experiment_id, count(*) as metric_rows from {derived} d join {variants} v on v.variant_id = d.variant_id where v.experiment_id <> 3 group by 1""")
def purge_experiment(spark, sf):
    variants = view(spark, sf, "variants")
    gone = view(spark, sf, "experiments").where("experiment_id = 3")
    left = snapshots.purge_experiments({"variants": variants, "metrics": view(spark, sf, "derived")}, gone)
    return left["metrics"].join(left["variants"].select("variant_id", "experiment_id"), "variant_id").groupBy(
        "experiment_id").agg(F.count(F.lit(1)).alias("metric_rows"))


@register("metric_owner_generation", """
select metric_id, metric_name, generation_id from {metrics}""")
def metric_owner_generation(spark, sf):
    variants = view(spark, sf, "variants")
    controls = variants.select(F.col("generation_id").alias("wt_control_id"), "generation_id").distinct()
    return M.generation_of_metric(view(spark, sf, "metrics"), variants, controls).select(
        "metric_id", "metric_name", "generation_id")


@register("results_export", """
select v.experiment_id, v.generation_number, v.variant_id, v.plasmid_variant_index, v.protein_sequence,
       max(case when m.metric_name in ('dna_yield_raw', 'dna_yield') then m.value end) as dna_yield,
       max(case when m.metric_name in ('protein_yield_raw', 'protein_yield') then m.value end) as protein_yield,
       max(case when m.metric_name = 'activity_score' then m.value end) as activity_score
from {variants} v left join (select variant_id, metric_name, value from {metrics} union all select variant_id, metric_name, value from {derived}) m
  on m.variant_id = v.variant_id group by 1, 2, 3, 4, 5""")
def results_export(spark, sf):
    rows = view(spark, sf, "metrics").select("variant_id", "metric_name", "value").unionByName(
        view(spark, sf, "derived").select("variant_id", "metric_name", "value"))
    return exports.results_table(view(spark, sf, "variants"), rows)


@register("fasta_export", """
select doc_id, concat('>variant_', cast(doc_id as varchar(20)), '_protein', chr(10), regexp_replace(seq, '(.{{1,70}})', '\\1' || chr(10), 'g')) as fasta
from (select doc_id, trim(regexp_replace(text, '\\s+', '', 'g')) as seq from {documents}) where seq <> ''""")
def fasta_export(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("variant_id"), F.regexp_replace("text", r"\s+", "").alias("protein_sequence"))
    return exports.variant_fasta(docs, "protein").withColumnRenamed("variant_id", "doc_id")


@register("results_csv_roundtrip", "select variant_id, generation_number, plasmid_variant_index from {variants}")
def results_csv_roundtrip(spark, sf):
    """Write the results as CSV, then read the files back."""
    path = scratch_path(spark, "results")
    exports.export_results(view(spark, sf, "variants"), view(spark, sf, "derived"), path)
    back = spark.read.csv(path, header=True, schema=(
        "experiment_id bigint, generation_number int, variant_id bigint, plasmid_variant_index string, "
        "protein_sequence string, dna_yield double, protein_yield double, activity_score double"), enforceSchema=False)
    return back.select("variant_id", "generation_number", "plasmid_variant_index")


JSON_TURNS = """
t as (select conv_id, conv_id % 7 as experiment_id, turn % 2 as generation_number, turn, turn % 3 = 2 as control from {conversations} where conv_id % 10 not in (3, 7)),
v as (select distinct experiment_id, generation_number, turn from t where not control)"""


def _number_documents(spark, sf: str) -> DataFrame:
    """Conversations as JSON uploads with numbers for keys and controls; some
    documents also hold an empty record or an item that is no record."""
    record = F.to_json(F.struct(
        (F.col("turn") + 0.7).alias("id"), (F.col("turn") % 2).alias("gen"), F.lit("ACGT" * 60).alias("sequence"),
        F.lit(500.5).alias("dna_yield"), F.lit(40).alias("protein_yield"),
        F.when(F.col("turn") % 3 == 2, 2).otherwise(0).alias("control")))
    records = table(spark, sf, "conversations").select("conv_id", record.alias("_r")).groupBy("conv_id").agg(
        F.array_join(F.collect_list("_r"), ",").alias("_r"))  # the turns of one conversation
    tail = F.when(F.col("conv_id") % 10 == 3, ",{}").when(F.col("conv_id") % 10 == 7, ",5").otherwise("")
    return records.select(F.col("conv_id").cast("string").alias("file_path"),
                          F.concat(F.lit("["), "_r", tail, F.lit("]")).alias("value"))


def _json_upload(spark, sf: str) -> dict[str, DataFrame]:
    docs = _number_documents(spark, sf)
    records = cut_lineage(uploads.parse_json_texts(docs))
    checked = qc.check_records(records)
    accepted, rejected = qc.upload_gate(
        checked, qc.cross_record_findings(records), uploads.json_errors(docs).where("error is not null"))
    scoped = accepted.withColumn("experiment_id", F.col("file_path").cast("bigint") % 7)
    empty = [spark.createDataFrame([], struct_of(t)) for t in ("variants", "metrics")]
    return {**snapshots.upsert_uploads(scoped, *empty), "rejected": rejected}


@register("json_number_variants", "with " + JSON_TURNS + """
select experiment_id, cast(generation_number as int) as generation_number, cast(turn as varchar(20)) as plasmid_variant_index from v""")
def json_number_variants(spark, sf):
    """From the scan through the gate to the merge, with keys that are JSON numbers."""
    return _json_upload(spark, sf)["variants"].select("experiment_id", "generation_number", "plasmid_variant_index")


@register("json_rejected_records", """
select conv_id, cast(count(*) + case when conv_id % 10 = 3 then 1 else 0 end as bigint) as records from {conversations} where conv_id % 10 in (3, 7) group by 1""")
def json_rejected_records(spark, sf):
    """Documents with an empty record or a number among the records are rejected whole."""
    return _json_upload(spark, sf)["rejected"].groupBy(F.col("file_path").cast("bigint").alias("conv_id")).agg(
        F.count(F.lit(1)).alias("records"))


@register("json_upload_generations", "with " + JSON_TURNS + """
select experiment_id, cast(generation_number as int) as generation_number, bool_or(control) as has_control from t group by 1, 2""")
def json_upload_generations(spark, sf):
    """Generations and wild-type controls that an upload creates."""
    out = _json_upload(spark, sf)
    controls = out["controls"].select("generation_id", F.lit(True).alias("_c"))
    return out["generations"].join(controls, "generation_id", "left").select(
        "experiment_id", "generation_number", F.coalesce("_c", F.lit(False)).alias("has_control"))
