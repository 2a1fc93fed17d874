"""Sequence analysis, mutation calling and embedding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evospark.functions import dna as D
from evospark.operators import embeddings as E, metrics as M, mutations as U, sequences as Q
from evospark.plans import flows as P
from evospark.plans.registry import register
from evospark.plans.reports import LATEST, rounded
from evospark.plans.views import table, view
from evospark.session import cut_lineage, many_partitions
from evospark.sources import exports, snapshots

AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codon_sql(c: str) -> str:
    """SQL of the residue of one codon; unknown bases give X."""
    part = lambda i: f"(instr('TCAG', substr({c}, {i}, 1)) - 1)"
    return (f"case when regexp_full_match({c}, '[ACGT]{{{{3}}}}') then substr('{AMINO}', cast(16 * {part(1)} + 4 * {part(2)} + {part(3)} + 1 as int), 1) else 'X' end")


def codons_sql(s: str) -> str:
    return f"list_transform(range(0, cast(floor(length({s}) / 3) as bigint)), lambda i: substr({s}, cast(3 * i + 1 as int), 3))"


def protein_sql(s: str) -> str:
    return f"array_to_string(list_transform({codons_sql(s)}, lambda c: {codon_sql('c')}), '')"


def _mappings(spark, sf: str) -> DataFrame:
    """Wild-type mapping of each experiment, as a first run stores it."""
    return view(spark, sf, "wild_types").select(
        "experiment_id", F.lit("PLUS").alias("strand"), F.lit(2).alias("frame"), F.lit(20).alias("cds_start"),
        (F.length("wt_cds") + 20).alias("cds_end"), "wt_cds", D.translate(F.col("wt_cds")).alias("wt_protein"))


def _mapped(spark, sf: str) -> DataFrame:
    return view(spark, sf, "plasmids").join(_mappings(spark, sf), "experiment_id")


@register("dna_functions", f"""
with s as (select o_orderkey, concat(case when o_custkey % 5 = 0 then 'NAA' else 'ATG' end, translate(md5(cast(o_orderkey as varchar(20))), '0123456789abcdef', 'ACGTACGTACGTACGT'),
                                     translate(md5(cast(o_custkey as varchar(20))), '0123456789abcdef', 'ACGTACGTACGTACGT')) as dna from {{orders}}),
p as (select *, {protein_sql('dna')} as protein from s)
select o_orderkey, reverse(translate(dna, 'ACGTN', 'TGCAN')) as reverse_complement, cast(length(protein) as int) as residues, split_part(protein, '*', 1) as protein_head,
       contains(dna, 'N') as has_ambiguous_bases, contains(protein, '*') as has_stop_codon,
       concat(substr(dna, 51, 17), substr(dna, 1, 10)) as wrapped from p""")
def dna_functions(spark, sf):
    text = ("concat(case when o_custkey % 5 = 0 then 'NAA' else 'ATG' end, "
            "translate(md5(cast(o_orderkey as varchar(20))), '0123456789abcdef', 'ACGTACGTACGTACGT'), "
            "translate(md5(cast(o_custkey as varchar(20))), '0123456789abcdef', 'ACGTACGTACGTACGT'))")
    df = table(spark, sf, "orders").select("o_orderkey", F.expr(text).alias("dna"))
    df = df.withColumn("q", D.translation_with_quality(F.col("dna")))
    return df.select(
        "o_orderkey", D.reverse_complement(F.col("dna")).alias("reverse_complement"),
        F.length(D.translate(F.col("dna"))).alias("residues"), F.col("q.protein").alias("protein_head"),
        F.col("q.has_ambiguous_bases"), F.col("q.has_stop_codon"),
        D.circular_slice(F.col("dna"), F.lit(50), F.lit(10)).alias("wrapped"))


@register("plasmid_validation", f"""
select p.variant_id, contains(pr.d0, w.protein) or contains(pr.d1, w.protein) or contains(pr.d2, w.protein) as is_valid
from {{plasmids}} p
join (select experiment_id, {protein_sql('wt_cds')} as protein from {{wild_types}}) w on w.experiment_id = p.experiment_id
join (select variant_id, {protein_sql('concat(assembled_dna_sequence, assembled_dna_sequence)')} as d0,
             {protein_sql('substr(concat(assembled_dna_sequence, assembled_dna_sequence), 2, 2000)')} as d1,
             {protein_sql('substr(concat(assembled_dna_sequence, assembled_dna_sequence), 3, 2000)')} as d2 from {{plasmids}}) pr on pr.variant_id = p.variant_id""")
def plasmid_validation(spark, sf):
    rows = _mapped(spark, sf).select("variant_id", "wt_protein", F.col("assembled_dna_sequence").alias("plasmid"))
    return Q.validate_plasmids(rows).select("variant_id", "is_valid")


@register("wild_type_location", """
select experiment_id, 'PLUS' as strand, 20 as cds_start, cast(20 + length(wt_cds) as int) as cds_end, wt_cds, cast(100.0 as double) as match_identity_pct from {wild_types}""")
def wild_type_location(spark, sf):
    rows = view(spark, sf, "wild_types").select(
        "experiment_id", D.translate(F.col("wt_cds")).alias("wt_protein"), "wt_plasmid")
    return Q.locate_wild_type(rows, ["experiment_id"]).drop("wt_protein", "frame")


@register("wild_type_references", """
select experiment_id, case when experiment_id % 2 = 0 then 'MKTAA' else 'MKT' end as wt_protein, case when experiment_id = 3 then 'ATGAAAACCTTTT' else 'ATGAAAACC' end as wt_plasmid from {experiments}""")
def wild_type_references(spark, sf):
    exps = view(spark, sf, "experiments")
    proteins = exps.select("wt_id").distinct().select(
        "wt_id", F.lit("MKT").alias("amino_acid_sequence"), F.lit("ATGAAAACC").alias("plasmid_sequence"))
    override = F.when(F.col("experiment_id") == 3, "atgaaaacc tttt").otherwise("ATG")
    exps_meta = exps.select("experiment_id", "wt_id", F.create_map(F.lit("wt_plasmid_sequence"), override).alias("extra_metadata"))
    staged = F.when(F.col("experiment_id") % 2 == 0, '{"protein_sequence": "mktaa"}').otherwise("{broken")
    metadata = exps.select("experiment_id", F.lit("uniprot_staging").alias("field_name"), staged.alias("field_value"))
    return Q.wt_references(exps_meta, proteins, metadata)


CDS = f"""
wt as (select experiment_id, wt_cds, length(wt_cds) as n, {protein_sql('wt_cds')} as wt_protein from {{wild_types}}),
anch as (
  select p.variant_id, p.experiment_id, p.assembled_dna_sequence as d, length(p.assembled_dna_sequence) as dn, concat(p.assembled_dna_sequence, p.assembled_dna_sequence) as dd, w.*
  from {{plasmids}} p join wt w on w.experiment_id = p.experiment_id),
starts as (select *, case
   when instr(dd, substr(wt_cds, 1, 30)) > 0 then (instr(dd, substr(wt_cds, 1, 30)) - 1) % dn
   when instr(dd, substr(wt_cds, 49, 30)) > 0 then (instr(dd, substr(wt_cds, 49, 30)) - 1 - 48 + dn) % dn
   when instr(dd, substr(wt_cds, 98, 30)) > 0 then (instr(dd, substr(wt_cds, 98, 30)) - 1 - 97 + dn) % dn
   when instr(dd, substr(wt_cds, 147, 30)) > 0 then (instr(dd, substr(wt_cds, 147, 30)) - 1 - 146 + dn) % dn end as st from anch),
coding as (select *, substr(dd, cast(st + 1 as int), cast(least(n + 150, dn) as int)) as coding from starts),
stops as (select *, instr({protein_sql('coding')}, '*') as stop from coding),
cut as (select *, case when stop > 0 then (stop - 1) * 3 else n end as size from stops),
cds as (select variant_id, experiment_id, wt_cds, wt_protein, st as cds_start, (st + size) % dn as cds_end, substr(coding, 1, cast(size as int)) as cds_dna,
        split_part({protein_sql('substr(coding, 1, cast(size as int))')}, '*', 1) as protein_aa from cut)"""


@register("variant_cds", "with " + CDS + """
select variant_id, cast(cds_start as int) as cds_start, cast(cds_end as int) as cds_end, cds_dna, protein_aa, length(cds_dna) % 3 <> 0 as has_frameshift,
       regexp_matches(cds_dna, '[^ACGT]') as has_ambiguous_bases, protein_aa <> '' and length(protein_aa) < length(wt_protein) as has_premature_stop from cds""")
def variant_cds(spark, sf):
    return Q.extract_cds(_mapped(spark, sf)).select(
        "variant_id", "cds_start", "cds_end", "cds_dna", "protein_aa", "has_frameshift", "has_ambiguous_bases", "has_premature_stop")


def _true_genes(spark, sf: str) -> DataFrame:
    """Variant genes next to their wild type."""
    wild = view(spark, sf, "wild_types").select("experiment_id", "wt_cds")
    return view(spark, sf, "genes").join(wild, "experiment_id").select(
        "variant_id", "experiment_id", "wt_cds", F.col("gene").alias("cds_dna"))


CALLS = f"""
g as (select v.variant_id, w.wt_cds as wt, v.gene as var, {codons_sql('w.wt_cds')} as w, {codons_sql('v.gene')} as v from {{genes}} v join {{wild_types}} w on w.experiment_id = v.experiment_id),
p as (select *, length(wt) % 3 <> 0 or length(var) % 3 <> 0 as shift, length(wt) = length(var) as eq,
             list_transform(w, lambda c: {codon_sql('c')}) as wa, list_transform(v, lambda c: {codon_sql('c')}) as va from g),
d as (select *, list_filter(range(1, len(w) + 1), lambda i: w[i] <> v[i]) as diff from p),
m as (select *, case when eq and not shift and len(diff) >= 2 then coalesce(list_min(list_filter(range(1, cast(floor(len(diff) / 2) as bigint) + 1),
        lambda k: list_max(diff) - list_min(diff) + 1 - k >= 1 and
        (w[list_min(diff) + k : list_max(diff)] = v[list_min(diff) : list_max(diff) - k] or w[list_min(diff) : list_max(diff) - k] = v[list_min(diff) + k : list_max(diff)]))), 0) else 0 end as move from d),
h as (select *, coalesce(list_min(list_filter(range(1, least(len(wa), len(va)) + 1), lambda i: wa[i] <> va[i])) - 1, least(len(wa), len(va))) as head from m),
t as (select *, coalesce(list_min(list_filter(range(1, least(len(wa), len(va)) - head + 1), lambda i: wa[len(wa) + 1 - i] <> va[len(va) + 1 - i])) - 1, least(len(wa), len(va)) - head) as tail from h),
c as (select *, list_concat(range(1, least(len(wa), len(va)) - tail + 1), range(len(wa) - tail + 1, len(wa) + 1)) as pairs, len(va) - len(wa) as grow from t),
e as (select *, list_filter(pairs, lambda i: w[i] <> v[i + case when i > len(wa) - tail then grow else 0 end]) as changed from c),
counts as (
  select variant_id,
    case when shift or move > 0 then 0 when eq then len(list_filter(diff, lambda i: wa[i] = va[i] and not contains(v[i], 'N') and va[i] <> '*'))
         else len(list_filter(changed, lambda i: wa[i] = va[i + case when i > len(wa) - tail then grow else 0 end])) end as synonymous,
    case when shift then 0 when move > 0 then 2 * move when eq then len(list_filter(diff, lambda i: (wa[i] <> va[i] or va[i] = '*') and not contains(v[i], 'N')))
         else len(list_filter(changed, lambda i: wa[i] <> va[i + case when i > len(wa) - tail then grow else 0 end])) + abs(grow) end as nonsynonymous,
    case when shift then 1 when move > 0 then 2 * move when eq then len(diff) else len(changed) + abs(grow) end as total
  from e)"""


@register("mutation_calls", "with " + CALLS + """
select variant_id, cast(synonymous as int) as synonymous, cast(nonsynonymous as int) as nonsynonymous, cast(total as int) as total from counts""")
def mutation_calls(spark, sf):
    return U.call_mutations(_true_genes(spark, sf)).select("variant_id", "mutation_counts.*")


SUBSTITUTED = CALLS + f""",
subs as (select variant_id, w, v, wa, eq, grow, tail, unnest(case when eq then diff else changed end) as i from e where not shift and move = 0),
placed as (select variant_id, cast(i as int) as position, w[i] as wt_codon, v[i + case when not eq and i > len(wa) - tail then grow else 0 end] as var_codon from subs),
named as (select variant_id, position, wt_codon, var_codon, {codon_sql('wt_codon')} as wt_aa, {codon_sql('var_codon')} as var_aa from placed)"""


@register("substitution_records", "with " + SUBSTITUTED + """
select variant_id, case when contains(var_codon, 'N') then 'AMBIGUOUS' when var_aa = '*' then 'NONSENSE' when wt_aa = var_aa then 'SYNONYMOUS' else 'NONSYNONYMOUS' end as mutation_type,
       position, wt_codon, var_codon, case when not contains(var_codon, 'N') then wt_aa end as wt_aa, case when not contains(var_codon, 'N') then var_aa end as var_aa from named""")
def substitution_records(spark, sf):
    rows = U.mutation_rows(U.call_mutations(_true_genes(spark, sf)))
    return rows.where(~F.col("mutation_type").isin("INSERTION", "DELETION", "FRAMESHIFT")).select(
        "variant_id", "mutation_type", F.col("aa_position_1based").alias("position"), "wt_codon", "var_codon", "wt_aa", "var_aa")


def _analysed(spark, sf: str) -> DataFrame:
    variants = view(spark, sf, "plasmids").withColumn("protein_sequence", F.lit(None).cast("string"))
    return P.analyse_sequences(variants, _mappings(spark, sf))


@register("sequence_run")
def sequence_run(spark, sf):
    return _analysed(spark, sf).select(
        "experiment_id", "variant_id", "cds_dna", "protein_aa", "mutation_counts.*", "guarded", "qc_notes")


@register("sequence_run_status", "with " + CDS + """
select experiment_id, case when bool_or(cds_dna = '' or length(cds_dna) % 3 <> 0 or (protein_aa <> '' and length(protein_aa) < length(wt_protein))) then 'ANALYSED_WITH_ERRORS' else 'ANALYSED' end as status
from cds group by 1""")
def sequence_run_status(spark, sf):
    return U.run_status(_analysed(spark, sf))


@register("count_metrics", "with " + CALLS + """
select variant_id, 'mutation_synonymous_count' as metric_name, cast(synonymous as double) as value from counts
union all select variant_id, 'mutation_nonsynonymous_count', cast(nonsynonymous as double) from counts
union all select variant_id, 'mutation_total_count', cast(total as double) from counts""")
def count_metrics(spark, sf):
    return U.count_metric_rows(U.call_mutations(_true_genes(spark, sf))).select("variant_id", "metric_name", "value")


@register("acceptable_mutations", "with " + SUBSTITUTED + """
select variant_id, 'protein' as mutation_type, position, wt_aa as original, var_aa as mutated, false as is_synonymous
from named where not contains(var_codon, 'N') and (wt_aa <> var_aa or var_aa = '*')""")
def acceptable_mutations(spark, sf):
    called = U.mutation_rows(U.call_mutations(_true_genes(spark, sf)))
    return snapshots.acceptable_mutations(called).drop("mutation_id", "annotation")


@register("mutation_report", "with " + CALLS + """
select v.experiment_id, v.generation_number, v.variant_id, case when c.total = 0 then 1 else c.total end as report_rows
from counts c join {variants} v on v.variant_id = c.variant_id""")
def mutation_report(spark, sf):
    called = U.call_mutations(_true_genes(spark, sf)).select(
        "variant_id", F.struct("mutations", "mutation_counts").alias("analysis"),
        F.lit(None).cast("timestamp").alias("updated_at"), F.current_timestamp().alias("created_at"))
    variants = view(spark, sf, "variants").withColumn("parent_variant_id", F.lit(None).cast("bigint"))
    report = exports.mutation_report(variants, called)
    return report.groupBy("experiment_id", "generation_number", "variant_id").agg(F.count(F.lit(1)).alias("report_rows"))


@register("mutation_feature_vectors", """
with f as (select distinct v.experiment_id, m.variant_id, concat(cast(m.position as varchar(9)), '_', m.mutated) as feature from {mutations} m join {variants} v on v.variant_id = m.variant_id where m.mutation_type = 'protein'),
i as (select experiment_id, feature, row_number() over (partition by experiment_id order by feature) - 1 as col from (select distinct experiment_id, feature from f)),
n as (select experiment_id, cast(count(*) as int) as size from i group by 1),
x as (select f.variant_id, string_agg(cast(i.col as varchar(9)), ',' order by i.col) as indices from f join i on i.experiment_id = f.experiment_id and i.feature = f.feature group by 1)
select v.experiment_id, v.variant_id, n.size, coalesce(x.indices, '') as indices from {variants} v join n on n.experiment_id = v.experiment_id left join x on x.variant_id = v.variant_id""")
def mutation_feature_vectors(spark, sf):
    many_partitions(spark)
    variants = view(spark, sf, "variants")
    features = E.mutation_features(variants, view(spark, sf, "mutations"), ["experiment_id"])
    return E.feature_vectors(variants, features, ["experiment_id"]).select(
        "experiment_id", "variant_id", "size", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"))


def _points(spark, sf: str) -> DataFrame:
    many_partitions(spark)
    variants = view(spark, sf, "variants")
    features = E.mutation_features(variants, view(spark, sf, "mutations"), ["experiment_id"], "position")
    return E.pca_points(variants, features, ["experiment_id"])


@register("pca_points")
def pca_points(spark, sf):
    return _points(spark, sf)


@register("pca_invariants", """
select v.experiment_id, count(*) as points, 0.0 as mean_x, 0.0 as mean_y, 0.0 as correlation, true as ordered, 1.0 as axis_x, 1.0 as axis_y
from {variants} v group by 1""")
def pca_invariants(spark, sf):
    """What makes points principal: zero means, no correlation, and both axes are eigenvectors (the squared products
    of a coordinate with the features add up to the square of its own sum of squares)."""
    many_partitions(spark)
    variants = view(spark, sf, "variants")
    features = cut_lineage(E.mutation_features(variants, view(spark, sf, "mutations"), ["experiment_id"], "position"))
    points = cut_lineage(E.pca_points(variants, features, ["experiment_id"]))
    x, y = F.col("pca_x"), F.col("pca_y")
    sums = points.groupBy("experiment_id").agg(
        F.count("*").alias("points"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"))
    products = features.join(points, ["experiment_id", "variant_id"]).groupBy("experiment_id", "feature").agg(
        F.sum(F.col("value") * x).alias("sx"), F.sum(F.col("value") * y).alias("sy"))
    eigen = products.groupBy("experiment_id").agg(F.sum(F.col("sx") * F.col("sx")).alias("ex"), F.sum(F.col("sy") * F.col("sy")).alias("ey"))
    close = lambda c: (F.round(c, 6) + 0.0).cast("double")
    return sums.join(eigen, "experiment_id").select(
        "experiment_id", "points", F.abs(close(F.col("mx"))).alias("mean_x"), F.abs(close(F.col("my"))).alias("mean_y"),
        F.abs(close(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))).alias("correlation"), (F.col("xx") >= F.col("yy")).alias("ordered"),
        close(F.col("ex") / (F.col("xx") * F.col("xx"))).alias("axis_x"), close(F.col("ey") / (F.col("yy") * F.col("yy"))).alias("axis_y"))


@register("activity_landscape")
def activity_landscape(spark, sf):
    return E.activity_landscape(view(spark, sf, "variants"), view(spark, sf, "derived"), _points(spark, sf))


@register("landscape_view", "with " + LATEST + """,
n as (select variant_id, count(*) as protein_mutations from {mutations} where mutation_type = 'protein' and is_synonymous is false group by 1)
select v.experiment_id, v.variant_id, v.generation_id, l.activity_score, coalesce(n.protein_mutations, 0) as protein_mutations
from {variants} v join latest l on l.variant_id = v.variant_id left join n on n.variant_id = v.variant_id where l.activity_score is not null""")
def landscape_view(spark, sf):
    variants, metrics = view(spark, sf, "variants"), view(spark, sf, "derived")
    scores = M.latest_metric(metrics, *M.ACTIVITY, out="activity_score")
    flat = variants.select("experiment_id", "variant_id", F.lit(0.0).alias("pca_x"), F.lit(0.0).alias("pca_y"))
    runs, points = E.embedding_run(flat, scores, "protein_mutation_counts")
    stored = metrics.where("metric_name <> 'activity_score'")
    return E.landscape_view(runs, points, variants, stored, view(spark, sf, "mutations")).select(
        "experiment_id", "variant_id", "generation_id", "activity_score", "protein_mutations")


@register("idw_surface", """
with s as (select c_nationkey as g, c_acctbal as x, cast(c_custkey % 100 as double) as y, sum(cast(c_nationkey + c_custkey % 7 as double)) as z, count(*) as n from {customer} group by 1, 2, 3),
f as (select g, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from s group by 1),
c as (select s.*, cell, x0 + (x1 - x0) * (cell % 10) / 9.0 as gx, y0 + (y1 - y0) * floor(cell / 10) / 9.0 as gy
      from s join f on f.g = s.g cross join (select unnest(range(0, 100)) as cell) k),
w as (select *, 1.0 / ((x - gx) * (x - gx) + (y - gy) * (y - gy) + 1e-12) as w from c)
select g as c_nationkey, cast(cell % 10 as int) as "column", cast(floor(cell / 10) as int) as row, round(sum(w * z) / sum(w * n), 6) as grid_z from w group by g, cell""")
def idw_surface(spark, sf):
    points = table(spark, sf, "customer").select(
        "c_nationkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"),
        (F.col("c_nationkey") + F.col("c_custkey") % 7).cast("double").alias("z"))
    return rounded(E.idw_surface(points, ["c_nationkey"], grid=10), "grid_z").drop("grid_x", "grid_y")
