"""Domain enrichment, mutation frequency and co-occurrence network queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evospark.operators import domains as D, network as N, ranking as R
from evospark.plans.registry import register
from evospark.plans.reports import LATEST, rounded
from evospark.plans.views import view

GENERATIONS = list(range(7))  # of the given campaign, for the SQL; the operators read them from the table

ENRICHED = """
enriched as (
  select v.generation_id, f.wt_id, f.feature_type, coalesce(f.description, f.feature_type) as domain_label, f.start_position, f.end_position,
         count(*) filter (where m.is_synonymous is false) as nonsyn_count, count(*) filter (where m.is_synonymous is true) as syn_count,
         count(*) as total_protein_mutations, f.end_position - f.start_position + 1 as domain_length,
         cast(count(*) filter (where m.is_synonymous is false) as double) / (f.end_position - f.start_position + 1) as nonsyn_per_residue
  from {variants} v join {experiments} e on e.experiment_id = v.experiment_id
  join {mutations} m on m.variant_id = v.variant_id and m.mutation_type = 'protein'
  join {features} f on f.wt_id = e.wt_id and m.position between f.start_position and f.end_position
  group by 1, 2, 3, 4, 5, 6)"""


def _enrichment(spark, sf: str) -> DataFrame:
    return D.domain_enrichment(view(spark, sf, "variants"), view(spark, sf, "mutations"),
                               view(spark, sf, "experiments"), view(spark, sf, "features"))


@register("domain_enrichment", "with " + ENRICHED + """
select generation_id, wt_id, feature_type, domain_label, start_position, end_position, nonsyn_count, syn_count, total_protein_mutations,
       domain_length, round(nonsyn_per_residue, 6) as nonsyn_per_residue from enriched""")
def domain_enrichment(spark, sf):
    df = _enrichment(spark, sf)
    return rounded(df.withColumn("nonsyn_count", F.col("nonsyn_count").cast("bigint")), "nonsyn_per_residue")


@register("domain_enrichment_report", "with " + ENRICHED + """
select generation_id, wt_id, domain_label, start_position, end_position, nonsyn_count, total_protein_mutations
from enriched where feature_type in ('Domain', 'Region')""")
def domain_enrichment_report(spark, sf):
    return D.domain_enrichment(
        view(spark, sf, "variants"), view(spark, sf, "mutations"), view(spark, sf, "experiments"),
        view(spark, sf, "features"), types=["Domain", "Region"],
    ).select("generation_id", "wt_id", "domain_label", "start_position", "end_position", "nonsyn_count",
             "total_protein_mutations")


_CELLS = ", ".join(f"coalesce(avg(nonsyn_count) filter (where generation_number = {g}), 0.0) as g{g}" for g in GENERATIONS)
_SUM = " + ".join(f"g{g}" for g in GENERATIONS)


@register("enrichment_matrix", "with " + ENRICHED + f""",
wide as (select domain_label, {_CELLS} from enriched join {{generations}} g on g.generation_id = enriched.generation_id group by 1)
select domain_label, {', '.join(f'round(g{g}, 6) as g{g}' for g in GENERATIONS)}, round({_SUM}, 6) as total from wide""")
def enrichment_matrix(spark, sf):
    df = D.enrichment_matrix(_enrichment(spark, sf), view(spark, sf, "generations"), "nonsyn_count")
    return rounded(df, *[c for c in df.columns if c != "domain_label"])


@register("top_domains", "with " + ENRICHED + """
select generation_id, wt_id, feature_type, domain_label, start_position, end_position, nonsyn_count, rank from (
  select *, cast(row_number() over (partition by generation_id order by nonsyn_count desc, domain_label, start_position, end_position, wt_id, feature_type) as int) as rank
  from enriched) where rank <= 25""")
def top_domains(spark, sf):
    return D.top_domains(_enrichment(spark, sf)).select(
        "generation_id", "wt_id", "feature_type", "domain_label", "start_position", "end_position", "nonsyn_count", "rank")


FREQ = """
freq as (select v.experiment_id, v.generation_number, m.position, count(*) as mutations from {mutations} m join {variants} v on v.variant_id = m.variant_id
         where m.mutation_type = 'protein' and (m.is_synonymous is false or m.is_synonymous is null) group by 1, 2, 3)"""


def _frequency(spark, sf: str) -> DataFrame:
    return D.mutation_frequency(view(spark, sf, "variants"), view(spark, sf, "mutations"))


@register("mutation_frequency", "with " + FREQ + " select * from freq")
def mutation_frequency(spark, sf):
    return _frequency(spark, sf)


@register("frequency_matrix", "with " + FREQ + " select experiment_id, position, " + ", ".join(
    f"cast(coalesce(sum(mutations) filter (where generation_number = {g}), 0) as bigint) as g{g}" for g in GENERATIONS) + " from freq group by 1, 2")
def frequency_matrix(spark, sf):
    return D.frequency_matrix(_frequency(spark, sf), view(spark, sf, "generations"))


@register("mutation_hotspots", "with " + FREQ + """,
t as (select experiment_id, position, cast(sum(mutations) as bigint) as total from freq group by 1, 2)
select * from (select *, cast(row_number() over (partition by experiment_id order by total desc, position) as int) as rank from t) where rank <= 5""")
def mutation_hotspots(spark, sf):
    return D.hotspots(D.position_totals(_frequency(spark, sf)))


@register("domain_regions", """
select distinct wt_id, coalesce(description, feature_type) as domain_label, start_position, end_position from {features} where feature_type in ('Domain', 'Region')""")
def domain_regions(spark, sf):
    return D.domain_regions(view(spark, sf, "features"))


@register("protein_mutation_counts", """
select v.experiment_id, v.variant_id, count(m.variant_id) as protein_mutations, count(m.variant_id) filter (where m.is_synonymous is false) as nonsyn_mutations
from {variants} v left join {mutations} m on m.variant_id = v.variant_id and m.mutation_type = 'protein' group by 1, 2""")
def protein_mutation_counts(spark, sf):
    return D.protein_mutation_counts(view(spark, sf, "variants"), view(spark, sf, "mutations"))


@register("mutation_position_range", """
select v.experiment_id, min(m.position) as min_position, max(m.position) as max_position
from {mutations} m join {variants} v on v.variant_id = m.variant_id where m.mutation_type = 'protein' group by 1""")
def mutation_position_range(spark, sf):
    return D.position_range(view(spark, sf, "variants"), view(spark, sf, "mutations"))


@register("variant_position_counts", "select variant_id, position, count(*) as mutations from {mutations} where mutation_type = 'protein' group by 1, 2")
def variant_position_counts(spark, sf):
    return D.variant_position_counts(view(spark, sf, "mutations"))


@register("feature_summary", """
with h as (select wt_id, feature_id, feature_type, concat(coalesce(description, feature_type), ' (', cast(start_position as varchar(9)), '-', cast(end_position as varchar(9)), ')') as hl from {features}),
t as (select wt_id, feature_type, count(*) as n, min(feature_id) as f from h group by 1, 2),
tt as (select wt_id, string_agg(case when n > 1 then concat(feature_type, ' (', cast(n as varchar(9)), ')') else feature_type end, ', ' order by rn) as top_types
       from (select *, row_number() over (partition by wt_id order by n desc, f) as rn from t) where rn <= 3 group by 1),
hh as (select wt_id, string_agg(hl, ', ' order by rn) as highlights from (
       select wt_id, hl, row_number() over (partition by wt_id order by min(feature_id)) as rn from h group by 1, 2) where rn <= 3 group by 1)
select h.wt_id, count(*) as features, tt.top_types, hh.highlights from h join tt on tt.wt_id = h.wt_id join hh on hh.wt_id = h.wt_id group by 1, 3, 4""")
def feature_summary(spark, sf):
    return D.feature_summary(view(spark, sf, "features"))


@register("network_diagnostics", """
select v.experiment_id, count(*) as variant_count, count(v.protein_sequence) as protein_sequences_available,
       cast(sum(coalesce(m.n, 0)) as bigint) as mutation_rows_total, cast(sum(coalesce(m.p, 0)) as bigint) as mutation_rows_protein, cast(sum(coalesce(m.d, 0)) as bigint) as mutation_rows_dna,
       cast(0 as bigint) as json_mutation_rows
from {variants} v left join (select variant_id, count(*) as n, count(*) filter (where mutation_type = 'protein') as p, count(*) filter (where mutation_type = 'dna') as d
                             from {mutations} group by 1) m on m.variant_id = v.variant_id group by 1""")
def network_diagnostics(spark, sf):
    return N.network_diagnostics(view(spark, sf, "variants"), view(spark, sf, "mutations"))


PICKED = LATEST + """,
pool as (select v.experiment_id, v.variant_id, v.protein_sequence, l.activity_score,
                row_number() over (partition by v.experiment_id order by l.activity_score desc nulls last, v.variant_id) as rn
         from {variants} v left join latest l on l.variant_id = v.variant_id),
picked as (select experiment_id, variant_id, activity_score, case when rn <= 10 and activity_score is not null then 1 else 0 end as is_top10 from pool where rn <= 120),
labels as (select distinct v.experiment_id, m.variant_id, concat(m.original, cast(m.position as varchar(9)), m.mutated) as label
           from {mutations} m join {variants} v on v.variant_id = m.variant_id where m.mutation_type = 'protein'),
mine as (select l.* from labels l join picked p on p.variant_id = l.variant_id),
sizes as (select variant_id, count(*) as n from mine group by 1),
pairs as (select a.experiment_id, a.variant_id as u, b.variant_id as v, count(*) as shared from mine a join mine b
          on a.experiment_id = b.experiment_id and a.label = b.label and a.variant_id < b.variant_id group by 1, 2, 3)"""


def _edge_sql(universe: str) -> str:
    return PICKED + f""",
feats as (select experiment_id, count(distinct label) as nf from {universe} group by 1),
scored_pairs as (select p.*, cast(p.shared as double) / (su.n + sv.n - p.shared) as jaccard,
         case when cast(su.n as double) * sv.n * (f.nf - su.n) * (f.nf - sv.n) > 0
              then (cast(p.shared as double) * (f.nf - (su.n + sv.n - p.shared)) - (su.n - p.shared) * (sv.n - p.shared))
                   / sqrt(cast(su.n as double) * sv.n * (f.nf - su.n) * (f.nf - sv.n)) else 0.0 end as pearson
  from pairs p join sizes su on su.variant_id = p.u join sizes sv on sv.variant_id = p.v join feats f on f.experiment_id = p.experiment_id)"""


OPTIONS = N.page_options(max_nodes=120, min_shared=1, pearson=0.0)


def _selected(spark, sf: str) -> DataFrame:
    nodes = R.similarity_nodes(view(spark, sf, "variants"), view(spark, sf, "derived"))
    return N.select_nodes(nodes, OPTIONS, need_sequence=False)


def _labelled(spark, sf: str) -> DataFrame:
    return N.protein_mutations(view(spark, sf, "variants"), view(spark, sf, "mutations"))


@register("network_nodes", "with " + PICKED + " select experiment_id, variant_id, activity_score, is_top10 from picked")
def network_nodes(spark, sf):
    return _selected(spark, sf).select("experiment_id", "variant_id", "activity_score", "is_top10")


@register("cooccurrence_edges", "with " + _edge_sql("labels") + """
select experiment_id, u, v, shared, round(jaccard, 6) as jaccard, round(pearson, 6) as pearson from scored_pairs where pearson >= 0.0""")
def cooccurrence_edges(spark, sf):
    edges = N.cooccurrence_edges(_selected(spark, sf), _labelled(spark, sf), OPTIONS)
    return rounded(edges, "jaccard", "pearson")


@register("phi_edges", "with " + _edge_sql("mine") + """
select experiment_id, u, v, round(pearson, 6) as pearson from scored_pairs where pearson >= 0.05""")
def phi_edges(spark, sf):
    return rounded(N.phi_edges(_selected(spark, sf), _labelled(spark, sf), 0.05), "pearson")


@register("protein_mutations", """
select distinct v.experiment_id, m.variant_id, m.position, m.original, m.mutated, 0 as source
from {mutations} m join {variants} v on v.variant_id = m.variant_id where m.mutation_type = 'protein'""")
def protein_mutations(spark, sf):
    return _labelled(spark, sf)


SEQUENCE_OPTIONS = N.NetworkOptions(top_n=60, neighbours_per_top10=25, max_nodes=350, identity_threshold=0.95)

SEQ_PICKED = LATEST + """,
pool as (select v.experiment_id, v.variant_id, v.protein_sequence, l.activity_score,
                row_number() over (partition by v.experiment_id order by l.activity_score desc nulls last, v.variant_id) as rn_all
         from {variants} v left join latest l on l.variant_id = v.variant_id),
seqs as (select *, case when rn_all <= 10 and activity_score is not null then 1 else 0 end as is_top10,
                row_number() over (partition by experiment_id order by activity_score desc nulls last, variant_id) as rn
         from pool where protein_sequence is not null),
base as (select * from seqs where rn <= 60 or is_top10 = 1),
near as (select *, row_number() over (partition by top order by d, variant_id) as nrn from (
           select t.variant_id as top, s.variant_id, hamming(t.protein_sequence, s.protein_sequence) as d
           from base t join seqs s on s.experiment_id = t.experiment_id
           where t.is_top10 = 1 and s.variant_id not in (select variant_id from base)
             and hamming(t.protein_sequence, s.protein_sequence) <= 1)),
chosen as (select experiment_id, variant_id, protein_sequence, activity_score, is_top10 from seqs
           where variant_id in (select variant_id from base) or variant_id in (select variant_id from near where nrn <= 25))"""


def _sequence_nodes(spark, sf: str) -> DataFrame:
    nodes = R.similarity_nodes(view(spark, sf, "variants"), view(spark, sf, "derived"))
    return N.select_nodes(nodes, SEQUENCE_OPTIONS)


@register("sequence_network_nodes", "with " + SEQ_PICKED + " select experiment_id, variant_id, is_top10 from chosen")
def sequence_network_nodes(spark, sf):
    return _sequence_nodes(spark, sf).select("experiment_id", "variant_id", "is_top10")


@register("similarity_edges", "with " + SEQ_PICKED + """
select a.experiment_id, a.variant_id as u, b.variant_id as v, round(1 - hamming(a.protein_sequence, b.protein_sequence) / 32.0, 6) as identity
from chosen a join chosen b on a.experiment_id = b.experiment_id and a.variant_id < b.variant_id
where hamming(a.protein_sequence, b.protein_sequence) <= 1""")
def similarity_edges(spark, sf):
    return rounded(N.similarity_edges(_sequence_nodes(spark, sf), 0.95), "identity")


COMPONENTS = """
reach (node, other) as (
  select variant_id, variant_id from chosen
  union
  select r.node, e.b from reach r join both_ways e on e.a = r.other)"""


@register("largest_component", "with recursive " + SEQ_PICKED + """,
pairs as (select a.variant_id as u, b.variant_id as v from chosen a join chosen b on a.experiment_id = b.experiment_id and a.variant_id < b.variant_id
          where hamming(a.protein_sequence, b.protein_sequence) <= 1),
both_ways as (select u as a, v as b from pairs union all select v, u from pairs),""" + COMPONENTS + """,
comp as (select c.experiment_id, r.node as variant_id, min(r.other) as component from reach r join chosen c on c.variant_id = r.node group by 1, 2),
sized as (select experiment_id, component, count(*) as size, row_number() over (partition by experiment_id order by count(*) desc, component) as rn from comp group by 1, 2)
select c.experiment_id, c.variant_id, c.component, s.size from comp c join sized s on s.experiment_id = c.experiment_id and s.component = c.component where s.rn = 1""")
def largest_component(spark, sf):
    nodes = _sequence_nodes(spark, sf)
    comp = N.connected_components(nodes, N.similarity_edges(nodes, 0.95))
    return N.largest_components(comp)


@register("top10_neighbourhood", "with " + _edge_sql("labels") + """,
kept as (select * from scored_pairs where pearson >= 0.0)
select experiment_id, variant_id, is_top10 from picked p where is_top10 = 1
   or variant_id in (select v from kept where u in (select variant_id from picked where is_top10 = 1))
   or variant_id in (select u from kept where v in (select variant_id from picked where is_top10 = 1))""")
def top10_neighbourhood(spark, sf):
    nodes = _selected(spark, sf)
    edges = N.cooccurrence_edges(nodes, _labelled(spark, sf), OPTIONS)
    return N.focus_on_top10(nodes, edges).select("experiment_id", "variant_id", "is_top10")
