"""Scoring, ranking and dashboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evospark.functions.ordering import rank_all
from evospark.operators import kpi, metrics as M, ranking as R, scoring as S
from evospark.plans.registry import register
from evospark.plans.views import view

RAW = """
raw as (
  select v.experiment_id, v.variant_id, v.generation_id, v.generation_number, v.plasmid_variant_index,
         max(case when m.metric_name in ('dna_yield_raw', 'dna_yield') then m.value end) as dna_yield_raw,
         max(case when m.metric_name in ('protein_yield_raw', 'protein_yield') then m.value end) as protein_yield_raw
  from {variants} v left join {metrics} m on m.variant_id = v.variant_id and m.metric_type = 'raw'
  group by 1, 2, 3, 4, 5)"""

WT = """
wt as (
  select * from (
    select generation_id,
           avg(case when metric_name in ('dna_yield_raw', 'dna_yield') then value end) as dna_wt,
           avg(case when metric_name in ('protein_yield_raw', 'protein_yield') then value end) as prot_wt
    from {metrics} where wt_control_id is not null and metric_type = 'raw' group by generation_id)
  where dna_wt is not null and prot_wt is not null)"""

SCORED = RAW + "," + WT + """,
coded as (
  select raw.*, dna_wt, prot_wt,
         case when dna_yield_raw is null or protein_yield_raw is null then 'missing_raw_metrics'
              when dna_yield_raw <= 0 or protein_yield_raw <= 0 then 'nonpositive_raw_metrics'
              when wt.generation_id is null then 'missing_wt_baseline'
              when dna_wt <= 0 or prot_wt <= 0 then 'invalid_wt_baseline'
              when protein_yield_raw / prot_wt <= 1e-9 then 'protein_norm_too_small'
              else 'ok' end as qc_stage4
  from raw left join wt on wt.generation_id = raw.generation_id),
scored as (
  select experiment_id, variant_id, generation_id, generation_number, plasmid_variant_index, dna_yield_raw, protein_yield_raw, qc_stage4,
         case when qc_stage4 in ('ok', 'protein_norm_too_small') then dna_yield_raw / dna_wt end as dna_yield_norm,
         case when qc_stage4 in ('ok', 'protein_norm_too_small') then protein_yield_raw / prot_wt end as protein_yield_norm,
         case when qc_stage4 = 'ok' then (dna_yield_raw / dna_wt) / (protein_yield_raw / prot_wt) end as activity_score
  from coded)"""

LATEST = """
latest as (
  select variant_id,
         max(case when metric_name = 'activity_score' and rn = 1 then value end) as activity_score,
         max(case when metric_name = 'mutation_total_count' and rn = 1 then value end) as total,
         max(case when metric_name = 'mutation_synonymous_count' and rn = 1 then value end) as syn,
         max(case when metric_name = 'mutation_nonsynonymous_count' and rn = 1 then value end) as nonsyn
  from (select *, row_number() over (partition by variant_id, metric_name order by metric_id desc, value desc) as rn from {derived})
  group by variant_id)"""


def _yields(spark, sf: str) -> DataFrame:
    return M.raw_yields(view(spark, sf, "variants"), view(spark, sf, "metrics"))


def scored_variants(spark, sf: str) -> DataFrame:
    """Every variant scored against its generation's control baseline."""
    return S.score_against_wt(_yields(spark, sf), M.wt_baselines(view(spark, sf, "metrics")))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


@register("scored_top10", "with " + SCORED + """
select * from (
  select experiment_id, cast(row_number() over (partition by experiment_id order by activity_score desc, variant_id) as int) as rank,
         variant_id, generation_number, plasmid_variant_index, round(activity_score, 6) as activity_score
  from scored where activity_score is not null) where rank <= 10""")
def scored_top10(spark, sf):
    rows = scored_variants(spark, sf).where("activity_score is not null")
    best = R.top_k(rows, ["experiment_id"], R.best_first(), 10)
    return rounded(best.select("experiment_id", "rank", "variant_id", "generation_number",
                               "plasmid_variant_index", "activity_score"), "activity_score")


@register("raw_yields", "with " + RAW + " select * from raw")
def raw_yields(spark, sf):
    return _yields(spark, sf)


@register("wt_baselines", "with " + WT + " select generation_id, round(dna_wt, 6) as dna_wt, round(prot_wt, 6) as prot_wt from wt")
def wt_baselines(spark, sf):
    return rounded(M.wt_baselines(view(spark, sf, "metrics")), "dna_wt", "prot_wt")


@register("generations_without_baseline", "with " + WT + """
select g.generation_id, g.experiment_id, g.generation_number from {generations} g
where g.generation_id not in (select generation_id from wt)""")
def generations_without_baseline(spark, sf):
    return M.generations_without_baseline(
        view(spark, sf, "generations"), M.wt_baselines(view(spark, sf, "metrics")))


@register("score_against_wt", "with " + SCORED + """
select experiment_id, variant_id, generation_id, generation_number, plasmid_variant_index, dna_yield_raw, protein_yield_raw, qc_stage4,
       round(dna_yield_norm, 6) as dna_yield_norm, round(protein_yield_norm, 6) as protein_yield_norm, round(activity_score, 6) as activity_score
from scored""")
def score_against_wt(spark, sf):
    return rounded(scored_variants(spark, sf), "dna_yield_norm", "protein_yield_norm", "activity_score")


@register("score_against_medians", "with " + RAW + """,
med as (select generation_id, quantile_cont(dna_yield_raw, 0.5) as dna_med, quantile_cont(protein_yield_raw, 0.5) as prot_med from raw group by 1)
select variant_id, generation_id, round(dna_yield_raw / dna_med, 6) as dna_yield_norm, round(protein_yield_raw / prot_med, 6) as protein_yield_norm,
       round((dna_yield_raw / dna_med) / (protein_yield_raw / prot_med), 6) as activity_score,
       case when dna_yield_raw is null or protein_yield_raw is null then 'invalid_fallback' else 'ok' end as qc_stage4
from raw left join med using (generation_id)""")
def score_against_medians(spark, sf):
    df = S.score_against_medians(_yields(spark, sf))
    df = df.select("variant_id", "generation_id", "dna_yield_norm", "protein_yield_norm", "activity_score", "qc_stage4")
    return rounded(df, "dna_yield_norm", "protein_yield_norm", "activity_score")


@register("scoring_modes", "with " + WT + """
select g.experiment_id, count(wt.generation_id) as generations_with_baseline, count(*) - count(wt.generation_id) as generations_without_baseline,
       case when count(wt.generation_id) > 0 then 'wt' else 'fallback' end as scoring_mode,
       case when count(wt.generation_id) > 0 then 'WT=1.0' else 'Generation median=1.0' end as baseline_used,
       case when count(wt.generation_id) > 0 then 'WT-normalized ratio' else 'Fallback ratio (DNA_norm/Protein_norm)' end as scoring_method
from {generations} g left join wt on wt.generation_id = g.generation_id group by 1""")
def scoring_modes(spark, sf):
    return S.scoring_labels(
        S.scoring_modes(view(spark, sf, "generations"), M.wt_baselines(view(spark, sf, "metrics"))))


@register("score_metric_rows", "with " + SCORED + """
select generation_id, variant_id, metric_name, metric_type, round(value, 6) as value, 'ratio' as unit from (
  select generation_id, variant_id, 'dna_yield_norm' as metric_name, 'normalized' as metric_type, dna_yield_norm as value from scored where qc_stage4 = 'ok'
  union all select generation_id, variant_id, 'protein_yield_norm', 'normalized', protein_yield_norm from scored where qc_stage4 = 'ok'
  union all select generation_id, variant_id, 'activity_score', 'derived', activity_score from scored where qc_stage4 = 'ok')""")
def score_metric_rows(spark, sf):
    rows = S.score_metric_rows(scored_variants(spark, sf)).drop("wt_control_id", "metric_definition_id")
    return rounded(rows, "value")


@register("score_quality_histogram", "with " + SCORED + " select experiment_id, qc_stage4, count(*) as variants from scored group by 1, 2")
def score_quality_histogram(spark, sf):
    return S.qc_histogram(scored_variants(spark, sf))


@register("score_formula_violations", "with " + SCORED + """
select count(*) as violations from scored where qc_stage4 = 'ok' and abs(activity_score - dna_yield_norm / protein_yield_norm) > 1e-9 * greatest(1.0, abs(activity_score))""")
def score_formula_violations(spark, sf):
    return S.formula_violations(scored_variants(spark, sf)).agg(F.count(F.lit(1)).alias("violations"))


@register("latest_metrics", "with " + LATEST + " select variant_id, activity_score, total as mutation_total, syn as mutation_syn, nonsyn as mutation_nonsyn from latest")
def latest_metrics(spark, sf):
    return M.latest_metrics(view(spark, sf, "derived"), {
        "activity_score": M.ACTIVITY, "mutation_total": M.MUTATION_TOTAL,
        "mutation_syn": M.MUTATION_SYN, "mutation_nonsyn": M.MUTATION_NONSYN})


@register("top10_with_totals", "with " + LATEST + """
select * from (
  select v.experiment_id, cast(row_number() over (partition by v.experiment_id order by activity_score desc, v.variant_id) as int) as rank,
         v.variant_id, v.generation_number, v.plasmid_variant_index, activity_score, cast(total as int) as total_mutations
  from {variants} v join latest l on l.variant_id = v.variant_id where activity_score is not null) where rank <= 10""")
def top10_with_totals(spark, sf):
    return R.top_variants(view(spark, sf, "variants"), view(spark, sf, "derived"))


@register("distribution_summary", "with " + LATEST + """
select v.experiment_id, v.generation_number, count(*) as n, min(activity_score) as min_value, max(activity_score) as max_value,
       round(avg(activity_score), 6) as mean_value, round(quantile_cont(activity_score, 0.25), 6) as q1,
       round(quantile_cont(activity_score, 0.5), 6) as median_value, round(quantile_cont(activity_score, 0.75), 6) as q3
from {variants} v join latest l on l.variant_id = v.variant_id where activity_score is not null group by 1, 2""")
def distribution_summary(spark, sf):
    rows = M.distribution_rows(view(spark, sf, "variants"), view(spark, sf, "derived"))
    return rounded(M.distribution_summary(rows, ["experiment_id", "generation_number"]), "mean_value", "q1", "median_value", "q3")


@register("numeric_profile", """
select metric_name, count(value) as n, round(quantile_cont(value, 0.0), 6) as min_value, round(quantile_cont(value, 0.01), 6) as p1, round(quantile_cont(value, 0.05), 6) as p5,
       round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as median_value, round(quantile_cont(value, 0.75), 6) as p75,
       round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(quantile_cont(value, 1.0), 6) as max_value
from {metrics} group by 1""")
def numeric_profile(spark, sf):
    df = M.numeric_profile(view(spark, sf, "metrics"), ["metric_name"], "value")
    return rounded(df, *[c for c in df.columns if c not in ("metric_name", "n")])


@register("scored_counts", """
select v.experiment_id, count(*) as scored_rows from {derived} d join {variants} v on v.variant_id = d.variant_id
where d.metric_name = 'activity_score' group by 1""")
def scored_counts(spark, sf):
    return M.scored_counts(view(spark, sf, "variants"), view(spark, sf, "derived"))


@register("metric_rule_violations", """
select rule, count(*) as violations from (
  select 'unique' as rule from {metrics} group by generation_id, variant_id, wt_control_id, metric_name, metric_type having count(*) > 1) group by 1""")
def metric_rule_violations(spark, sf):
    return M.metric_violations(view(spark, sf, "metrics")).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


@register("similarity_nodes", "with " + LATEST + """,
ranked as (
  select v.variant_id, activity_score, row_number() over (partition by v.experiment_id order by activity_score desc nulls last, v.variant_id) as rn
  from {variants} v left join latest l on l.variant_id = v.variant_id)
select v.experiment_id, v.variant_id, v.generation_number, v.plasmid_variant_index, v.protein_sequence, r.activity_score,
       case when r.rn <= 10 and r.activity_score is not null then 1 else 0 end as is_top10
from {variants} v join ranked r on r.variant_id = v.variant_id""")
def similarity_nodes(spark, sf):
    return R.similarity_nodes(view(spark, sf, "variants"), view(spark, sf, "derived")).select(
        "experiment_id", "variant_id", "generation_number", "plasmid_variant_index", "protein_sequence",
        "activity_score", "is_top10")


@register("performance_rankings", """
select generation_id, variant_id, metric_name, metric_type, value,
       row_number() over (partition by generation_id, metric_name, metric_type order by value desc, variant_id) as rank
from (select *, row_number() over (partition by generation_id, variant_id, metric_name, metric_type order by metric_id desc, value desc) as rn from {derived})
where rn = 1""")
def performance_rankings(spark, sf):
    return R.performance_rankings(view(spark, sf, "derived"))


@register("top_per_generation", "with " + LATEST + """
select * from (select v.experiment_id, v.generation_number, v.variant_id, activity_score,
       cast(row_number() over (partition by v.experiment_id, v.generation_number order by activity_score desc, v.variant_id) as int) as rank
  from {variants} v join latest l on l.variant_id = v.variant_id where activity_score is not null) where rank <= 3""")
def top_per_generation(spark, sf):
    nodes = R.similarity_nodes(view(spark, sf, "variants"), view(spark, sf, "derived"))
    return R.top_per_generation(nodes, 3).select(
        "experiment_id", "generation_number", "variant_id", "activity_score", "rank")


@register("generation_group_ranks", """
select experiment_id, generation_number, variant_id,
       row_number() over (partition by experiment_id, generation_number order by variant_id) - 1 as group_rank,
       count(*) over (partition by experiment_id, generation_number) as group_size
from {variants}""")
def generation_group_ranks(spark, sf):
    return R.group_sizes(view(spark, sf, "variants").select("experiment_id", "generation_number", "variant_id"))


@register("natural_order_positions", """
select experiment_id, variant_id, plasmid_variant_index,
       row_number() over (partition by experiment_id order by
         case when regexp_full_match(plasmid_variant_index, '[0-9]+') then cast(plasmid_variant_index as bigint) end asc nulls last,
         plasmid_variant_index asc, variant_id) as place
from {indexed}""")
def natural_order_positions(spark, sf):
    rows = view(spark, sf, "indexed").select("experiment_id", "variant_id", "plasmid_variant_index")
    return rank_all(rows, ["experiment_id"], [*R.natural_order(), F.col("variant_id").asc()], rank="place")


@register("top_of_generation", "with " + LATEST + """
select * from (select v.generation_id, v.variant_id, activity_score,
       cast(row_number() over (partition by v.generation_id order by activity_score desc, v.variant_id desc) as int) as rank
  from {variants} v join latest l on l.variant_id = v.variant_id where activity_score is not null) where rank <= 5""")
def top_of_generation(spark, sf):
    return R.top_of_generation(view(spark, sf, "variants"), view(spark, sf, "derived")).select(
        "generation_id", "variant_id", "activity_score", "rank")


@register("fallback_variants", """
with n as (select variant_id, count(*) filter (where is_synonymous is false or is_synonymous is null) as nonsyn_count
           from {mutations} where mutation_type = 'protein' group by 1)
select experiment_id, generation_id, variant_id, nonsyn_count, rank from (
  select v.experiment_id, v.generation_id, v.variant_id, coalesce(n.nonsyn_count, 0) as nonsyn_count,
         cast(row_number() over (partition by v.generation_id order by coalesce(n.nonsyn_count, 0) desc, v.variant_id desc) as int) as rank
  from {variants} v left join n on n.variant_id = v.variant_id) where rank = 1""")
def fallback_variants(spark, sf):
    return R.fallback_variants(view(spark, sf, "variants"), view(spark, sf, "mutations"))


@register("latest_generation", """
select experiment_id, generation_id, generation_number from (
  select *, row_number() over (partition by experiment_id order by generation_number desc, generation_id desc) as rn from {generations}) where rn = 1""")
def latest_generation(spark, sf):
    return R.latest_generation(view(spark, sf, "generations"))


@register("resolve_variant_ids", """
select v.experiment_id, v.generation_number, v.plasmid_variant_index, max(w.variant_id) as variant_id
from {indexed} v join {indexed} w on w.experiment_id = v.experiment_id and w.generation_number = v.generation_number
 and w.plasmid_variant_index = v.plasmid_variant_index group by 1, 2, 3""")
def resolve_variant_ids(spark, sf):
    known = view(spark, sf, "indexed")
    keys = known.select("experiment_id", "generation_number", "plasmid_variant_index").distinct()
    return R.resolve_variant_ids(keys.withColumn("variant_id", F.lit(None).cast("bigint")), known)


@register("change_lists", """
select variant_id, string_agg(label, ', ' order by position, mutation_id, label) as aa_changes,
       string_agg(cast(position as varchar(20)), ', ' order by position, mutation_id, label) as aa_sites
from (select *, concat(original, cast(position as varchar(20)), mutated) as label from {mutations}) where mutation_type = 'protein' group by 1""")
def change_lists(spark, sf):
    return R.change_lists(view(spark, sf, "mutations"))


@register("enriched_top10", "with " + LATEST + "," + SCORED.lstrip() + """,
best as (select * from (
  select v.experiment_id, v.variant_id, l.activity_score, l.total, coalesce(l.syn, 0) as syn, coalesce(l.nonsyn, 0) as nonsyn,
         cast(row_number() over (partition by v.experiment_id order by l.activity_score desc, v.variant_id) as int) as rank
  from {variants} v join latest l on l.variant_id = v.variant_id where l.activity_score is not null) where rank <= 10),
lists as (select variant_id, string_agg(concat(original, cast(position as varchar(20)), mutated), ', '
              order by position, mutation_id, concat(original, cast(position as varchar(20)), mutated)) as aa_changes
          from {mutations} where mutation_type = 'protein' group by 1)
select b.experiment_id, b.rank, b.variant_id, b.activity_score, cast(b.total as int) as total_mutations,
       case when b.total = 0 then 'No mutation detected' when b.nonsyn > 0 and b.syn > 0 then 'Mixed (synonymous + non-synonymous)'
            when b.nonsyn > 0 then 'Non-synonymous' when b.syn > 0 then 'Synonymous-only' else 'Unknown' end as mutation_class,
       lists.aa_changes, s.qc_stage4, s.qc_stage4 <> 'ok' as qc_flagged
from best b left join lists on lists.variant_id = b.variant_id left join scored s on s.variant_id = b.variant_id""")
def enriched_top10(spark, sf):
    return R.enriched_top_variants(
        view(spark, sf, "variants"), view(spark, sf, "derived"), view(spark, sf, "mutations"),
        scored_variants(spark, sf),
    ).select("experiment_id", "rank", "variant_id", "activity_score", "total_mutations", "mutation_class",
             "aa_changes", "qc_stage4", "qc_flagged")


@register("experiment_kpis", "with " + LATEST + """,
wide as (
  select v.experiment_id, v.variant_id, v.generation_number, l.activity_score, l.total, l.syn,
         a.variant_id as analysed, (select count(*) from {mutations} m where m.variant_id = v.variant_id and m.mutation_type = 'protein') as prot
  from {variants} v left join latest l on l.variant_id = v.variant_id left join {analysis} a on a.variant_id = v.variant_id),
agg as (
  select experiment_id, count(*) as total_records, concat('G', cast(min(generation_number) as varchar(9)), ' to G', cast(max(generation_number) as varchar(9))) as generations_covered,
         avg(activity_score) as activity_mean, quantile_cont(activity_score, 0.5) as activity_median, max(activity_score) as activity_best,
         round_even(count(*) filter (where total > 0) / count(analysed) * 100, 1) as mutated_percent,
         cast(sum(syn) as bigint) as syn, cast(sum(prot) as bigint) as nonsyn
  from wide group by 1),
common as (select experiment_id, string_agg(concat(label, ' (', cast(n as varchar(20)), ')'), ', ' order by rn) as most_common_mutations from (
  select *, row_number() over (partition by experiment_id order by n desc, label) as rn from (
    select v.experiment_id, concat(m.original, cast(m.position as varchar(20)), m.mutated) as label, count(*) as n
    from {mutations} m join {variants} v on v.variant_id = m.variant_id where m.mutation_type = 'protein' group by 1, 2)) where rn <= 3 group by 1)
select agg.experiment_id, total_records, generations_covered, round(activity_mean, 6) as activity_mean, round(activity_median, 6) as activity_median,
       activity_best, mutated_percent, most_common_mutations, printf('%d:%d (%.2f)', syn, nonsyn, syn / nonsyn) as syn_non_syn_ratio
from agg left join common on common.experiment_id = agg.experiment_id""")
def experiment_kpis(spark, sf):
    df = kpi.experiment_kpis(view(spark, sf, "variants"), view(spark, sf, "derived"),
                             view(spark, sf, "mutations"), view(spark, sf, "analysis"))
    return rounded(df, "activity_mean", "activity_median")


@register("analysis_completeness", """
select e.experiment_id, e.status, count(v.variant_id) as total_variants, count(a.variant_id) as analysed_variants,
       count(a.variant_id) as analysis_rows, count(v.protein_sequence) as protein_ready,
       count(v.variant_id) > 0 and count(a.variant_id) >= count(v.variant_id) as outputs_complete,
       count(v.variant_id) > 0 and (e.status = 'FAILED' or count(a.variant_id) < count(v.variant_id) or count(v.protein_sequence) = 0) as needs_backfill
from {experiments} e left join {variants} v on v.experiment_id = e.experiment_id left join {analysis} a on a.variant_id = v.variant_id group by 1, 2""")
def analysis_completeness(spark, sf):
    return kpi.completeness(view(spark, sf, "variants"), view(spark, sf, "analysis"), view(spark, sf, "experiments"))


@register("owned_variants", """
select v.variant_id from {variants} v join {experiments} e on e.experiment_id = v.experiment_id where e.user_id = 1""")
def owned_variants(spark, sf):
    return R.owned_variants(view(spark, sf, "variants"), view(spark, sf, "experiments"), 1).select("variant_id")


@register("protein_windows", """
with f as (select variant_id, cast(min(position % 32 + 1) as int) as position from {mutations} where mutation_type = 'protein' group by 1)
select v.variant_id, f.position, substr(v.protein_sequence, greatest(f.position - 10, 1), least(32, f.position + 10) - greatest(f.position - 10, 1) + 1) as "window"
from {variants} v join f on f.variant_id = v.variant_id where v.protein_sequence is not null""")
def protein_windows(spark, sf):
    firsts = view(spark, sf, "mutations").where("mutation_type = 'protein'").groupBy("variant_id").agg(
        F.min(F.col("position") % 32 + 1).cast("int").alias("position"))
    return R.protein_windows(view(spark, sf, "variants"), firsts)
