"""Lineage queries: closure, chains, trajectories, trends, nearest parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evospark.operators import lineage as L
from evospark.operators.ranking import flag_top, top_per_generation
from evospark.plans.registry import register
from evospark.plans.reports import rounded
from evospark.plans.views import view

WALK = """
walk (ancestor_id, descendant_id, distance) as (
  select variant_id, variant_id, 0 from {lineage}
  union all
  select l.parent_variant_id, w.descendant_id, w.distance + 1
  from walk w join {lineage} l on l.variant_id = w.ancestor_id where l.parent_variant_id is not null)"""


def _nodes(spark, sf: str) -> DataFrame:
    return view(spark, sf, "lineage")


def _closure(spark, sf: str) -> DataFrame:
    nodes = _nodes(spark, sf)
    return L.lineage_closure(L.lineage_edges(nodes), nodes)


@register("lineage_edges", """
select c.experiment_id, p.variant_id as parent_id, c.variant_id as child_id
from {lineage} c join {lineage} p on p.variant_id = c.parent_variant_id and p.experiment_id = c.experiment_id""")
def lineage_edges(spark, sf):
    return L.lineage_edges(_nodes(spark, sf))


@register("lineage_closure", "with recursive " + WALK + " select ancestor_id, descendant_id, distance from walk")
def lineage_closure(spark, sf):
    return _closure(spark, sf)


@register("ancestor_chains", "with recursive " + WALK + """
select w.descendant_id as target_id, w.ancestor_id as variant_id, w.distance as depth, l.experiment_id, l.generation_number
from walk w join {lineage} l on l.variant_id = w.ancestor_id""")
def ancestor_chains(spark, sf):
    return L.ancestor_chains(_closure(spark, sf), _nodes(spark, sf))


@register("lineage_roots", "with recursive " + WALK + """
select descendant_id as variant_id, arg_max(ancestor_id, distance) as root_id, max(distance) as depth from walk group by 1""")
def lineage_roots(spark, sf):
    return L.lineage_roots(_closure(spark, sf))


@register("subtree_nodes", "with recursive " + WALK + """
select w.ancestor_id as root_id, w.descendant_id as variant_id, l.parent_variant_id, l.generation_number, w.distance as depth
from walk w join {lineage} l on l.variant_id = w.descendant_id join {lineage} r on r.variant_id = w.ancestor_id
where r.generation_number = 2 and w.distance <= 4""")
def subtree_nodes(spark, sf):
    nodes = _nodes(spark, sf)
    return L.subtree(_closure(spark, sf), nodes, nodes.where("generation_number = 2"), 4)


@register("highlighted_edges", "with recursive " + WALK + """,
seeds as (select variant_id from (select *, row_number() over (partition by experiment_id, generation_number order by activity_score desc, variant_id) as rn
          from {lineage} where activity_score is not null) where rn <= 3),
kept as (select distinct ancestor_id as id from walk where descendant_id in (select variant_id from seeds))
select experiment_id, parent_variant_id as parent_id, variant_id as child_id from {lineage}
where parent_variant_id in (select id from kept) and variant_id in (select id from kept)""")
def highlighted_edges(spark, sf):
    nodes = _nodes(spark, sf)
    return L.highlighted_subgraph(nodes, L.lineage_edges(nodes), _closure(spark, sf), 3)[1]


@register("top10_branches", "with recursive " + WALK + """,
seeds as (select variant_id from (select *, row_number() over (partition by experiment_id order by activity_score desc, variant_id) as rn
          from {lineage} where activity_score is not null) where rn <= 10)
select distinct l.experiment_id, l.variant_id, l.generation_number, case when s.variant_id is null then 0 else 1 end as is_top10
from walk w join {lineage} l on l.variant_id = w.ancestor_id left join seeds s on s.variant_id = l.variant_id
where w.descendant_id in (select variant_id from seeds)""")
def top10_branches(spark, sf):
    nodes = flag_top(_nodes(spark, sf))
    kept = L.with_ancestors(_closure(spark, sf), nodes.where("is_top10 = 1"))
    return nodes.join(kept, "variant_id", "left_semi").select(
        "experiment_id", "variant_id", "generation_number", "is_top10")


@register("consecutive_edges", """
select c.experiment_id, p.variant_id as parent_id, c.variant_id as child_id
from {lineage} c join {lineage} p on p.variant_id = c.parent_variant_id where c.generation_number - p.generation_number = 1""")
def consecutive_edges(spark, sf):
    nodes = _nodes(spark, sf)
    return L.consecutive_edges(L.lineage_edges(nodes), nodes)


@register("connected_nodes", """
select variant_id from {lineage} l where parent_variant_id is not null
   or exists (select 1 from {lineage} c where c.parent_variant_id = l.variant_id)""")
def connected_nodes(spark, sf):
    nodes = _nodes(spark, sf)
    return L.connected_only(nodes, L.lineage_edges(nodes)).select("variant_id")


@register("introduction_events", "with recursive " + WALK + """
select target_id, position, original, mutated, introduced_variant_id, introduced_generation,
       concat(original, '>', mutated) as label, concat(original, cast(position as varchar(9)), mutated) as full_label from (
  select w.descendant_id as target_id, m.position, m.original, m.mutated, w.ancestor_id as introduced_variant_id, l.generation_number as introduced_generation,
         row_number() over (partition by w.descendant_id, m.position, m.original, m.mutated order by w.distance desc) as rn
  from walk w join {lineage_mutations} m on m.variant_id = w.ancestor_id join {lineage} l on l.variant_id = w.ancestor_id
  where m.mutation_type = 'protein' and (m.is_synonymous is false or m.is_synonymous is null)) where rn = 1""")
def introduction_events(spark, sf):
    chains = L.ancestor_chains(_closure(spark, sf), _nodes(spark, sf))
    return L.introduction_events(chains, view(spark, sf, "lineage_mutations"))


@register("cumulative_trajectory", "with recursive " + WALK + """,
firsts as (select w.descendant_id, m.position, m.original, m.mutated, max(w.distance) as depth
           from walk w join {lineage_mutations} m on m.variant_id = w.ancestor_id
           where m.mutation_type = 'protein' and m.is_synonymous is false group by 1, 2, 3, 4),
n as (select descendant_id, depth, count(*) as fresh from firsts group by 1, 2)
select w.descendant_id as target_id, w.ancestor_id as variant_id, w.distance as depth,
       cast(sum(coalesce(n.fresh, 0)) over (partition by w.descendant_id order by w.distance desc) as bigint) as cumulative_nonsyn
from walk w left join n on n.descendant_id = w.descendant_id and n.depth = w.distance""")
def cumulative_trajectory(spark, sf):
    chains = L.ancestor_chains(_closure(spark, sf), _nodes(spark, sf))
    return L.cumulative_trajectory(chains, view(spark, sf, "lineage_mutations")).select(
        "target_id", "variant_id", "depth", "cumulative_nonsyn")


@register("chain_nonsyn_counts", "with recursive " + WALK + """,
n as (select variant_id, count(distinct (position, original, mutated)) as nonsyn_count from {lineage_mutations}
      where mutation_type = 'protein' and is_synonymous is false group by 1)
select w.descendant_id as target_id, w.ancestor_id as variant_id, w.distance as depth, coalesce(n.nonsyn_count, 0) as nonsyn_count
from walk w left join n on n.variant_id = w.ancestor_id""")
def chain_nonsyn_counts(spark, sf):
    chains = L.ancestor_chains(_closure(spark, sf), _nodes(spark, sf))
    return L.chain_nonsyn_counts(chains, view(spark, sf, "lineage_mutations")).select(
        "target_id", "variant_id", "depth", "nonsyn_count")


@register("branch_trend", "with recursive " + WALK + """,
seeds as (select variant_id from (select *, row_number() over (partition by experiment_id order by activity_score desc, variant_id) as rn
          from {lineage} where activity_score is not null) where rn <= 10),
pts as (select experiment_id, generation_number as x, activity_score as y from {lineage}
        where variant_id in (select ancestor_id from walk where descendant_id in (select variant_id from seeds)))
select experiment_id, count(*) as points, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, round(corr(x, y), 6) as r_value
from pts group by 1""")
def branch_trend(spark, sf):
    df = L.branch_trend(_nodes(spark, sf), _closure(spark, sf))
    return rounded(df.select("experiment_id", "points", "slope", "intercept", "r_value"), "slope", "intercept", "r_value")


@register("branch_trend_significance")
def branch_trend_significance(spark, sf):
    return L.branch_trend(_nodes(spark, sf), _closure(spark, sf))


@register("generation_trend", """
with m as (select experiment_id, generation_number, avg(activity_score) as y from {lineage} where activity_score is not null group by 1, 2)
select experiment_id, count(*) as points, round(regr_slope(y, generation_number), 6) as slope, round(regr_intercept(y, generation_number), 6) as intercept,
       round(corr(generation_number, y), 6) as r_value from m group by 1""")
def generation_trend(spark, sf):
    df = L.generation_trend(_nodes(spark, sf))
    return rounded(df.select("experiment_id", "points", "slope", "intercept", "r_value"), "slope", "intercept", "r_value")


@register("nearest_index_edges", """
with n as (select *, try_cast(plasmid_variant_index as double) as idx from {indexed})
select experiment_id, parent_id, child_id from (
  select c.experiment_id, p.variant_id as parent_id, c.variant_id as child_id,
         row_number() over (partition by c.variant_id order by abs(p.idx - c.idx), p.variant_id) as rn
  from n c join n p on p.experiment_id = c.experiment_id and p.generation_number = c.generation_number - 1 and abs(p.idx - c.idx) <= 3.0)
where rn = 1""")
def nearest_index_edges(spark, sf):
    return L.nearest_index_edges(view(spark, sf, "indexed"), 3.0)


@register("resolve_parents", """
select c.variant_id, p.variant_id as parent_variant_id
from {variants} c left join {variants} p on p.experiment_id = c.experiment_id and p.generation_number = c.generation_number - 1
 and p.plasmid_variant_index = cast(c.parent_variant_index as varchar(20)) and c.parent_variant_index >= 0 and c.generation_number > 0""")
def resolve_parents(spark, sf):
    known = view(spark, sf, "variants")
    return L.resolve_parents(known, known).select("variant_id", "parent_variant_id")


@register("reparented_variants", """
select variant_id, parent_variant_id, case when activity_score > 1000 then null else parent_variant_id end as old_parent_id
from {lineage} where activity_score > 1000 and parent_variant_id is not null""")
def reparented_variants(spark, sf):
    new = _nodes(spark, sf)
    old = new.withColumn("parent_variant_id", F.when(F.col("activity_score") <= 1000, F.col("parent_variant_id")))
    return L.reparented(old, new)


@register("top_generation_nodes", """
select experiment_id, generation_number, variant_id, rank from (
  select *, cast(row_number() over (partition by experiment_id, generation_number order by activity_score desc, variant_id) as int) as rank
  from {lineage} where activity_score is not null) where rank <= 3""")
def top_generation_nodes(spark, sf):
    return top_per_generation(_nodes(spark, sf), 3).select("experiment_id", "generation_number", "variant_id", "rank")
