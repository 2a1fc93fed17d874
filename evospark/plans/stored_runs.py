"""Queries over a campaign store: what is stored after a run, a second run and an upload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evospark.plans import stored_flows
from evospark.plans.analyses import CDS, _mappings
from evospark.plans.registry import register
from evospark.plans.views import view
from evospark.session import many_partitions, scratch_path
from evospark.sources.stores import CampaignStore, Version

DONE = "generation_number <= 2"
"""Variants of the first generations count as analysed before the run."""


def _campaign(spark, sf: str) -> tuple[CampaignStore, Version]:
    """A store of the derived campaign in which the later generations are still to be analysed."""
    store = CampaignStore(spark, scratch_path(spark, "campaign"), parts=16)
    home = view(spark, sf, "variants")
    variants = home.join(view(spark, sf, "plasmids").select("variant_id", "assembled_dna_sequence"), "variant_id").select(
        "variant_id", "experiment_id", "generation_id", "generation_number", F.lit(None).cast("bigint").alias("parent_variant_id"),
        "plasmid_variant_index", "assembled_dna_sequence", F.when(F.expr(DONE), F.lit("DONE")).alias("protein_sequence"),
        F.lit(None).cast("map<string,string>").alias("extra_metadata"))
    owner = home.select("variant_id", "experiment_id")
    mutations = view(spark, sf, "mutations").withColumn("annotation", F.lit(None).cast("string"))
    metrics = view(spark, sf, "derived").select(
        "metric_id", "generation_id", "variant_id", "wt_control_id", "metric_name", "metric_type", "value",
        F.lit(None).cast("string").alias("unit"), F.lit(None).cast("bigint").alias("metric_definition_id"))
    experiments = view(spark, sf, "experiments").select("experiment_id", F.lit("RAW").alias("status"))
    return store, stored_flows.create_store(store, {
        "experiments": experiments, "variants": variants, "generations": view(spark, sf, "generations"),
        "mutations": mutations.join(owner, "variant_id"), "metrics": metrics.join(owner, "variant_id")})


def _contents(store: CampaignStore, version: Version) -> DataFrame:
    """Per experiment: status and what is stored for its variants."""
    def per_experiment(table: str, condition: str, name: str) -> DataFrame:
        return store.read(table, version).groupBy("experiment_id").agg(F.count_if(F.expr(condition)).alias(name))

    done = store.read("variants", version).where(DONE).select("variant_id")
    untouched = store.read("mutations", version).join(done, "variant_id").groupBy("experiment_id").agg(F.count("*").alias("old_mutations"))
    out = store.read("experiments", version).select("experiment_id", "status")
    for counted in (per_experiment("variants", "protein_sequence = 'DONE'", "done_variants"),
                    per_experiment("variant_sequence_analysis", "true", "analyses"),
                    per_experiment("metrics", "metric_name like 'mutation%count'", "count_metrics"), untouched):
        out = out.join(counted, "experiment_id", "left")
    return out.na.fill(0).withColumn("version", F.lit(version.number))


RUN = """,
todo as (select * from {variants} where generation_number > 2),
st as (select c.experiment_id, case when bool_or(cds_dna = '' or length(cds_dna) % 3 <> 0 or (protein_aa <> '' and length(protein_aa) < length(wt_protein)))
          then 'ANALYSED_WITH_ERRORS' else 'ANALYSED' end as status from cds c join todo t on t.variant_id = c.variant_id group by 1),
o as (select d.metric_name, d.variant_id, v.experiment_id, v.generation_number from {derived} d join {variants} v on v.variant_id = d.variant_id
      where d.metric_name in ('mutation_total_count', 'mutation_synonymous_count', 'mutation_nonsynonymous_count')),
m as (select experiment_id, count(*) as n from o where generation_number <= 2 group by 1),
u as (select v.experiment_id, count(*) as n from {mutations} x join {variants} v on v.variant_id = x.variant_id where v.generation_number <= 2 group by 1),
a as (select experiment_id, count(*) as n from todo group by 1),
d as (select experiment_id, count(*) as n from {variants} where generation_number <= 2 group by 1)
select e.experiment_id, coalesce(st.status, 'RAW') as status, coalesce(d.n, 0) as done_variants, coalesce(a.n, 0) as analyses,
       coalesce(m.n, 0) + 3 * coalesce(a.n, 0) as count_metrics, coalesce(u.n, 0) as old_mutations, 2 as version
from {experiments} e left join st on st.experiment_id = e.experiment_id left join d on d.experiment_id = e.experiment_id
left join a on a.experiment_id = e.experiment_id left join m on m.experiment_id = e.experiment_id left join u on u.experiment_id = e.experiment_id"""


@register("stored_sequence_run", "with " + CDS + RUN)
def stored_sequence_run(spark, sf):
    store, _ = _campaign(many_partitions(spark), sf)
    return _contents(store, stored_flows.run_sequences(store, _mappings(spark, sf)))


@register("stored_sequence_rerun", "with " + CDS + RUN)
def stored_sequence_rerun(spark, sf):
    """The second run finds nothing to do: same version, same contents."""
    store, _ = _campaign(many_partitions(spark), sf)
    stored_flows.run_sequences(store, _mappings(spark, sf))
    return _contents(store, stored_flows.run_sequences(store, _mappings(spark, sf)))


@register("stored_upload_merge", """
with fresh as (select * from {variants} where generation_number >= 2 and experiment_id in (1, 2)),
raw as (select experiment_id, count(*) as n from fresh group by 1),
old as (select experiment_id, count(*) as n, count(*) filter (where generation_number <= 2) as done from {variants} group by 1),
m as (select v.experiment_id, count(*) as n from {derived} d join {variants} v on v.variant_id = d.variant_id
      where not (v.generation_number >= 2 and v.experiment_id in (1, 2)) group by 1),
u as (select v.experiment_id, count(*) as n from {mutations} x join {variants} v on v.variant_id = x.variant_id
      where not (v.generation_number >= 2 and v.experiment_id in (1, 2)) group by 1),
p as (select experiment_id, count(*) filter (where generation_number <= 1) as done from {variants} where experiment_id in (1, 2) group by 1)
select old.experiment_id, old.n as variants, coalesce(p.done, old.done) as done_variants, coalesce(m.n, 0) + 2 * coalesce(raw.n, 0) as metrics,
       coalesce(u.n, 0) as mutations, old.experiment_id in (1, 2) as rewritten
from old left join raw on raw.experiment_id = old.experiment_id left join m on m.experiment_id = old.experiment_id
left join u on u.experiment_id = old.experiment_id left join p on p.experiment_id = old.experiment_id""")
def stored_upload_merge(spark, sf):
    """A re-upload of two experiments: only their buckets get new files."""
    store, first = _campaign(spark, sf)
    fresh = view(spark, sf, "variants").where("generation_number >= 2 and experiment_id in (1, 2)").select(
        F.lit("upload").alias("file_path"), F.col("variant_id").alias("_row_number"), "experiment_id",
        F.col("plasmid_variant_index").alias("variant_index"), F.col("generation_number").cast("string").alias("generation"),
        F.lit(None).cast("string").alias("parent_variant_index"), F.lit("GGGG").alias("assembled_dna_sequence"),
        F.lit("500.5").alias("dna_yield"), F.lit("40").alias("protein_yield"), F.lit("False").alias("control"),
        F.lit(None).cast("map<string,string>").alias("metadata"))
    second = stored_flows.store_upload(store, fresh, ("uploads", 0))
    changed = [k for k, p in second.folders["variants"].items() if first.folders["variants"].get(k) != p]
    out = store.read("variants", second).groupBy("experiment_id").agg(
        F.count("*").alias("variants"), F.count_if(F.col("protein_sequence") == "DONE").alias("done_variants"))
    for table in ("metrics", "mutations"):
        out = out.join(store.read(table, second).groupBy("experiment_id").agg(F.count("*").alias(table)), "experiment_id", "left")
    return out.na.fill(0).withColumn("rewritten", store.part_of(F.col("experiment_id"), second).isin(changed))
