"""Campaign tables derived from the benchmark star schema.

The given tables hold no variants, so each view below re-reads one of them as a
campaign table. The SQL text is plain enough to run unchanged on other engines,
which is how the results are checked.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from evospark.session import spread as spread_rows

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_CODONS = ["GCT", "TGC", "GAT", "GAA", "TTC", "GGT", "CAC", "ATC", "AAA", "CTG", "AAC", "CCG", "CAG", "CGT", "AGC", "TGG"]


def coded(text: str) -> str:
    """SQL of a stop-free coding text: every hexadecimal digit becomes a codon."""
    for digit, codon in zip("0123456789abcdef", _CODONS):
        text = f"replace({text}, '{digit}', '{codon}')"
    return text


def gene_of(experiment: str) -> str:
    """SQL of an experiment's wild-type gene: start codon and 64 codons."""
    return "concat('ATG', " + ", ".join(coded(f"md5(concat('{s}', cast({experiment} as varchar(9))))") for s in "gh") + ")"


def bases_of(text: str) -> str:
    """SQL of 32 pseudo-random bases."""
    return f"translate(md5({text}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


VIEWS: dict[str, str] = {
    # One order is one variant: five experiments, one generation per year.
    "experiments": """
        select distinct cast(o_custkey % 5 as bigint) as experiment_id,
               cast(o_custkey % 5 % 2 as bigint) as wt_id,
               cast(o_custkey % 5 % 3 as bigint) as user_id,
               case when o_custkey % 5 = 4 then 'FAILED' else 'ANALYSED' end as status
        from {orders}""",
    "generations": """
        select distinct cast((o_custkey % 5) * 100 + year(o_orderdate) - 1995 as bigint) as generation_id,
               cast(o_custkey % 5 as bigint) as experiment_id,
               cast(year(o_orderdate) - 1995 as int) as generation_number
        from {orders}""",
    "variants": """
        select o_orderkey as variant_id,
               cast(o_custkey % 5 as bigint) as experiment_id,
               cast((o_custkey % 5) * 100 + year(o_orderdate) - 1995 as bigint) as generation_id,
               cast(year(o_orderdate) - 1995 as int) as generation_number,
               cast(o_orderkey as varchar(20)) as plasmid_variant_index,
               o_custkey as parent_variant_index,
               case when o_orderstatus = 'P' then null else concat(
                    substr(translate(md5(cast(o_custkey % 5 as varchar(20))), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'), 1, cast(o_orderkey % 31 as int)),
                    substr('ACDEFGHIKLMNPQRS', cast(o_custkey % 16 + 1 as int), 1),
                    substr(translate(md5(cast(o_custkey % 5 as varchar(20))), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'), cast(o_orderkey % 31 + 2 as int), 40))
               end as protein_sequence
        from {orders}""",
    # Every line item is a yield measurement; returned lines are controls,
    # except in the last generation, which stays without a baseline.
    "metrics": """
        select (l.l_orderkey * 100 + l.l_linenumber * 10 + n.k) * 1000000000 + l.l_partkey * 1000 + l.l_suppkey % 1000 as metric_id,
               v.generation_id,
               case when l.l_returnflag = 'R' and v.generation_number < 6 then null else l.l_orderkey end as variant_id,
               case when l.l_returnflag = 'R' and v.generation_number < 6 then v.generation_id end as wt_control_id,
               case when n.k = 1 then 'dna_yield_raw' when l.l_linenumber = 7 then 'protein_yield' else 'protein_yield_raw' end as metric_name,
               'raw' as metric_type,
               case when n.k = 1 then l.l_extendedprice else l.l_quantity end as value,
               case when n.k = 1 then 'fg' else 'pg' end as unit,
               cast(null as bigint) as metric_definition_id
        from {lineitem} l
        join {variants} v on v.variant_id = l.l_orderkey
        {one_and_two}""",
    # Values stored by earlier runs: several per variant, the newest counts.
    "derived": """
        select (l.l_orderkey * 100 + l.l_linenumber * 10 + 3) * 1000000000 + l.l_partkey * 1000 + l.l_suppkey % 1000 as metric_id,
               v.generation_id,
               l.l_orderkey as variant_id,
               cast(null as bigint) as wt_control_id,
               case when l.l_linenumber <= 3 then 'activity_score'
                    when l.l_linenumber = 4 then 'mutation_total_count'
                    when l.l_linenumber = 5 then 'mutation_synonymous_count'
                    else 'mutation_nonsynonymous_count' end as metric_name,
               'derived' as metric_type,
               case when l.l_linenumber <= 3 then l.l_extendedprice / l.l_quantity
                    else cast(cast(l.l_quantity as int) % 6 as double) end as value
        from {lineitem} l join {variants} v on v.variant_id = l.l_orderkey""",
    "mutations": """
        select l_orderkey * 1000000 + l_partkey % 10000 * 100 + l_suppkey % 10 * 10 + l_linenumber as mutation_id,
               l_orderkey as variant_id,
               case when l_linenumber = 6 then 'dna' else 'protein' end as mutation_type,
               cast(l_partkey % 400 + 1 as int) as position,
               substr('ACDEFGHIKLMNPQRSTVWY', cast(l_partkey % 20 + 1 as int), 1) as original,
               substr('CDEFGHIKLMNPQRSTVWYA', cast((l_partkey + l_suppkey) % 20 + 1 as int), 1) as mutated,
               case when l_returnflag = 'N' then null else l_linestatus = 'F' end as is_synonymous
        from {lineitem}""",
    # Variants whose sequence analysis is stored.
    "analysis": """
        select distinct l_orderkey as variant_id, 1 as stored from {lineitem} where l_linenumber <= 4""",
    "features": """
        select p_partkey as feature_id,
               cast(p_partkey % 2 as bigint) as wt_id,
               case when p_size % 3 = 0 then 'Domain' when p_size % 3 = 1 then 'Region' else 'Binding site' end as feature_type,
               case when p_partkey % 4 = 3 then null else concat('feature ', cast(p_partkey % 7 as varchar(20))) end as description,
               cast(p_partkey * 37 % 380 + 1 as int) as start_position,
               cast(p_partkey * 37 % 380 + 1 + p_size as int) as end_position
        from {part}""",
    # Two forests over the parts in heap order: the parent of node j is (j-1)/2.
    "lineage": """
        select p_partkey as variant_id,
               cast(p_partkey % 2 as bigint) as experiment_id,
               case when p_partkey >= 2 then cast(floor((floor(p_partkey / 2) - 1) / 2) as bigint) * 2 + p_partkey % 2 end as parent_variant_id,
               cast(length(bin(cast(floor(p_partkey / 2) as bigint) + 1)) - 1 as int) as generation_number,
               round(p_retailprice * (1 + p_size / 100.0), 4) as activity_score
        from {part}""",
    "lineage_mutations": """
        select l_partkey as variant_id,
               case when l_linenumber = 6 then 'dna' else 'protein' end as mutation_type,
               cast(l_suppkey % 23 + 1 as int) as position,
               substr('ACDEFGHIKLMNPQRSTVWY', cast(l_suppkey % 19 + 1 as int), 1) as original,
               substr('CDEFGHIKLMNPQRSTVWYA', cast(l_linenumber as int), 1) as mutated,
               case when l_returnflag = 'N' then null else l_linestatus = 'F' end as is_synonymous
        from {lineitem}""",
    # Uploaded records as text, with the faults that uploads have.
    "records": f"""
        select concat('batch-', cast(o_custkey % 5 as varchar(9))) as file_path,
               o_orderkey + 2 as row_number,
               case when o_orderkey % 50 = 7 then concat('v', cast(o_orderkey as varchar(20)))
                    when o_orderkey % 97 = 3 then cast(o_custkey as varchar(20))
                    when o_orderkey % 211 = 5 then '' else cast(o_orderkey as varchar(20)) end as variant_index,
               case when o_orderkey % 41 = 5 then 'INVALID' when year(o_orderdate) = 1998 then '9' else cast(year(o_orderdate) - 1994 as varchar(9)) end as generation,
               case when o_orderkey % 7 = 2 then 'NULL' when o_orderkey % 53 = 1 then 'none' else cast(o_custkey as varchar(20)) end as parent_variant_index,
               case when o_orderkey % 61 = 4 then 'N/A' when o_orderkey % 67 = 4 then null else cast(o_totalprice / 80 as varchar(30)) end as dna_yield,
               case when o_orderkey % 71 = 4 then '' else cast(o_totalprice / 200 as varchar(30)) end as protein_yield,
               case when o_orderkey % 43 = 9 then '' when o_orderkey % 37 = 9 then 'ACGTXQ12' when o_orderkey % 5 = 0 then 'ACGTN'
                    else concat({bases_of("concat('p', cast(o_orderkey as varchar(20)))")}, {bases_of("concat('q', cast(o_orderkey as varchar(20)))")},
                                {bases_of("concat('r', cast(o_orderkey as varchar(20)))")}, {bases_of("concat('s', cast(o_orderkey as varchar(20)))")}) end as assembled_dna_sequence,
               case when o_orderkey % 13 = 0 then 'True' when o_orderkey % 13 = 1 then 'no' else '' end as control,
               o_orderpriority as priority
        from {{orders}}""",
    "wild_types": f"""
        select experiment_id, gene as wt_cds, concat(substr(backbone, 1, 20), gene, 'TAA', substr(backbone, 21, 12)) as wt_plasmid from (
          select experiment_id, {gene_of("experiment_id")} as gene, {bases_of("concat('b', cast(experiment_id as varchar(9)))")} as backbone from {{experiments}})""",
    # Variant genes: one edit each, or a codon moved; then the circle is cut at
    # another place.
    "genes": f"""
        select variant_id, experiment_id, kind, p, concat(
                 case when kind = 3 then concat(substr(gene, 1, 3 * p), codon, substr(gene, 3 * p + 1, 300))
                      when kind = 4 then concat(substr(gene, 1, 3 * p), substr(gene, 3 * p + 4, 300))
                      when kind = 5 then concat(substr(gene, 1, 3 * p), substr(gene, 3 * p + 2, 300))
                      when kind = 6 then concat(substr(gene, 1, 3 * p), 'N', substr(gene, 3 * p + 2, 300))
                      when kind = 7 then concat(substr(gene, 1, 3 * p), codon, substr(gene, 3 * p + 1, 12), substr(gene, 3 * p + 16, 300))
                      when kind = 8 then concat(substr(gene, 1, 3 * p), 'TGA', substr(gene, 3 * p + 4, 300))
                      when kind = 9 then concat(substr(gene, 1, 3 * p), codon, substr(gene, 3 * p + 4, 6), codon, substr(gene, 3 * p + 13, 300))
                      else concat(substr(gene, 1, 3 * p), codon, substr(gene, 3 * p + 4, 300)) end, '') as gene
        from (
          select o.o_orderkey as variant_id, w.experiment_id, cast(o.o_orderkey % 10 as int) as kind, cast(o.o_custkey % 60 + 1 as int) as p, w.wt_cds as gene,
                 substr('GCCTGTGACGAGTTTGGACATATTAAGCTTAATCCACAACGATCATGG', cast(o.o_orderkey % 16 * 3 + 1 as int), 3) as codon
          from {{orders}} o join {{wild_types}} w on w.experiment_id = o.o_custkey % 5)""",
    "plasmids": f"""
        select variant_id, experiment_id, concat(substr(circle, cut + 1, 400), substr(circle, 1, cut)) as assembled_dna_sequence from (
          select variant_id, experiment_id, cast(variant_id % 230 as int) as cut,
                 concat(gene, 'TAA', {bases_of("concat('b', cast(experiment_id as varchar(9)))")}) as circle from {{genes}})""",
    "indexed": """
        select o_orderkey as variant_id,
               cast(o_custkey % 5 as bigint) as experiment_id,
               cast(year(o_orderdate) - 1995 as int) as generation_number,
               case when o_orderstatus = 'P' and o_orderkey % 3 = 0 then concat('clone ', cast(o_orderkey as varchar(20)))
                    else cast(cast(floor(o_totalprice) as bigint) % 5000 as varchar(20)) end as plasmid_variant_index
        from {orders}""",
}

# Views whose row texts are costly to build.
COSTLY = {"genes", "records"}

SPARK_PARTS = {"one_and_two": "lateral view explode(array(1, 2)) n as k"}
PORTABLE_PARTS = {"one_and_two": "cross join (select unnest([1, 2]) as k) n"}


def _placeholders(sql: str) -> list[str]:
    return list(dict.fromkeys(name for _, name, _, _ in Formatter().parse(sql) if name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived campaign table (or a given table) as a lazy DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    return run_sql(spark, sf_dir, VIEWS[name], spread=name in COSTLY)


def run_sql(spark: SparkSession, sf_dir: str, sql: str, *, spread: bool = False) -> DataFrame:
    """SQL over views and tables named as ``{placeholders}``."""
    names = _placeholders(sql)
    frames = {n: view(spark, sf_dir, n) for n in names if n not in SPARK_PARTS}
    if spread:
        frames = {n: spread_rows(df) if n in TABLES else df for n, df in frames.items()}
    for part, text in SPARK_PARTS.items():
        sql = sql.replace("{" + part + "}", text)
    return spark.sql(sql, **frames)


def portable_sql(sql: str) -> str:
    """The same SQL as one standalone statement: views become a WITH list."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for dep in _placeholders(VIEWS[name]):
                visit(dep)
            ordered.append(name)

    for name in _placeholders(sql):
        visit(name)

    def filled(text: str) -> str:
        names = {n: (f"v_{n}" if n in VIEWS else n) for n in _placeholders(text)}
        return text.format(**{**names, **PORTABLE_PARTS})

    body = filled(sql).strip()
    if not ordered:
        return body
    head = ", ".join(f"v_{n} as ({filled(VIEWS[n]).strip()})" for n in ordered)
    if body.lower().startswith("with recursive "):
        return f"with recursive {head}, {body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {head}, {body[len('with '):]}"
    return f"with {head} {body}"
