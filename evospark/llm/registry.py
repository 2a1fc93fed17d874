"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evospark.llm import (
    divergence, licenses, mixing, ngram_join, packing, paragraph_dedup, pii, quality_rules, sharding, spelling, token_output,
    topk, toxicity,
)
from evospark.llm.common import table
from evospark.llm.term_checks import DIVERGENCE_SQL, SPELLING_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


@_register
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_register
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "mix.*")


@_register
def op4_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.ring_shards(table(spark, sf_dir, "documents"))


@_register
def op5_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"))


@_register
def op6_pii_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_table(table(spark, sf_dir, "documents"))


@_register
def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"))


@_register
def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@_register
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licensed(licenses.document_paths(table(spark, sf_dir, "documents")))


@_register
def op10_repair_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read_documents(token_output.write_shards(table(spark, sf_dir, "documents")))


@_register
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


@_register
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


@_register
def op13_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_CAPITALS = r"\p{Lu}+"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

_NGRAM_SQL = f"""
with recursive w as (
  select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select doc_id, list_sort(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end) as s from w),
sets as (select s, min(doc_id) as rep, len(s) as n from s where len(s) > 0 group by s),
e as (select rep, n, unnest(s) as g from sets),
links as (select a.rep as x, b.rep as y from e a join e b on a.g = b.g and a.rep < b.rep group by a.rep, b.rep, a.n, b.n
          having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways as (select x, y from links union all select y, x from links),
reach as (select rep as x, rep as y from sets union select r.x, b.y from reach r join both_ways b on b.x = r.y),
roots as (select x, min(y) as root from reach group by x)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(roots.root, s.doc_id) as component_id, coalesce(sets.rep, s.doc_id) as set_id
from s left join sets on sets.s = s.s left join roots on roots.x = sets.rep"""

_TOPK_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(coalesce(list_sum(list_transform(range(1, len(c.e) + 1), lambda i: q.e[i] * c.e[i])), 0) as bigint) as score
      from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.e) = len(q.e)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""


def _quality_sql() -> str:
    q = quality_rules
    rates = ", ".join(f"{{'rule': '{r}', 'rate': cast({e.replace('1D', '1.0')} as double)}}" for r, e in q.RULES.items())
    p = q.MAX_FALSE_REJECTION / len(q.RULES)
    level = (1 - q.CONFIDENCE) / (len(q.RULES) * len(q.CUTOFFS))
    worth = f"k_bad / greatest(n_bad, 1) - {q.PENALTY} * k / greatest(n, 1)"
    count = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    return f"""
with d as (select row_number() over () as row, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t from documents),
w as (select *, {_WORDS.format('t')} as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
windows as (select row, i, count(*) over (partition by row, array_to_string(w[i:i + 7], ' ')) as times
            from (select row, w, unnest(range(1, len(w) - 6)) as i from w)),
repeats as (select row, count(distinct j) as n_repeat_words from (select row, unnest(range(i, i + 8)) as j from windows where times > 1) group by row),
m as (select row, doc_id, stratum, len(w) as n_words, length(array_to_string(w, '')) as word_chars, {count('[#*$%&|<>]+')} as n_symbols,
        len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(lines) as n_lines,
        {count(_CAPITALS)} as n_capitals, {count('[!?]+')} as n_marks from w left join repeats using (row)),
x as (select *, unnest([{rates}]) as r from m),
known as (select doc_id, min(quality) as good from labels where doc_id is not null and quality is not null group by doc_id),
seen as (select stratum, r.rule as rule, r.rate as rate, good >= 1 as good from x join known using (doc_id)),
cells as (select stratum, rule, cutoff, count(*) filter (where good) as n, count(*) filter (where not good) as n_bad,
            count(*) filter (where good and rate > cutoff) as k, count(*) filter (where not good and rate > cutoff) as k_bad
          from seen cross join (select unnest({q.CUTOFFS}) as cutoff) group by stratum, rule, cutoff),
allowed as (select *, {worth} as worth from cells where n > 0 and k <= n * {p} and {worth} > 0
            and list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln({1 - p}))))
                <= {level} / (select count(distinct stratum) from cells)),
chosen as (select stratum, rule, arg_max(cutoff, (worth, cutoff)) as cutoff from allowed group by stratum, rule),
hits as (select row, string_agg(rule, ',' order by list_position({list(q.RULES)}, rule)) as rules from
           (select x.row, x.r.rule as rule from x join chosen c on c.stratum = x.stratum and c.rule = x.r.rule where x.r.rate > c.cutoff) group by row),
v as (select m.*, n_words < {q.MIN_WORDS} or 100 * n_repeat_words > 30 * n_words as base_failed, coalesce(rules, '') as rules from m left join hits using (row))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and rules = '' as kept, rules from v"""


#: SQL of the queries that it can express.
CHECKS: dict[str, str] = {
    "op1_ngram_join": _NGRAM_SQL, "op2_quality_rules": _quality_sql(), "op7_exact_topk": _TOPK_SQL,
    "op11_spelling_variants": SPELLING_SQL, "op12_source_divergence": DIVERGENCE_SQL,
}
