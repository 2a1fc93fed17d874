"""Personal data: pattern spans, and terms that disclose them.

Patterns find emails, IP addresses, card and phone numbers. Every value found is
a protected entity. The corpus then says how strongly a nearby term reveals it:
with p(e|t) the share of the documents holding term t in which t stands next to
entity e, the pointwise mutual information ``ln(p(e|t) / p(e))`` is compared
with the entity's information content ``-ln p(e)``. A term whose share of that
information reaches ``GENERALISE`` is replaced by a placeholder, from ``REMOVE``
it is removed, in the documents that hold the entity. Terms need ``SUPPORT``
different surroundings with the entity, so copies of one text prove nothing.
Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evospark.llm.common import free_name, shielded, stored

# Kinds in their order, each with its pattern. Possessive repeats
# and the look-behind only spare backtracking; the matches are those of the
# plain patterns of the query's contract.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"\p{L}{3,}"
REACH = 80
"""Characters on either side of an entity in which a term counts as near it."""

SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.98


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    digits = _digits(match)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    backwards = F.reverse(digits)
    doubled = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: backwards.substr(i, F.lit(1)).cast("int")
                          * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(doubled, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0))
    return F.when(F.length(digits).between(16, 19), total % 10 == 0).otherwise(False)


def _entity(kind: str, match: Column) -> Column:
    return F.lower(match) if kind == "email" else match if kind == "ip" else _digits(match)


SPAN = "array<struct<kind:string,start:int,end:int,match:string>>"


def _located(text: Column, pattern: Column, valid, kind: str) -> Column:
    """Spans (kind, start, end, match) of a pattern's valid matches, in order."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    steps = F.arrays_zip(gaps.alias("gap"), found.alias("match"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["match"].alias("match"))
        keep = x["match"].isNotNull() & valid(x["match"])
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """All pattern spans, by kind as listed and then by start."""
    none = F.array().cast(SPAN)
    return F.concat(*(
        F.when(text.contains("@") if kind == "email" else text.rlike(GUARDS[kind]),
               _located(text, F.lit(p), lambda m, k=kind: _valid(k, m), kind)).otherwise(none)
        for kind, p in PATTERNS.items()))


def _key(text: Column) -> Column:
    """Documents with equal texts have equal spans, so the text's hash identifies a row's decision."""
    return F.xxhash64(text)


def _entities(spotted: DataFrame, text: str, spans: str) -> DataFrame:
    """(key, entity, before, after) of every base span."""
    value = F.lit(None).cast("string")
    for kind in PATTERNS:
        value = F.when(F.col("s.kind") == kind, F.concat(F.lit(kind + ":"), _entity(kind, F.col("s.match")))).otherwise(value)
    near = lambda a, n: F.col(text).substr(a, n)
    begin = F.greatest(F.col("s.start") - REACH, F.lit(0))
    return spotted.where(F.size(spans) > 0).select(text, F.explode(spans).alias("s")).select(
        _key(F.col(text)).alias("key"), value.alias("entity"),
        near(begin + 1, F.col("s.start") - begin).alias("before"), near(F.col("s.end") + 1, F.lit(REACH)).alias("after"))


def disclosing_terms(spotted: DataFrame, text: str, spans: str, support: int = SUPPORT,
                     generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, strength): PMI over information content, for the terms that reach ``generalise``."""
    found = stored(_entities(spotted, text, spans).distinct(), "entities")
    around = found.withColumn("term", F.explode(F.array_distinct(F.concat(
        F.regexp_extract_all("before", F.lit(TERM), F.lit(0)), F.regexp_extract_all("after", F.lit(TERM), F.lit(0))))))
    # The outermost words of a window may be cut; their halves are rare and simply lack support.
    pairs = around.groupBy("entity", "term", F.xxhash64("before", "after").alias("surrounding")).agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("surroundings"))
    pairs = stored(pairs.where(F.col("surroundings") >= support), "pairs")
    with_copies = spotted.groupBy(_key(F.col(text)).alias("key")).agg(F.count("*").alias("copies"))
    copies = stored(with_copies, "copies")
    joint = (around.join(pairs, ["entity", "term"]).select("entity", "term", "key").distinct()
             .join(copies, "key").groupBy("entity", "term").agg(F.sum("copies").alias("together")))
    holders = found.select("entity", "key").distinct().join(copies, "key").groupBy("entity").agg(F.sum("copies").alias("holders"))
    # Document frequency over the whole corpus, counted before the candidates are picked out.
    words = spotted.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0)))).alias("term"))
    frequency = words.groupBy("term").agg(F.count("*").alias("documents"))
    total = copies.agg(F.sum("copies").alias("total"))  # one row
    rated = joint.join(holders, "entity").join(frequency, "term").crossJoin(total)
    share = F.ln(F.col("together") / F.col("documents") * F.col("total") / F.col("holders")) / F.greatest(
        F.ln(F.col("total") / F.col("holders")), F.lit(1e-9))
    return stored(rated.select("entity", "term", share.alias("strength")).where(F.col("strength") >= generalise), "terms")


def with_spans(docs: DataFrame, text: str, spans: str) -> DataFrame:
    """``docs`` with the pattern spans of column ``text`` and the disclosing terms of the row, as
    ``spans`` and ``spans_terms`` (term -> strength)."""
    spotted = stored(docs.withColumn(spans, base_spans(F.col(text))), "spotted")
    terms = disclosing_terms(spotted, text, spans)
    held = stored(_entities(spotted, text, spans).select("key", "entity").distinct(), "held")
    per_text = held.join(terms, "entity").groupBy("key", "term").agg(F.max("strength").alias("strength"))
    per_text = per_text.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "strength")))).alias("terms"))
    per_text = stored(per_text, "per_text")  # bounded by the words near a text's own entities
    return spotted.join(per_text, _key(F.col(text)) == per_text["key"], "left").drop("key").withColumnRenamed("terms", f"{spans}_terms")


def _any_of(terms: Column) -> Column:
    return F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.map_keys(terms), "|"), F.lit(r")(?!\p{L})"))


def pii_table(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of each kind, base_sha256, spans (patterns, then disclosing terms).

    Offsets are code points, end exclusive. A null text is an empty one; rows
    with null or repeated ids and repeated texts are all returned.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = with_spans(rows, "text", "s")
    terms = F.when(F.col("s_terms").isNotNull(), _located(
        F.col("text"), _any_of(F.col("s_terms")), lambda m: F.lit(True), "term")).otherwise(F.array().cast(SPAN))
    shown = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = found.select("doc_id", "s", shown(F.col("s")).alias("base"), shown(terms).alias("added"))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return base.select("doc_id", *(count(k) for k in PATTERNS), F.sha2(F.col("base"), 256).alias("base_sha256"),
                       F.concat_ws(",", F.when(F.col("base") != "", F.col("base")),
                                   F.when(F.col("added") != "", F.col("added"))).alias("spans"))


def _masked(text: Column, kind: str, present: Column) -> Column:
    """``text`` with the valid matches of one kind replaced by the kind in brackets."""
    pattern = F.lit(PATTERNS[kind])

    def joined(t: Column) -> Column:
        return F.array_join(F.zip_with(
            F.split(t, pattern, -1), F.regexp_extract_all(t, pattern, F.lit(0)),
            lambda gap, m: F.concat(gap, F.when(m.isNull(), "").when(_valid(kind, m), f"[{kind.upper()}]").otherwise(m))), "")

    return F.transform(F.array(text), lambda t: F.when(present, joined(t)).otherwise(t))[0]


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind in brackets and disclosing
    terms generalised or removed; null texts stay null and ``n_chars``, if present, follows the text."""
    return shielded(docs, ["doc_id", "text", "n_chars"], _sanitised)


def _sanitised(docs: DataFrame) -> DataFrame:
    source, spans = free_name(docs, "_source"), free_name(docs, "_spans")
    found = with_spans(docs.withColumn(source, F.coalesce(F.col("text").cast("string"), F.lit(""))), source, spans)
    terms = F.col(f"{spans}_terms")
    drop = F.map_filter(terms, lambda _, v: v >= REMOVE)
    mask = F.map_filter(terms, lambda _, v: v < REMOVE)
    out = F.col(source)
    for kind in PATTERNS:
        out = _masked(out, kind, F.exists(F.col(spans), lambda s: s["kind"] == kind))  # noqa: B023
    out = F.when(F.size(drop) > 0, F.regexp_replace(out, _any_of(drop), F.lit(""))).otherwise(out)
    out = F.when(F.size(mask) > 0, F.regexp_replace(out, _any_of(mask), F.lit("[TERM]"))).otherwise(out)
    touched = (F.size(spans) > 0) & F.col("text").isNotNull()
    clean = found.withColumn(source, F.when(touched, out).otherwise(F.col("text")))
    columns = [F.when(touched, F.length(source)).otherwise(F.col(c)).cast(t).alias(c) if c == "n_chars"
               else F.col(source).alias(c) if c == "text" else F.col(f"`{c}`") for c, t in docs.dtypes]
    return clean.select(*columns)
