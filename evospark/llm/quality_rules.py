"""Quality rules with risk-controlled cutoffs.

Every rule rejects a document whose measure lies above a cutoff. For each stratum
(language) the labelled good documents are a holdout: a cutoff may be used only
if an exact binomial (Clopper-Pearson) test shows, at a confidence shared by all
tests (Bonferroni over strata, rules and cutoffs), that the rule rejects at most
its share of good documents. With probability ``confidence`` no stratum then
loses more than ``max_false_rejection`` of its good documents to all rules
together. Among the allowed cutoffs the one that separates best is taken, and
none where no cutoff is allowed (too few labels). Everything is DataFrame and
SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evospark.llm.common import WORD, free_name, shielded, stored

RULES = {
    "symbols": "least(1D, n_symbols / greatest(word_chars, 1))",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "marks": "least(1D, n_marks / greatest(n_words, 1))",
}
CUTOFFS = [0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8, 0.9]
MAX_FALSE_REJECTION = 0.04
CONFIDENCE = 0.95
PENALTY = 20
"""How many rejected bad documents (as a share) one rejected good document must be worth."""

MIN_WORDS = 20
WINDOW = 8


def measures(text: Column) -> Column:
    """Struct of the counts of a whole text; null and empty texts count nothing."""
    def let(value: Column, body) -> Column:  # evaluates ``value`` once
        return F.transform(F.array(value), body)[0]

    def count_chars(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")

    def repeated(words: Column) -> Column:
        size = F.size(words)
        hashes = F.when(size >= WINDOW, F.transform(
            F.sequence(F.lit(1), size - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))

        def covered(pairs: Column) -> Column:
            at = F.filter(F.transform(pairs, lambda x, i: F.when(
                (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"]), x["p"])),
                lambda p: p.isNotNull())
            return let(F.sort_array(at), lambda s: F.aggregate(
                F.transform(s, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW)))),
                F.lit(0), lambda a, b: a + b))

        return F.coalesce(let(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), covered))
            .otherwise(0)), F.lit(0)).cast("long")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(words, lambda w: let(lines, lambda x: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        count_chars(r"[#*$%&|<>]+").alias("n_symbols"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated(w).alias("n_repeat_words"),
        F.size(x).cast("long").alias("n_lines"),
        count_chars(r"\p{Lu}+").alias("n_capitals"),
        count_chars(r"[!?]+").alias("n_marks"),
    )))


def measured(docs: DataFrame, keep: list[str], at: str) -> DataFrame:
    """``keep`` columns and a struct column ``at`` with the measures, computed once and stored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return stored(docs.select(*keep, measures(text).alias(at)), "measured")


def _log_gamma(x: str) -> str:
    """ln Gamma for x >= 1: Stirling's series eight steps further on."""
    z = f"({x} + 8D)"
    product = " * ".join(f"({x} + {i}D)" for i in range(8))
    return (f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1D / (12 * {z}) - 1D / (360 * pow({z}, 3))"
            f" + 1D / (1260 * pow({z}, 5)) - ln({product}))")


def binomial_tail(k: str, n: str, p: float) -> Column:
    """P(Bin(n, p) <= k) for integer columns; the terms are summed from k downwards
    until they no longer count (each is smaller than the one before when k <= n p);
    1 where k lies above the mean."""
    term = (f"exp({_log_gamma(f'({n} + 1D)')} - {_log_gamma('(i + 1D)')} - {_log_gamma(f'({n} - i + 1D)')}"
            f" + i * ln({p}D) + ({n} - i) * ln(1 - {p}D))")
    terms = f"transform(sequence(greatest(0L, {k} - 200L - cast(60 * sqrt({n} * {p}D) as bigint)), {k}), i -> {term})"
    return F.expr(f"case when {n} = 0 or {k} > {n} * {p}D then 1D "
                  f"else least(1D, aggregate({terms}, 0D, (a, b) -> a + b)) end")


def calibrated(values: DataFrame, labels: DataFrame, at: str, stratum: Column,
               max_false_rejection: float = MAX_FALSE_REJECTION, confidence: float = CONFIDENCE) -> DataFrame:
    """(stratum, rule, cutoff) of the chosen cutoffs; at most one row per stratum and rule.

    ``labels`` has doc_id and quality (1 good, 0 bad; rows without either are
    left out, and the lowest of several labels counts).
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    rates = F.array(*(F.struct(F.lit(r).alias("rule"), F.expr(e).alias("rate")) for r, e in RULES.items()))
    seen = values.select("doc_id", stratum.alias("stratum"), f"{at}.*").select("doc_id", "stratum", rates.alias("rates"))
    # Histogram over the cutoffs passed, then sums from above: no row is repeated per cutoff.
    passed = F.aggregate(F.array(*map(F.lit, CUTOFFS)), F.lit(0), lambda n, c: n + (F.col("r.rate") > c).cast("int"))
    counts = (
        seen.join(known, "doc_id").select("stratum", "good", F.explode("rates").alias("r"))
        .groupBy("stratum", F.col("r.rule").alias("rule"), passed.alias("passed"))
        .agg(F.count_if(F.col("good") >= 1).alias("good"), F.count_if(F.col("good") < 1).alias("bad"))
    )
    cells = counts.select("stratum", "rule", "good", "bad", "passed", F.explode(F.sequence(F.lit(0), F.lit(len(CUTOFFS) - 1))).alias("step"))
    totals = cells.groupBy("stratum", "rule", "step").agg(
        F.sum("good").alias("n"), F.sum("bad").alias("n_bad"),
        F.sum(F.when(F.col("passed") > F.col("step"), F.col("good")).otherwise(0)).alias("k"),
        F.sum(F.when(F.col("passed") > F.col("step"), F.col("bad")).otherwise(0)).alias("k_bad"))
    share = max_false_rejection / len(RULES)
    tests = totals.agg(F.countDistinct("stratum").alias("strata"))
    level = (1 - confidence) / (len(RULES) * len(CUTOFFS))
    worth = F.expr(f"k_bad / greatest(n_bad, 1) - {PENALTY} * k / greatest(n, 1)")
    allowed = totals.crossJoin(tests).where(  # one row
        (binomial_tail("k", "n", share) <= level / F.col("strata")) & (worth > 0))
    cutoff = F.element_at(F.array(*map(F.lit, CUTOFFS)), F.col("step") + 1)
    best = allowed.groupBy("stratum", "rule").agg(F.max_by(cutoff, F.struct(worth, "step")).alias("cutoff"))
    return stored(best, "cutoffs")


def judged(values: DataFrame, cutoffs: DataFrame, at: str, stratum: Column, verdict: str) -> DataFrame:
    """``values`` with a struct ``verdict``: base_failed, kept, and the rules that reject."""
    taken = {r: f"cutoff_{i}" for i, r in enumerate(RULES)}
    wide = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(
        *(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(c) for r, c in taken.items()))
    wide = stored(wide.select("_stratum", F.struct(*taken.values()).alias("_cutoffs")), "strata")
    hits = F.filter(F.array(*(F.when(F.expr(_of(e, at)) > F.col(f"_cutoffs.{taken[r]}"), F.lit(r)) for r, e in RULES.items())),
                    lambda x: x.isNotNull())
    base = (F.col(f"{at}.n_words") < MIN_WORDS) | (100 * F.col(f"{at}.n_repeat_words") > 30 * F.col(f"{at}.n_words"))
    joined = values.withColumn("_key", stratum).join(wide, F.col("_key") == F.col("_stratum"), "left")
    return joined.withColumn(verdict, F.struct(
        base.alias("base_failed"), (~base & (F.size(hits) == 0)).alias("kept"), F.array_join(hits, ",").alias("rules"))
    ).drop("_key", "_stratum", "_cutoffs")


def _of(expression: str, at: str) -> str:
    for name in ("n_symbols", "word_chars", "n_repeat_words", "n_words", "n_dup_lines", "n_lines", "n_capitals", "n_marks"):
        expression = expression.replace(name, f"`{at}`.{name}")
    return expression


def _stratum() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rules per row.

    One row per input row, also for null ids, repeated rows and null texts (no
    words, so base_failed). A null language and an empty one are one stratum.
    """
    values = measured(docs, ["doc_id", "lang"], "m")
    out = judged(values, calibrated(values, labels, "m", _stratum()), "m", _stratum(), "v")
    return out.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
                      "v.base_failed", "v.kept", "v.rules")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns, whatever these are called."""
    return shielded(docs, ["doc_id", "text", "lang"], lambda d: _kept(d, labels))


def _kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    at, verdict = free_name(docs, "_measures"), free_name(docs, "_verdict")
    values = measured(docs, [f"`{c}`" for c in docs.columns], at)
    out = judged(values, calibrated(values, labels, at, _stratum()), at, _stratum(), verdict)
    return out.where(f"`{verdict}`.kept").select(*(f"`{c}`" for c in docs.columns))
