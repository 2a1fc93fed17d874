"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic). The cells' weights are
raked to the target shares of each margin in turn until all margins agree;
documents are then drawn with a probability proportional to weight over tokens
of their cell, so the expected token shares are the targets; cells with fewer
tokens than their share of the sample are kept whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evospark.llm.common import batch_words, free_name, mix, shielded, stored

MARGINS = ("source", "lang", "topic")
TOPICS = 8
FLATTEN = 0.7
"""Target share of a value: its token share to this power, normalised."""

KEPT_SHARE = 0.9
"""Share of all tokens that a sample is expected to hold."""

TOLERANCE = 1e-6
ROUNDS_PER_WRITE = 3


def lexical_topic(docs: DataFrame, name: str, topics: int = TOPICS) -> DataFrame:
    """Adds int column ``name``: the vocabulary bucket that most of the text's distinct words of
    the whole text fall into (smallest bucket on ties; null without words), and ``name``_words."""

    def label(batches):
        for batch in batches:
            found, counts = [], []
            for words, _, _ in batch_words(batch.column(batch.num_columns - 1)):
                counts.append(len(words))
                bucket = mix(np.unique(words) ^ np.uint64(7)) >> np.uint64(40)
                found.append(int(np.bincount((bucket % np.uint64(topics)).astype(np.int64)).argmax()) if len(words) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int32()), pa.array(counts, pa.int64())],
                                             names=[*batch.schema.names[:-1], name, f"{name}_words"])

    text = free_name(docs, "_text")
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.select("*", F.col("text").cast("string").alias(text)).mapInArrow(
        label, f"{fields}, `{name}` int, `{name}_words` long")


def flattened_targets(cells: DataFrame, margin: str, power: float = FLATTEN) -> DataFrame:
    """(value, share): token shares of a margin raised to ``power``."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("p"))
    return sums.crossJoin(sums.agg(F.sum("p").alias("all"))).select("value", (F.col("p") / F.col("all")).alias("share"))  # one row


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with a column ``weight`` whose margins are the targets.

    A target of an absent value is ignored and the rest is scaled to one; cells
    whose value has no target at all get no weight and are left out. Where
    the targets contradict each other over the cells present (they can't all be
    met), rounds end as soon as they no longer come closer.
    """
    base = stored(cells.where("tokens > 0"), "cells")
    total = base.agg(F.sum("tokens")).first()[0] or 1
    out = base.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for m, target in targets.items():
        # Written, so that neither the next margin nor the rounds carry its plan.
        present = stored(target.join(base.select(F.col(m).alias("value")).distinct(), "value").select("value", "share"), "targets")
        scale = present.agg(F.sum("share")).first()[0] or 1.0
        out = out.join(present.select(F.col("value").alias(m), (F.col("share") / F.lit(float(scale))).alias(f"_target_{m}")), m)
    out = stored(out, "cells")
    before = float("inf")
    while True:
        for _ in range(ROUNDS_PER_WRITE):
            for m in targets:
                out = out.withColumn("weight", F.col("weight") * F.col(f"_target_{m}") / F.sum("weight").over(Window.partitionBy(m)))
        out = stored(out, "raked")
        off = max(
            out.groupBy(m).agg(F.abs(F.sum("weight") / F.first(f"_target_{m}") - 1).alias("off")).agg(F.max("off")).first()[0] or 0.0
            for m in targets)
        if off <= tolerance or off >= before * 0.9:
            return out.drop(*(f"_target_{m}" for m in targets))
        before = off


def sampling_scale(weights: DataFrame, kept_share: float | None) -> float:
    """The factor c for which probabilities min(1, c * weight / tokens) keep ``kept_share`` of the tokens.

    The cells that c saturates are kept whole and the others share the rest of the
    budget in proportion to their weights, until no further cell is saturated.
    Without a share, c is the largest factor that saturates no cell, and all
    targets are met. The size of a sample then hangs on the rarest cell.
    """
    if kept_share is None:
        return float(weights.agg(F.min(F.col("tokens") / F.col("weight"))).first()[0] or 1.0)
    budget = kept_share * float(weights.agg(F.sum("tokens")).first()[0] or 0)
    c = 0.0
    while True:
        full = F.col("weight") * c >= F.col("tokens")
        whole, rest = weights.agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not rest:  # every cell is whole
            return c
        more = (budget - float(whole or 0)) / rest
        if more <= c * (1 + 1e-12):
            return max(c, more)
        c = more


def _uniform(*key: Column) -> Column:
    """A repeatable number in [0, 1) per row key."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(1 << 53))


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: int = 11,
          kept_share: float | None = KEPT_SHARE) -> DataFrame:
    """``docs`` with topic, n_tokens (words), weight, probability, saturated and sampled in a struct ``mix`` (a
    free name): the first returned column that ``docs`` lacks.

    The probability is min(1, c * weight / tokens of the cell), with c such that ``kept_share`` of all tokens
    is expected in the sample: every draw is without repetition. A saturated cell is kept whole, so its values
    fall short of their targets; a rare cell never shrinks the sample. ``kept_share=None`` saturates none.
    Null source or language is a value of its own. Documents without words have no
    tokens at stake and are kept with their cell's probability, or dropped
    where the cell has no tokens. Rows with equal id and text are drawn together.
    """
    topic = free_name(docs, "_topic")
    while f"{topic}_words".lower() in {c.lower() for c in docs.columns}:
        topic = free_name(docs.withColumn(topic, F.lit(0)), topic)
    labelled = stored(lexical_topic(docs, topic), "topics")
    keys = {"source": F.coalesce(F.col("source").cast("string"), F.lit("\0")),
            "lang": F.coalesce(F.col("lang").cast("string"), F.lit("\0")),
            "topic": F.coalesce(F.col(topic), F.lit(-1))}
    cells = stored(labelled.groupBy(*(k.alias(m) for m, k in keys.items())).agg(F.sum(f"{topic}_words").alias("tokens")), "cells")
    weights = rake(cells, targets or {m: flattened_targets(cells.where("tokens > 0"), m) for m in MARGINS})
    c = sampling_scale(weights, kept_share)
    at = {m: free_name(labelled, f"_rate_{m}") for m in (*MARGINS, "weight", "share")}
    rates = stored(weights.select(
        *(F.col(m).alias(at[m]) for m in MARGINS), F.col("weight").alias(at["weight"]),
        F.least(F.lit(1.0), F.lit(c) * F.col("weight") / F.col("tokens")).alias(at["share"])), "rates")
    on = [k == F.col(at[m]) for m, k in keys.items()]
    joined = labelled.join(rates, on, "left")
    p = F.coalesce(F.col(at["share"]), F.lit(0.0))
    name = free_name(docs, "mix")
    return joined.select(*(f"`{c}`" for c in docs.columns), F.struct(
        F.col(topic).alias("topic"), F.col(f"{topic}_words").alias("n_tokens"), F.coalesce(F.col(at["weight"]), F.lit(0.0)).alias("weight"),
        p.alias("probability"), (p >= 1).alias("saturated"),
        (_uniform(F.col("doc_id"), F.col("text"), F.lit(seed)) < p).alias("sampled")).alias(name))


def sampled_documents(docs: DataFrame, targets: dict[str, DataFrame] | None = None, kept_share: float | None = KEPT_SHARE) -> DataFrame:
    """The sampled rows of ``docs`` with their own columns, whatever these are called."""

    def drawn(rows: DataFrame) -> DataFrame:
        out = mixed(rows, targets, kept_share=kept_share)
        return out.where(F.col(f"`{out.columns[-1]}`.sampled"))

    return shielded(docs, ["doc_id", "text", "lang", "source"], drawn)
