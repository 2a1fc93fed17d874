"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer maps every word to a symbol: insult, threat, target,
negation, reporting verb or other. Insults are learned as weighted prefix arcs
(up to eight bytes of a word and its end) from labelled documents; the other
symbols are fixed words. Three transducers then rewrite the symbols of a clause:
what stands behind a reporting verb is reported, what a negation governs is
negated, and insults and threats with a target become targeted. They are
composed into one table, which reads all clauses of a batch side by side. The
weights of the rewritten matches, by kind, are the features of a document, and a
logistic model fitted on the labelled rows turns them into the score. Labels,
language, source and doc_id are no features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evospark.llm.common import stored
from evospark.llm.terms import PACKED, Runs, batch_runs, codes, distinct

FIT_ROWS = 8_000
"""Labelled documents of each class that the arcs and the model are learned from, at most."""

ARCS = 4_096
"""Insult arcs in the lexicon, at most: the ones with most evidence."""

DEPTHS = range(3, PACKED + 1)
LEAST_TOXIC = 3
LEAST_WEIGHT = 1.5
PRIOR = 3.0
RIDGE = 1e-2
SCOPE = 3
"""Words behind a negation that it governs."""

# Words of the other symbols in four languages.
THREATS = "kill hurt destroy burn shoot stab beat die töten umbringen schlagen verbrennen sterben tuer frapper brûler mourir crever matar golpear quemar morir"
TARGETS = "you your yours yourself he him she her they them du dich dir dein deine euch ihr sie tu te toi ton ta vous votre tú ti tuyo usted ustedes él ella ellos"
NEGATIONS = "not no never none neither nor isn aren don doesn nicht kein keine nie niemals pas jamais aucun nunca jamás ningún"
REPORTS = "said says say wrote claims claimed called quoted sagte sagt schrieb behauptet nannte dit écrit déclare appelle dijo dice escribió llamó"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
REPORTED, NEGATED, AIMED, AIMED_THREAT, LATE_TARGET = range(6, 11)
_SYMBOLS = 11
KINDS = (INSULT, AIMED, NEGATED, REPORTED, AIMED_THREAT, LATE_TARGET)

_CLAUSE_END = np.zeros(256, dtype=bool)
_CLAUSE_END[list(b".!?;:,\n|\"()")] = True


@dataclass
class Transducer:
    """``step[state, symbol]`` is the next state, ``out[state, symbol]`` the symbol written; state 0 is the start."""

    step: np.ndarray
    out: np.ndarray

    @classmethod
    def passing(cls, states: int) -> Transducer:
        """Stays in every state and writes what it reads."""
        return cls(np.tile(np.arange(states)[:, None], (1, _SYMBOLS)), np.tile(np.arange(_SYMBOLS), (states, 1)))

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes."""
        n = len(other.step)
        written = self.out[:, None, :]
        second = np.arange(n)[None, :, None]
        step = self.step[:, None, :] * n + other.step[second, written]
        out = other.out[second, written]
        return Transducer(step.reshape(-1, _SYMBOLS), out.reshape(-1, _SYMBOLS))


def reported_speech() -> Transducer:
    t = Transducer.passing(2)
    t.step[0, REPORT] = 1
    t.out[1, INSULT], t.out[1, THREAT] = REPORTED, OTHER
    return t


def negation(scope: int = SCOPE) -> Transducer:
    t = Transducer.passing(scope + 1)
    t.step[1:] -= 1
    t.step[:, NEGATION] = scope
    t.out[1:, INSULT], t.out[1:, THREAT] = NEGATED, OTHER
    return t


def targeting() -> Transducer:
    free, seen, insult, threat = range(4)
    t = Transducer.passing(4)
    t.step[:, TARGET] = seen
    t.step[free, INSULT] = t.step[threat, INSULT] = insult
    t.step[free, THREAT] = t.step[insult, THREAT] = threat
    t.out[seen, INSULT], t.out[seen, THREAT] = AIMED, AIMED_THREAT
    t.out[insult, TARGET], t.out[threat, TARGET] = LATE_TARGET, AIMED_THREAT
    return t


GRAMMAR = reported_speech().then(negation()).then(targeting())


def rewritten(symbols: np.ndarray, clause: np.ndarray, grammar: Transducer = GRAMMAR) -> np.ndarray:
    """What the grammar writes for each symbol; ``clause`` numbers the clauses in ascending order.

    All clauses that hold an insult or a threat are read side by side; the others are copied.
    """
    out = symbols.copy()
    live = np.isin(clause, np.unique(clause[(symbols == INSULT) | (symbols == THREAT)]))
    at = np.flatnonzero(live)
    if not len(at):
        return out
    begin = np.flatnonzero(np.concatenate(([True], clause[at][1:] != clause[at][:-1])))
    size = np.diff(np.append(begin, len(at)))
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    state = np.zeros(len(begin), dtype=np.int64)
    for i in range(int(size[0])):
        n = int(np.searchsorted(-size, -i, side="left"))  # clauses with more than i words
        here = at[begin[:n] + i]
        read = symbols[here]
        out[here] = grammar.out[state[:n], read]
        state[:n] = grammar.step[state[:n], read]
    return out


def _word_codes(words: str) -> np.ndarray:
    runs = next(batch_runs(pa.array(words.split())))
    return np.unique(runs.packed(closed=True))


_FIXED = ((THREAT, _word_codes(THREATS)), (TARGET, _word_codes(TARGETS)), (NEGATION, _word_codes(NEGATIONS)), (REPORT, _word_codes(REPORTS)))


def _depth_mask(depth: int) -> int:
    """The first ``depth`` bytes of a packed word, as a signed long."""
    mask = (1 << 64) - (1 << (64 - 8 * depth))
    return mask - (1 << 64)


@dataclass
class Lexicon:
    """Insult arcs with the toxic and clean (document, word) pairs that support them."""

    arcs: np.ndarray  # packed prefixes, sorted
    toxic: np.ndarray
    clean: np.ndarray
    share: float  # toxic share of the documents learned from

    def weights(self, label: int | None = None) -> np.ndarray:
        """Log-odds of the arcs; for a labelled document its own support is taken out."""
        t = np.maximum(self.toxic - (label == 1), 0)
        c = np.maximum(self.clean - (label == 0), 0)
        p = (t + PRIOR * self.share) / (t + c + PRIOR)
        return np.maximum(np.log(p / (1 - p)) - np.log(self.share / (1 - self.share)), 0.0)


def _toxic_by_document(labels: DataFrame) -> DataFrame:
    known = labels.where("doc_id is not null and toxic is not null")
    return known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") >= 1, 1).otherwise(0)).alias("toxic"))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by five (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of up to ``fit_rows`` labelled documents per class that are not held out,
    chosen by a hash of the id."""
    known = _toxic_by_document(labels).where(~held_out(F.col("doc_id")))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [known.where(F.col("toxic") == y).orderBy(*order).limit(fit_rows) for y in (1, 0)]
    sample = stored(chosen[0].unionByName(chosen[1]), "fit")
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select("doc_id", text.alias("text")).join(F.broadcast(sample), "doc_id")  # 2 * fit_rows ids at most


def learned_lexicon(rows: DataFrame, arcs: int = ARCS) -> Lexicon | None:
    """Insult arcs of ``rows`` (text, toxic); None unless both labels occur."""
    classes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (classes.get(0) and classes.get(1)):
        return None
    share = classes[1] / (classes[0] + classes[1])

    def count(batches):
        for batch in batches:
            label = np.asarray(batch.column(1)).astype(np.int64)
            for runs in batch_runs(batch.column(0)):
                code, words = codes(pa.array(runs.packed(closed=True)))
                size = max(1, len(words))
                pairs, _ = distinct(runs.text * size + code)
                cells, n = distinct(pairs % size * 2 + label[runs.first + pairs // size])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(words)[cells // 2].view(np.int64)), pa.array(np.where(cells % 2 == 1, n, 0)), pa.array(np.where(cells % 2 == 0, n, 0))],
                    names=["word", "toxic", "clean"])

    words = rows.select("text", "toxic").mapInArrow(count, "word long, toxic long, clean long").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    depths = F.array_distinct(F.array(*(F.col("word").bitwiseAND(F.lit(_depth_mask(d))) for d in DEPTHS)))
    counts = words.withColumn("arc", F.explode(depths)).groupBy("arc").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    p = (F.col("toxic") + PRIOR * share) / (F.col("toxic") + F.col("clean") + PRIOR)
    weight = F.log(p / (1 - p)) - float(np.log(share / (1 - share)))
    best = (counts.where(F.col("toxic") >= LEAST_TOXIC).withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT)
            .orderBy(F.desc(F.col("weight") * F.col("toxic")), "arc").limit(arcs).toArrow())  # bounded by ``arcs``
    arc = np.asarray(best.column("arc"), dtype=np.int64).view(np.uint64)
    order = np.argsort(arc)
    return Lexicon(arc[order], np.asarray(best.column("toxic"), dtype=np.float64)[order],
                   np.asarray(best.column("clean"), dtype=np.float64)[order], share)


def _symbols(runs: Runs, lexicon: Lexicon, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, weight) of every run: the heaviest arc that accepts the word, then the fixed words."""
    words, back = codes(pa.array(runs.packed(closed=True)))
    packed = np.asarray(back)
    weight = np.zeros(len(packed))
    if len(lexicon.arcs):
        for depth in DEPTHS:
            key = packed & np.uint64((1 << 64) - (1 << (64 - 8 * depth)))
            i = np.minimum(np.searchsorted(lexicon.arcs, key), len(lexicon.arcs) - 1)
            weight = np.maximum(weight, np.where(lexicon.arcs[i] == key, weights[i], 0.0))
    symbol = np.where(weight > 0, INSULT, OTHER)
    for kind, fixed in _FIXED:
        symbol = np.where((symbol == OTHER) & np.isin(packed, fixed), kind, symbol)
    return symbol[words], weight[words]


FEATURES = 2 * len(KINDS) + 3


def _features(runs: Runs, lexicon: Lexicon, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, matched clauses) of every text of a chunk."""
    symbol, weight = _symbols(runs, lexicon, weights)
    ends = np.concatenate(([0], np.cumsum(_CLAUSE_END[runs.data])))
    clause = ends[runs.start] + runs.text  # a text's border ends a clause
    out = rewritten(symbol, clause)
    n = np.bincount(runs.text, minlength=runs.count).astype(np.float64)
    worth = np.where(weight > 0, weight, 1.0)
    sums = np.stack([np.bincount(runs.text[out == k], worth[out == k], minlength=runs.count) for k in KINDS], axis=1)
    hit = np.isin(out, KINDS)
    clauses = np.bincount(np.unique(np.stack([runs.text[hit], clause[hit]]), axis=1)[0], minlength=runs.count)
    strongest = np.zeros(runs.count)
    np.maximum.at(strongest, runs.text[out == INSULT], weight[out == INSULT])
    np.maximum.at(strongest, runs.text[out == AIMED], weight[out == AIMED])
    length = np.log1p(n)
    x = np.concatenate([np.log1p(sums), np.log1p(100 * sums / np.maximum(n, 1)[:, None]), length[:, None], strongest[:, None],
                        np.ones((runs.count, 1))], axis=1)
    return x, clauses


def _fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic coefficients by Newton steps with a small ridge; the last column of ``x`` is the constant."""
    b = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE * len(y))
    ridge[-1] = 1e-6
    ridge /= np.maximum(1.0, 1.0 / np.maximum(x.var(axis=0), 1e-3))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x * w[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _training_features(rows: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    def build(batches):
        for batch in batches:
            for label in (0, 1):
                part = batch.filter(pa.array(np.asarray(batch.column(2)) == label))
                weights = lexicon.weights(label)
                for runs in batch_runs(part.column(1)):
                    x, _ = _features(runs, lexicon, weights)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(runs.first, runs.count), pa.array(list(x)), pa.array(np.full(runs.count, label, np.int32))],
                        names=["doc_id", "x", "toxic"])

    built = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic").mapInArrow(build, "doc_id long, x array<double>, toxic int")
    one = built.groupBy("doc_id").agg(F.min_by(F.struct("x", "toxic"), F.xxhash64("x")).alias("r")).select("r.*").toArrow()  # 2 * fit_rows at most
    if not one.num_rows:
        return np.zeros((0, FEATURES)), np.zeros(0)
    return np.array(one.column("x").to_pylist()), np.asarray(one.column("toxic")).astype(np.float64)


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, arcs: int = ARCS) -> DataFrame:
    """(doc_id, held_out, score, predicted, clauses), one row per row of ``docs``.

    ``labels`` has doc_id and toxic (1 or 0; null ids and labels are left out, the
    higher of several labels counts). ``clauses`` are those with a match. Null and
    empty texts get the model's score for no words; without labels of both kinds
    every score is the share of toxic labels (0 without any).
    """
    rows = stored(training_rows(docs, labels, fit_rows), "training")
    lexicon = learned_lexicon(rows, arcs)
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text.alias("text"))
    if lexicon is None:
        share = float(_toxic_by_document(labels).where(~held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0] or 0.0)
        return keyed.select("doc_id", "held_out", F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"),
                            F.lit(0).cast("long").alias("clauses"))
    x, y = _training_features(rows, lexicon)
    model, weights = _fitted(x, y), lexicon.weights()

    def score(batches):
        for batch in batches:
            for runs in batch_runs(batch.column(2)):
                features, clauses = _features(runs, lexicon, weights)
                p = 1 / (1 + np.exp(-np.clip(features @ model, -30, 30)))
                part = slice(runs.first, runs.count)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, part.stop), batch.column(1).slice(part.start, part.stop), pa.array(p),
                     pa.array((p >= 0.5).astype(np.int32)), pa.array(clauses.astype(np.int64))],
                    names=["doc_id", "held_out", "score", "predicted", "clauses"])

    return keyed.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, clauses long")
