import random
import zlib

import numpy as np
import pytest

from evospark.llm import toxicity
from evospark.llm.toxicity import AIMED, AIMED_THREAT, INSULT, LATE_TARGET, NEGATED, NEGATION, OTHER, REPORT, REPORTED, TARGET, THREAT
from tests.llm.conftest import prose

SCHEMA = "doc_id long, text string, lang string, source string, score string, toxic int, clauses string"
INSULTS = ["blorgo", "snarfle", "wumpitch"]


def write(symbols, clause=None):
    s = np.array(symbols)
    return toxicity.rewritten(s, np.array(clause) if clause else np.zeros(len(s), int)).tolist()


def test_grammar():
    assert write([OTHER, INSULT, OTHER]) == [OTHER, INSULT, OTHER]
    assert write([TARGET, OTHER, INSULT]) == [TARGET, OTHER, AIMED]
    assert write([INSULT, OTHER, TARGET, INSULT]) == [INSULT, OTHER, LATE_TARGET, AIMED]
    assert write([NEGATION, OTHER, OTHER, INSULT]) == [NEGATION, OTHER, OTHER, NEGATED]
    assert write([NEGATION, OTHER, OTHER, OTHER, INSULT]) == [NEGATION, OTHER, OTHER, OTHER, INSULT]
    assert write([REPORT, TARGET, OTHER, INSULT]) == [REPORT, TARGET, OTHER, REPORTED]
    assert write([THREAT, OTHER]) == [THREAT, OTHER]
    assert write([THREAT, TARGET]) == [THREAT, AIMED_THREAT]
    assert write([TARGET, THREAT]) == [TARGET, AIMED_THREAT]
    # A clause's end forgets everything.
    assert write([TARGET, NEGATION, REPORT, INSULT, INSULT], [0, 0, 0, 1, 2]) == [TARGET, NEGATION, REPORT, INSULT, INSULT]


def test_composition_equals_running_one_after_the_other():
    rng = random.Random(1)
    chain = [toxicity.reported_speech(), toxicity.negation(), toxicity.targeting()]
    for _ in range(300):
        symbols = [rng.choice([OTHER, OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT]) for _ in range(rng.randrange(1, 14))]
        want = symbols
        for t in chain:
            state, out = 0, []
            for s in want:
                out.append(int(t.out[state, s]))
                state = int(t.step[state, s])
            want = out
        if INSULT in symbols or THREAT in symbols:
            assert write(symbols) == want


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randrange(20, 80), 300).replace("w", "q").translate(str.maketrans("0123456789", "abcdefghij")).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        docs.append((i, " ".join(words), rng.choice(["en", "de"]), "s", "x", 7, "y"))
        labels.append((i, int(toxic)))
    docs += [(None, docs[0][1], None, None, None, None, None), (5000, None, "en", "s", "x", 1, "y"), (5001, "", "en", "s", "x", 1, "y"),
             (5002, " ".join(prose(rng, 4000) for _ in range(10)), "en", "s", "x", 1, "y"), docs[3], docs[3]]
    return spark.createDataFrame(docs, SCHEMA), [*labels, (None, 1), (3, None), (3, 0)]


def test_held_out_rows(spark, labelled):
    docs, known = labelled
    labels = spark.createDataFrame(known, "doc_id long, toxic int")
    out = toxicity.toxicity_scores(docs, labels).collect()
    assert len(out) == docs.count()
    by_id = {r.doc_id: r for r in out}
    for r in out:
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(text.encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(by_id[i].predicted, y) for i, y in known if i is not None and y is not None and by_id[i].held_out]
    assert sum(y for _, y in held) > 20 and np.mean([p == y for p, y in held]) > 0.98
    assert by_id[5000].score == by_id[5001].score and by_id[5000].predicted == 0
    # Labels of held-out rows and the other columns do not touch a score.
    flipped = [(i, 1 - y if y is not None and i is not None and by_id[i].held_out else y) for i, y in known]
    again = toxicity.toxicity_scores(docs.withColumn("lang", docs.source), spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({r.doc_id: r.score for r in out}, abs=1e-9)


def test_clause_counts(spark, labelled):
    docs, known = labelled
    rows = toxicity.training_rows(docs, spark.createDataFrame(known, "doc_id long, toxic int"))
    lexicon = toxicity.learned_lexicon(rows)
    heaviest = {a for a, w in zip(lexicon.arcs.tolist(), lexicon.weights(), strict=True) if w > 3}
    packed = [int.from_bytes((w + " ").encode()[:8].ljust(8, b"\0")) for w in INSULTS]
    assert all(any(p & ((1 << 64) - (1 << (64 - 8 * d))) in heaviest for d in toxicity.DEPTHS) for p in packed)


@pytest.mark.parametrize(("labels", "score"), [([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)])
def test_one_kind_of_label(spark, labels, score):
    docs = spark.createDataFrame([(1, "a", "en", "s", None, 1, None), (2, None, None, None, None, 1, None)], SCHEMA)
    out = toxicity.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert [r.score for r in out] == [score, score]
    assert toxicity.toxicity_scores(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).collect() == []
