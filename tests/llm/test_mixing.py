from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evospark.llm.mixing import FLATTEN, mixed, rake, sampled_documents
from tests.llm.conftest import prose, rows_of


def test_margins_are_met(documents, corpus):
    assert mixed(documents(corpus)).count() == len(corpus)
    corpus = [r for r in corpus if "source" in r]  # the rows without any value can't meet three shares at once
    got = mixed(documents(corpus), kept_share=None)
    assert got.columns[-1] == "mix_"  # the table has a column of that name
    rows = got.select("source", "lang", "mix_.*").collect()
    assert len(rows) == len(corpus)
    for key in ("source", "lang", "topic"):
        tokens, expected = defaultdict(float), defaultdict(float)
        for r in rows:
            tokens[r[key]] += r.n_tokens
            expected[r[key]] += r.n_tokens * r.probability
        total, drawn = sum(v**FLATTEN for v in tokens.values()), sum(expected.values())
        for k, v in tokens.items():
            assert expected[k] / drawn == pytest.approx(v**FLATTEN / total if v else 0, abs=1e-5)
    assert max(r.probability for r in rows) == pytest.approx(1)


def test_a_stray_row_does_not_shrink_the_sample(documents):
    import random

    rng = random.Random(4)
    rows = rows_of([prose(rng, rng.randrange(20, 90)) for _ in range(900)])

    def kept(rows):
        m = [r[0] for r in mixed(documents(rows)).select("mix_").collect()]
        assert all(x.saturated == (x.probability >= 1) for x in m)
        return sum(x.probability * x.n_tokens for x in m) / sum(x.n_tokens for x in m)

    plain = kept(rows)
    assert plain == pytest.approx(0.9, abs=1e-6)
    stray = {"doc_id": 10_000, "text": prose(rng, 20), "lang": None, "source": "never seen before", "n_chars": 1}
    assert kept([*rows, stray]) == pytest.approx(plain, abs=0.01)


def test_scale_against_bisection(spark):
    from evospark.llm.mixing import sampling_scale

    rng = np.random.default_rng(5)
    tokens, weight = rng.integers(1, 1000, 40).astype(float), rng.dirichlet(np.full(40, 0.4)) + 1e-9
    cells = spark.createDataFrame([(float(t), float(w)) for t, w in zip(tokens, weight, strict=True)], "tokens double, weight double")
    for share in (0.05, 0.5, 0.9, 1.0):
        c = sampling_scale(cells, share)
        assert np.minimum(tokens, c * weight).sum() == pytest.approx(share * tokens.sum(), rel=1e-9)


def test_clashing_names(documents):
    docs = documents(rows_of(["some words here", "more of them"])).withColumn("_topic_words", F.lit(1)).withColumn("_topic__words", F.lit(2))
    assert sampled_documents(docs, kept_share=1.0).columns == docs.columns


def test_rake_against_numpy(spark):
    rng = np.random.default_rng(2)
    table = rng.integers(1, 100, (4, 3)).astype(float)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", float(table[i, j])) for i in range(4) for j in range(3)], "source string, lang string, tokens double")
    t1, t2 = np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25])
    targets = {"source": spark.createDataFrame([(f"s{i}", float(x)) for i, x in enumerate(t1)] + [("absent", 1.0)], "value string, share double"),
               "lang": spark.createDataFrame([(f"l{i}", float(x)) for i, x in enumerate(t2)], "value string, share double")}
    w = table / table.sum()
    for _ in range(200):
        w *= (t1 / w.sum(1))[:, None]
        w *= t2 / w.sum(0)
    got = {(r.source, r.lang): r.weight for r in rake(cells, targets).collect()}
    assert all(got[f"s{i}", f"l{j}"] == pytest.approx(w[i, j], abs=1e-6) for i in range(4) for j in range(3))


def test_contradicting_targets_end(spark):
    cells = spark.createDataFrame([("a", "x", 5.0), ("b", "y", 5.0)], "source string, lang string, tokens double")
    targets = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "value string, share double"),
               "lang": spark.createDataFrame([("x", 0.2), ("y", 0.8)], "value string, share double")}
    assert rake(cells, targets).count() == 2


def test_sample_is_repeatable_and_near_its_size(documents):
    import random

    rng = random.Random(1)
    docs = documents(rows_of([prose(rng, rng.randrange(5, 60)) for _ in range(1500)]))
    out = mixed(docs)
    name = out.columns[-1]
    p = out.agg(F.sum(f"{name}.probability")).first()[0]
    drawn = sampled_documents(docs)
    assert drawn.columns == docs.columns
    ids = {r.doc_id for r in drawn.collect()}
    assert abs(len(ids) - p) < 120
    assert ids == {r.doc_id for r in sampled_documents(docs.repartition(7)).collect()}


def test_empty_table(documents):
    assert sampled_documents(documents([])).collect() == []
    assert mixed(documents(rows_of([None, "", " "]))).count() == 3
