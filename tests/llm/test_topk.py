import numpy as np
import pytest

from evospark.llm import topk


def test_against_all_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 40)], 0) for i in range(400)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(30)]  # ties
    rows += [(500, None, 0), (550, [None] * 40, 0), (600, [float("nan")] * 40, 0), (None, rows[0][1], 0), (650, [float("inf")] + [0.0] * 39, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in topk.exact_topk(vectors, candidate_rows=64, query_rows=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    kept = [r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    ids = np.array([r[0] for r in kept])
    m = np.floor(256 * np.array([r[1] for r in kept], dtype=np.float32).astype(np.float64)).astype(np.int64)
    for i in np.flatnonzero(ids % 50 == 0):
        score = m @ m[i]
        best = [j for j in np.lexsort((ids, -score)) if j != i][:5]
        assert sorted(got.pop(ids[i])) == [(n + 1, ids[j], score[j]) for n, j in enumerate(best)]
    assert not got


@pytest.mark.parametrize("dims", [1, 16, 17])
def test_few_candidates(spark, dims):
    rows = [(0, [0.5] * dims), (1, [1.0] * dims), (50, [2.0] * dims)]
    got = topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == [(0, 1, 50), (0, 2, 1), (50, 1, 1), (50, 2, 0)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.exact_topk(none).collect() == []
