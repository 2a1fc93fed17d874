"""Exact top-k by columnar branch and bound.

Vectors of whole numbers are held dimension by dimension. Scores are summed one
block of dimensions at a time; what the remaining dimensions can still add is at
most the product of the remaining norms, so a candidate whose upper bound lies
below the k-th best lower bound leaves, and survivors are compacted.

Candidates and queries are dealt into groups of bounded size; every group of
queries meets every group of candidates once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evospark.llm.common import stored

TOP = 5
EVERY = 50
SCALE = 256
CANDIDATE_ROWS = 8192
QUERY_ROWS = 1024
DIMENSIONS = 16


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, dims) with v = floor(scale * x); rows with nulls or non-finite components are left out."""
    wide = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    finite = F.forall("wide", lambda x: x.isNotNull() & (x > F.lit(float("-inf"))) & (x < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("wide")).where("vec_id is not null")
    return rows.where(F.col("wide").isNotNull() & finite).select(
        "vec_id", F.transform("wide", lambda x: F.floor(x * scale).cast("long")).alias("v"), F.size("wide").alias("dims"))


def best_in_block(queries: np.ndarray, q_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """(query, candidate, score) of each query's k best; equal scores go to the smaller id."""
    dims = queries.shape[1]
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(dims, 1)
    exact = np.int64 if largest >= 2**53 else np.float64  # doubles are exact below
    spread = np.argsort(-vectors.astype(np.float64).var(axis=0)) if len(vectors) else np.arange(dims)
    columns = np.ascontiguousarray(vectors.T[spread]).astype(exact)
    asked = np.ascontiguousarray(queries[:, spread]).astype(exact)
    cuts = [*range(0, dims, DIMENSIONS), dims] if dims else [0, 0]

    def rest(matrix: np.ndarray) -> list[np.ndarray]:  # norm of what follows each block, over the first axis
        squares = matrix.astype(np.float64) ** 2
        return [np.sqrt(squares[c:].sum(axis=0)) for c in cuts[1:]]

    q_rest, c_rest = rest(asked.T), rest(columns)
    first = asked[:, :cuts[1]] @ columns[:cuts[1]]
    out = []
    for q in range(len(asked)):
        alive = np.flatnonzero(ids != q_ids[q])
        score = first[q][alive]
        for b in range(len(cuts) - 1):
            if b:
                score = score + asked[q, cuts[b]:cuts[b + 1]] @ columns[cuts[b]:cuts[b + 1], alive]
            slack = q_rest[b][q] * c_rest[b][alive] * (1 + 1e-9) + 1e-6
            if len(alive) > k:
                kth = np.partition(score - slack, len(alive) - k)[len(alive) - k]
                near = score + slack >= kth - 1e-6 - 1e-9 * abs(kth)
                alive, score = alive[near], score[near]
        order = np.lexsort((ids[alive], -score))[:k]
        out += [(int(q_ids[q]), int(ids[alive[i]]), int(score[i])) for i in order]
    return out


def exact_topk(vectors: DataFrame, queries: Column | None = None, k: int = TOP, candidate_rows: int = CANDIDATE_ROWS,
               query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products, ties to the smaller vec_id.

    Queries are the rows that satisfy ``queries`` (vec_id divisible by 50), the
    candidates all rows with another vec_id. Vectors that are null, or hold null
    or non-finite components, take no part; vectors of different lengths are not
    compared. Of repeated query ids the smallest vector asks; repeated
    candidates are all listed. Scores must fit 64 bits.
    """
    rows = stored(whole_numbers(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    ask = rows.where(F.col("vec_id") % EVERY == 0 if queries is None else queries)
    ask = stored(ask.groupBy("vec_id", "dims").agg(F.min("v").alias("v")).withColumn("row", F.monotonically_increasing_id()), "queries")
    deal = lambda n, each: max(1, -(-n // each))
    c_groups, q_groups = deal(rows.count(), candidate_rows), deal(ask.count(), query_rows)
    # Rows are numbered per partition, so a hash of the number deals them evenly.
    groups = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    own = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = ask.select("vec_id", "v", "dims", own(q_groups).alias("qg"), F.explode(groups(c_groups)).alias("cg"))
    right = rows.select("vec_id", "v", "dims", own(c_groups).alias("cg"), F.explode(groups(q_groups)).alias("qg"))
    names = ["query_id", "vec_id", "score"]

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = table.column("v").combine_chunks()
        flat = np.asarray(v.flatten() if isinstance(v, pa.Array) else v.chunk(0).flatten(), dtype=np.int64)
        return np.asarray(table.column("vec_id"), dtype=np.int64), flat.reshape(table.num_rows, -1)

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and held.num_rows:
            q_ids, q = matrix(asked)
            ids, v = matrix(held)
            found = best_in_block(q, q_ids, v, ids, k)
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 3)], names=names)

    keys = ["dims", "qg", "cg"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, ", ".join(f"{n} long" for n in names))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
