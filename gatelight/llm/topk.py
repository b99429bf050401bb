"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt to blocks; a block keeps one list of its vectors per dimension, sorted by that component. For a query the lists are read
in parallel from the end its sign prefers, every vector met is scored in full, and reading stops when no unread vector can
reach the k-th score: the bound is the sum over dimensions of the query's component times the last value read. Query blocks meet
every vector block; the k best of each block are merged per query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ship

K = 5
SCALE = 256
QUERY_EVERY = 50
#: A vector is repeated for each block of queries and a query for each block of vectors; blocks are as large as a task's memory allows.
VECTORS_PER_BLOCK = 32768
QUERIES_PER_BLOCK = 8192
LONG = (1 << 63) - 1
FIRST_DEPTH = 4


def threshold_search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best of each query among ``vectors``, without the query's own id; ties to the smaller id.

    ``vectors`` and ``queries`` hold whole numbers as doubles. Scores are exact: in doubles while every sum is below 2**53, else in Python
    integers. A score beyond 64 bits counts as the nearest 64-bit number.
    """
    n, dims = vectors.shape
    out: list[tuple[int, int, int]] = []
    if not n:
        return out
    largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dims, 1)
    exact = np.float64 if largest < 2**53 else object
    whole = (lambda a: a) if exact is np.float64 else np.vectorize(int, otypes=[object])
    fit = (lambda a: a) if exact is np.float64 else np.vectorize(lambda s: max(-LONG - 1, min(LONG, s)), otypes=[object])
    v, q = whole(vectors), whole(queries)
    order = np.argsort(vectors, axis=0, kind="stable").T.copy() if dims else np.zeros((0, n), np.int64)  # per dimension, ascending
    values = whole(np.take_along_axis(vectors.T, order, axis=1)) if dims else np.zeros((0, n))
    axis = np.arange(dims)
    for query, own in zip(q, query_ids):
        up = query < 0  # a negative component prefers small values
        others = ids != own
        seen = np.zeros(n, dtype=bool)
        scores = np.empty(n, dtype=exact)
        depth, at, kth = 0, FIRST_DEPTH, None
        while depth < n:
            stop = min(at, n)
            rows = np.concatenate([order[up, depth:stop].ravel(), order[~up, n - stop : n - depth].ravel()]) if dims else np.arange(n)
            fresh = np.zeros(n, dtype=bool)
            fresh[rows] = True
            fresh &= ~seen
            new = np.flatnonzero(fresh)
            scores[new] = fit(v[new] @ query)
            seen |= fresh
            found = np.flatnonzero(seen & others)
            if len(found) >= k:
                kth = np.sort(scores[found])[-k] if exact is object else np.partition(scores[found], len(found) - k)[-k]
                last = np.where(up, values[axis, stop - 1], values[axis, n - stop]) if dims else values[:0, 0]
                if fit((query * last).sum()) < kth:
                    break
            if seen.all():
                break
            depth, at = stop, at * 2
        found = np.flatnonzero(seen & others)
        if len(found) > k:
            found = found[scores[found] >= kth]
        found = found[np.lexsort((ids[found], -scores[found].astype(np.float64)))] if exact is not object else np.array(sorted(found, key=lambda i: (-scores[i], ids[i])), dtype=np.int64)
        out += [(int(own), int(ids[i]), int(scores[i])) for i in found[:k]]
    return out


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """The ``k`` best of ``vectors`` for each row of ``queries``: query, rank, ``id_col``, score.

    Components become floor(scale * x); the score is their inner product as an integer. Ties go to the smaller id.

    Defined cases: rows with a null id, a null vector or a null or non-finite component (before or after scaling) take no part on either side.
    Components of any size are multiplied exactly; a score beyond 64 bits counts as the nearest 64-bit number. Vectors are only compared
    with those of equal length. A row is not its query's own result, nor is another row of the same id. Repeated rows count as one. If a query
    has fewer than ``k`` candidates all are returned; an empty table gives an empty result.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)

    def whole(df: DataFrame) -> DataFrame:
        x = F.col(vector_col)
        valid = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float("inf")))
        small = lambda c: F.abs(c) < 2.0**52  # noqa: E731  a larger double is whole already
        ints = F.transform(F.transform(x, lambda c: c.cast("double") * scale), lambda c: F.when(small(c), F.floor(F.when(small(c), c)).cast("double")).otherwise(c))
        return df.filter(valid).select(F.col(id_col).cast("long").alias("id"), ints.alias("x"), F.size(x).alias("dims")).dropDuplicates(["id", "x"])

    vecs, asks = scratch.keep(whole(vectors), "vectors"), scratch.keep(whole(queries), "queries")
    v_blocks = max(1, math.ceil(vecs.count() / VECTORS_PER_BLOCK))
    q_blocks = max(1, math.ceil(asks.count() / QUERIES_PER_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = vecs.withColumn("vb", block(v_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = asks.withColumn("qb", block(q_blocks)).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        return np.stack(frame["x"].to_numpy()) if len(frame) else np.zeros((0, 0))

    def run(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query": [], "id": [], "score": []}, dtype="int64")
        rows = threshold_search(matrix(v), v["id"].to_numpy(), matrix(q), q["id"].to_numpy(), k)
        return pd.DataFrame(rows, columns=["query", "id", "score"], dtype="int64")

    ship(spark)
    keys = ["dims", "qb", "vb"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query long, id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = hits.dropDuplicates().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query", "rank", F.col("id").alias(id_col), "score")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0))


SQL = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query, v.vec_id, list_inner_product(q.x::double[], v.x::double[])::bigint as score
  from v q join v on q.vec_id % 50 = 0 and v.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query order by score desc, vec_id)::int as rank from pairs)
select query, rank, vec_id, score from ranked where rank <= 5
"""
