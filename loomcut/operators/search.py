"""Exact vector search and ranking metrics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcut.workers import ship


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Scaled to length one; the zero vector stays."""
    d = v.cast("array<double>")
    n = F.sqrt(dot(d, d))
    return F.when(n == 0, d).otherwise(F.transform(d, lambda x: x / F.nullif(n, F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NaN if either is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(float("nan"))).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def search(index: DataFrame, query: list[float], top_k: int = 10, pattern: str | None = None, path: str = "filepath", order: str = "ord") -> DataFrame:
    """The ``top_k`` rows of ``index`` most similar to ``query``, best first; ties in the index's order.

    ``pattern`` filters paths before anything is scored.  The plan is a
    projection under a bounded top-k, without a full sort.
    """
    rows = index.where(F.col(path).rlike(pattern)) if pattern else index
    q = F.array(*[F.lit(float(x)) for x in query])
    score = cosine(F.col("embedding"), q)
    scored = rows.withColumn("score", score)
    return scored.orderBy(F.when(F.isnan("score"), F.lit(None)).otherwise(F.col("score")).desc_nulls_last(), order).limit(max(1, min(50, top_k)))


#: Queries whose vectors are in memory at once; of these and of rows, how many are multiplied at a time.
QUERY_BLOCK, QUERY_STEP, ROW_STEP = 4096, 512, 2048


def search_many(index: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the exact top-k of each row of ``queries`` (``query_id, q``), a stated set, among all other rows.

    Queries are broadcast in blocks of at most ``QUERY_BLOCK``.  A task
    multiplies the block with its rows, ``QUERY_STEP`` by ``ROW_STEP`` at a
    time, of which only scores that reach a query's ``top_k`` so far are kept,
    and passes on its best of each query alone; a window picks the best of all.
    Vectors of another length than the query's block, and null ones, take no part.
    """
    ship(index.sparkSession)
    rows = index.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null and e is not null")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q")).where("query_id is not null and q is not null")
    sizes = asked.groupBy(F.size("q").alias("dim")).agg(F.count("*").alias("n")).collect()
    out = "query_id long, vec_id long, score double"
    parts = []
    for dim, n in sorted((r["dim"], r["n"]) for r in sizes if r["dim"] > 0):
        blocks = max(1, math.ceil(n / QUERY_BLOCK))
        for b in range(blocks):
            block = asked.where((F.size("q") == dim) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
            if block.num_rows:
                parts.append(rows.where(F.size("e") == dim).mapInArrow(_best(index, block, dim, top_k), out))
    if not parts:
        return index.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def _best(index: DataFrame, block: pa.Table, dim: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    matrix = lambda c: c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    ids = block.column("query_id").to_numpy()
    q = matrix(block.column("q").combine_chunks())
    shared = index.sparkSession.sparkContext.broadcast((ids, q, np.sqrt((q * q).sum(1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, qn = shared.value
        score, found = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, ROW_STEP):
                b = batch.slice(i, ROW_STEP)
                x, vec = matrix(b.column("e")), b.column("vec_id").to_numpy()
                xn = np.sqrt((x * x).sum(1))
                for j in range(0, len(q), QUERY_STEP):
                    at = slice(j, j + QUERY_STEP)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        s = q[at] @ x.T
                        s /= qn[at, None] * xn
                    s[np.isnan(s)] = -2  # of no direction: after all others
                    s[ids[at, None] == vec] = -np.inf
                    _keep(score[at], found[at], s, vec)
        row, at = np.nonzero(score > -np.inf)
        s = score[row, at]
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found[row, at]), pa.array(s, mask=s == -2)], ["query_id", "vec_id", "score"])

    return run


def _keep(score: np.ndarray, found: np.ndarray, s: np.ndarray, vec: np.ndarray) -> None:
    """Of each row of ``score`` and ``s`` together the best, rounded to 9 digits, ties to smaller ids, are put in place."""
    k = score.shape[1]
    least = score[:, -1]
    if s.shape[1] > k and np.isneginf(least).any():
        least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
    row, col = np.nonzero(s >= least[:, None] - 1e-9)  # what rounding may lift is among them
    if not len(row):
        return
    some = np.unique(row)
    rows = np.concatenate([np.repeat(some, k), row])
    scores = np.concatenate([score[some].ravel(), np.round(s[row, col], 9)])
    ids = np.concatenate([found[some].ravel(), vec[col]])
    order = np.lexsort((ids, -scores, rows))
    first = np.searchsorted(rows[order], some)
    best = order[first[:, None] + np.arange(k)]
    score[some], found[some] = scores[best], ids[best]


def hits(ranked: DataFrame, k: int) -> Column:
    return F.max(F.when((F.col("rank") <= k) & F.col("hit"), 1).otherwise(0)).cast("int")


def ranking_metrics(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """``query_id``, hit@k and reciprocal rank of rankings (``query_id, rank, hit``)."""
    first = F.min(F.when(F.col("hit"), F.col("rank")))
    return ranked.groupBy("query_id").agg(*[hits(ranked, k).alias(f"hit_{k}") for k in ks], F.round(F.coalesce(1 / first, F.lit(0.0)), 6).alias("reciprocal_rank"))


def coverage(ranked: DataFrame, oracle: DataFrame, k: int) -> DataFrame:
    """``query_id, coverage``: share of a query's oracle files (``query_id, file``) among its first ``k``; 1 if it has none.

    ``ranked`` has every query; ``rank`` may be null for one without results.
    """
    got = ranked.where(F.col("rank") <= k).select("query_id", "file").distinct()
    want = oracle.select("query_id", "file").distinct()
    found = want.join(got.withColumn("hit", F.lit(1)), ["query_id", "file"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("h"))
    return ranked.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.round(F.coalesce(F.col("h") / F.col("n"), F.lit(1.0)), 6).alias("coverage"))
