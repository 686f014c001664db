"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors get one more component that makes all norms equal, so that the largest
inner product is the smallest distance, and are rotated at random.  Lists are
the cells of centroids fitted to ``SAMPLE`` rows; every row is put in one.
Their number grows with the root of the table's: up to ``CELLS`` are cells of
their own, beyond that each cell is cut by a second, shared set of centroids of
what is left after the first, up to ``CELLS`` times ``CELLS``.

A query scans the lists nearest to it.  Within a list the rotated vectors lie in
blocks of ``COLUMNS`` columns: after each block, a candidate whose partial
distance is too large for it still to be, by a test on ``k`` of ``D`` random
dimensions, among the query's nearest is abandoned; the threshold is the
distance of the ``k``-th best that the list has shown so far, tightened after
every ``CHUNK`` rows.  What survives is scored exactly, on the original vectors
in double precision.

How many lists are scanned is fitted too: so many that, over the sample,
``RECALL`` of the true neighbours lie within them; and always enough to hold
``MARGIN`` times ``k`` rows.  Long lists are cut into parts of ``PART_ROWS``, so
that a cell holding a third of all rows is many tasks; a part's rows come first
and its queries stream past them, so no row is sent twice and any number of
queries may ask for it.

Defined results: vectors that are null, zero, hold null or non-finite
components, have no id, or aren't of the commonest length take no part; of
equal scores the smaller id comes first; a query's own row is left out, others
with its id are not; fewer rows than ``k`` give fewer; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbuf as tb
from .runtime import cut

SAMPLE = 20_000
CELLS = 1024
ROUNDS = 8
RECALL = 0.97
MARGIN = 50
COLUMNS = 16
#: Strictness of the test: a true neighbour is abandoned with a chance that falls with its square.
EPSILON = 2.1
#: What rounding may do to a squared distance, as a share of the squared norm; copies of a vector stay within it.
SLACK = 1e-12
#: Pairs that are scored at once.
PAIRS = 1 << 15
#: Rows of a list after which the threshold is taken anew.
CHUNK = 1024
#: Rows of a list that a worker holds at once, about.
PART_ROWS = 8192
#: Queries that are scanned at once.
QUERIES = 256


class Space:
    """Rotation, norms and cells: of bounded size, whatever the table's."""

    def __init__(self, dim: int, norm2: float, centroids: np.ndarray, scanned: int, seed: int = 3):
        self.dim, self.norm2, self.centroids, self.scanned = dim, norm2, centroids, scanned
        self.inner, self.tops = np.zeros((1, dim + 1)), len(centroids)
        self.rotation = rotation(dim + 1, seed)

    @property
    def lists(self) -> int:
        return len(self.centroids) * len(self.inner)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The list of each row."""
        a = _cells(x, self.centroids)
        return a if len(self.inner) == 1 else a * len(self.inner) + _cells(x - self.centroids[a], self.inner)

    def near(self, q: np.ndarray) -> np.ndarray:
        """Lists of each query, nearest first: all, or, where cells are cut, those of the ``tops`` nearest cells."""
        d = _squared(q, self.centroids)
        if len(self.inner) == 1:
            return np.argsort(d, 1, kind="stable")
        top = np.argsort(d, 1, kind="stable")[:, : self.tops]
        out = []
        for row, t in zip(q, top):
            far = _squared(row - self.centroids[t], self.inner).ravel()
            out.append((t[:, None] * len(self.inner) + np.arange(len(self.inner))).ravel()[np.argsort(far, kind="stable")])
        return np.array(out).reshape(len(q), -1)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))
        return np.hstack([x, rest[:, None]])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.lifted(x) @ self.rotation

    def queries(self, q: np.ndarray) -> np.ndarray:
        """A query's own length doesn't change its order; it is scaled to the vectors' common norm."""
        n = np.sqrt(self.norm2 / (q * q).sum(1))
        return np.hstack([q * n[:, None], np.zeros((q.shape[0], 1))]) @ self.rotation


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def _cells(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin(_squared(x[i : i + 4096], centroids), 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(ROUNDS):
        a = _cells(x, c)
        size = np.bincount(a, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def fit(sample: np.ndarray, norm2: float, n: int, k: int, seed: int = 3) -> Space:
    """Centroids by k-means over the sample, and the number of lists to scan."""
    dim = sample.shape[1]
    space = Space(dim, norm2, np.zeros((1, dim + 1)), 1, seed)
    x = space.rows(sample)
    lists = max(1, round(np.sqrt(n) / 2))
    rng = np.random.default_rng(seed)
    space.centroids = _means(x, min(lists, CELLS, len(x)), rng)
    if lists > len(space.centroids):
        space.inner = _means(x - space.centroids[_cells(x, space.centroids)], min(-(-lists // len(space.centroids)), CELLS, len(x)), rng)
    a = space.cells(x)
    ask = np.arange(0, len(x), max(1, len(x) // 256))
    q = space.queries(sample[ask])
    d = _squared(q, x)
    d[np.arange(len(ask)), ask] = np.inf
    true = np.argsort(d, 1)[:, : min(k, len(x) - 1)] if len(x) > 1 else np.zeros((len(ask), 0), np.int64)
    space.tops = len(space.centroids)
    if len(space.inner) > 1 and true.size:  # nearly all true neighbours lie in so many of the nearest cells
        order = np.argsort(_squared(q, space.centroids), 1, kind="stable")
        deep = np.sort(np.take_along_axis(np.argsort(order, 1), a[true] // len(space.inner), 1).ravel())
        space.tops = int(deep[int(np.ceil((1 + RECALL) / 2 * deep.size)) - 1]) + 1
    near = space.near(q)
    rank = np.full((len(ask), space.lists), near.shape[1])
    np.put_along_axis(rank, near, np.arange(near.shape[1])[None, :].repeat(len(ask), 0), 1)
    deep = np.sort(np.take_along_axis(rank, a[true], 1).ravel())
    space.scanned = min(int(deep[min(deep.size - 1, int(np.ceil(RECALL * deep.size)) - 1)]) + 1, near.shape[1]) if deep.size else near.shape[1]
    return space


def _tightened(best: np.ndarray, qi: np.ndarray, part: np.ndarray) -> np.ndarray:
    """``best`` (each query's least distances so far) with new ones let in."""
    k = best.shape[1]
    order = np.lexsort((part, qi))
    qi, part = qi[order], part[order]
    nth = np.arange(qi.size) - np.searchsorted(qi, qi)
    new = np.full_like(best, np.inf)
    new[qi[nth < k], nth[nth < k]] = part[nth < k]
    return np.partition(np.hstack([best, new]), k - 1, 1)[:, :k]


def scan(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that may be among a query's ``k`` nearest rows of this list; ``own``: the row that is the query itself, or -1.

    Rows come in chunks, and these in column blocks; candidates are abandoned by
    the test after each block, and after each chunk the threshold tightens.
    """
    dim = q.shape[1]
    slack = SLACK * (q * q).sum(1)
    best = np.full((len(q), k), np.inf)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    head = min(len(x), max(4 * k, 64))  # scanned whole: their k-th distance is the first threshold
    bounds = [0, *range(head, len(x), CHUNK), len(x)] if len(x) else [0]
    for lo, hi in zip(bounds, bounds[1:]):
        block = x[lo:hi]
        limit = best.max(1)
        c = min(COLUMNS, dim) if lo else dim
        bound = lambda c: slack + limit * ((c / dim) * (1 + EPSILON / np.sqrt(c)) ** 2 if c < dim else 1 + 1e-9)  # noqa: B023, E731
        part = _squared(q[:, :c], block[:, :c])
        qi, xi = np.nonzero(part <= bound(c)[:, None])
        part = part[qi, xi]
        while c < dim:
            e = min(dim, c + COLUMNS)
            for i in range(0, qi.size, 1 << 17):
                s = slice(i, i + (1 << 17))
                part[s] += ((q[qi[s], c:e] - block[xi[s], c:e]) ** 2).sum(1)
            c = e
            keep = part <= bound(c)[qi]
            qi, xi, part = qi[keep], xi[keep], part[keep]
        xi = xi + lo
        keep = own[qi] != xi
        qi, xi, part = qi[keep], xi[keep], part[keep]
        if qi.size:
            best = _tightened(best, qi, part)
            found.append((qi, xi, part))
    qi, xi, part = (np.concatenate([f[j] for f in found]) for j in range(3))
    # of those left, no more than the k nearest of each query are of use (equal ones all stay)
    keep = part <= (best.max(1) * (1 + 1e-9) + slack)[qi]
    return qi[keep], xi[keep]


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def search(vectors: DataFrame, every: int = 20, k: int = 20, vector: str = "embedding", sample_rows: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows whose id is divisible by ``every``, the ``k`` rows of the largest inner product."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    v = F.col(vector).cast(f"array<{kind}>")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) != float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    good = good.where(finite & F.exists("v", lambda e: e != 0))
    good = good.withColumn("dim", F.size("v")).withColumn("n2", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    good = cut(good.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    per = good.groupBy("dim").agg(F.count("*").alias("n"), F.max("n2").alias("n2")).orderBy(F.desc("n"), "dim").first()
    out = "query_id long, rank int, vec_id long, score double"
    if per is None:
        return spark.createDataFrame([], out)
    dim, n = per["dim"], per["n"]
    good = good.where(F.col("dim") == dim).select("uid", "vec_id", "v")
    draw = F.pmod(F.xxhash64("vec_id", "uid"), F.lit(1 << 20))
    drawn = good.where(draw < int((1 << 20) * min(1.0, sample_rows / n))).select("v").toArrow()
    if not drawn.num_rows:
        drawn = good.limit(1).select("v").toArrow()
    space = fit(_matrix(drawn.column(0), dim), float(per["n2"]), n, k)
    shared = spark.sparkContext.broadcast(space)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            cell = s.cells(s.rows(_matrix(b.column("v"), dim)))
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("vec_id"), b.column("v"), pa.array(cell.astype(np.int32))], ["uid", "vec_id", "v", "list"])

    placed = cut(good.mapInArrow(tb.lean(place), f"uid long, vec_id long, v array<{kind}>, list int"), "placed")
    sizes = cut(placed.groupBy("list").agg(F.count("*").alias("n")), "lists")  # as many rows as lists: in proportion to the root of the table's
    held = np.zeros(space.lists, np.int64)
    got = sizes.toArrow()
    held[got.column("list").to_numpy()] = got.column("n").to_numpy()
    counts = spark.sparkContext.broadcast(held)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            q = s.queries(_matrix(b.column("v"), dim))
            for i in range(0, len(q), 512):
                near, held = s.near(q[i : i + 512]), counts.value
                enough = (np.cumsum(held[near], 1) < MARGIN * k + 1).sum(1) + 1
                take = np.minimum(np.maximum(s.scanned, enough), near.shape[1])
                lists = [np.sort(row[:t]) for row, t in zip(near, take)]
                o = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                c = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([c.column("uid"), c.column("vec_id"), c.column("v"), pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(np.concatenate(lists).astype(np.int32)))], ["uid", "vec_id", "v", "lists"])

    asked = placed.where(F.col("vec_id") % every == 0).select("uid", "vec_id", "v").mapInArrow(tb.lean(ask), f"uid long, vec_id long, v array<{kind}>, lists array<int>")
    # Parts of lists: their rows come first, then the queries that ask for them.
    parts = F.broadcast(sizes.select("list", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")))
    rows = placed.join(parts, "list").select("list", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("asks"), "uid", "vec_id", "v")
    asks = cut(asked, "queries").select("uid", "vec_id", "v", F.explode("lists").alias("list")).join(parts, "list")
    asks = asks.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("asks"), "uid", "vec_id", "v")
    met = rows.unionByName(asks).repartition("list", "part").sortWithinPartitions("list", "part", "asks", "uid")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        key, held, x, rx, uids, ids = None, [], None, None, None, None

        def answers(b: pa.RecordBatch) -> pa.RecordBatch:
            q = _matrix(b.column("v"), dim)
            quid, rq = b.column("uid").to_numpy(), s.queries(q)
            at = np.minimum(np.searchsorted(uids, quid), uids.size - 1)
            qi, xi = scan(rq, rx, k, np.where(uids[at] == quid, at, -1))
            # by parts, since all copies of a vector are here
            score = np.concatenate([np.zeros(0), *((q[qi[j : j + PAIRS]] * x[xi[j : j + PAIRS]]).sum(1) for j in range(0, qi.size, PAIRS))])
            best = np.lexsort((ids[xi], -score, qi))
            qi, xi, score = qi[best], xi[best], score[best]
            keep = np.arange(qi.size) - np.searchsorted(qi, qi) < k
            qi, xi, score = qi[keep], xi[keep], score[keep]
            return pa.RecordBatch.from_arrays([pa.array(quid[qi]), pa.array(b.column("vec_id").to_numpy()[qi]), pa.array(ids[xi]), pa.array(score)], ["quid", "query_id", "vec_id", "score"])

        for batch in batches:
            names = [batch.column(c).to_numpy() for c in ("list", "part", "asks")]
            edges = np.flatnonzero(np.logical_or.reduce([np.diff(c, prepend=c[0]) != 0 for c in names])) if batch.num_rows else []
            for i, j in zip([0, *edges], [*edges, batch.num_rows]):
                if i == j:
                    continue
                run = batch.slice(i, j - i)
                if (names[0][i], names[1][i]) != key:
                    key, held, x = (names[0][i], names[1][i]), [], None
                if not names[2][i]:
                    held.append(run)
                    continue
                if not held:
                    continue
                if x is None:
                    x = np.concatenate([_matrix(h.column("v"), dim) for h in held])
                    uids, ids = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("uid", "vec_id"))
                    rx = s.rows(x)
                for a in range(0, run.num_rows, QUERIES):
                    yield answers(run.slice(a, QUERIES))

    met = met.mapInArrow(tb.lean(meet), "quid long, query_id long, vec_id long, score double")
    best = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
