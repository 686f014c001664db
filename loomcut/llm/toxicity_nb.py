"""Toxicity: a linear classifier of character n-grams scaled by log-count ratios.

Features are the n-grams of 3, 4 and 5 characters that a text holds (letters
A-Z in lower case), hashed into ``2 ** HASH_BITS`` buckets.  Each is scaled by
its naive Bayes log-count ratio between labelled toxic and clean texts; all
buckets that tell the classes apart (a likelihood ratio of ``LEAST_G`` at
least) enter a logistic regression with an L2 penalty, in which both classes
weigh the same.  It is fitted by L-BFGS: loss and gradient are summed in
``PARTS`` tasks over the features' table, and only these sums, of the size of
the feature space, reach the driver.

The classifier is fitted on about ``TRAIN_ROWS`` labelled rows of the training
fold, drawn by a hash of their id; that bound is a parameter.  Everything is
scored.  ``labels``, ``lang``, ``source`` and ``doc_id`` don't enter a score.

Defined results: null and empty text gets the score of a text without
features; a document labelled twice counts as toxic if either label says so;
null labels are left out; without any training row, or with one class only,
every score is the training rows' share of toxic ones (0 without any);
repeated rows are scored alike; a score of exactly 0.5 is predicted toxic; a
long text is scored whole; columns besides doc_id and text aren't read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .rowwise import keep_where
from .runtime import cut, drop_cut, fold, id_text

SIZES = (3, 4, 5)
HASH_BITS = 20
TRAIN_ROWS = 20_000
#: Least likelihood-ratio statistic of a feature; chance alone hardly reaches it.
LEAST_G = 6.0
PENALTY = 1e-3
STEPS = 40
#: Tasks that share a sum of the gradient, and so how many of them the driver adds up.
PARTS = 8

#: Bytes of text whose features are taken at once.
_SLICE = 1 << 19
_MULT = np.random.default_rng(11).integers(0, 1 << 63, (max(SIZES) + 1, max(SIZES)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number for each character (its lower-cased bytes), and where it begins."""
    b = tb.LOWER[buf]
    lead = (b & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    v = b[at].astype(np.uint64)
    tail = np.zeros(b.size + 3, np.uint8)
    tail[: b.size] = np.where(lead, 0, b)
    more = np.ones(at.size, bool)
    for k in (1, 2, 3):
        x = tail[at + k]
        more &= x > 0
        if not more.any():
            break
        v += np.where(more, x, 0).astype(np.uint64) << np.uint64(8 * k)
    return v, at


def features(buf: np.ndarray, offs: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of the distinct features (of those ``wanted``), in order.

    Bytes are taken ``_SLICE`` at a time, so a long text needs no more memory
    than its features, of which there are at most as many as buckets.
    """
    keys: list[np.ndarray] = []
    v, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin, most = 0, max(SIZES) - 1
    while begin < buf.size:
        end = min(begin + _SLICE, buf.size)
        while end < buf.size and buf[end] & 0xC0 == 0x80:
            end += 1
        new, at = characters(buf[begin:end])
        old = v.size
        v, row = np.concatenate([v, new]), np.concatenate([row, np.searchsorted(offs, at + begin, side="right") - 1])
        for n in SIZES:
            first = max(0, old - n + 1)  # earlier ones have been taken
            m = v.size - n + 1 - first
            if m <= 0:
                continue
            with np.errstate(over="ignore"):
                s = v[first : first + m] * _MULT[n, 0]
                for k in range(1, n):
                    s += v[first + k : first + m + k] * _MULT[n, k]
                s ^= s >> np.uint64(29)
                s *= np.uint64(0xBF58476D1CE4E5B9)
            bucket = (s >> np.uint64(64 - HASH_BITS)).astype(np.int64)
            whole = row[first : first + m] == row[first + n - 1 :]
            if wanted is not None:
                whole &= wanted[bucket]
            keys.append((row[first : first + m][whole] << HASH_BITS) | bucket[whole])
        if len(keys) > 4 * len(SIZES):
            keys = [np.unique(np.concatenate(keys))]
        v, row, begin = v[-most:], row[-most:], end
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> HASH_BITS, key & ((1 << HASH_BITS) - 1)


class Classifier:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def score(self, text: pa.Array) -> np.ndarray:
        buf, offs = tb.buffers(text)
        wanted = self.weights != 0
        out = [np.zeros(0)]
        for i, j in tb.slices(offs, _SLICE):
            row, bucket = features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], wanted)
            z = self.bias + np.bincount(row, self.weights[bucket].astype(float), minlength=j - i)
            out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return np.concatenate(out)


def _gradient(design: DataFrame, scale: np.ndarray, rates: np.ndarray) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Penalised loss and its gradient at weights (the bias last), summed over the rows ``y, b`` of ``design``; ``rates``: a row's weight by class."""
    spark = design.sparkSession
    fixed = spark.sparkContext.broadcast((scale, rates))

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (scale, rates), w = fixed.value, shared.value
            v, loss, g, gb = scale * w[:-1], 0.0, np.zeros(scale.size), 0.0
            for batch in batches:
                y = batch.column("y").to_numpy()
                o = batch.column("b").offsets.to_numpy().astype(np.int64)
                col = batch.column("b").flatten().to_numpy()
                o = o - o[0]
                z = tb.row_sums(v[col], o) + w[-1]
                rate = rates[y]
                loss += float((rate * np.logaddexp(0, np.where(y > 0, -z, z))).sum())
                d = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * rate
                g += np.bincount(col, np.repeat(d, np.diff(o)), minlength=scale.size)
                gb += d.sum()
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([np.append(g * scale, gb).tobytes()])], ["loss", "g"])

        got = design.mapInArrow(run, "loss double, g binary").toArrow()
        shared.unpersist()
        loss, g = 0.0, np.zeros(w.size)
        for x, raw in sorted(zip(got.column("loss").to_pylist(), got.column("g").to_pylist())):
            loss, g = loss + x, g + np.frombuffer(raw)
        g[:-1] += PENALTY * w[:-1]
        return loss + PENALTY / 2 * float((w[:-1] ** 2).sum()), g

    return at


def minimised(at: Callable[[np.ndarray], tuple[float, np.ndarray]], n: int, steps: int = STEPS, kept: int = 8) -> np.ndarray:
    """Where ``at`` is least, by L-BFGS from 0 with a backtracking search."""
    w = np.zeros(n)
    loss, g = at(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, a = g.copy(), []
        for s, y, r in reversed(past):
            a.append(r * (s @ q))
            q -= a[-1] * y
        if past:
            s, y, r = past[-1]
            q *= 1 / (r * (y @ y))
        else:
            q /= max(np.sqrt(g @ g), 1e-300)
        for (s, y, r), x in zip(past, reversed(a)):
            q += (x - r * (y @ q)) * s
        slope, rate = -(g @ q), 1.0
        for _ in range(20):
            new = w - rate * q
            l2, g2 = at(new)
            if l2 <= loss + 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            return w
        s, y = new - w, g2 - g
        if s @ y > 1e-12:
            past = [*past[1 - kept :], (s, y, 1 / (s @ y))]
        done = loss - l2 < 1e-5 * max(loss, 1e-12)
        w, loss, g = new, l2, g2
        if done:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Classifier:
    """Learn from the labelled rows of ``docs`` outside the held-out fold."""
    spark = docs.sparkSession
    told = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(5) != 0)).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("y"))
    told = cut(told, "labels")
    n = told.count()
    part = told.where(F.pmod(F.xxhash64(id_text()), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, train_rows / max(n, 1)))))
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(part), "doc_id"), "toxicity-sample")
    rows = sample.groupBy("y").count().collect()
    sizes = {r["y"]: r["count"] for r in rows}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        share = pos / max(pos + neg, 1)
        return Classifier(np.zeros(1 << HASH_BITS), float(np.log((share + 1e-9) / (1 - share + 1e-9))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << HASH_BITS), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy()
            buf, offs = tb.buffers(batch.column("text"))
            for i, j in tb.slices(offs, _SLICE):
                row, bucket = features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                for k in (0, 1):
                    total[k] += np.bincount(bucket[y[i:j][row] == k], minlength=1 << HASH_BITS)
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0, at]), pa.array(total[1, at])], ["bucket", "q", "p"])

    got = sample.select("text", "y").mapInArrow(tb.lean(count), "bucket int, q long, p long").groupBy("bucket").agg(F.sum("q").alias("q"), F.sum("p").alias("p")).where("p + q >= 3").toPandas()
    p, q = got.p.to_numpy(float), got.q.to_numpy(float)
    ratio = np.log((p + 1) / (p + 1).sum()) - np.log((q + 1) / (q + 1).sum())
    # likelihood ratio of presence against class
    a, total = p + q, pos + neg
    cell = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)), 0)
    g = cell(p, a * pos / total) + cell(q, a * neg / total) + cell(pos - p, (total - a) * pos / total) + cell(neg - q, (total - a) * neg / total)
    tells = g >= LEAST_G
    by = np.argsort(got.bucket.to_numpy()[tells])
    bucket, scale = got.bucket.to_numpy()[tells][by], ratio[tells][by]
    if not bucket.size:
        return Classifier(np.zeros(1 << HASH_BITS), 0.0)
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[bucket] = np.arange(bucket.size)
    shared = spark.sparkContext.broadcast(place)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value >= 0
        for batch in batches:
            buf, offs = tb.buffers(batch.column("text"))
            for i, j in tb.slices(offs, _SLICE):
                row, b = features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], wanted)
                o = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(i, j - i), pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(shared.value[b]))], ["y", "b"])

    design = cut(sample.select("text", "y").mapInArrow(tb.lean(vectors), "y int, b array<int>").coalesce(PARTS), "toxicity-features")
    w = minimised(_gradient(design.coalesce(PARTS), scale, np.array([0.5 / neg, 0.5 / pos])), bucket.size + 1)
    drop_cut(design)
    weights = np.zeros(1 << HASH_BITS)
    weights[bucket] = w[:-1] * scale
    return Classifier(weights, float(w[-1]))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(batch.column("text")))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(tb.lean(run), f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` scored under 0.5, with the columns they had, whatever their names; nulls and repeated rows as in ``toxicity``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return keep_where(docs, lambda b: pa.array(model.value.score(b.column("text")) < 0.5))
