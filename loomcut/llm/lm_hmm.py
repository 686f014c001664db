"""LM scoring with a hidden Markov language model.

The model emits word *classes*: each of the ``own`` most frequent training
words is a class of its own, any other word belongs to one of ``forms``
classes by its last bytes, and the end of a text is one more.  A word has its
class's probability times its smoothed share of that class, so that the model
is a proper distribution over all texts whose emission table stays of one size
however large the vocabulary grows.

* Counting: one pass over the training texts, pre-aggregated in each task,
  then one aggregation by word.
* Encoding: a second pass writes class codes, and the hashes of the rarer
  words, to the shared folder.  The ``frequent`` most frequent words have
  their counts broadcast (the size is a parameter); all the others meet theirs
  in a join whose keys none is hot, since the hot ones were taken out.
* Baum-Welch: each iteration sums expected counts per task over all training
  texts, each taken whole, and adds them up in one aggregation of ``states *
  classes`` cells.
* Scoring: the scaled forward recursion over each whole text.
* Either recursion is a product of matrices, so segments of a long text are
  multiplied side by side and then chained: exact, over texts of any length.

Words are identified by a 64-bit hash of their lower-cased bytes.

Defined results: a null text is empty and has one token, the end; a null id
counts as the empty text for the fold and is returned as null; repeated rows
are scored alike and each count; an empty table gives no rows, and without any
training row every count is 0 and the model is uniform; of words of equal
count those of smaller hash come first; columns besides doc_id and text aren't
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .runtime import cut, fold

SEGMENT = 64
#: The same for training, where only texts longer than that need the matrices.
STRETCH = 512
STATES = 8
OWN = 4096
FORMS = 512
FREQUENT = 65536
ITERATIONS = 5
#: Most distinct words that a task holds before it passes its counts on.
HELD = 1 << 20
BASE_ALPHA = 0.1


def _hash_form(w: tb.Words, forms: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the class of its form: its last three bytes and whether it is short."""
    h = tb.hashes(w, lower=True)
    key = np.minimum(w.end - w.start, 4).astype(np.uint64)
    for back in (1, 2, 3):
        at = w.end - back
        byte = np.where(at >= w.start, tb.LOWER[w.buf[np.maximum(at, 0)]], 0).astype(np.uint64)
        key = key * np.uint64(256) + byte
    return h, (tb.mix(key) % np.uint64(forms)).astype(np.int16)


def count_words(docs: DataFrame, forms: int = FORMS) -> DataFrame:
    """``h, form, c`` of every word of ``text``; the end of texts isn't among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            h = np.concatenate([x[0] for x in held])
            u, first, inv = np.unique(h, return_index=True, return_inverse=True)
            c = np.bincount(inv, np.concatenate([x[2] for x in held])).astype(np.int64)
            return u, np.concatenate([x[1] for x in held])[first], c

        def rows(x):
            for i in range(0, x[0].size, 200_000):
                a, b, c = (v[i : i + 200_000] for v in x)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b), pa.array(c)], ["h", "form", "c"])

        for batch in batches:
            buf, offs = tb.buffers(batch.column(0))
            for i, j in tb.slices(offs):
                w = tb.words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                if not w.start.size:
                    continue
                h, form = _hash_form(w, forms)
                u, first, c = np.unique(h, return_index=True, return_counts=True)
                held.append((u, form[first], c))
                size += u.size
                if size > 2 * HELD:
                    held = [merged()]
                    size = held[0][0].size
                    if size > HELD:
                        yield from rows(held[0])
                        held, size = [], 0
        if held:
            yield from rows(merged())

    found = docs.select("text").mapInArrow(tb.lean(count), "h long, form short, c long")
    return found.groupBy("h", "form").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The bounded part of the counts that every task gets."""

    def __init__(self, h, c, own, form_n, form_v, n, v, ends, forms):
        order = np.argsort(h)
        rank = np.arange(h.size)
        self.h = h[order]
        self.c = c[order]
        self.code = np.where(rank < own, rank, -1)[order]
        self.own, self.forms = min(own, h.size), forms
        self.end = self.own + forms
        self.form_n, self.form_v = form_n, form_v
        self.n, self.v, self.ends = n, v, ends

    @property
    def classes(self) -> int:
        return self.end + 1

    def class_share(self) -> np.ndarray:
        """log10 of the smoothed size of each class: a word's share is ``(c + alpha)`` over it."""
        out = np.zeros(self.classes)
        out[self.own : self.end] = np.log10(self.form_n + BASE_ALPHA * (self.form_v + 1))
        return out


def _frequent(counts: DataFrame, most: int) -> Column:
    """A condition that about the ``most`` most frequent words meet, and not many more.

    It comes from a histogram of fixed size, so that no sort and no task's list
    of words goes to the driver; of the words of the bin that only some of can
    be taken, a hash chooses.
    """
    steps = 16  # bins for each doubling
    bin_ = F.floor(F.log2("c") * steps).cast("int")
    have, whole, taken = 0, None, None
    for b in sorted(counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).collect(), key=lambda b: -b["bin"]):
        if have + b["n"] > most:
            taken = (bin_ == b["bin"]) & (F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int((most - have) / b["n"] * (1 << 20)))
            break
        have, whole = have + b["n"], bin_ >= b["bin"]
    return F.lit(False) if whole is taken is None else taken if whole is None else whole if taken is None else whole | taken


def vocabulary(counts: DataFrame, ends: int, own: int = OWN, forms: int = FORMS, frequent: int = FREQUENT) -> Vocabulary:
    top = counts.where(_frequent(counts, max(own, frequent))).toPandas().sort_values(["c", "h"], ascending=[False, True])
    h = top.h.to_numpy().view(np.uint64)
    per = counts.groupBy("form").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas()
    form_n, form_v = np.zeros(forms), np.zeros(forms)
    form_n[per.form] = per.n
    form_v[per.form] = per.v
    n, v = int(per.n.sum()) + ends, int(per.v.sum()) + (ends > 0)
    mine = top.head(own)  # words with a class of their own aren't in their form's
    np.subtract.at(form_n, mine.form.to_numpy(int), mine.c.to_numpy(float))
    np.subtract.at(form_v, mine.form.to_numpy(int), 1)
    return Vocabulary(h, top.c.to_numpy(float), own, form_n, form_v, n, v, ends, forms)


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``rid, doc_id, held_out`` to: class codes, sums over the frequent words, hashes of the rest."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vo = shared.value
        logc = np.log10(vo.c + BASE_ALPHA)
        for batch in batches:
            buf, offs = tb.buffers(batch.column("text"))
            for i, j in tb.slices(offs):
                w = tb.words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                n = w.counts()
                h, form = _hash_form(w, vo.forms) if w.start.size else (np.zeros(0, np.uint64), np.zeros(0, np.int16))
                at = np.minimum(np.searchsorted(vo.h, h), max(vo.h.size - 1, 0))
                hit = vo.h[at] == h if vo.h.size else np.zeros(h.size, bool)
                code = np.where(hit & (vo.code[at] >= 0), vo.code[at], vo.own + form.astype(np.int64)) if vo.h.size else form.astype(np.int64)
                own = hit & (vo.code[at] >= 0) if vo.h.size else hit
                lg = np.where(hit, logc[at], 0.0) if vo.h.size else np.zeros(h.size)
                o = np.concatenate([[0], np.cumsum(n)])
                with_end = np.insert(code, o[1:], vo.end).astype(np.int16)
                oe = o + np.arange(o.size)
                rare = ~hit
                ro = np.concatenate([[0], np.cumsum(np.bincount(w.row[rare], minlength=w.rows))])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("rid"),
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array(n + 1),
                        pa.array(tb.row_sums(hit, o) + (vo.ends > 0)),
                        pa.array(tb.row_sums(lg, o)),
                        pa.array(tb.row_sums(np.where(own, 0.0, lg), o)),
                        pa.Array.from_buffers(pa.binary(), w.rows, [None, pa.py_buffer((oe * 2).astype(np.int32)), pa.py_buffer(with_end)]),
                        pa.ListArray.from_arrays(pa.array(ro.astype(np.int32)), pa.array(h[rare].view(np.int64))),
                    ],
                    ["rid", "doc_id", "held_out", "n_tokens", "n_known", "s_all", "s_form", "codes", "rare"],
                )

    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text").mapInArrow(
        tb.lean(run), f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, s_all double, s_form double, codes binary, rare array<long>"
    )


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (K,), (K, K), (classes, K)


def first_model(classes: int, states: int, prior: np.ndarray, seed: int = 7) -> Model:
    """The classes' own shares, disturbed differently in each state."""
    rng = np.random.default_rng(seed)
    emit = prior[:, None] * rng.uniform(0.5, 1.5, (classes, states))
    move = rng.uniform(0.5, 1.5, (states, states)) + 8 * np.eye(states)
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _segments(codes: np.ndarray, offs: np.ndarray, length: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes by step and segment (padded), the row of each segment, and whether it begins one."""
    n = np.diff(offs)
    parts = -(-n // length)
    row = np.repeat(np.arange(n.size), parts)
    nth = np.arange(row.size) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(length, n[row] - nth * length)
    begin = offs[:-1][row] + nth * length
    at = begin[:, None] + np.arange(length)
    return np.where(np.arange(length) < size[:, None], codes[np.minimum(at, codes.size - 1)], pad).T, row, nth


def _products(m: Model, seq: np.ndarray, live: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment the matrix from the state before it to the one at its end, scaled, and the scale's log10; ``begins``: no state is before it."""
    steps, n = seq.shape
    k = m.start.size
    emit = np.vstack([m.emit, np.ones(k)])
    prod = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    lg = np.zeros(n)
    for t in range(steps):
        on = live[t]
        if not on.any():
            break
        full = on.all()
        p = prod if full else prod[on]
        q = (p.reshape(-1, k) @ m.move).reshape(-1, k, k)
        if t == 0:  # a text's first word follows the start instead of a move
            q[begins[on] if not full else begins] = np.eye(k)
        q *= emit[seq[t] if full else seq[t][on]][:, None, :]
        if t % 8 == 7 or t == steps - 1:
            s = q.sum((1, 2))
            q /= s[:, None, None]
            if full:
                lg += np.log10(s)
            else:
                lg[on] += np.log10(s)
        if full:
            prod = q
        else:
            prod[on] = q
    return prod, lg


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(v.sum(1, keepdims=True), 1e-300)


def expected_counts(m: Model, codes: np.ndarray, offs: np.ndarray, length: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions over the rows' whole sequences, and their log10 likelihood."""
    classes, k = m.emit.shape
    seq, row, nth = _segments(codes, offs, length, classes)
    size = (seq != classes).sum(0)
    order = np.argsort(-size, kind="stable")  # so that those still running are the first
    place = np.empty_like(order)
    place[order] = np.arange(order.size)
    seq, row, nth, size = seq[: size.max(initial=0), order], row[order], nth[order], size[order]
    steps, n = seq.shape
    emit = np.vstack([m.emit, np.ones(k)])
    before = np.broadcast_to(m.start, (n, k)).copy()  # the state before a segment, or the start
    after = np.ones((n, k))  # what comes behind a segment, by the state at its end
    last = int(nth.max(initial=0))
    if last:
        parts = np.bincount(row)
        many = np.flatnonzero(parts[row] > 1)
        prod, _ = _products(m, seq[:, many], seq[:, many] != classes, nth[many] == 0)
        where = np.empty(n, np.int64)
        where[many] = np.arange(many.size)
        first = np.cumsum(parts) - parts  # a row's segments in the order before sorting
        for i in range(1, last + 1):
            at = np.flatnonzero(parts > i)
            here, back = place[first[at] + i], place[first[at] + i - 1]
            before[here] = _unit(np.einsum("nk,nkl->nl", before[back], prod[where[back]]))
        for i in range(last, 0, -1):
            at = np.flatnonzero(parts > i)
            here, back = place[first[at] + i], place[first[at] + i - 1]
            after[back] = _unit(np.einsum("nkl,nl->nk", prod[where[here]], after[here]))
    alive = np.searchsorted(-size, -np.arange(steps), side="left")  # segments longer than each step
    alpha, scale = np.zeros((steps, n, k)), np.ones((steps, n))
    a = np.where((nth == 0)[:, None], before, before @ m.move)
    for t in range(steps):
        c = alive[t]
        a = (a[:c] if t == 0 else a[:c] @ m.move) * emit[seq[t, :c]]
        s = a.sum(1)
        a /= s[:, None]
        alpha[t, :c], scale[t, :c] = a, s
    like = float(np.log10(scale).sum())
    b = after / np.maximum((alpha[size - 1, np.arange(n)] * after).sum(1, keepdims=True), 1e-300)
    xi, start = np.zeros((k, k)), np.zeros(k)
    for t in range(steps - 1, -1, -1):
        c = alive[t]
        e = emit[seq[t, :c]] * b[:c] / scale[t, :c][:, None]
        alpha[t, :c] *= b[:c]  # from here on the chance of each state
        if t:
            xi += alpha[t - 1, :c].T @ e
            b[:c] = e @ m.move.T
        else:
            xi += before[nth > 0].T @ e[nth > 0]
            start = alpha[0][nth == 0].sum(0)
    flat = seq.ravel()
    out = np.stack([np.bincount(flat, alpha[:, :, s].ravel(), classes + 1)[:classes] for s in range(k)], 1) if n else np.zeros((classes, k))
    return start, xi * m.move, out, like


def train(encoded: DataFrame, vocab: Vocabulary, states: int = STATES, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch over all rows that aren't held out."""
    spark = encoded.sparkSession
    classes = vocab.classes
    prior = np.ones(classes)
    order = np.argsort(vocab.code[vocab.code >= 0])
    prior[: vocab.own] += vocab.c[vocab.code >= 0][order]
    prior[vocab.own : vocab.end] += vocab.form_n
    prior[vocab.end] += vocab.ends
    prior /= prior.sum()
    model = first_model(classes, states, prior)
    if not vocab.ends:
        return model
    rows = encoded.where(~F.col("held_out")).select("codes")
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            total = None
            for batch in batches:
                buf, offs = tb.buffers(batch.column(0))
                for i, j in tb.slices(offs, 1 << 20):
                    part = buf[offs[i] : offs[j]].view(np.int16).astype(np.int64)
                    x = expected_counts(m, part, (offs[i : j + 1] - offs[i]) // 2)
                    total = list(x[:3]) if total is None else [p + q for p, q in zip(total, x[:3])]
            if total is not None:
                flat = np.concatenate([x.ravel() for x in total])
                at = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], ["cell", "x"])

        got = rows.mapInArrow(tb.lean(run), "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()
        flat = np.zeros(states + states * states + classes * states)
        flat[got.cell.to_numpy()] = got.x.to_numpy()
        start, move, emit = np.split(flat, [states, states + states * states])
        start = start + 1
        move = move.reshape(states, states) + 1
        emit = emit.reshape(classes, states) + 2 * prior[:, None] * states
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        shared.unpersist()
    return model


def log_likelihood(m: Model, codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """log10 likelihood of each row's whole sequence: the forward recursion, exactly."""
    classes, k = m.emit.shape
    rows = offs.size - 1
    seq, row, nth = _segments(codes, offs, SEGMENT, classes)
    like = np.zeros(rows)
    if not row.size:
        return like
    begins = nth == 0
    prod, lg = _products(m, seq, seq != classes, begins)
    state = np.broadcast_to(m.start, (rows, k)).copy()
    for i in range(int(nth.max()) + 1):  # segments of a text, one after the other
        at = np.flatnonzero(nth == i) if i else np.flatnonzero(begins)
        r = row[at]
        v = np.einsum("nk,nkl->nl", state[r], prod[at])
        s = v.sum(1)
        state[r] = v / s[:, None]
        like[r] += lg[at] + np.log10(s)
    return like


def score(encoded: DataFrame, vocab: Vocabulary, model: Model, counts: DataFrame) -> DataFrame:
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast((vocab.class_share(), model))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, m = shared.value
        for batch in batches:
            buf, offs = tb.buffers(batch.column("codes"))
            for i, j in tb.slices(offs, 1 << 18):
                part = buf[offs[i] : offs[j]].view(np.int16).astype(np.int64)
                o = (offs[i : j + 1] - offs[i]) // 2
                lp = log_likelihood(m, part, o) - tb.row_sums(share[part], o)
                b = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rid", "doc_id", "held_out", "n_tokens", "n_known", "s_all")), pa.array(lp + b.column("s_form").to_numpy())], ["rid", "doc_id", "held_out", "n_tokens", "n_known", "s_all", "lp"])

    schema = f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, s_all double, lp double"
    scored = encoded.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "s_all", "s_form", "codes").mapInArrow(tb.lean(run), schema)
    rare = (
        encoded.select("rid", F.explode("rare").alias("h"))
        .join(counts.select("h", "c"), "h", "left")
        .groupBy("rid")
        .agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + BASE_ALPHA)).alias("s"), F.count("c").alias("known"))
    )
    n, v = vocab.n, vocab.v
    end = float(np.log10(vocab.ends + BASE_ALPHA))
    total = float(np.log10(n + BASE_ALPHA * (v + 1)))
    s = F.coalesce("s", F.lit(0.0))
    return scored.join(rare, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("s_all") + s + F.lit(end) - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("lp") + s).alias("score"),
    )


def lm_score(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS, own: int = OWN, forms: int = FORMS, frequent: int = FREQUENT) -> DataFrame:
    """Scores of every row of ``docs`` (``doc_id``, ``text``) under a model learned from the training fold."""
    own = min(own, frequent, 32000 - forms)
    docs = docs.select("doc_id", "text").withColumn("held_out", fold(10) == 0)
    train_docs = docs.where(~F.col("held_out"))
    counts = cut(count_words(train_docs, forms), "lm-counts")
    ends = train_docs.select(F.count(F.lit(1))).first()[0]
    vocab = vocabulary(counts, ends, own, forms, frequent)
    encoded = cut(encode(docs, vocab), "lm-codes")
    model = train(encoded, vocab, states, iterations)
    return score(encoded, vocab, model, counts)
