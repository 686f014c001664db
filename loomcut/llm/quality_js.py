"""Quality rules by distribution divergence.

For every language (the ``lang`` column) one pass over all documents adds up a
histogram of character classes and the counts of all words; the ``COMMON``
most frequent words, and all others together, make the word histogram.  A
document is compared with its language's references by Jensen-Shannon distance
(base 2, so from 0 to 1) and rejected when either exceeds a limit that is
wider for short texts, whose histograms scatter: ``limit + slack /
sqrt(words)``.  Guards: a text under ``LEAST_WORDS`` words, or a language under
``LEAST_REFERENCE`` words, isn't judged by the distances.  The references of
the ``BROADCAST`` languages with most words are broadcast; those of all others,
none of which is hot, are joined to their documents by language.

Before that come fixed rules: a text fails with fewer than 20 words, or when
more than 30 % of its words lie in 8-word windows found twice or more.

Defined results: null and empty text has no words and fails; a null lang is a
language of its own; repeated rows are judged alike; a long text is judged whole;
of common words of equal count those of smaller hash come first; a distance
equal to its limit is kept; columns besides doc_id, text and lang aren't read;
an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbuf as tb
from .rowwise import keep_where

COMMON = 64
LEAST_WORDS = 20
LEAST_REFERENCE = 5000
BROADCAST = 1024
CHAR_LIMIT, CHAR_SLACK = 0.14, 1.2
WORD_LIMIT, WORD_SLACK = 0.20, 2.5
WINDOW = 8
#: Most distinct (language, word) counts that a task holds before it passes them on.
HELD = 1 << 20

CLASSES = 8
_CLASS = np.full(256, 5)
_CLASS[tb.WS] = 0
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in ".,;:'\"!?-()"]] = 4
_CLASS[0x80:0xC0] = 7  # bytes inside a character; not counted
_CLASS[0xC0:] = 6
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
_MULT = np.random.default_rng(5).integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _plain(w: tb.Words) -> np.ndarray:
    """Hashes of the lower-cased words without closing punctuation."""
    end = w.end
    for _ in range(2):
        end = np.where((end - w.start > 1) & _STOP[w.buf[end - 1]], end - 1, end)
    return tb.hashes(tb.Words(w.buf, w.offs, w.start, end, w.row), lower=True)


def _char_classes(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    rows = offs.size - 1
    row = np.repeat(np.arange(rows), np.diff(offs))
    return np.bincount(row * CLASSES + _CLASS[buf], minlength=rows * CLASSES).reshape(rows, CLASSES)[:, : CLASSES - 1]


def _langs(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    d = batch.column("lang").cast(pa.string()).fill_null("").dictionary_encode()
    return d.indices.to_numpy(), d.dictionary.to_pylist()


def counts_by_language(docs: DataFrame) -> DataFrame:
    """``lang, kind, h, c``: kind 0 counts characters by class ``h``, kind 1 words by hash ``h``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CLASSES - 1, np.int64))
        found: dict[str, list] = defaultdict(list)
        held = 0

        def merged(parts):
            h, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return h, np.bincount(inv, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out(lang, kind, h, c):
            n = len(h)
            return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(h).astype(np.int64) if kind == 0 else h.view(np.int64)), pa.array(c)], ["lang", "kind", "h", "c"])

        for batch in batches:
            code, names = _langs(batch)
            buf, offs = tb.buffers(batch.column("text"))
            for i, j in tb.slices(offs):
                b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                w = tb.words(b, o)
                lang, h, hist = code[i:j], _plain(w), _char_classes(b, o)
                for k in np.unique(lang):
                    chars[names[k]] += hist[lang == k].sum(0)
                    u, c = np.unique(h[lang[w.row] == k], return_counts=True)
                    found[names[k]].append((u, c))
                    held += u.size
                if held > 2 * HELD:
                    found = defaultdict(list, {k: [merged(v)] for k, v in found.items()})
                    held = sum(v[0][0].size for v in found.values())
                    if held > HELD:
                        for k, v in found.items():
                            yield out(k, 1, *v[0])
                        found, held = defaultdict(list), 0
        for k, v in found.items():
            yield out(k, 1, *merged(v))
        for k, v in chars.items():
            yield out(k, 0, np.arange(CLASSES - 1), v)

    got = docs.select("text", "lang").mapInArrow(tb.lean(run), "lang string, kind int, h long, c long")
    return got.groupBy("lang", "kind", "h").agg(F.sum("c").alias("c"))


class References:
    """Histograms of the languages: a table of a bounded number of rows."""

    def __init__(self, names: list[str], chars: np.ndarray, word_keys: np.ndarray, word_bins: np.ndarray, shares: np.ndarray):
        self.index = {n: i for i, n in enumerate(names)}
        self.chars, self.shares = chars, shares
        order = np.argsort(word_keys)
        self.keys, self.bins = word_keys[order], word_bins[order]

    @staticmethod
    def key(h: np.ndarray, lang: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return h ^ (lang.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    def word_bin(self, h: np.ndarray, lang: np.ndarray) -> np.ndarray:
        if not self.keys.size:
            return np.full(h.size, COMMON)
        k = self.key(h, lang)
        at = np.minimum(np.searchsorted(self.keys, k), self.keys.size - 1)
        return np.where(self.keys[at] == k, self.bins[at], COMMON)


def _from_counts(counts: dict[str, list[tuple[int, int, int, int, int]]]) -> References:
    """References of languages by their ``(n, kind, r, h, c)``: words in all, and a class or word of rank ``r`` with its count."""
    names = sorted(counts)
    chars, shares = np.zeros((len(names), CLASSES - 1)), np.zeros((len(names), COMMON + 1))
    keys, bins = [], []
    for i, name in enumerate(names):
        for n, kind, r, h, c in counts[name]:
            if kind == 0:
                chars[i, h] = c
            else:
                shares[i, r - 1] = c
                keys.append(References.key(np.array([h]).view(np.uint64), np.array([i]))[0])
                bins.append(r - 1)
        shares[i, COMMON] = n - shares[i].sum()
    norm = lambda x: x / np.maximum(x.sum(1, keepdims=True), 1)
    return References(names, norm(chars), np.array(keys, np.uint64), np.array(bins, np.int64), norm(shares))


def references(docs: DataFrame) -> tuple[References, DataFrame | None]:
    """References of the languages with most words, and a table ``lang, counts`` of all others, if there are any."""
    from .runtime import cut

    counts = cut(counts_by_language(docs), "words-by-language")
    totals = counts.where("kind = 1").groupBy("lang").agg(F.sum("c").alias("n"))
    known = cut(totals.where(F.col("n") >= LEAST_REFERENCE), "languages")
    first = known.orderBy(F.desc("n"), "lang").limit(BROADCAST)
    most = docs.sparkSession.createDataFrame(first.collect(), known.schema)
    best = Window.partitionBy("lang", "kind").orderBy(F.desc("c"), "h")
    ranked = lambda part: part.withColumn("r", F.row_number().over(best)).where(f"r <= {COMMON}")
    got = defaultdict(list)
    for x in ranked(counts.join(F.broadcast(most), "lang")).collect():
        got[x.lang].append((x.n, x.kind, x.r, x.h, x.c))
    if known.count() <= BROADCAST:
        return _from_counts(got), None
    others = known.join(F.broadcast(most.select("lang")), "lang", "left_anti")
    rest = ranked(counts.join(others, "lang")).groupBy("lang").agg(F.collect_list(F.struct("n", "kind", "r", "h", "c")).alias("counts"))
    return _from_counts(got), cut(rest, "references")


def _with_references(docs: DataFrame, judge: Callable[[DataFrame, Callable[[pa.RecordBatch], References]], DataFrame]) -> DataFrame:
    """``judge`` of the documents, told how to find a batch's references; they may come with a column more."""
    most, rest = references(docs)
    shared = docs.sparkSession.sparkContext.broadcast(most)
    if rest is None:
        return judge(docs, lambda batch: shared.value)
    name, at = f"_lang_{uuid.uuid4().hex}", f"_counts_{uuid.uuid4().hex}"
    rest = rest.select(F.col("lang").alias(name), F.col("counts").alias(at))
    names = docs.sparkSession.createDataFrame([(n,) for n in most.index], f"{name} string")
    same = F.coalesce(docs["lang"].cast("string"), F.lit("")) == F.col(name)

    def own(batch: pa.RecordBatch) -> References:
        code, langs = _langs(batch)
        _, i = np.unique(code, return_index=True)
        found = ((langs[code[k]], batch.column(at)[k].as_py()) for k in i.tolist())
        return _from_counts({lang: [(c["n"], c["kind"], c["r"], c["h"], c["c"]) for c in cs] for lang, cs in found if cs is not None})

    frequent = docs.join(F.broadcast(names), same, "left_semi")
    others = docs.join(F.broadcast(names), same, "left_anti").join(rest, same, "left").drop(name)
    return judge(frequent, lambda batch: shared.value).unionByName(judge(others, own).drop(at))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each pair of rows."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(1)
        return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def repeated_words(w: tb.Words, h: np.ndarray) -> np.ndarray:
    """Per row: words inside windows of ``WINDOW`` words that occur twice or more in it."""
    n = w.counts()
    first = np.cumsum(n) - n
    out = np.zeros(n.size, np.int64)
    if h.size < WINDOW:
        return out
    with np.errstate(over="ignore"):
        s = sum((h[k : h.size - WINDOW + 1 + k] * _MULT[k] for k in range(1, WINDOW)), h[: h.size - WINDOW + 1] * _MULT[0])
    s = tb.mix(s)
    for i in np.flatnonzero(n > WINDOW):
        own = s[first[i] : first[i] + n[i] - WINDOW + 1]
        a = np.sort(own)
        twice = a[1:][a[1:] == a[:-1]]
        if twice.size:
            twice = np.unique(twice)
            hit = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, own), twice.size - 1)] == own)
            cover = np.zeros(n[i] + 1, np.int64)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + WINDOW, -1)
            out[i] = np.count_nonzero(np.cumsum(cover)[:-1])
    return out


def duplicate_lines(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per row: lines with a word that equal an earlier line."""
    member = np.ones(256, bool)
    member[10] = False
    lines = tb.words(buf, offs, member)
    if not lines.start.size:
        return np.zeros(lines.rows, np.int64)
    solid = np.concatenate([[0], np.cumsum(~tb.WS[buf])])
    has = solid[lines.end] > solid[lines.start]
    lines = tb.Words(buf, offs, lines.start[has], lines.end[has], lines.row[has])
    many = np.bincount(lines.row, minlength=lines.rows)[lines.row] > 1
    lines = tb.Words(buf, offs, lines.start[many], lines.end[many], lines.row[many])
    if not lines.start.size:
        return np.zeros(lines.rows, np.int64)
    h = tb.hashes(lines)
    order = np.lexsort((h, lines.row))
    r, v = lines.row[order], h[order]
    same = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    return np.bincount(r[1:][same], minlength=lines.rows)


def measure(batch: pa.RecordBatch, refs: References) -> dict[str, np.ndarray]:
    """Counts, distances and verdicts of a batch with columns ``text`` and ``lang``."""
    code, names = _langs(batch)
    to = np.array([refs.index.get(x, -1) for x in names] or [-1])
    buf, offs = tb.buffers(batch.column("text"))
    parts = []
    for i, j in tb.slices(offs):
        b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        w = tb.words(b, o)
        n = w.counts()
        chars = _char_classes(b, o)
        lang = to[code[i:j]]
        bins = refs.word_bin(_plain(w), lang[w.row])
        hist = np.bincount(w.row * (COMMON + 1) + bins, minlength=n.size * (COMMON + 1)).reshape(n.size, COMMON + 1)
        x = {"n_words": n, "word_chars": chars.sum(1) - chars[:, 0], "n_symbols": tb.row_sums(_SYMBOL[b], o), "n_dup_lines": duplicate_lines(b, o), "n_repeat_words": repeated_words(w, tb.hashes(w))}
        x["base_failed"] = (n < 20) | (100 * x["n_repeat_words"] > 30 * n)
        judged = (lang >= 0) & (n >= LEAST_WORDS)
        x["char_distance"], x["word_distance"] = np.full(n.size, np.nan), np.full(n.size, np.nan)
        if judged.any():
            share = lambda v: v[judged] / v[judged].sum(1, keepdims=True)
            x["char_distance"][judged] = js_distance(share(chars), refs.chars[lang[judged]])
            x["word_distance"][judged] = js_distance(share(hist), refs.shares[lang[judged]])
        root = np.sqrt(np.maximum(n, 1))
        with np.errstate(invalid="ignore"):
            far = (x["char_distance"] > CHAR_LIMIT + CHAR_SLACK / root) | (x["word_distance"] > WORD_LIMIT + WORD_SLACK / root)
        x["kept"] = ~x["base_failed"] & ~far
        parts.append(x)
    if not parts:
        return {}
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "char_distance": "double", "word_distance": "double"}


def quality(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``COLUMNS`` of every row; a distance that wasn't taken is null."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judge(part: DataFrame, refs: Callable[[pa.RecordBatch], References]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = measure(batch, refs(batch))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x[k], from_pandas=True) for k in COLUMNS)], ["doc_id", *COLUMNS])

        return part.mapInArrow(tb.lean(run), f"doc_id {kind}, " + ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))

    return _with_references(docs.select("doc_id", "text", "lang"), judge)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that ``quality`` keeps, with the columns they had."""
    return _with_references(docs, lambda part, refs: keep_where(part, lambda b: pa.array(measure(b, refs(b)).get("kept", np.zeros(0, bool)))))
