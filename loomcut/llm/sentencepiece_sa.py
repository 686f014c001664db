"""SentencePiece encoding and decoding by suffix-array matching.

The pieces of a BPE model with byte fallback are matched against a whole batch
at once.  A text is split before every run of spaces (no piece has a space
after another character, so nothing merges across), and the batch's distinct
units are joined into one string.  Its suffix array is built by prefix
doubling up to the longest piece; every piece is found by binary search as a
range of it; the ranges' occurrences are the edges of a graph over positions.
Edges sorted by position are then relaxed for all units side by side: each
position has exactly one last token whose pair with the token before it merges
no further, which is what the greedy merges of BPE give.  (A piece's place in a
BPE encoding isn't the best sum of scores, so pairs are tested instead.)
Tests of pairs are remembered, and so are units with their ids: by a hash, and
by their bytes, so that units of equal hash are told apart.

Results equal those of the sentencepiece library on models with the identity
normaliser, a dummy prefix and kept white space; others are refused.

Defined results: null and empty text has no tokens and decodes to the empty
text; a literal U+2581 is encoded as a space (so it decodes to one); characters
without a piece become the pieces of their bytes; a text without spaces is one
unit, however long; repeated rows are encoded alike; columns besides doc_id and
text aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from . import textbuf as tb

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A session's own path of the model.
SETTING = "spark.loomcut.sentencepiece"
MODEL_BYTES = 32 << 20
#: Units whose encoding a worker remembers before it starts anew, and their bytes.
REMEMBERED = 1 << 20
REMEMBERED_BYTES = 16 << 20
#: Characters that are indexed at once; the edges over them take about 200 bytes each.
INDEXED = 200_000
#: Bytes of text whose ids are put together at once; the temporaries are about 20 times that.
_SLICE = 1 << 20
#: Of these, bytes that are hashed and compared at once.
_STEP = 1 << 18
_SPACE = "▁"
_SPACE_BYTES = _SPACE.encode()


class Pieces:
    """What encoding and decoding need of a model; its size is that of the vocabulary."""

    def __init__(self, path: str, raw: bytes | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path) if raw is None else sentencepiece.SentencePieceProcessor(model_proto=raw)
        probe = " a  b\n"
        if model.decode(model.encode(probe)) != probe:
            raise ValueError(f"{path}: only models that keep white space are supported")
        n = model.get_piece_size()
        self.size = n
        self.text = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.score = {t: model.get_score(i) for i, t in enumerate(self.text) if not special[i]}
        if any(_SPACE in t.lstrip(_SPACE) for t in self.score):
            raise ValueError(f"{path}: a piece has a space after another character")
        self.id = {t: i for i, t in enumerate(self.text) if not special[i]}
        self.ids = np.array(list(self.id.values()))
        self.lengths = np.array([len(t) for t in self.id])
        self.width = int(self.lengths.max())
        self.codes = np.zeros((self.ids.size, self.width), np.uint32)
        for k, t in enumerate(self.id):
            self.codes[k, : len(t)] = [ord(c) for c in t]
        self.single = np.unique([ord(t) for t in self.id if len(t) == 1])
        raw = [b"" if special[i] else t.replace(_SPACE, " ").encode() for i, t in enumerate(self.text)]
        for b, i in enumerate(self.byte):
            raw[i] = bytes([b])
        self.raw_size = np.array([len(x) for x in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)


def bpe(text: str, score: dict[str, float]) -> list[str]:
    """Greedy merges of the best-scored adjacent pair, the leftmost of equals."""
    part = list(text)
    while True:
        best, at = None, -1
        for i in range(len(part) - 1):
            s = score.get(part[i] + part[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if at < 0:
            return part
        part[at : at + 2] = [part[at] + part[at + 1]]


def suffix_array(codes: np.ndarray, width: int) -> np.ndarray:
    """Positions ordered by their next ``width`` codes, by prefix doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < width:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:] + 1
        rank = np.unique(rank * (rank.max() + 2) + after, return_inverse=True)[1]
        k *= 2
    return np.argsort(rank, kind="stable")


def occurrences(codes: np.ndarray, sa: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Range of the suffix array where each piece occurs: binary search, one character after the other."""
    padded = np.concatenate([codes, np.zeros(pieces.width, codes.dtype)])
    lo, hi = np.zeros(pieces.ids.size, np.int64), np.full(pieces.ids.size, sa.size)
    for k in range(pieces.width):
        live = np.flatnonzero((pieces.lengths > k) & (lo < hi))
        want = pieces.codes[live, k]
        for upper in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                got = padded[sa[np.minimum(mid, sa.size - 1)] + k]
                right = open_ & ((got <= want) if upper else (got < want))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            if upper:
                hi[live] = a
            else:
                first = a
        lo[live] = first
    return lo, hi


def _equal(a: np.ndarray, a_at: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_n: np.ndarray) -> np.ndarray:
    """Whether each range of ``a`` holds the same bytes as that of ``b``."""
    same = a_n == b_n
    n = np.where(same, a_n, 0)
    offs = np.concatenate([[0], np.cumsum(n)])
    for i, j in tb.slices(offs, _STEP):
        m, o = n[i:j], offs[i : j + 1] - offs[i]
        step = np.arange(int(o[-1])) - np.repeat(o[:-1], m)
        differ = a[np.repeat(a_at[i:j], m) + step] != b[np.repeat(b_at[i:j], m) + step]
        if differ.any():
            same[i:j] &= tb.row_sums(differ, o) == 0
    return same


class _Ranges:
    """Ranges of values, one after another, in an array that is seldom copied."""

    def __init__(self, kind: type):
        self.data, self.offs = np.empty(0, kind), np.zeros(1, np.int64)

    def add(self, values: np.ndarray, n: np.ndarray) -> None:
        used = int(self.offs[-1])
        if used + values.size > self.data.size:
            grown = np.empty(max(used + values.size, 2 * self.data.size), self.data.dtype)
            grown[:used] = self.data[:used]
            self.data = grown
        self.data[used : used + values.size] = values
        self.offs = np.concatenate([self.offs, used + np.cumsum(n)])


class Encoder:
    """A worker's encoder: pieces, pairs tested so far, units encoded so far."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.keys, self.good = np.zeros(0, np.int64), np.zeros(0, bool)
        self.forget()

    def forget(self) -> None:
        self.unit, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # by hash; the slot counts as units came
        self.ids, self.raw = _Ranges(np.int32), _Ranges(np.uint8)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether ``right`` can follow ``left`` (-1: nothing that could merge)."""
        key = (left.astype(np.int64) + 1) * self.p.size + right
        u, inv = np.unique(key, return_inverse=True)
        at = np.searchsorted(self.keys, u)
        new = u[(at == self.keys.size) | (self.keys[np.minimum(at, self.keys.size - 1)] != u)] if self.keys.size else u
        if new.size:
            text, score = self.p.text, self.p.score
            good = []
            for k in new.tolist():
                a, b = divmod(k, self.p.size)
                b = text[b]
                if a:
                    a = text[a - 1]
                    good.append(bpe(a + b, score) == [a, b])
                else:
                    good.append(bpe(b, score) == [b])
            keys = np.concatenate([self.keys, new])
            order = np.argsort(keys, kind="stable")
            self.keys, self.good = keys[order], np.concatenate([self.good, np.array(good, bool)])[order]
        return self.good[np.searchsorted(self.keys, u)][inv]

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every unit, one after another, and the offsets."""
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        base = np.cumsum(length + 1) - length - 1
        inner = np.ones(codes.size, bool)
        inner[base + length] = False
        codes[inner & (codes == 0)] = 0x110000  # a NUL of the text is no separator
        kind = np.int32 if codes.size * self.p.width < 1 << 31 else np.int64  # holds any position and any number of edges
        sa = suffix_array(codes, self.p.width).astype(kind)
        lo, hi = occurrences(codes, sa, self.p)
        n = hi - lo
        start = sa[np.repeat((lo - np.cumsum(n) + n).astype(kind), n) + np.arange(n.sum(), dtype=kind)]
        end = start + np.repeat(self.p.lengths.astype(kind), n)
        token = np.repeat(self.p.ids.astype(np.int32), n)
        odd = np.flatnonzero(inner & ~np.isin(codes, self.p.single))  # characters without a piece
        start = np.concatenate([start, odd.astype(kind)])
        end = np.concatenate([end, (odd + 1).astype(kind)])
        token = np.concatenate([token, -10 - np.where(codes[odd] == 0x110000, 0, codes[odd]).astype(np.int32)])
        depth_in_unit = end - np.repeat(base.astype(kind), length + 1)[start]
        order = np.argsort(depth_in_unit, kind="stable").astype(kind)
        bounds = np.flatnonzero(np.diff(depth_in_unit[order], prepend=-1))
        del depth_in_unit
        start, end, token = start[order], end[order], token[order]
        del order
        last = np.full(codes.size + 1, -1, np.int64)
        prev, depth = np.zeros(codes.size + 1, np.int64), np.zeros(codes.size + 1, np.int64)
        for i, j in zip(bounds, [*bounds[1:], start.size]):
            s, t = start[i:j], token[i:j]
            before = np.maximum(last[s], -1)
            ok = t < 0
            plain = ~ok
            ok[plain] = self._pairs(before[plain], t[plain])
            e = end[i:j][ok]
            last[e], prev[e], depth[e] = t[ok], s[ok], depth[s[ok]] + 1
        size = depth[base + length]
        offs = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros(offs[-1], np.int64)
        at, put, live = base + length, offs[1:] - 1, np.arange(len(texts))
        while (live := live[at[live] > base[live]]).size:
            out[put[live]] = last[at[live]]
            put[live] -= 1
            at[live] = prev[at[live]]
        if (out < 0).any():
            wide = [[self.p.byte[b] for b in chr(-10 - x).encode("utf-8", "surrogatepass")] if x < 0 else [x] for x in out.tolist()]
            grown = np.concatenate([[0], np.cumsum([len(x) for x in wide])])
            out, offs = np.array([y for x in wide for y in x]), grown[offs]
        return out.astype(np.int32), offs

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after another, and how many each has."""
        length = np.cumsum([len(x) + 1 for x in texts])
        parts, i = [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(length, (length[i - 1] if i else 0) + INDEXED, side="right")))
            parts.append(self.units(texts[i:j]))
            i = j
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([np.diff(o) for _, o in parts])

    def batch(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every row, and the rows' offsets."""
        size = np.diff(offs)
        if _SPACE_BYTES in buf.tobytes():
            rows = [buf[a:b].tobytes().replace(_SPACE_BYTES, b" ") for a, b in zip(offs[:-1], offs[1:])]
            size = np.array([len(x) for x in rows])
            buf = np.frombuffer(b"".join(rows), np.uint8)
            offs = np.concatenate([[0], np.cumsum(size)])
        some = size > 0
        buf = np.insert(buf, offs[:-1][some], 0x20)  # the dummy prefix
        offs = np.concatenate([[0], np.cumsum(size + some)])
        space = buf == 0x20
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[offs[:-1][some]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], buf.size)[: start.size]
        row = np.searchsorted(offs, start, side="right") - 1
        h = tb.hashes(tb.Words(buf, offs, start, end, row), most=_STEP)
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        if self.unit.size + u.size > REMEMBERED or self.raw.offs[-1] > REMEMBERED_BYTES:
            self.forget()
        at = np.searchsorted(self.unit, u)
        known = (at < self.unit.size) & (self.unit[np.minimum(at, self.unit.size - 1)] == u) if self.unit.size else np.zeros(u.size, bool)
        size_of = end - start
        odd = ~_equal(buf, start, size_of, buf, start[first[inv]], size_of[first[inv]])
        if known.any():
            other = np.zeros(u.size, bool)
            k, mine = self.slot[at[known]], first[known]
            other[known] = ~_equal(buf, start[mine], size_of[mine], self.raw.data, self.raw.offs[k], np.diff(self.raw.offs)[k])
            if other.any():  # the remembered unit isn't this one, so each of its kind is looked at
                odd |= other[inv]
        new = first[~known]
        if new.size:
            texts = [buf[a:b].tobytes().decode().replace(" ", _SPACE) for a, b in zip(start[new].tolist(), end[new].tolist())]
            ids, n = self._encoded(texts)
            unit = np.concatenate([self.unit, u[~known]])
            order = np.argsort(unit, kind="stable")
            self.slot = np.concatenate([self.slot, np.arange(self.slot.size, unit.size, dtype=np.int32)])[order]
            self.unit = unit[order]
            self.ids.add(ids, n)
            length = size_of[new]
            self.raw.add(buf[np.repeat(start[new] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))], length)
        k = self.slot[np.searchsorted(self.unit, u)][inv]
        begin = self.ids.offs[k]
        n, pool = self.ids.offs[k + 1] - begin, self.ids.data
        if odd.any():
            texts = [buf[a:b].tobytes().decode().replace(" ", _SPACE) for a, b in zip(start[odd].tolist(), end[odd].tolist())]
            distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
            ids, m = self._encoded(list(distinct))
            which = np.array([distinct[t] for t in texts])
            pool = pool[: self.ids.offs[-1]]
            n[odd], begin[odd] = m[which], (np.cumsum(m) - m + pool.size)[which]
            pool = np.concatenate([pool, ids])
        total = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(begin - total[:-1], n) + np.arange(total[-1])
        per_row = np.bincount(row, n, minlength=size.size).astype(np.int64)
        return pool[take], np.concatenate([[0], np.cumsum(per_row)])


def decode_bytes(pieces: Pieces, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts of rows of ids, without the dummy prefix, and their offsets."""
    n = pieces.raw_size[ids]
    at = np.cumsum(n) - n
    out = pieces.raw[np.repeat(pieces.raw_at[ids] - at, n) + np.arange(int(n.sum()))]
    o = np.concatenate([at, [out.size]])[offs]
    lead = o[:-1][o[1:] > o[:-1]]
    drop = lead[out[lead] == 0x20]
    gone = np.zeros(out.size + 1, np.int64)
    gone[drop + 1] = 1
    return np.delete(out, drop), o - np.cumsum(gone)[o]


def _shipped(spark: SparkSession, path: str | None) -> Broadcast:
    """The model as the driver reads it (a vocabulary's size, under ``MODEL_BYTES``), so that workers needn't have the file."""
    with open(path or spark.conf.get(SETTING, MODEL), "rb") as f:
        raw = f.read(MODEL_BYTES + 1)
    if len(raw) > MODEL_BYTES:
        raise ValueError(f"a model of more than {MODEL_BYTES} bytes")
    return spark.sparkContext.broadcast(raw)


@cache
def _pieces(raw: bytes) -> Pieces:
    return Pieces("the model", raw)


@cache
def _encoder(raw: bytes) -> Encoder:
    return Encoder(_pieces(raw))


def encode_batches(enc: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``encode`` for those with ``doc_id, text``."""
    for batch in batches:
        buf, offs = tb.buffers(batch.column("text"))
        for i, j in tb.slices(offs, _SLICE):
            b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            ids, io = enc.batch(b, o)
            back, bo = decode_bytes(enc.p, ids, io)
            same = np.diff(bo) == np.diff(o)
            if back.size == b.size and np.array_equal(bo, o):
                if not np.array_equal(back, b):
                    same &= tb.row_sums((back != b).astype(np.int64), o) == 0
            else:
                same = np.array([back[bo[k] : bo[k + 1]].tobytes() == b[o[k] : o[k + 1]].tobytes() for k in range(j - i)])
            lists = pa.ListArray.from_arrays(pa.array(io.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(io)), lists, pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"])
            del ids, back, lists
        b = None
        del batch, buf  # else the next batch comes on top of this one


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and whether the ids decode to the text (``round_trip``), for every row.

    The model is at ``path`` on the driver, else where the session's ``SETTING`` says.
    """
    model = _shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encode_batches(_encoder(model.value), batches)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tb.lean(run), f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, ids``; null ids give the empty text."""
    model = _shipped(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model.value)
        for batch in batches:
            ids = batch.column("ids")
            n = np.array([len(x) if x is not None else 0 for x in ids.to_pylist()]) if ids.null_count else np.diff(ids.offsets.to_numpy())
            flat = ids.flatten().to_numpy()
            raw, o = decode_bytes(pieces, flat, np.concatenate([[0], np.cumsum(n)]))
            data = raw.tobytes()
            text = [data[a:b].decode("utf-8", "replace") for a, b in zip(o[:-1].tolist(), o[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(tb.lean(run), f"doc_id {kind}, text string")
