"""Near-duplicates by b-bit MinHash.

A document's set is its distinct ``width``-word shingles (with fewer words,
the whole sequence as one).  Every document gets ``PERMS`` minima; bands of
them give candidate buckets, and ``BITS`` low bits of each are packed into
signatures whose bit counts estimate, corrected for chance collisions, which
candidates are worth confirming.  Links are confirmed on the full sets.

Documents of equal sets are one class from the start.  Within a bucket every
class is compared with the bucket's smallest alone, and components are formed.
Only classes that share a bucket and are still apart can be linked besides: in
buckets of up to ``SMALL`` classes each is compared with the others; classes of
larger ones (pages around the same boilerplate) are joined by their rarest
shingles instead - a pair as similar as asked shares one of the first ``n -
needed + 1`` in the order of rarity - so that what they all hold makes no pairs.
No link between classes that would join components is left out.

Defined results: null or empty text, or text without words, has an empty set
and links with nothing (its component is its own id); rows that share a doc_id
are linked with one another, and each comes out with its own set's size; a
null doc_id has a null component and is kept; repeated rows change no
component; a long text is hashed whole; other columns aren't read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .components import components, joined
from .runtime import cut, drop_cut
from .sieve import bit_of, bitmap, has_bit

PERMS = 120
BITS = 4
#: Candidates are kept down to this far below the threshold, over four standard deviations of the estimate.
MARGIN = 0.17
_PER_LONG = 64 // BITS
#: Classes of a bucket that are compared with one another directly.
SMALL = 32

_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(w: tb.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the rows, one after another, and the rows' offsets."""
    h = tb.hashes(w, lower=True)
    n = w.counts()
    first = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        size = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
        offs = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(offs[-1]) - np.repeat(offs[:-1], size) + np.repeat(first, size)
        length = np.repeat(np.minimum(n, width), size)
        s = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(width):
            there = k < length
            s += np.where(there, h[np.minimum(at + k, h.size - 1)] * _STEP[k % 64] if h.size else 0, np.uint64(0))
    s = tb.mix(s)
    for i in np.flatnonzero(size > 1):
        s[offs[i] : offs[i + 1]].sort()
    keep = np.ones(s.size, bool)
    keep[1:] = s[1:] != s[:-1]
    keep[offs[:-1][size > 0]] = True
    return s[keep], np.concatenate([[0], np.cumsum(tb.row_sums(keep, offs))])


def _reduce(op, values: np.ndarray, offs: np.ndarray, fill) -> np.ndarray:
    out = np.full(offs.size - 1, fill, values.dtype)
    some = offs[1:] > offs[:-1]
    if some.any():
        out[some] = op.reduceat(values, offs[:-1][some])
    return out


def set_key(s: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that depend on a row's set alone."""
    with np.errstate(over="ignore"):
        return tuple(_reduce(np.add, tb.mix(s ^ np.uint64(c)), offs, 0) for c in (0x1234567890ABCDEF, 0x0FEDCBA987654321))


def minima(s: np.ndarray, offs: np.ndarray) -> np.ndarray:
    out = np.empty((offs.size - 1, PERMS), np.uint64)
    with np.errstate(over="ignore"):
        for p in range(PERMS):
            out[:, p] = _reduce(np.minimum, s * _MULT[p], offs, 0)
    return out


def pack(m: np.ndarray) -> np.ndarray:
    """Low bits of the minima, ``_PER_LONG`` to a word."""
    low = tb.mix(m.ravel()).reshape(m.shape) & np.uint64((1 << BITS) - 1)
    wide = np.zeros((m.shape[0], -(-PERMS // _PER_LONG) * _PER_LONG), np.uint64)
    wide[:, :PERMS] = low
    wide = wide.reshape(m.shape[0], -1, _PER_LONG) << (np.arange(_PER_LONG) * BITS).astype(np.uint64)
    return np.bitwise_or.reduce(wide, axis=2)


def band_keys(m: np.ndarray, rows_per_band: int) -> np.ndarray:
    bands = PERMS // rows_per_band
    cut_ = m[:, : bands * rows_per_band].reshape(m.shape[0], bands, rows_per_band)
    with np.errstate(over="ignore"):
        key = (cut_ * _STEP[:rows_per_band]).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return tb.mix(key.ravel()).reshape(key.shape)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sketches(docs: DataFrame, width: int, rows_per_band: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = tb.buffers(batch.column("text"))
            for i, j in tb.slices(offs, 1 << 20):
                s, o = shingles(tb.words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), width)
                hi, lo = set_key(s, o)
                m = minima(s, o)
                sig, band = pack(m).view(np.int64), band_keys(m, rows_per_band).view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]).astype(np.int32)), pa.array(x.ravel())) for x in (sig, band)]
                own = [batch.column(c).slice(i, j - i) for c in ("rid", "doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(o)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), *lists], ["rid", "doc_id", "text_hash", "n_shingles", "hi", "lo", "sig", "band"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text_hash(F.col("text")).alias("text_hash"), "text")
    return rows.mapInArrow(tb.lean(run), f"rid long, doc_id {kind}, text_hash long, n_shingles long, hi long, lo long, sig array<long>, band array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the share of equal low bits, corrected for those equal by chance."""
    ones = F.lit(sum(1 << (BITS * k) for k in range(_PER_LONG)) - (1 << 64 if BITS == 1 else 0))
    differ = []
    for k in range(-(-PERMS // _PER_LONG)):
        x = a[k].bitwiseXOR(b[k])
        any_bit = reduce(Column.bitwiseOR, [F.shiftrightunsigned(x, s) for s in range(BITS)])
        differ.append(F.bit_count(any_bit.bitwiseAND(ones)))
    share = 1 - reduce(Column.__add__, differ) / F.lit(PERMS)
    chance = 2.0**-BITS
    return (share - chance) / (1 - chance)


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node, s``: full sets of the classes in ``nodes`` (``node, doc_id, hi, lo``)."""
    seen = docs.sparkSession.sparkContext.broadcast(bitmap(nodes, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = has_bit(seen.value, batch.column("bit").to_numpy()) & ~batch.column("doc_id").is_null().to_numpy(False)
            batch = batch.filter(pa.array(hit))
            buf, offs = tb.buffers(batch.column("text"))
            for i, j in tb.slices(offs, 1 << 20):
                s, o = shingles(tb.words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), width)
                sets = pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *(pa.array(k.view(np.int64)) for k in set_key(s, o)), sets], ["doc_id", "hi", "lo", "s"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text", bit_of("doc_id").alias("bit")).mapInArrow(tb.lean(run), f"doc_id {kind}, hi long, lo long, s array<long>")
    return found.join(nodes, ["doc_id", "hi", "lo"]).dropDuplicates(["node"]).select("node", "s")


def _enough(both: Column, na: Column, nb: Column, percent: int) -> Column:
    return 100 * both >= percent * (na + nb - both)


def _confirm(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) whose full sets are similar enough."""
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = cut(_sets(docs, ids.join(classes.select("node", "rep.doc_id", "hi", "lo"), "node"), width), "sets")
    a = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(a, "a").join(b, "b").withColumn("both", both).where(_enough(F.col("both"), F.size("sa"), F.size("sb"), percent))
    links = cut(met.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    drop_cut(sets)
    return links


def _near_size(percent: int) -> Column:
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent


def _worth(percent: int) -> Column:
    return _near_size(percent) & (estimate(F.col("ga"), F.col("gb")) >= percent / 100 - MARGIN)


def rare_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a`` < ``b``) of ``sets`` (``node, s``) that share one of their rarest shingles, as every pair that is similar enough does.

    Shingles of one set alone are the rarest and can't be shared, so only their
    number counts.  Places in the order bound what two sets can still share.
    """
    each = cut(sets.select("node", F.size("s").alias("n"), F.explode("s").alias("x")), "shingles")
    often = each.groupBy("x").agg(F.count("*").alias("f")).where("f > 1")
    shared = each.join(often, "x").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("common"))
    alone = F.col("n") - F.size("common")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9).cast("int") + 1 - alone
    head = shared.where(prefix > 0).select("node", "n", alone.alias("alone"), F.posexplode(F.slice("common", F.lit(1), prefix)).alias("at", "entry"))
    head = cut(head.select("node", "n", (F.col("alone") + F.col("at")).alias("at"), F.col("entry.x").alias("x")), "rarest")
    left = head.select("x", F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"))
    right = head.select("x", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # were this the first they share
    least = F.ceil(percent / (100.0 + percent) * (F.col("na") + F.col("nb")) - 1e-9)
    met = left.join(right, "x").where((F.col("a") < F.col("b")) & _near_size(percent))
    return met.groupBy("a", "b").agg(F.max(most >= least).alias("can")).where("can").select("a", "b")


def _apart(docs: DataFrame, classes: DataFrame, members: DataFrame, comp: DataFrame, ga: DataFrame, gb: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of classes that share a bucket, lie in different components, and are worth confirming."""
    named = members.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("k")).where("lo <> hi").select("band", "k")
    apart = cut(named.join(mixed, "band"), "apart")
    few = apart.where(F.col("k") <= SMALL)
    left = few.select("band", F.col("node").alias("a"), F.col("component").alias("ca"))
    right = few.select("band", F.col("node").alias("b"), F.col("component").alias("cb"))
    pairs = left.join(right, "band").where("ca < cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    many = cut(apart.where(F.col("k") > SMALL).select("node", "component").distinct(), "crowded")
    if not many.isEmpty():
        sets = cut(_sets(docs, many.join(classes.select("node", "rep.doc_id", "hi", "lo"), "node").drop("component"), width), "sets")
        of = lambda c: many.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        pairs = pairs.unionByName(rare_pairs(sets, percent).join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select("a", "b"))
    return cut(pairs.distinct().join(ga, "a").join(gb, "b").where(_worth(percent)).select("a", "b"), "rest")


def grouped(docs: DataFrame, width: int, percent: int, rows_per_band: int, same_id: bool) -> DataFrame:
    """``doc_id, text_hash, n_shingles, top, kept`` of every row of ``docs``.

    ``top`` is the smallest ``(doc_id, text_hash)`` of the row's component
    (``same_id``: rows of one doc_id are linked), null where none is formed;
    such rows are kept, as is the row that ``top`` names.
    """
    sk = cut(sketches(docs, width, rows_per_band), "sketches")
    has = sk.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    rep = F.min(F.struct("doc_id", "text_hash")).alias("rep")
    classes = cut(has.groupBy("hi", "lo").agg(F.min("rid").alias("node"), rep, F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("band").alias("band")), "classes")
    members = classes.select("node", F.explode("band").alias("band"))
    heads = members.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("k")).where("k > 1").select("band", "a")
    raw = heads.join(members.select("band", F.col("node").alias("b")), "band").where("a <> b").select("a", "b").distinct()
    ga = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("ga"))
    gb = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("gb"))
    pairs = cut(raw.join(ga, "a").join(gb, "b").where(_worth(percent)).select("a", "b"), "pairs")
    links = _confirm(docs, pairs, classes, width, percent)
    if same_id:
        several = cut(has.groupBy("doc_id").agg(F.min("lo").alias("first"), F.max("lo").alias("last")).where("first <> last").select("doc_id"), "repeated")
        if not several.isEmpty():
            of = has.join(several, "doc_id").select("doc_id", "hi", "lo").join(classes.select("hi", "lo", "node"), ["hi", "lo"]).select("doc_id", F.col("node").alias("v")).distinct()
            links = cut(links.unionByName(of.join(of.groupBy("doc_id").agg(F.min("v").alias("u")), "doc_id").where("u <> v").select("u", "v")), "links")
    comp = cut(components(links), "components")
    rest = _apart(docs, classes, members, comp, ga, gb, width, percent)
    rest = cut(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = _confirm(docs, rest, classes, width, percent)
        if not more.isEmpty():
            comp = cut(joined(comp, more), "components")
    placed = classes.select("hi", "lo", "node", "rep").join(comp, "node", "left")
    tops = placed.where("component is not null").groupBy("component").agg(F.min("rep").alias("top"))
    class_of = placed.join(tops, "component", "left").select("hi", "lo", F.coalesce("top", "rep").alias("top"))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = sk.select("doc_id", "text_hash", "n_shingles", "hi", "lo").join(class_of, ["hi", "lo"], "left").withColumn("top", F.when(linked, F.col("top")))
    kept = F.col("top").isNull() | (F.struct("doc_id", "text_hash") == F.col("top"))
    return out.select("doc_id", "text_hash", "n_shingles", "top", kept.alias("kept"))


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, rows_per_band: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``."""
    found = grouped(docs, width, percent, rows_per_band, same_id=True)
    component = F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
