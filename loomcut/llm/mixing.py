"""Mixing sources to target weights, with DataFrame operations alone.

Every source is one stream of words: its documents in the order of a hash of
their id and text.  The stream is packed into blocks of ``BLOCK`` words (the last may be
shorter).  Sources, by code point and null last, weigh 1, 2, 3, repeating; a
source's target is its share of all words, at most ``MOST`` times its own
size, the excess being shared again by weight until none is above.

* The output is cut into shards of ``SHARD`` slots.  A shard draws its counts of
  the sources by residual multinomial sampling: of the number that a source's
  share of the mix lets expect, the whole part is taken, and the slots left are
  drawn, each by itself from a seeded hash, with the fractions as probabilities.
  So each shard's counts are random with the right means, and the mix's totals
  come as near the targets as a few slots a shard allow; a plain multinomial
  would miss a source of 150 blocks by 8 %.  Sources too small to expect a slot
  in every shard are drawn by a plain multinomial.
* A source's draws are numbered shard after shard.  A draw beyond ``MOST`` times
  its blocks is void: chance may ask a full source for a few slots too many.
* A source's ``k``-th draw takes, in its ``k div n``-th round through its ``n``
  blocks, the one where that round's own permutation puts ``k mod n``; so no
  block is taken more than ``MOST`` times.  Permutations are swap-or-not
  networks: bijections of any range, computed for one index alone.
* Blocks and draws meet in a join by source and index, a key that isn't hot.

That join is always a merge join: before the draws are counted out, their
plan looks small enough to broadcast, and isn't.

Stream offsets, the sources' numbers and their shares of a draw are prefix sums
in two steps (within ranges, then over them), so a source of any size, and any
number of sources, is spread over many tasks.  All that decides is summed in
integers, so that no order of addition changes it.

Defined results: null and empty text has size 0 and takes nothing; a null
source is a source of its own, the last; a null id is an id of its own; equal
rows lie side by side in the stream, and each is taken by itself; a long text is
many blocks; other columns, whatever their names, come through as they are; an
empty table gives no rows.  Reruns agree, in whatever order the rows come.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rowwise import row_hash
from .runtime import cut

BLOCK = 64
MOST = 3
SHARD = 4096
ROUNDS = 32
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one hash range, about; only a matter of parallelism.
_RANGE = 4096
_BATCH = 4096
#: Draws of one task, about.
_DRAWS = 50_000
#: Fixed-point units of a source's expected draws, and of the fraction of a slot that it expects in a shard.
_UNIT = 1 << 20
_FRACTION = 1 << 40


def permuted(x: Column, n: Column, *seed: Column) -> Column:
    """Where a pseudorandom permutation of 0..n-1, chosen by ``seed``, puts ``x``."""

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*seed, r), n) - at, n)
        return F.when(F.xxhash64(*seed, r, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), x.cast("long"), swap)


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, text_hash, copies``: distinct rows of ``docs`` as far as mixing sees them."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    seen = docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return seen.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("copies"))


def _span(df: DataFrame, n: Column, name: str) -> DataFrame:
    """``df`` with ``name`` from 0 to ``n - 1``, in two steps so that no array is longer than ``n / _BATCH``."""
    df = df.withColumn(name, F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / _BATCH)))))
    return df.withColumn(name, F.explode(F.sequence(F.col(name) * _BATCH, F.least((F.col(name) + 1) * _BATCH, n) - 1)))


def _before(df: DataFrame, value: str, order: Column) -> Column:
    """Sum of the long ``value`` over all earlier rows; ``part`` numbers stretches of ``df`` in that order.

    One number for each stretch, of which there are as many as the shuffle had partitions, reaches the driver.
    """
    per = {r["part"]: r["n"] for r in df.groupBy("part").agg(F.sum(value).alias("n")).collect()}
    base = [0]
    for i in range(max(per, default=0)):
        base.append(base[-1] + (per.get(i) or 0))
    inside = F.sum(value).over(Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return F.get(F.array(*[F.lit(b).cast("long") for b in base]), F.col("part")) + F.coalesce(inside, F.lit(0).cast("long"))


def targets(sized: DataFrame) -> DataFrame:
    """``part, sid, source, source_size, target, blocks, rate`` of every source; ``rate``: draws it expects, times ``_UNIT``."""
    order = F.asc_nulls_last("source")
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).cast("long").alias("source_size"))
    per = cut(per.orderBy(order).withColumn("part", F.spark_partition_id()).withColumn("one", F.lit(1).cast("long")), "mix-order")
    per = per.withColumn("sid", _before(per, "one", order) + 1)
    per = per.withColumn("weight", F.pmod(F.col("sid") - 1, F.lit(3)) + 1)
    most = F.col("source_size") * MOST
    # Sources that their share fills are full; what is left is shared by weight among the others, until none is filled anew.
    level, full = 0.0, -1
    while True:
        over = most <= F.lit(level) * F.col("weight")
        x = per.agg(F.count_if(over).alias("n"), F.sum(F.when(over, most)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.sum("source_size").alias("total")).first()
        if x["n"] == full or not x["weight"]:
            break
        full, level = x["n"], (x["total"] - (x["full"] or 0)) / x["weight"]
    target = F.least(most.cast("double"), F.lit(level) * F.col("weight")) if full >= 0 else most.cast("double")
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    per = per.withColumn("target", target).withColumn("blocks", blocks)
    rate = F.when(F.col("blocks") > 0, F.floor(F.col("target") / F.col("source_size") * F.col("blocks") * _UNIT)).otherwise(0)
    return per.select("part", "sid", "source", "source_size", "target", "blocks", rate.cast("long").alias("rate"))


def shard_counts(sources: DataFrame) -> DataFrame:
    """``shard, sid, blocks, n, first, drawn``: how many slots of a shard a source takes, and which of its draws is the first.

    A pair of shard and source may have two rows: of the whole part of its
    expected number, and of the slots ``drawn`` besides.
    """
    spark = sources.sparkSession
    expected = (sources.agg(F.sum("rate")).first()[0] or 0) / _UNIT
    if not round(expected):
        return spark.range(0).select(*[F.col("id").alias(c) for c in ("shard", "sid", "blocks", "n", "first")], F.lit(False).alias("drawn"))
    shards = max(1, math.ceil(expected / SHARD))
    size = max(1, round(expected / shards))
    each = F.col("rate") / F.lit(float(_UNIT * shards))
    shares = sources.withColumn("whole", F.floor(each)).withColumn("fraction", F.round((each - F.floor(each)) * _FRACTION).cast("long"))
    shares = cut(shares.select("part", "sid", "blocks", "whole", "fraction"), "mix-shares")
    sums = shares.agg(F.sum("whole").alias("whole"), F.sum("fraction").alias("fraction"), F.count("*").alias("n")).first()
    fixed = _span(shares.where("whole > 0"), F.lit(shards).cast("long"), "shard")
    fixed = fixed.select("shard", "sid", "blocks", F.col("whole").alias("n"), (F.col("shard") * F.col("whole")).alias("first"), F.lit(False).alias("drawn"))
    left = size - sums["whole"]
    if left <= 0 or not sums["fraction"]:
        return fixed
    # A draw meets the source whose stretch of 0..fraction it falls in, by equal buckets of about one source each.
    step = max(1, -(-sums["fraction"] // sums["n"]))
    low = shares.withColumn("low", _before(shares, "fraction", F.col("sid"))).where("fraction > 0")
    low = low.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor((F.col("low") + F.col("fraction") - 1) / step))))
    draws = spark.range(0, shards, 1, max(1, min(10_000, shards * left // _DRAWS))).select(F.col("id").alias("shard"))
    draws = _span(draws, F.lit(left).cast("long"), "slot").withColumn("u", F.pmod(F.xxhash64(F.lit("source"), "shard", "slot"), F.lit(sums["fraction"])))
    met = draws.withColumn("bucket", F.floor(F.col("u") / step)).join(low, "bucket").where("u >= low and u < low + fraction")
    drawn = cut(met.groupBy("shard", "sid", "blocks", "whole").agg(F.count("*").alias("n")), "mix-drawn")
    drawn = drawn.withColumn("range", F.floor(F.col("shard") / _BATCH))
    so_far = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = drawn.groupBy("sid", "range").agg(F.sum("n").alias("n")).select("sid", "range", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("so_far"))
    inside = Window.partitionBy("sid", "range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("whole") * shards + F.col("so_far") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return fixed.unionByName(drawn.join(ranges, ["sid", "range"]).select("shard", "sid", "blocks", "n", first.alias("first"), F.lit(True).alias("drawn")))


def draw(counts: DataFrame) -> DataFrame:
    """``shard, sid, block, round, k`` of every draw that ``counts`` asks for; ``k``: its number among the source's."""
    n = counts.agg(F.sum("n")).first()[0] or 0
    # a stated number, since the few rows here become many
    each = counts.repartition(max(1, min(10_000, n // _DRAWS)), F.xxhash64("shard", "sid", "drawn"))
    each = each.withColumn("k", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))).where(F.col("k") < F.col("blocks") * MOST)
    each = each.withColumn("round", F.floor(F.col("k") / F.col("blocks")))
    block = permuted(F.pmod("k", "blocks"), F.col("blocks"), F.lit("block"), F.col("sid"), F.col("round"))
    return each.select("shard", "sid", block.alias("block"), "round", "k")


def packed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents as pieces of blocks: ``doc_id, source, size, text_hash, copy, sid, block, start, n_words, shift``.

    ``shift`` is where in a block the document begins.  A document without words
    is one row without a block.
    """
    n = sized.count()
    bits = max(0, math.ceil(math.log2(max(n, 1) / _RANGE)))
    h = F.xxhash64(F.lit("stream"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_hash"))
    # Hash ranges in the order of the hash, so that the order doesn't depend on their number.
    range_ = F.shiftright(h, 64 - bits) if bits else F.lit(0).cast("long")
    known = sized.withColumn("h", h).withColumn("range", range_)
    known = known.join(sources.select("sid", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.col("size") * F.col("copies")
    ranges = known.groupBy("sid", "range").agg(F.sum(whole).alias("n"))
    so_far = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("sid", "range", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "range").orderBy("h", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("inner", F.coalesce(F.sum(whole).over(inside), F.lit(0))).join(ranges, ["sid", "range"])
    placed = _span(placed, F.col("copies"), "copy")
    placed = placed.withColumn("at", F.col("base") + F.col("inner") + F.col("copy") * F.col("size"))
    first, last = F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("size") - 1) / BLOCK)
    placed = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    begin = F.greatest("at", F.col("block") * BLOCK)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return placed.select("doc_id", "source", "size", "text_hash", "copy", "sid", "block", (begin - F.col("at")).alias("start"), (end - begin).alias("n_words"), F.pmod("at", F.lit(BLOCK)).alias("shift"))


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, pieces of blocks, and draws of ``docs``."""
    sized = cut(sizes(docs), "mix-sizes")
    sources = cut(targets(sized), "mix-sources")
    return sources, packed(sized, sources), draw(cut(shard_counts(sources), "mix-counts"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: ``shard, slot, source, doc_id, text_hash, copy, round, start, n_words`` of every piece it takes.

    A shard's slots are in a pseudorandom order, numbered from 0.
    """
    _, pieces, draws = plan(docs)
    slot = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit("slot"), "sid", "k"), "sid", "k")) - 1
    return draws.withColumn("slot", slot).join(pieces.hint("merge"), ["sid", "block"]).select("shard", "slot", "source", "doc_id", "text_hash", "copy", "round", "start", "n_words")


def taken_words(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every row of ``docs``."""
    sources, pieces, draws = plan(docs)
    times = draws.groupBy("sid", "block").agg(F.count("*").alias("times"))
    met = pieces.hint("merge").join(times, ["sid", "block"], "left")
    words = F.coalesce(F.col("n_words") * F.col("times"), F.lit(0))
    per = met.groupBy("doc_id", "sid", "size", "text_hash", "copy").agg(F.sum(words).alias("taken"))
    return per.join(sources.select("sid", "source", "source_size", "target"), "sid").select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns, mixed: a document comes once for every round that takes words of it.

    Where a round takes the whole document the row is as it was; else ``text``
    is the words taken, joined by spaces, and ``n_chars`` (if there) its length.
    Documents are matched by 128 bits of hashes of their id, source and text,
    so that their texts are shuffled once.
    """
    _, pieces, draws = plan(docs)
    nth = F.floor((F.col("start") + F.col("shift")) / BLOCK).cast("int")
    got = draws.join(pieces.hint("merge"), ["sid", "block"]).groupBy("doc_id", "source", "text_hash", "size", "copy", "round", "shift").agg(F.sum("n_words").alias("n"), F.collect_set(nth).alias("taken"))
    # One character for each block that the document touches: whether the round takes it.
    every = F.sequence(F.lit(0), F.floor((F.col("shift") + F.col("size") - 1) / BLOCK).cast("int"))
    mask = F.array_join(F.transform(every, lambda b: F.when(F.array_contains("taken", b), "1").otherwise("0")), "")
    got = got.select(
        F.xxhash64("doc_id", "source").alias("_k"), F.col("text_hash").alias("_h"), "copy", "round", "shift",
        (F.col("n") == F.col("size")).alias("_whole"), F.when(F.col("n") < F.col("size"), mask).alias("_mask"),
    )
    got = got.groupBy("_k", "_h").agg(F.collect_list(F.struct("copy", "round", "shift", "_whole", "_mask")).alias("_takes"))
    names = docs.columns
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select(F.struct("*").alias("_row"), F.xxhash64("doc_id", "source").alias("_k"), h.alias("_h"))
    copy = F.row_number().over(Window.partitionBy("_k", "_h").orderBy(row_hash(docs, "_row"))) - 1
    met = keyed.withColumn("_copy", copy).join(got, ["_k", "_h"])
    met = met.withColumn("_take", F.explode(F.filter("_takes", lambda t: t["copy"] == F.col("_copy"))))
    words = F.regexp_extract_all(F.col("_row.text"), F.lit(WORD), F.lit(0))
    block_of = lambda i: F.floor((i + F.col("_take.shift")) / BLOCK).cast("int") + 1
    part = F.array_join(F.filter(words, lambda w, i: F.col("_take._mask").substr(block_of(i), F.lit(1)) == "1"), " ")
    text = F.when(F.col("_take._whole"), F.col("_row.text")).otherwise(part)
    met = met.withColumn("_text", text)
    chars = docs.schema["n_chars"].dataType if "n_chars" in names else None
    new = {"text": F.col("_text")} | ({"n_chars": F.when(F.col("_take._whole"), F.col("_row.n_chars")).otherwise(F.length("_text").cast(chars))} if chars else {})
    return met.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in names])
