"""Size-bounded windows over a text's lines, and the chunks made of them.

These are the flat forms, in which a line is a leaf: each text is folded within
its own row, so nothing is shuffled until windows are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcut.functions import text as T


def numbered_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line_no, line, start, length``: every line with its offset."""
    each = docs.select(key, F.posexplode(T.lines(text)).alias("line_no", "line"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    n = T.utf16_length("line")
    return each.withColumn("length", n).withColumn("start", F.coalesce(F.sum(F.col("length") + 1).over(before), F.lit(0)).cast("long"))


def _fold_starts(sizes: Column, most: int) -> Column:
    """First line of each window: filled while it fits; a line over the limit stands alone.

    The state grows by one number for each window, so a text costs one pass.
    """
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("some"))

    def step(a: Column, s: Column) -> Column:
        fits = a["size"] + s <= most
        big = ~fits & (s > most)
        return F.struct(
            F.when(a["some"] & fits, a["starts"]).otherwise(F.concat(a["starts"], F.array(a["at"]))).alias("starts"),
            (a["at"] + 1).alias("at"),
            F.when(big, F.lit(0)).when(fits, a["size"] + s).otherwise(s).cast("long").alias("size"),
            (~big).alias("some"),
        )

    return F.aggregate(sizes, zero, step)["starts"]


def _line_sizes(text: str) -> Column:
    return F.transform(T.lines(text), lambda x: T.nws_count(x).cast("long"))


def line_windows(docs: DataFrame, most: int = 1500, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, window_idx, first_line, last_line, size``: greedy windows of at most ``most`` non-space characters."""
    each = docs.select(key, _line_sizes(text).alias("s"))
    each = each.select(key, "s", _fold_starts(F.col("s"), most).alias("starts"))

    def window(first: Column, i: Column) -> Column:
        after = F.coalesce(F.get("starts", i + 1), F.size("s"))
        return F.struct(first.alias("first_line"), (after - 1).alias("last_line"), F.aggregate(F.slice("s", first + 1, after - first), F.lit(0).cast("long"), lambda a, x: a + x).alias("size"))

    return each.select(key, F.posexplode(F.transform("starts", window)).alias("window_idx", "w")).select(key, "window_idx", "w.*")


def merge_windows(windows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """Adjacent windows merged from left to right while their sizes together stay within ``most``."""
    per = windows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("window_idx", "first_line", "last_line", "size"))).alias("w"))

    def step(a: Column, w: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.struct(last["window_idx"].alias("window_idx"), last["first_line"].alias("first_line"), w["last_line"].alias("last_line"), (last["size"] + w["size"]).alias("size"))
        return F.when((F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1))["size"], F.lit(0)) + w["size"] <= most), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(a, F.array(w)))

    merged = F.aggregate(F.slice("w", 2, 1 << 30), F.slice("w", 1, 1), step)
    return per.select(key, F.posexplode(merged).alias("window_idx", "m")).select(key, "window_idx", "m.first_line", "m.last_line", "m.size")


def line_chunks(docs: DataFrame, most: int = 1500, overlap: int = 10, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns to ``keep``, and ``idx, total, first_line, last_line, chunk, overlap``: chunk texts with the last lines of the chunk before.

    Texts without anything but white space have no chunks.  A row's own lines
    make all of its chunks, so no join is needed.
    """
    d = docs.where(T.nws_count(text) > 0).select(key, *keep, T.lines(text).alias("l"), _line_sizes(text).alias("s"))
    d = d.select(key, *keep, "l", _fold_starts(F.col("s"), most).alias("starts"))

    def chunk(first: Column, i: Column) -> Column:
        after = F.coalesce(F.get("starts", i + 1), F.size("l"))
        n = F.least(F.lit(overlap), first - F.get("starts", i - 1))
        before = F.when((i > 0) & F.lit(overlap > 0), F.nullif(F.array_join(F.slice("l", first + 1 - F.coalesce(n, F.lit(0)), F.coalesce(n, F.lit(0))), "\n"), F.lit("")))
        return F.struct(F.size("starts").alias("total"), first.alias("first_line"), (after - 1).alias("last_line"), F.array_join(F.slice("l", first + 1, after - first), "\n").alias("chunk"), before.alias("overlap"))

    return d.select(key, *keep, F.posexplode(F.transform("starts", chunk)).alias("idx", "c")).select(key, *keep, "idx", "c.*")


def contextualized(text: Column, filepath: Column, scope: Column, defines: Column, uses: Column, after: Column, before: Column, overlap: Column) -> Column:
    """Chunk text under a header of what surrounds it.

    ``scope`` is innermost first; ``defines`` signatures, ``uses`` import names
    (ten at most), ``after`` and ``before`` sibling names; ``overlap`` may be null.
    """
    some = lambda a, label, sep, n=None: F.when(F.size(a) > 0, F.concat(F.lit(label), F.array_join(F.slice(a, 1, n) if n else a, sep)))
    segments = F.split(filepath, "/", -1)
    path = F.when(filepath.isNotNull() & (filepath != ""), F.concat(F.lit("# "), F.array_join(F.slice(segments, F.greatest(F.size(segments) - 2, F.lit(1)), 3), "/")))
    heads = [path, some(F.reverse(scope), "# Scope: ", " > "), some(defines, "# Defines: ", ", "), some(uses, "# Uses: ", ", ", 10), some(after, "# After: ", ", "), some(before, "# Before: ", ", ")]
    blank = F.when(F.coalesce(*heads).isNotNull(), F.lit(""))
    over = F.when(overlap.isNotNull() & (overlap != ""), F.concat(F.lit("# ...\n"), overlap, F.lit("\n# ---")))
    return F.concat_ws("\n", *heads, blank, over, text)
