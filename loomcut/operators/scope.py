"""Ranges within a file: containment, overlap, enclosing scope, siblings.

Every join has the file as its equality key, so it runs as a hash or merge join
with the range test on top; what contains a range is found in one pass over the
file's ranges in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcut.workers import cut, drop_cut, ship


def contains(outer: str, inner: str) -> Column:
    """Closed containment of ranges in columns ``{x}_start`` and ``{x}_end``."""
    return (F.col(f"{outer}_start") <= F.col(f"{inner}_start")) & (F.col(f"{inner}_end") <= F.col(f"{outer}_end"))


def _buckets(start: str, end: str, width: int) -> Column:
    """Numbers of the stretches of ``width`` that a half-open range touches."""
    return F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / width)))


def scope_parents(entities: DataFrame) -> DataFrame:
    """``file_id, id, parent``: the deepest earlier entity that contains each (null at the top).

    Entities are ``file_id, id, start, end``; order is by start, then id.  What
    contains an entity is the latest one before it that doesn't end earlier,
    nested or not.  A file's entities pass one after another; what is in memory
    are those still open, as many as the file's nesting is deep.  An entity
    without a start or end has no parent and is none.
    """
    ship(entities.sparkSession)
    e = entities.select("file_id", "id", F.col("id").alias("parent"), "start", "end")
    return e.repartition("file_id").sortWithinPartitions("file_id", "start", "id").mapInArrow(_containers, e.select("file_id", "id", "parent").schema)


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    file, open_ = None, []
    for batch in batches:
        parents = []
        for f, i, start, end in zip(*(batch.column(c).to_pylist() for c in ("file_id", "id", "start", "end"))):
            if f != file:
                file, open_ = f, []
            if f is None or start is None or end is None:
                parents.append(None)
                continue
            while open_ and open_[-1][0] < end:  # whoever it contains, the one at hand does too
                open_.pop()
            parents.append(open_[-1][1] if open_ else None)
            open_.append((end, i))
        yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("id"), pa.array(parents, batch.schema.field("id").type)], ["file_id", "id", "parent"])


def scope_at(points: DataFrame, entities: DataFrame, width: int = 4096) -> DataFrame:
    """``points`` (``file_id, point, at``) with the deepest entity whose half-open range holds ``at``."""
    e = entities.withColumn("ord", F.row_number().over(Window.partitionBy("file_id").orderBy("start", "id")))
    spread = e.select("file_id", "id", "start", "end", "ord", _buckets("start", "end", width).alias("_b"))
    inside = points.withColumn("_b", F.floor(F.col("at") / width)).join(spread, ["file_id", "_b"]).where("start <= at and at < end")
    best = inside.groupBy("file_id", "point").agg(F.max_by("id", "ord").alias("scope"))
    return points.join(best, ["file_id", "point"], "left")


def ancestors(parents: DataFrame) -> DataFrame:
    """``file_id, id, depth, chain``: ids from the parent to the root, nearest first.

    Each round appends to a chain that of its last entity, so chains double and
    as many rounds do as the depth has binary digits.  A round's table is
    written, so that none is computed again.
    """
    key = dict(parents.dtypes)["parent"]
    none = F.array().cast(f"array<{key}>")
    now = cut(parents.select("file_id", "id", F.col("parent").alias("_p"), F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(none).alias("chain")), "chains")
    while True:
        round_ = F.array_contains("chain", F.col("id")) & F.col("_p").isNotNull()
        more = now.agg(F.count("_p").alias("open"), F.count_if(round_).alias("round")).first()
        if more["round"]:
            raise ValueError("entities are their own ancestors")
        if not more["open"]:
            return now.select("file_id", "id", F.size("chain").alias("depth"), "chain")
        up = now.select("file_id", F.col("id").alias("_p"), F.col("_p").alias("_pp"), F.col("chain").alias("_c"))
        longer = now.where("_p is not null").join(up, ["file_id", "_p"], "left").select("file_id", "id", F.col("_pp").alias("_p"), F.concat("chain", F.coalesce("_c", none)).alias("chain"))
        before, now = now, cut(now.where("_p is null").unionByName(longer), "chains")
        drop_cut(before)


def flattened(entities: DataFrame, chains: DataFrame) -> DataFrame:
    """``file_id, id, depth, position``: depth-first order of the scope tree."""
    e = entities.join(chains, ["file_id", "id"])
    order = F.row_number().over(Window.partitionBy("file_id").orderBy("start", "depth", "id"))
    return e.select("file_id", "id", "depth", order.alias("position"))


def entities_in_range(chunks: DataFrame, entities: DataFrame, width: int = 4096) -> DataFrame:
    """Entities (``id, start, end``) that overlap each chunk (``chunk, c_start, c_end``), and whether only in part.

    Both sides are spread over stretches of ``width`` of the file and meet
    there, so a long file is many small joins; a pair counts where it first
    overlaps.
    """
    a = chunks.select("file_id", "chunk", "c_start", "c_end", _buckets("c_start", "c_end", width).alias("_b"))
    b = entities.select("file_id", "id", "start", "end", _buckets("start", "end", width).alias("_b"))
    met = a.join(b, ["file_id", "_b"]).where((F.col("start") < F.col("c_end")) & (F.col("end") > F.col("c_start")))
    met = met.where(F.col("_b") == F.floor(F.greatest("start", "c_start") / width))
    partial = (F.col("start") < F.col("c_start")) | (F.col("end") > F.col("c_end"))
    return met.select("file_id", "chunk", "id", partial.alias("is_partial"))


def siblings(nodes: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` nearest siblings before and after each node (``file_id, parent, id, ord``), in the order of ``ord``.

    A node looks at its neighbours in the window, so a parent of many children costs no more for each.
    """
    level = Window.partitionBy("file_id", "parent").orderBy("ord")
    near = [F.struct(f("id", k).over(level).alias("sibling"), F.lit(side).alias("position"), F.lit(k).alias("distance")) for side, f in (("before", F.lag), ("after", F.lead)) for k in range(1, most + 1)]
    each = nodes.select("file_id", "id", F.array(*near).alias("near")).select("file_id", "id", F.explode("near").alias("s"))
    return each.where("s.sibling is not null").select("file_id", "id", "s.sibling", "s.position", "s.distance")


def siblings_of_ranges(ranges: DataFrame, nodes: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` nearest nodes before and after each range, of those on its level that it doesn't overlap.

    ``nodes`` are ``file_id, parent, id, start, end``, properly nested (a null
    parent: the top level); ``ranges`` are ``file_id, chunk, c_start, c_end,
    scope``, the node that each begins in or null.  A range's level is that of
    its scope, or the top one.  Distances count from the scope; without one,
    from the level's far end: the first node is 1 after, the last 1 before.

    On each level nodes and ranges are sorted together once; what lies before
    and after a range are then runs of neighbours, joined by their number.
    """
    level = Window.partitionBy("file_id", "up")
    n = nodes.withColumn("up", F.coalesce(F.col("parent").cast("string"), F.lit("")))
    n = n.withColumn("i", F.row_number().over(level.orderBy("start", "id"))).withColumn("size", F.count("*").over(level))
    of = n.select("file_id", F.col("id").alias("scope"), "up", F.col("i").alias("here"))
    r = ranges.join(of, ["file_id", "scope"], "left").withColumn("up", F.coalesce("up", F.lit("")))
    none = F.lit(None)
    cols = ["file_id", "up", "at", "kind", "i", "chunk", "here", "side"]
    marks = n.select("file_id", "up", F.col("end").alias("at"), F.lit(0).alias("kind"), "i", none.cast(dict(r.dtypes)["chunk"]).alias("chunk"), none.cast("int").alias("here"), F.lit("before").alias("side"))
    marks = marks.unionByName(n.select("file_id", "up", (-F.col("start")).alias("at"), F.lit(0).alias("kind"), "i", none.cast(dict(r.dtypes)["chunk"]).alias("chunk"), none.cast("int").alias("here"), F.lit("after").alias("side")))
    for side, at in (("before", F.col("c_start")), ("after", -F.col("c_end"))):
        marks = marks.unionByName(r.select("file_id", "up", at.alias("at"), F.lit(1).alias("kind"), none.cast("int").alias("i"), "chunk", "here", F.lit(side).alias("side")))
    so_far = Window.partitionBy("file_id", "up", "side").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = F.when(F.col("side") == "before", F.max("i").over(so_far)).otherwise(F.min("i").over(so_far))
    near = marks.select(*cols, edge.alias("edge")).where("kind = 1 and edge is not null")
    step = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    near = near.withColumn("k", step).withColumn("i", F.when(F.col("side") == "before", F.col("edge") - F.col("k")).otherwise(F.col("edge") + F.col("k")))
    met = near.join(n.select("file_id", "up", "i", "id", "size"), ["file_id", "up", "i"])
    distance = F.when(F.col("here").isNotNull(), F.abs(F.col("i") - F.col("here"))).when(F.col("side") == "before", F.col("size") - F.col("i") + 1).otherwise(F.col("i"))
    return met.select("file_id", "chunk", F.col("id").alias("sibling"), F.col("side").alias("position"), distance.cast("int").alias("distance"))


def used_imports(imports: DataFrame, names: DataFrame) -> DataFrame:
    """Imports (``file_id, name``) whose name is among the file's used ``names``."""
    return imports.join(names.select("file_id", "name").distinct(), ["file_id", "name"], "left_semi")


def used_names(imports: Column, names: Column) -> Column:
    """The same within a row: of an array of imported names those among the file's ``names``."""
    return F.array_intersect(imports, names)
