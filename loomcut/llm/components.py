"""Connected components by alternating large-star and small-star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, drop_cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node of ``edges`` (``u``, ``v``).

    Each round is two aggregations and two joins over a table of at most the
    edges' number, written to the shared folder; the number of rounds grows as
    the logarithm of the largest component.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        new = cut(_small_star(_large_star(now)), "edges")
        mark = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("count(distinct v)")).first()
        drop_cut(now)
        now = new
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionByName(roots.join(stars.select(F.col("u").alias("node")), "node", "left_anti"))


def joined(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """``comp`` (``node, component``) with further ``edges`` (``u``, ``v``) let in: components of the components that they connect."""
    ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    every = cut(comp.unionByName(ends.join(comp, "node", "left_anti").select("node", F.col("node").alias("component"))), "components")
    of = lambda c: every.select(F.col("node").alias(c), F.col("component").alias(f"{c}{c}"))
    hooks = edges.join(of("u"), "u").join(of("v"), "v").select(F.col("uu").alias("u"), F.col("vv").alias("v"))
    moved = components(hooks).select(F.col("node").alias("component"), F.col("component").alias("into"))
    return every.join(moved, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
