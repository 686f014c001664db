"""Analytics of event logs and of metrics by variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTERS = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def first_of(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first event of every key."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def usage(events: DataFrame, session: str, message: str, order: list[str], counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """Sums of the counters by session, each message counted once, as first seen."""
    return first_of(events, [session, message], order).groupBy(session).agg(*[F.sum(c).alias(c) for c in counters])


def tool_latency(starts: DataFrame, ends: DataFrame, key: list[str]) -> DataFrame:
    """Ends with the time since their start; 0 where no start is known."""
    s = starts.groupBy(*key).agg(F.min("ts_ms").alias("_start"))
    return ends.join(s, key, "left").withColumn("latency_ms", F.coalesce(F.col("ts_ms") - F.col("_start"), F.lit(0)).cast("long")).drop("_start")


def first_seen(paths: DataFrame, session: str = "session", path: str = "path", order: tuple[str, ...] = ("event_no",)) -> DataFrame:
    """``session, path, rank``: distinct paths by when they were first seen, within an event by their place if ``order`` has it."""
    first = paths.groupBy(session, path).agg(F.min(F.struct(*order)).alias("_at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(session).orderBy("_at", path))).drop("_at")


def first_hit(events: DataFrame, session: str = "session") -> DataFrame:
    """``session, ts_ms, tokens``: when a session first saw a wanted path (``hit``), and the tokens used by then."""
    so_far = Window.partitionBy(session).orderBy("event_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = events.withColumn("_sum", F.sum("tokens").over(so_far))
    return running.where("hit").groupBy(session).agg(F.min_by("ts_ms", "event_no").alias("ts_ms"), F.min_by("_sum", "event_no").alias("tokens"))


def map_sum(events: DataFrame, session: str, key: str, value: str, name: str) -> DataFrame:
    """``session`` and a map from ``key`` to the sum of ``value``."""
    per = events.groupBy(session, key).agg(F.sum(value).alias("_v"))
    return per.groupBy(session).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "_v")))).alias(name))


def nearest_rank(column: str, percent: float) -> Column:
    """Nearest-rank percentile; null over nothing."""
    return F.expr(f"percentile_disc({percent / 100}) within group (order by {column})")


def variant_summary(metrics: DataFrame, variants: list[str], rates: dict[str, Column], means: list[str], percentiles: dict[str, tuple[float, ...]]) -> DataFrame:
    """One row for each variant, with zeros for one that has no rows: rates of conditions, means, nearest-rank percentiles."""
    agg = [F.count("*").alias("n")]
    agg += [F.round(F.avg(c.cast("double")), 6).alias(k) for k, c in rates.items()]
    agg += [F.round(F.avg(m), 6).alias(f"mean_{m}") for m in means]
    kinds = dict(metrics.dtypes)  # percentile_disc gives doubles
    agg += [nearest_rank(m, p).cast(kinds[m]).alias(f"p{p:g}_{m}") for m, ps in percentiles.items() for p in ps]
    spark = metrics.sparkSession
    dim = spark.createDataFrame([(v,) for v in variants], "variant string")
    out = dim.join(metrics.groupBy("variant").agg(*agg), "variant", "left")
    return out.select("variant", *[F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in out.dtypes if c != "variant"])


def delta(summary: DataFrame, first: str, second: str, columns: list[str]) -> DataFrame:
    """One row: ``first`` less ``second`` for each column of a summary."""
    of = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    return summary.agg(*[F.round(of(first, c) - of(second, c), 6).alias(f"delta_{c}") for c in columns])
