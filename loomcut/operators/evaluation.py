"""Metrics of retrieval runs against the files that a fix touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcut.functions import text as T
from loomcut.operators.events import delta, first_of, nearest_rank

COST_PER_1000 = 0.00002


def extract_oracle(instances: DataFrame, with_tests: bool = False) -> DataFrame:
    """``instance_id, file``: distinct files of the patch, and of the test patch if asked."""
    files = T.diff_files("patch")
    if with_tests:
        files = F.array_union(files, T.diff_files(F.coalesce("test_patch", F.lit(""))))
    return instances.select("instance_id", F.explode(files).alias("file"))


KS = (1, 3, 5, 10)
KINDS = {"behavioral": "ranked_files_from_tools", "declared": "top_files_final"}


def _ranked(runs: DataFrame, oracle: str) -> DataFrame:
    """``runs`` with both rankings normalized, and the place of the first hit in each: columns of their own, so that they are made once."""
    made = {f"_ranked_{name}": F.transform(F.coalesce(files, F.array().cast("array<string>")), T.normalize_path) for name, files in KINDS.items()}
    place = lambda ranked: F.array_min(F.filter(F.transform(ranked, lambda f, i: F.when(F.array_contains(oracle, f), i + 1)), lambda p: p.isNotNull()))
    return runs.withColumns(made).withColumns({f"_place_{name}": place(f"_ranked_{name}") for name in KINDS})


def _ranking(name: str, oracle: str) -> list[Column]:
    """Hits, reciprocal rank and coverage of a ranking of ``_ranked`` against the set ``oracle``."""
    ranked, place = F.col(f"_ranked_{name}"), F.col(f"_place_{name}")
    covered = lambda k: F.size(F.array_intersect(F.slice(ranked, 1, k), oracle)) / F.nullif(F.size(oracle), F.lit(0))
    out = [F.coalesce(place <= k, F.lit(False)).alias(f"hit_at_{k}_{name}") for k in KS]
    out.append(F.round(F.coalesce(1 / place, F.lit(0.0)), 6).alias(f"mrr_{name}"))
    return out + [F.round(F.coalesce(covered(k), F.lit(1.0)), 6).alias(f"coverage_at_{k}_{name}") for k in (5, 10)]


def instance_metrics(runs: DataFrame, oracle: DataFrame) -> DataFrame:
    """The metrics' row of every run: quality of both rankings, time and tokens to the first hit, cost, search, output, rankings.

    ``runs`` has ``instance_id, agent_variant``, the arrays
    ``ranked_files_from_tools`` (behaviour) and ``top_files_final`` (declared),
    ``time_to_first_hit_ms, tokens_to_first_hit, total_duration_ms,
    total_cost_usd, total_input_tokens, total_output_tokens, tool_calls_count,
    tool_output_chars_by_type``, and for runs with semantic search (null else)
    ``semantic_search_calls, query_embed_tokens, query_embed_latency_ms,
    index_embed_tokens, index_load_ms``.  A run without ranked files found
    nothing; one without oracle files (``instance_id, file``) covers all.
    """
    wanted = oracle.groupBy("instance_id").agg(F.array_sort(F.collect_set(T.normalize_path("file"))).alias("oracle_files"))
    r = _ranked(runs.join(wanted, "instance_id", "left").withColumn("oracle_files", F.coalesce("oracle_files", F.array().cast("array<string>"))), "oracle_files")
    searched = F.col("semantic_search_calls").isNotNull()
    sum_of = lambda a, b: F.when(searched, F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    tokens = sum_of("query_embed_tokens", "index_embed_tokens")
    chars = F.aggregate(F.map_values("tool_output_chars_by_type"), F.lit(0).cast("long"), lambda s, x: s + x)
    return r.select(
        "instance_id", "agent_variant", "oracle_files", *[c for name in KINDS for c in _ranking(name, "oracle_files")],
        "time_to_first_hit_ms", "tokens_to_first_hit", "total_duration_ms", "total_cost_usd", "total_input_tokens", "total_output_tokens", "tool_calls_count", "semantic_search_calls",
        sum_of("query_embed_latency_ms", "index_load_ms").alias("embed_latency_ms"), tokens.alias("embed_tokens"), F.round(tokens / 1000 * COST_PER_1000, 9).alias("embed_cost_usd"),
        F.coalesce(chars, F.lit(0)).alias("tool_output_chars_total"), "tool_output_chars_by_type", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("top_files_final", "ranked_files_from_tools")],
    )


def runs_of_events(events: DataFrame, sessions: DataFrame, oracle: DataFrame) -> DataFrame:
    """What ``instance_metrics`` asks for, from logs: one row for each of ``sessions``.

    ``sessions`` has ``session, instance_id, agent_variant, total_duration_ms,
    total_cost_usd, top_files_final``; ``events`` has ``session, event_no,
    type`` (``tool_call`` or ``usage``), ``timestamp`` since the session's
    start, ``tool_name, output_chars, paths`` (the files that a call named, in
    order), ``message_id, input_tokens, output_tokens``.  A file is ranked where
    it is first seen; a message's usage counts once; the first hit is the first
    new file that the oracle has, with the tokens used by then.
    """
    calls, spent = events.where("type = 'tool_call'"), first_of(events.where("type = 'usage'"), ["session", "message_id"], ["event_no"])
    seen = calls.select("session", "event_no", "timestamp", F.posexplode("paths").alias("place", "path"))
    order = F.col("event_no").cast("decimal(20,0)") * F.lit(1 << 31) + F.col("place")  # a number, not a struct, is aggregated without a sort
    first = lambda rows, at: rows.groupBy("session", "path").agg(F.min(at).alias("at"), F.min("event_no").alias("event_no"), F.min_by("timestamp", "event_no").alias("timestamp"))
    few = first(seen, order).withColumn("path", T.normalize_path("path")).repartition("session")  # all that follows is within a session
    ranked = first(few, "at").withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy("at", "path")))
    files = ranked.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "event_no", "timestamp"))).alias("files"))
    wanted = oracle.groupBy("instance_id").agg(F.collect_set(T.normalize_path("file")).alias("wanted"))
    hit = F.get(F.filter("files", lambda f: F.array_contains("wanted", f["path"])), F.lit(0))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    both = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    usage_ = spent.groupBy("session").agg(total("input_tokens").alias("total_input_tokens"), total("output_tokens").alias("total_output_tokens"), F.collect_list(F.struct("event_no", both.cast("long").alias("tokens"))).alias("spent"))
    by_tool = calls.groupBy("session", "tool_name").agg(F.sum("output_chars").alias("_v"), F.count("*").alias("_n"))
    tools = by_tool.groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool_name", "_v")))).alias("tool_output_chars_by_type"), F.sum("_n").alias("tool_calls_count"))
    out = sessions.join(files, "session", "left").join(usage_, "session", "left").join(tools, "session", "left").join(wanted, "instance_id", "left")
    out = out.withColumn("hit", hit).withColumn("time_to_first_hit_ms", F.col("hit.timestamp")).withColumn("ranked_files_from_tools", F.transform("files", lambda f: f["path"]))
    by_then = F.aggregate("spent", F.lit(0).cast("long"), lambda n, u: n + F.when(u["event_no"] < F.col("hit.event_no"), u["tokens"]).otherwise(0))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total_input_tokens", "total_output_tokens", "tool_calls_count")]
    none = [F.lit(None).cast("long").alias(c) for c in ("semantic_search_calls", "query_embed_tokens", "query_embed_latency_ms", "index_embed_tokens", "index_load_ms")]
    tokens = F.when(F.col("time_to_first_hit_ms").isNotNull(), F.coalesce(by_then, F.lit(0))).cast("long").alias("tokens_to_first_hit")
    return out.select("instance_id", "agent_variant", "ranked_files_from_tools", "top_files_final", "time_to_first_hit_ms", tokens, "total_duration_ms", "total_cost_usd", *zero, "tool_output_chars_by_type", *none)


VARIANTS = ("ops-only", "ops-plus-search")
DENIED_TOOLS = ("Write", "Edit", "Bash", "WebFetch", "TodoRead", "TodoWrite", "NotebookRead", "NotebookEdit")
_OPS = ("Read", "Grep", "Glob")
_POLICIES = ((VARIANTS[0], _OPS, 20, 50), (VARIANTS[1], (*_OPS, "mcp__semantic_search__search"), 20, 50))


def variant_policies(spark: SparkSession) -> DataFrame:
    """``agent_variant, allowed_tools, max_turns, max_tool_calls``: what each variant may do."""
    return spark.createDataFrame([(v, list(tools), turns, calls) for v, tools, turns, calls in _POLICIES], "agent_variant string, allowed_tools array<string>, max_turns int, max_tool_calls int")


def judged_calls(calls: DataFrame, policies: DataFrame) -> DataFrame:
    """``calls`` (``agent_variant, tool, so_far``: calls before it) with a ``verdict`` by its variant's policy."""
    budget = F.col("so_far") >= F.col("max_tool_calls")
    verdict = F.when(budget, "Tool budget exceeded").when(F.col("tool").isin(*DENIED_TOOLS), "Tool is denied for retrieval-only mode").when(~F.array_contains("allowed_tools", F.col("tool")), "Tool not in allowlist").otherwise("allowed")
    return calls.join(F.broadcast(policies), "agent_variant").withColumn("verdict", verdict).drop("allowed_tools", "max_turns", "max_tool_calls")


def aggregate_metrics(metrics: DataFrame, variants: tuple[str, ...] = VARIANTS) -> DataFrame:
    """One row for each variant, zeros for one without rows: hit rates, means, totals, nearest-rank percentiles.

    ``metrics`` are the rows of ``instance_metrics``; quality is that of the
    behavioural ranking.  Medians to the first hit stay null where no run has
    one.
    """
    m = metrics.withColumn("tokens", F.col("total_input_tokens") + F.col("total_output_tokens"))
    zero = [F.round(F.avg(F.col(f"hit_at_{k}_behavioral").cast("double")), 6).alias(f"hit_at_{k}_rate") for k in KS]
    zero += [F.round(F.avg(f"{c}_behavioral"), 6).alias(f"mean_{c}") for c in ("mrr", "coverage_at_5", "coverage_at_10")]
    totals = {"duration_ms": "total_duration_ms", "tokens": "tokens", "input_tokens": "total_input_tokens", "output_tokens": "total_output_tokens", "cost_usd": "total_cost_usd", "tool_calls": "tool_calls_count"}
    zero += [F.round(F.sum(c), 6).alias(f"total_{name}") for name, c in totals.items()]
    zero += [nearest_rank(totals[c], p).cast("long").alias(f"{n}_{c}") for c in ("duration_ms", "tokens") for n, p in (("median", 50), ("p90", 90))]
    absent = [nearest_rank(c, 50).cast("long").alias(f"median_{c}") for c in ("time_to_first_hit_ms", "tokens_to_first_hit")]
    per = m.groupBy(F.col("agent_variant").alias("variant")).agg(*zero, *absent)
    dim = metrics.sparkSession.createDataFrame([(v,) for v in variants], "variant string")
    out = dim.join(per, "variant", "left")
    keep = {f"median_{c}" for c in ("time_to_first_hit_ms", "tokens_to_first_hit")} | {"variant"}
    return out.select(*[F.col(c) if c in keep else F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in out.dtypes])


def summary_report(summary: DataFrame, split: str, instances: int, width: int = 70) -> str:
    """A summary's few rows as text."""
    out = [f"Retrieval evaluation ({split})", f"Total instances: {instances}"]
    for r in summary.orderBy("variant").collect():
        out += [
            f" {r.variant.upper()} ".center(width, "="),
            "  ".join(f"Hit@{k}: {r[f'hit_at_{k}_rate'] * 100:5.1f}%" for k in KS),
            f"MRR: {r.mean_mrr:.3f}  Coverage@5: {r.mean_coverage_at_5 * 100:.1f}%  Coverage@10: {r.mean_coverage_at_10 * 100:.1f}%",
            f"Duration: {r.total_duration_ms} ms (median {r.median_duration_ms}, p90 {r.p90_duration_ms})  Tokens: {r.total_tokens} (median {r.median_tokens}, p90 {r.p90_tokens})",
            f"Tool calls: {r.total_tool_calls}  Cost: ${r.total_cost_usd:.4f}",
        ]
    return "\n".join(out)


def metric_deltas(summary: DataFrame, variants: tuple[str, str] = VARIANTS) -> DataFrame:
    """The second variant less the first."""
    return delta(summary, variants[1], variants[0], ["hit_at_1_rate", "hit_at_3_rate", "hit_at_5_rate", "mean_mrr", "total_duration_ms", "total_tokens", "total_cost_usd"])


def reported_usage(accumulated: str, reported: str):
    """What a session's last message reports, or what was added up where that is 0 or missing."""
    return F.coalesce(F.nullif(F.col(reported), F.lit(0)), F.col(accumulated), F.lit(0))
