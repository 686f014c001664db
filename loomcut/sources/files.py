"""Tables of files, events and indexes, in and out."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loomcut.functions.text import LANGUAGE_OF

INDEX_VERSION = 1
FILES = "path string, modificationTime timestamp, length long, content binary"
EVENTS = (
    "type string, timestamp long, session string, message_id string, tool_name string, tool_use_id string, input string, output string, error string, latency_ms long, output_chars long, "
    "input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long"
)
METRICS = (
    "instance_id string, agent_variant string, oracle_files array<string>, "
    + ", ".join(f"hit_at_1_{k} boolean, hit_at_3_{k} boolean, hit_at_5_{k} boolean, hit_at_10_{k} boolean, mrr_{k} double, coverage_at_5_{k} double, coverage_at_10_{k} double" for k in ("behavioral", "declared"))
    + ", time_to_first_hit_ms long, tokens_to_first_hit long, total_duration_ms long, total_cost_usd double, total_input_tokens long, total_output_tokens long, tool_calls_count long, semantic_search_calls long, "
    "embed_latency_ms long, embed_tokens long, embed_cost_usd double, tool_output_chars_total long, tool_output_chars_by_type map<string,long>, top_files_final array<string>, ranked_files_from_tools array<string>"
)


def dotted(extensions) -> list[str]:
    """Extensions with their leading dot."""
    return [e if e.startswith(".") else f".{e}" for e in extensions]


def read_files(spark: SparkSession, folder: str, extensions=tuple(LANGUAGE_OF), streaming: bool = False) -> DataFrame:
    """``filepath`` (relative to ``folder``) and ``code`` of all files below it with one of the extensions (case-sensitive).

    The names are pruned before any content is read.
    """
    glob = "*{" + ",".join(dotted(extensions)) + "}"
    reader = spark.readStream.schema(FILES) if streaming else spark.read
    raw = reader.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    root = ("file:" + folder if folder.startswith("/") else re.sub("^file:/+", "file:/", folder)).rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), "^file:/+", "file:/")
    rel = F.when(F.startswith(path, F.lit(root)), F.ltrim(F.substr(path, F.lit(len(root) + 1)), F.lit("/"))).otherwise(path)
    return raw.select(rel.alias("filepath"), F.make_valid_utf8(F.col("content").cast("string")).alias("code"))


INSTANCES = "instance_id string, repo string, base_commit string, problem_statement string, patch string, test_patch string"


def read_dataset(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Benchmark instances from JSON lines or Parquet, at most ``most`` of them."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.schema(INSTANCES).json(path)
    return df.limit(most) if most is not None else df


def read_paged(spark: SparkSession, fetch: Callable[[int, int], list[dict]], total: int, cache: str, page: int = 100, attempts: int = 5, wait: float = 1.0) -> DataFrame:
    """Benchmark instances from a paged service: ``fetch(offset, length)`` gives the rows of a page.

    Each page is one row of work; a page that fails is asked for again with
    doubled waits.  What came is kept at ``cache``, and read from there the next time.
    """
    if (kept := _read_parquet(spark, cache)) is not None:
        return kept
    kind = StructType.fromDDL(INSTANCES)

    def run(batches):
        for batch in batches:
            for offset in batch.column(0).to_pylist():
                for k in range(attempts):
                    try:
                        rows = fetch(offset, min(page, total - offset))
                        break
                    except Exception:
                        if k == attempts - 1:
                            raise
                        time.sleep(wait * 2**k)
                yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in kind.names} for r in rows], schema=to_arrow_schema(kind))

    spark.range(0, max(total, 0), page, max(1, min(32, -(-total // page)))).mapInArrow(run, kind).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def _read_parquet(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing is there; any other fault is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_events(events: DataFrame, path: str) -> None:
    """Add rows to a JSON-lines log."""
    events.write.mode("append").json(path)


def append_event_stream(events: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Add the rows of a stream to a JSON-lines log, each exactly once; ``once`` ends with what is there now."""
    writer = events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").json(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows; blank lines are nothing."""
    return spark.read.schema(METRICS).json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """The few rows of a summary, as one JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def index_path(folder: str, instance: str, provider: str, dims: int) -> str:
    return f"{folder}/{instance}_{provider}_{dims}"


def save_index(index: DataFrame, folder: str, instance: str, provider: str, dims: int, settings: dict | None = None) -> None:
    """Vectors in a folder of their own, and last one row that names it.

    An index without that row isn't there, and one that is replaced stays whole
    until it is.
    """
    at = index_path(folder, instance, provider, dims)
    vectors = f"vectors-{uuid.uuid4().hex}"
    index.write.parquet(f"{at}/{vectors}")
    meta = index.sparkSession.createDataFrame([(INDEX_VERSION, instance, provider, dims, {k: str(v) for k, v in (settings or {}).items()}, vectors)], "version int, instance string, provider string, dims int, settings map<string,string>, vectors string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{at}/meta")


def load_index(spark: SparkSession, folder: str, instance: str, provider: str, dims: int) -> DataFrame | None:
    """The saved vectors, or None if there are none of this version."""
    at = index_path(folder, instance, provider, dims)
    meta = _read_parquet(spark, f"{at}/meta")
    row = meta.where(F.col("version") == INDEX_VERSION).first() if meta is not None else None
    return _read_parquet(spark, f"{at}/{row['vectors']}") if row else None


def index_exists(spark: SparkSession, folder: str, instance: str, provider: str, dims: int) -> bool:
    return load_index(spark, folder, instance, provider, dims) is not None
