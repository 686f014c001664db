"""A semantic index: chunk, embed, search."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcut.operators import search as V
from loomcut.operators.chunker import Options
from loomcut.operators.code import chunk_files
from loomcut.workers import ship

Embedder = Callable[[list[str], str], list[list[float]]]
BATCH = 100
SETTINGS = Options(max_chunk_size=1500, overlap_lines=5)
_RETRY = re.compile(r"429|5\d\d|rate.?limit|timeout|timed out|temporar|unavailable|reset|overloaded", re.I)


def hashing_embedder(dims: int = 256) -> Embedder:
    """Deterministic vectors of hashed words, for tests and offline use."""

    def embed(texts: list[str], task: str) -> list[list[float]]:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in re.findall(r"[A-Za-z]+", t):
                h = int.from_bytes(hashlib.blake2b(w.lower().encode(), digest_size=8).digest(), "little")
                out[i, h % dims] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n == 0, 1, n)).tolist()

    return embed


def retrying(embed: Embedder, attempts: int = 5, wait: float = 1.0) -> Embedder:
    """``embed``, tried again with doubled waits after errors that may pass."""

    def tried(texts: list[str], task: str) -> list[list[float]]:
        for k in range(attempts):
            try:
                return embed(texts, task)
            except Exception as e:  # noqa: BLE001
                if k == attempts - 1 or not _RETRY.search(str(e)):
                    raise
                time.sleep(wait * 2**k)
        raise AssertionError

    return tried


def build_index(files: DataFrame, embed: Embedder, options: Options = SETTINGS) -> DataFrame:
    """``filepath, ord, start_line, end_line, text, contextualized_text, embedding`` of every chunk of every file that can be chunked."""
    ship(files.sparkSession)
    chunks = chunk_files(files, options).select("filepath", F.col("index").alias("ord"), F.col("line_range.start").alias("start_line"), F.col("line_range.end").alias("end_line"), "text", "contextualized_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                b = batch.slice(i, BATCH)
                vectors = embed(b.column("contextualized_text").to_pylist(), "document")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], [*b.schema.names, "embedding"])

    return chunks.mapInArrow(run, "filepath string, ord int, start_line int, end_line int, text string, contextualized_text string, embedding array<double>")


def search_index(index: DataFrame, query: str, embed: Embedder, top_k: int = 10, pattern: str | None = None) -> DataFrame:
    """``filepath, start_line, end_line, score, snippet``, best first."""
    q = embed([query], "query")[0]
    found = V.search(index.withColumn("_order", F.struct("filepath", "ord")), q, top_k, pattern, order="_order")
    return found.select("filepath", "start_line", "end_line", "score", F.left("text", F.lit(200)).alias("snippet"))


def result_text(found: DataFrame) -> Column | str:
    """The results (few rows) as the text that a search tool returns, with the list of files."""
    rows = found.collect()
    shown = []
    for i, r in enumerate(rows):
        lines = f":L{r.start_line}-{r.end_line}" if r.start_line and r.end_line else ""
        snippet = r.snippet.replace("\n", "\n   ")
        shown.append(f"{i + 1}. {r.filepath}{lines} (score: {r.score:.3f})\n   {snippet}")
    files = "\n".join(r.filepath for r in rows)
    return f"Found {len(rows)} relevant code locations:\n\n" + "\n\n".join(shown) + f"\n\n__FILES__\n{files}\n__END_FILES__"
