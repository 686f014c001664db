"""Chunking and extraction over tables of files.

A file is one row (``filepath``, ``code``, optionally ``options``), handled in
one Python worker by ``mapInArrow``: nothing is shuffled, and a file that fails
gives a row with its error instead of ending the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomcut.operators import chunker
from loomcut.operators.chunker import Options
from loomcut.workers import ship

_RANGE = "struct<start:int,end:int>"
CONTEXT = (
    "struct<filepath:string,language:string,scope:array<struct<name:string,type:string,signature:string>>,"
    f"entities:array<struct<name:string,type:string,signature:string,docstring:string,line_range:{_RANGE},is_partial:boolean>>,"
    "siblings:array<struct<name:string,type:string,position:string,distance:int>>,imports:array<struct<name:string,source:string>>,parse_error:struct<message:string,recoverable:boolean>>"
)
CHUNK = f"struct<text:string,contextualized_text:string,byte_range:{_RANGE},line_range:{_RANGE},context:{CONTEXT},index:int,total_chunks:int>"
OPTIONS = "struct<max_chunk_size:int,context_mode:string,sibling_detail:string,filter_imports:boolean,language:string,overlap_lines:int>"
RESULT = f"filepath string, chunks array<{CHUNK}>, error struct<tag:string,message:string>"
#: Characters of code whose chunks, and entities that, a worker gathers before it passes them on, beyond those of one file.
STEP, ROWS = 1 << 20, 4096
ENTITY = f"filepath string, ord int, type string, name string, signature string, docstring string, parent string, source string, byte_range {_RANGE}, line_range {_RANGE}"


def _schema(ddl: str) -> tuple[StructType, pa.Schema]:
    t = StructType.fromDDL(ddl)
    return t, to_arrow_schema(t)


def merge_options(base: Options, own: dict | None) -> Options:
    """A file's own options over the batch's; null means not given."""
    known = {f.name for f in fields(Options)}
    return replace(base, **{k: v for k, v in (own or {}).items() if v is not None and k in known})


def _files(files: DataFrame) -> DataFrame:
    ship(files.sparkSession)
    own = F.col("options") if "options" in files.columns else F.lit(None).cast(OPTIONS)
    return files.select("filepath", F.coalesce("code", F.lit("")).alias("code"), own.alias("options"))


def chunk_batch(files: DataFrame, options: Options = Options(), chunk_file: Callable[[str, str, Options], list[dict]] = chunker.chunk) -> DataFrame:
    """``filepath, chunks, error``: one row for each file, with either its chunks or what went wrong.

    ``chunk_file`` may be another function of path, code and options.
    """
    kind, arrow = _schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows, size = [], 0
                for r in batch.slice(i, 64).to_pylist():
                    if rows and size + len(r["code"]) > STEP:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
                    size += len(r["code"])
                    try:
                        rows.append({"filepath": r["filepath"], "chunks": chunk_file(r["filepath"] or "", r["code"], merge_options(options, r["options"])), "error": None})
                    except Exception as e:  # noqa: BLE001 - one file's failure is its result
                        rows.append({"filepath": r["filepath"], "chunks": None, "error": {"tag": getattr(e, "tag", "ChunkingError"), "message": str(e)}})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return _files(files).mapInArrow(run, kind)


def chunk_batch_stream(files: DataFrame, options: Options = Options(), on_progress: Callable[[int, int, str, bool], None] | None = None) -> Iterator:
    """Rows of ``chunk_batch`` one after another, partition by partition, the next one made meanwhile.

    ``on_progress`` is told after each: how many are done, of how many, the
    path, and whether it went well.
    """
    total = files.count() if on_progress else 0
    for done, r in enumerate(chunk_batch(files, options).toLocalIterator(prefetchPartitions=True), 1):
        if on_progress:
            on_progress(done, total, r.filepath, r.error is None)
        yield r


def chunk_files(files: DataFrame, options: Options = Options()) -> DataFrame:
    """``filepath`` and the chunk's fields, one row for each chunk; files that fail have none."""
    return chunk_batch(files, options).select("filepath", F.explode("chunks").alias("c")).select("filepath", "c.*")


def chunk_files_stream(files: DataFrame, options: Options = Options()) -> DataFrame:
    """``chunk_files`` over a stream of files: it has no state, so any sink and mode will do."""
    if not files.isStreaming:
        raise ValueError("a streaming DataFrame is asked for")
    return chunk_files(files, options)


def extract_entities(files: DataFrame, mode: str = "patterns") -> DataFrame:
    """``ENTITY`` rows of every file, in order; files of no known language have none."""
    kind, arrow = _schema(ENTITY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(i, 64).to_pylist():
                    if len(rows) > ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                    language = (r["options"] or {}).get("language") or chunker.detect(r["filepath"] or "")
                    if language is None:
                        continue
                    counts = chunker.Counts(r["code"])
                    for k, e in enumerate(chunker.entities_of(r["filepath"], r["code"], language, mode)[0]):
                        at = {"start": counts.utf16(e.start), "end": counts.utf16(e.end)}
                        rows.append({"filepath": r["filepath"], "ord": k, "type": e.type, "name": e.name, "signature": e.signature, "docstring": e.docstring, "parent": e.parent, "source": e.source, "byte_range": at, "line_range": {"start": e.line_start, "end": e.line_end}})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return _files(files).mapInArrow(run, kind)


def parse_errors(files: DataFrame) -> DataFrame:
    """``filepath, message``: what is wrong with each file, null if nothing."""
    from loomcut.lang import parse

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                language = (r["options"] or {}).get("language") or chunker.detect(r["filepath"] or "")
                error = parse(r["code"], language)[1] if language else None
                rows.append((r["filepath"], error.message if error else None))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.string()) for k in (0, 1)], ["filepath", "message"])

    return _files(files).mapInArrow(run, "filepath string, message string")


@dataclass(frozen=True)
class Chunker:
    """Options to be used again; each call may override some."""

    options: Options = Options()

    def _with(self, own: dict) -> Options:
        return replace(self.options, **own)

    def chunk(self, path: str, code: str, **own) -> list[dict]:
        return chunker.chunk(path, code, self._with(own))

    def stream(self, path: str, code: str, **own) -> Iterator[dict]:
        return chunker.stream(path, code, self._with(own))

    def chunk_batch(self, files: DataFrame, **own) -> DataFrame:
        return chunk_batch(files, self._with(own))

    def chunk_batch_stream(self, files: DataFrame, on_progress=None, **own) -> Iterator:
        return chunk_batch_stream(files, self._with(own), on_progress)


def create_chunker(**options) -> Chunker:
    return Chunker(Options(**options))
