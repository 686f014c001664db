"""Source chunking and retrieval analytics on Spark."""

from loomcut.functions.text import detect_language
from loomcut.operators.chunker import Options, UnsupportedLanguage, chunk, format_chunk_with_context
from loomcut.operators.chunker import stream as chunk_stream
from loomcut.operators.code import Chunker, chunk_batch, chunk_batch_stream, chunk_files, chunk_files_stream, create_chunker, extract_entities
from loomcut.operators.evaluation import aggregate_metrics, extract_oracle, instance_metrics, metric_deltas
from loomcut.operators.index import build_index, hashing_embedder, search_index

__all__ = [
    "Chunker", "Options", "UnsupportedLanguage", "aggregate_metrics", "build_index", "chunk", "chunk_batch", "chunk_batch_stream", "chunk_files", "chunk_files_stream", "chunk_stream",
    "create_chunker", "detect_language", "extract_entities", "extract_oracle", "format_chunk_with_context", "hashing_embedder", "instance_metrics", "metric_deltas", "search_index",
]
