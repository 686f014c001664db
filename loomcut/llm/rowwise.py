"""Row-wise verdicts that keep a table's own columns whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, StructField, StructType

from . import textbuf as tb


def keep_where(docs: DataFrame, verdict: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """Rows of ``docs`` for which ``verdict`` is true; all columns stay as they are, whatever their names."""
    mark = uuid.uuid4().hex
    flag = f"_keep_{mark}"
    names = [c if c.isidentifier() else f"_{mark}_{i}" for i, c in enumerate(docs.columns)]  # a name with a dot can't be given to Python workers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, verdict(b)], [*b.schema.names, flag])

    plain = docs.toDF(*names)
    schema = StructType([*plain.schema.fields, StructField(flag, BooleanType())])
    return plain.mapInArrow(tb.lean(run), schema).where(F.col(flag)).drop(flag).toDF(*docs.columns)


def _has_map(t: DataType) -> bool:
    return isinstance(t, MapType) or isinstance(t, ArrayType) and _has_map(t.elementType) or isinstance(t, StructType) and any(_has_map(f.dataType) for f in t)


def row_hash(docs: DataFrame, inside: str) -> Column:
    """A hash of a whole row in the struct ``inside``; maps, which have no order, don't count."""
    return F.xxhash64(*[F.col(inside)[f.name] for f in docs.schema if not _has_map(f.dataType)])
