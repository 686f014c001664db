"""Row filters by id sets of any size, without shuffling the rows that surely miss."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: a documented bound (1 MiB), whatever the number of ids.
BITS = 1 << 23
_BUCKET = 32768


def bit_of(*cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BITS))


def _bitmap(at: DataFrame) -> DataFrame:
    """``bucket, bits`` of the bits in ``at`` (one column of that name)."""
    return at.groupBy(F.floor(F.col("at") / _BUCKET).cast("int").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(cast(at % {_BUCKET} as int))").alias("bits"))


def bitmap(ids: DataFrame, *cols: str) -> np.ndarray:
    """``BITS`` booleans of ``bit_of(*cols)``, for use inside Python workers; at most 1 MiB reaches the driver."""
    out = np.zeros(BITS // 8, np.uint8)
    for b in _bitmap(ids.select(bit_of(*cols).alias("at"))).collect():
        out[b[0] * _BUCKET // 8 :][: _BUCKET // 8] = np.frombuffer(bytes(b[1]), np.uint8)
    return out


def has_bit(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def split(rows: DataFrame, ids: DataFrame, keys: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``keys`` surely aren't among ``ids`` (as many columns), and those that may be.

    Both have the one column ``row``, so that no name of theirs can clash, and
    the second ``k0``, ``k1``, ... as well.
    """
    bits = F.broadcast(_bitmap(ids.select(bit_of(*[F.col(c) for c in ids.columns]).alias("at"))))
    at = bit_of(*keys)
    told = rows.select(F.struct("*").alias("row"), *[k.alias(f"k{i}") for i, k in enumerate(keys)], F.floor(at / _BUCKET).cast("int").alias("bucket"), (at % _BUCKET).cast("int").alias("at"))
    told = told.join(bits, "bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at / 8 as int) + 1, 1)")), 16, 10).cast("int")
    told = told.withColumn("byte", byte).withColumn("hit", F.coalesce(F.expr("shiftright(byte, at % 8)").bitwiseAND(F.lit(1)) == 1, F.lit(False)))
    return told.where(~F.col("hit")).select("row"), told.where("hit").select("row", *[f"k{i}" for i in range(len(keys))])


def anti(rows: DataFrame, ids: DataFrame, keys: list[Column]) -> DataFrame:
    """``rows`` whose ``keys`` aren't among ``ids`` (as many columns); a null key is in no set.

    Rows whose bit is unset stay where they are; only the others, few unless
    ``ids`` are very many, go through the exact anti-join.
    """
    clear, maybe = split(rows, ids, keys)
    listed = ids.toDF(*[f"k{i}" for i in range(len(keys))]).distinct()
    return clear.unionByName(maybe.join(listed, listed.columns, "left_anti").select("row")).select("row.*")
