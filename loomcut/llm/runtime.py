"""What the operators share: tables, scratch tables in the shared folder, folds."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ship

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which every executor reaches; in local mode, where it is unset, a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not at:
        at = getattr(shared_dir, "own", None)
        if not at:
            at = shared_dir.own = tempfile.mkdtemp(prefix="loomcut-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there: a lost executor costs at most the stage that reads it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomcut/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete a table of ``cut`` that no later result reads."""
    for f in df.inputFiles()[:1]:
        _delete(df.sparkSession, f.rsplit("/", 1)[0])


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that ``cut`` has made in this session, once no result that reads them is needed."""
    for s, path in _made:
        if s is spark:
            _delete(s, path)
    _made[:] = [x for x in _made if x[0] is not spark]


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        local = path.removeprefix("file://")
        if os.path.isdir(local):
            shutil.rmtree(local, ignore_errors=True)
        elif spark.sparkContext._jsc is not None:  # on another file system, while the session lives
            _delete(spark, path)


def id_text(col: str | Column = "doc_id") -> Column:
    """The id as text; a null id counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def fold(n: int, col: str | Column = "doc_id") -> Column:
    """``crc32(id as text) mod n``."""
    return (F.crc32(id_text(col)) % F.lit(n)).cast("int")
