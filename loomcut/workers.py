"""What workers need: this package where it isn't installed, and folders that all of them share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])


def ship(spark: SparkSession) -> None:
    """Put this package's folder on the workers' path; on a cluster, install it or pass ``--py-files``."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in ``spark.checkpoint.dir``; in local mode, where it is unset, in a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(scratch, "own", None)
        if not at:
            at = scratch.own = tempfile.mkdtemp(prefix="loomcut-scratch-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in a folder of ``scratch`` and read it back."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop_cut(df: DataFrame) -> None:
    """Delete a table of ``cut`` that no later result reads."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        p = spark._jvm.org.apache.hadoop.fs.Path(f.rsplit("/", 1)[0])
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
