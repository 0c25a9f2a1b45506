"""Tables written to the folder that driver and executors share, to cut a long lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="staged-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows never recomputes ``df``, and a lost executor costs only its running tasks.
    Parquet rather than ``checkpoint()``, which computes its input twice and stores whole rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _staged:
        atexit.register(drop_staged)
    _staged[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def _delete(path: str, spark: SparkSession) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def drop_staged() -> None:
    """Delete all staged tables; for when the results that read them are written. What is left goes at the end of the process."""
    while _staged:
        path, spark = _staged.popitem()
        if spark._jsc is not None and not spark._jsc.sc().isStopped():
            _delete(path, spark)
