"""Tables in the folder that driver and executors share; they cut the lineage of what is read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests, one machine) gets a folder of its own where the setting is missing.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_lodestone_dir", None)
    if own is None:
        own = spark.sparkContext._lodestone_dir = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return own


def save(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-computation, and later
    stages share the rows without caching them in executor memory.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of that name that nothing has used, inside the shared one; nothing is written yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_saved(df: DataFrame) -> None:
    """Delete what :func:`save` wrote for ``df``; nothing may read it afterwards."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
