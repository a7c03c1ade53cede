"""Freeing the shuffle files of stages that are over."""

import gc

from pyspark.sql import SparkSession


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files that nothing refers to any more.

    It learns of them when the driver's garbage is collected, which on a quiet driver may be long
    after a large stage; an operator of several large stages calls this between them.
    """
    gc.collect()
    spark._jvm.System.gc()
