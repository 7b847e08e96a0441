"""Tables written between stages, into the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of that name below spark.checkpoint.dir, which all executors share; in local mode below the machine's own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.gettempdir()
    return os.path.join(folder, f"{name}-{spark.sparkContext.applicationId}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read again: its lineage is cut, lost executors cost nothing of it, and columns are pruned.

    The table lasts as long as the driver.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark, 'folio')}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    if path.startswith(("/", "file:")):
        atexit.register(shutil.rmtree, path.removeprefix("file://").removeprefix("file:"), True)
    return spark.read.schema(df.schema).parquet(path)
