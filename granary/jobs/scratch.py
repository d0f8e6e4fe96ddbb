"""A folder for a job's own tables, in the one that the cluster shares; it is deleted as the driver ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    name = f"{base.rstrip('/')}/job-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{name}/rows"


def saved(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df as a table of the job's folder, for what is read more than once."""
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
