"""The folder that driver and executors share, for tables that a job writes for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.errors import ConfigError


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only in local mode, where it may be unset, a temporary folder is made and set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    context = spark.sparkContext
    made = context._jsc.sc().getCheckpointDir()
    if not made.isDefined():
        if not context.master.startswith("local"):
            raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        made = context._jsc.sc().getCheckpointDir()
    return made.get()


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/millrace-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: computed once, and lineage ends there. by: the column that its files are parted by."""
    path = new_folder(df.sparkSession, label)
    (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
