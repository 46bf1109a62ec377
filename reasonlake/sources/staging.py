"""Tables between the steps of a computation, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the executors share: below ``spark.checkpoint.dir``; a local session without it has one of its own,
    a cluster without it the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or (
        "file://" + tempfile.mkdtemp(prefix="spark-reasonlake-") if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
    )
    return f"{root}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
