"""Readers for the tables a query works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; columns and filters that follow reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def instant(column: str):
    """A stored wall-clock time as an instant in UTC."""
    return F.col(column).cast("timestamp")


def settled(df: DataFrame) -> DataFrame:
    """Lineage cut in the folder that the cluster shares; one in the warehouse where none is named."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return df.checkpoint()
