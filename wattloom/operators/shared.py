"""Intermediate tables in the folder that all executors share: what a loop needs again is written once, and lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session (tests) that names none gets a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.conf.get("wattloom.tables.dir", None)
    if not own:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="wattloom-tables-")
        spark.conf.set("wattloom.tables.dir", own)
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def series_table(readings: DataFrame, key: str = "household_id", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """readings as a table bucketed by household and sorted in each bucket: windows and groupings of series whose keys hold the
    household then need no shuffle. A stored table, so lost executors lose nothing; one shuffle of the readings in all."""
    spark, name = readings.sparkSession, f"series_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = readings.repartition(buckets, key).write.format("parquet").option("path", f"{shared_dir(spark)}/{name}")
    writer.bucketBy(buckets, key).sortBy(key, *order).saveAsTable(name)
    return spark.table(name)
