"""Writers: tokens, vocabularies, splits, synthetic months, reports."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_tokens(df: DataFrame, path: str) -> None:
    """Tokenised readings, partitioned by split, rows of a household together."""
    df.repartition("split", "household_id").sortWithinPartitions("household_id", "ts").write.mode("overwrite").partitionBy("split").parquet(path)


def write_vocabulary(vocab: DataFrame, path: str, **properties) -> None:
    """One row a modality: a few hundred numbers."""
    out = vocab.select("*", *[F.lit(v).alias(k) for k, v in properties.items()])
    out.coalesce(1).write.mode("overwrite").parquet(path)


def write_assignment(df: DataFrame, path: str) -> None:
    """split_assignment(household_id, split, shard)."""
    df.select("household_id", "split", "shard").write.mode("overwrite").partitionBy("split").parquet(path)


def write_shards(sequences: DataFrame, path: str) -> None:
    """Training windows (sequence_id, shard, x, y), a folder a shard."""
    sequences.write.mode("overwrite").partitionBy("shard").parquet(path)


def wide_month(df: DataFrame, households: list[str], keys: list[str]) -> DataFrame:
    """keys, then two columns a household. The list of households fixes the columns and spares a scan."""
    names = {"electricity": "elec_net_Wh", "gas": "gas_Wh"}
    cell = F.concat_ws("_", "household_id", F.when(F.col("fuel") == "gas", names["gas"]).otherwise(names["electricity"]))
    return df.withColumn("_c", cell).groupBy(*keys).pivot("_c", [f"{h}_{n}" for h in households for n in names.values()]).agg(F.first("value"))


def append_batch_summary(batch: DataFrame, path: str) -> None:
    batch.write.mode("append").parquet(path)


def write_household(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("household_id").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_report(sections: dict[str, DataFrame], path: str, **run) -> None:
    """The results as JSON lines, a folder `section=<name>` a section, and the run's metadata as a section of its own.

    Executors write the rows under Spark's commit protocol to whatever store the path names; the driver sees none of them."""
    for name, df in sections.items():
        rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
        rows.write.mode("overwrite").text(f"{path}/section={name}")
    if sections:
        spark = next(iter(sections.values())).sparkSession
        meta = run | {"written": datetime.now(timezone.utc).isoformat(), "sections": sorted(sections)}
        spark.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/section=run")


def read_report(spark: SparkSession, path: str, section: str, schema: str | StructType) -> DataFrame:
    """One section of a written report."""
    return spark.read.schema(schema).json(f"{path}/section={section}")


def report_metadata(spark: SparkSession, path: str) -> dict:
    """The run's metadata: one line."""
    return json.loads(spark.read.text(f"{path}/section=run").first()["value"])


def write_household_list(households: DataFrame, path: str) -> None:
    """The households that a vocabulary was made from, beside it: tokenising is restricted to them."""
    households.select("household_id").where("household_id is not null").distinct().write.mode("overwrite").parquet(f"{path.rstrip('/')}_households")
