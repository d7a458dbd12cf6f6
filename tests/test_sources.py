"""Round trips of matrices and reports, household files with fallback, and lists that prune partitions."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.sources import matrices, readers, writers


def test_matrix_round_trip(spark, tmp_path):
    df = spark.range(1000).select("id", F.concat(F.lit("h"), "id").alias("name"), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.col("id") / k).alias("x")).repartition(3)
    path = f"file://{tmp_path}/m"
    matrices.write_matrix(df, path, rows=150)
    assert sorted(map(str, matrices.read_matrix(spark, path, df.schema).collect())) == sorted(map(str, df.collect()))
    shards = [json.loads(x) for x in open(tmp_path / "m" / "manifest.json")]
    assert sum(s["rows"] for s in shards) == 1000 and max(s["rows"] for s in shards) <= 150 and {s["columns"] for s in shards} == {5}
    assert np.load(tmp_path / "m" / "part-00000.npy").shape == (shards[0]["rows"], 5) and not (tmp_path / "m" / "_staged").exists()
    matrices.write_matrix(df.limit(7), path)  # a smaller one leaves nothing of the former
    assert matrices.read_matrix(spark, path, df.schema).count() == 7


def test_matrix_refuses(spark, tmp_path):
    for rows in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, None)]):
        df = spark.createDataFrame(rows, "id long, x array<double>").coalesce(1)
        with pytest.raises(Exception, match="widths|nulls"):
            matrices.write_matrix(df, f"file://{tmp_path}/bad")
    assert not (tmp_path / "bad" / "manifest.json").exists()


def test_empty_matrix(spark, tmp_path):
    df = spark.createDataFrame([], "id long, x array<double>")
    matrices.write_matrix(df, f"file://{tmp_path}/none")
    assert matrices.read_matrix(spark, f"file://{tmp_path}/none", df.schema).count() == 0


def test_report_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("gas", 1.5, None), ("elec", None, "x\ny")], "fuel string, v double, note string")
    b = a.where("false")
    writers.write_report({"a": a, "b": b}, f"file://{tmp_path}/r", vocabulary="v7")
    back = writers.read_report(spark, f"file://{tmp_path}/r", "a", a.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, a.collect()))
    assert writers.read_report(spark, f"file://{tmp_path}/r", "b", a.schema).count() == 0
    meta = writers.report_metadata(spark, f"file://{tmp_path}/r")
    assert meta["vocabulary"] == "v7" and meta["sections"] == ["a", "b"]


def test_household_files(spark, tmp_path):
    def put(name, v):
        spark.createDataFrame([(v,)], "value double").coalesce(1).toPandas().to_parquet(tmp_path / "h" / name)

    (tmp_path / "h").mkdir()
    put("a.parquet", 1.0), put("b.parquet", 2.0), put("metadata_catalog.parquet", 9.0)
    got = readers.household_files(spark, str(tmp_path / "h"), "value double")
    assert sorted(map(tuple, got.collect())) == [(1.0, "a"), (2.0, "b")]
    put("a_tokenised.parquet", 5.0), put("summary_tokenised.parquet", 9.0)
    got = readers.household_files(spark, str(tmp_path / "h"), "value double")
    assert sorted(map(tuple, got.collect())) == [(5.0, "a")]


def test_listed_households_prune_partitions(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 6).alias("household_id"), "id")
    writers.write_household(df, f"{tmp_path}/t")
    assert readers.household_list(spark, f"{tmp_path}/vocab") is None
    writers.write_household_list(spark.createDataFrame([(1,), (4,), (77,), (None,), (1,)], "household_id long"), f"{tmp_path}/vocab")
    stored = spark.read.parquet(f"{tmp_path}/t")
    own, missing = readers.listed(stored, readers.household_list(spark, f"{tmp_path}/vocab"))
    scan = next(x for x in own._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x)
    assert "household_id" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert own.count() == 20 and [r[0] for r in missing.collect()] == [77]
    assert readers.listed(stored, missing, most=0)[0].count() == 0


def test_listed_readings_are_stored_in_few_files(spark, tmp_path):
    from wattloom.plans.queries import QUERIES

    spark.range(4000).selectExpr(
        "id AS l_orderkey", "id % 200 AS l_suppkey", "int(id) AS l_linenumber", "double(id % 50) AS l_quantity", "1D AS l_extendedprice", "0D AS l_discount", "0D AS l_tax",
        "'A' AS l_returnflag", "CAST(TIMESTAMP '1995-12-05' AS TIMESTAMP_NTZ) AS l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("wattloom.tables.dir", None)
    spark.conf.set("wattloom.tables.dir", f"file://{tmp_path}/tables")
    try:
        got = QUERIES["listed_readings"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("wattloom.tables.dir", before) if before else spark.conf.unset("wattloom.tables.dir")
    assert sorted(r["household_id"] for r in got) == list(range(1, 200, 3)) and {r["n"] for r in got} == {20}
    assert len(list((tmp_path / "tables").rglob("*.parquet"))) < 20  # a file a household were 200
