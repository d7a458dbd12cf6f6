"""Generated fixtures: table-valued functions over spark.range, seeded by hashes, in any number of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value lists of the fixture's schema.
REGIONS = ["EAST MIDLANDS", "EAST OF ENGLAND", "GREATER LONDON", "NORTH EAST", "NORTH WEST", "SCOTLAND", "SOUTH EAST", "SOUTH WEST", "WALES", "WEST MIDLANDS", "YORKSHIRE"]
RATINGS = ["A", "B", "C", "D", "E", "F", "G"]
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on its parts only."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def normal(*parts: Column) -> Column:
    u, v = F.greatest(uniform(*parts, F.lit("u")), F.lit(1e-12)), uniform(*parts, F.lit("v"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def pick(values: list, *parts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(uniform(*parts) * len(values)) + 1).cast("int"))


def household_ids(spark: SparkSession, n: int) -> DataFrame:
    """n distinct ids of 8 upper-case letters and digits: the row number in base 36 after a bijection modulo 36^8."""
    mixed = F.pmod(F.col("id") * 1_000_003 + 12_345_678_901, F.lit(36**8))
    digits = [F.substring(F.lit(_ALPHABET), 1, 36).substr((F.pmod(F.floor(mixed / 36**i), F.lit(36)) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return spark.range(n).select(F.concat(*digits).alias("PUPRN"))


def exporters(ids: DataFrame, share: float = 0.07) -> DataFrame:
    return ids.where(uniform(F.col("PUPRN"), F.lit("exporter")) < share).select(F.col("PUPRN").alias("puprn"))


def participants(ids: DataFrame) -> DataFrame:
    p = F.col("PUPRN")
    return ids.select("PUPRN", pick(REGIONS, p, F.lit("region")).alias("Region"), (F.floor(uniform(p, F.lit("imd")) * 5) + 1).cast("int").alias("IMD_quintile"))


def epc(ids: DataFrame, missing: float = 0.3) -> DataFrame:
    p = F.col("PUPRN")
    held = lambda name, c: F.when(uniform(p, F.lit(name), F.lit("null")) >= missing, c).alias(name)
    return ids.select("PUPRN", held("currentEnergyRating", pick(RATINGS, p, F.lit("rating"))), held("totalFloorArea", F.round(30 + uniform(p, F.lit("area")) * 220, 1)))


def survey(ids: DataFrame) -> DataFrame:
    p = F.col("PUPRN")
    code = lambda name, low, high: (F.floor(uniform(p, F.lit(name)) * (high - low + 1)) + low).cast("int").alias(name)
    codes = [code(*x) for x in (("A1", 1, 2), ("A2", 1, 2), ("B1", -2, 6), ("B4", -2, 5), ("B5", -2, 10), ("B9", -2, 7), ("C1", 1, 8), ("C1_new", -2, 8), ("C5", -1, 2), ("D1", 1, 5), ("D2", 1, 5), ("D4", -2, 5))]
    codes += [code(f"A3{i:02d}", 0, 1) for i in range(1, 11)]
    return ids.select(
        "PUPRN", F.lit("v1").alias("Survey_version"), F.lit("2023-01-01").alias("Recorded_date"), pick(["online", "paper"], p, F.lit("how")).alias("Collection_method"),
        F.lit("English").alias("Language"), *codes, F.lit(False).alias("B5_err"), (uniform(p, F.lit("A3_err")) < 0.1).alias("A3_err"),
    )


def follow_up(ids: DataFrame, missing: float = 0.4) -> DataFrame:
    p = F.col("PUPRN")
    held = lambda name, c: F.when(uniform(p, F.lit(name), F.lit("null")) >= missing, c).alias(name)
    return ids.select(
        "PUPRN", held("A1_corr_C", F.round(15 + uniform(p, F.lit("corr")) * 10, 1)), held("A1_err", uniform(p, F.lit("e")) < 0.05), held("B3_1_yes", pick(["yes", "no"], p, F.lit("b31"))),
        held("B3_4_yes", pick(["yes", "no"], p, F.lit("b34"))), held("C1", pick([f"band {i}" for i in range(1, 7)], p, F.lit("c1"))), held("D4", pick(["1", "2", "3", "4", "5"], p, F.lit("d4"))), held("D5", pick(["1", "2", "3"], p, F.lit("d5"))),
    )


def half_hours(spark: SparkSession, year: int) -> DataFrame:
    """ts from 00:30 on 1 January to 00:00 of the next year."""
    return spark.sql(f"SELECT explode(sequence(TIMESTAMP_NTZ '{year}-01-01 00:30:00', TIMESTAMP_NTZ '{year + 1}-01-01 00:00:00', INTERVAL 30 MINUTES)) AS ts")


def readings(ids: DataFrame, year: int = 2023) -> DataFrame:
    """PUPRN, ts, eff_date, half-hour 1..48, electricity, gas, temperature and solar for a year of each household."""
    spark = ids.sparkSession
    grid = F.broadcast(half_hours(spark, year))  # 17,520 rows, whatever the number of households
    x = ids.crossJoin(grid)
    p, ts = F.col("PUPRN"), F.col("ts")
    hour = F.hour(ts) + F.minute(ts) / 60
    season = F.cos(2 * math.pi * (F.dayofyear(ts) - 15) / 365)
    day = F.when((hour >= 17) & (hour < 22), 1.8).when((hour >= 6) & (hour < 9), 1.4).when(hour < 6, 0.5).otherwise(1.0)
    base = 100 + 200 * uniform(p, F.lit("base"))
    elec = F.greatest(F.lit(0.0), base * day * (1 + 0.3 * season) * (1 + 0.3 * normal(p, ts, F.lit("e"))))
    elec = F.when(uniform(p, ts, F.lit("spike")) < 0.02, 500 + 1500 * uniform(p, ts, F.lit("height"))).otherwise(elec)
    gas = F.greatest(F.lit(0.0), 800 * F.greatest(season, F.lit(0.0)) * day * (1 + 0.4 * normal(p, ts, F.lit("g"))))
    summer = F.month(ts).isin(6, 7, 8)
    gas = F.when(summer, F.when(uniform(p, ts, F.lit("hot")) < 0.15, 50 + 250 * uniform(p, ts, F.lit("w"))).otherwise(0.0)).otherwise(gas)
    temp = 10 - 7 * season + 4 * F.sin(2 * math.pi * (hour - 9) / 24) + normal(ts, F.lit("t"))
    solar = F.greatest(F.lit(0.0), 600 * (1 - 0.6 * season) * F.sin(math.pi * (hour - 6) / 12))
    return x.select(
        "PUPRN", "ts", F.to_date(ts - F.expr("INTERVAL 30 MINUTES")).alias("eff_date"), (F.pmod(F.hour(ts) * 2 + F.floor(F.minute(ts) / 30) - 1, F.lit(48)) + 1).cast("int").alias("half_hour"),
        F.round(elec, 1).alias("electricity"), F.round(gas, 1).alias("gas"), F.round(temp, 1).alias("temp_c"), F.round(solar, 1).alias("solar"),
    )
