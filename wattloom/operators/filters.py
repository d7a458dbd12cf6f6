"""Household filters, catalog clean-up and stage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed categories of the survey's codes.
BUILDING = {1: "Detached", 2: "Semi-detached", 3: "Terraced", 4: "Flat/tenement"}
AGE_BUILT = {1: "Before 1900", 2: "1900-1929", 3: "1930-1949", 4: "1950-1975", 5: "1976-1990", 6: "1991-2002", 7: "2003 onwards"}
TENURE = {1: "Owner occupier", 2: "Shared ownership", 3: "Private rented", 4: "Social rented", 5: "Rent free"}
MANAGING = {1: "Living comfortably", 2: "Doing alright", 3: "Just about getting by", 4: "Finding it quite difficult", 5: "Finding it very difficult"}
HAS_EV = {-1: "Don't know", 1: "Has EV", 2: "No EV"}
HEATING = [(("A301",), "No central heating"), (("A302",), "Gas central heating"), (("A303", "A304", "A305"), "Electric heating"), (("A306", "A307", "A308", "A309", "A310"), "Other heating")]


def missingness(readings: DataFrame, *keys: str) -> DataFrame:
    """Share of null values and mean of the rest by keys (household and fuel by default)."""
    return readings.groupBy(*(keys or ("household_id", "fuel"))).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("value").isNull().cast("int")).alias("missing"), F.avg("value").alias("mean")
    )


def attach_missingness(catalog: DataFrame, readings: DataFrame, fuels: tuple[str, ...] = ("electricity", "gas")) -> DataFrame:
    """catalog with <fuel>_missing and <fuel>_mean; a household or fuel without rows is missing entirely."""
    m = readings.groupBy("household_id").agg(*[
        x for f in fuels for x in (
            F.avg(F.when(F.col("fuel") == f, F.col("value").isNull().cast("int"))).alias(f"{f}_missing"),
            F.avg(F.when(F.col("fuel") == f, F.col("value"))).alias(f"{f}_mean"),
        )
    ])
    out = catalog.join(m, "household_id", "left")
    return out.withColumns({f"{f}_missing": F.coalesce(f"{f}_missing", F.lit(1.0)) for f in fuels})


def without_exporters(catalog: DataFrame, exporters: DataFrame) -> DataFrame:
    return catalog.join(exporters.select(F.col("puprn").alias("household_id")), "household_id", "left_anti")


def complete(fuels: tuple[str, ...] = ("electricity", "gas"), limit: float = 0.2) -> Column:
    """Every fuel strictly under the limit."""
    out = F.lit(True)
    for f in fuels:
        out = out & (F.col(f"{f}_missing") < limit)
    return out


def valid_context(b5: str = "B5_err", a3: str = "A3_err", a1: str = "A1_err") -> Column:
    """No error flag set; a null follow-up flag is no error."""
    return ~F.col(b5) & ~F.col(a3) & ~F.coalesce(F.col(a1), F.lit(False))


def negative_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in columns})


def staged(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """df with _stage: how many of the stages, in order, a row passes before the first it fails."""
    passed, out = F.lit(True), F.lit(0)
    for test in stages.values():
        passed = passed & F.coalesce(test, F.lit(False))
        out = out + passed.cast("int")
    return df.withColumn("_stage", out)


def stage_report(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """stage, position, n, removed, pct (of the first stage's input): one pass over df."""
    counts = staged(df, stages).agg(F.count(F.lit(1)).alias("n0"), *[F.count_if(F.col("_stage") > i).alias(f"n{i + 1}") for i in range(len(stages))])
    rows = F.array(*[
        F.struct(F.lit(name).alias("stage"), F.lit(i + 1).alias("position"), F.col(f"n{i + 1}").alias("n"), (F.col(f"n{i}") - F.col(f"n{i + 1}")).alias("removed"),
                 F.round(100 * F.try_divide(F.col(f"n{i + 1}"), F.col("n0")), 4).alias("pct"))
        for i, name in enumerate(stages)
    ])
    return counts.select(F.inline(rows))


def passing(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    return staged(df, stages).where(F.col("_stage") == len(stages)).drop("_stage")


def merged_region(region: Column) -> Column:
    return F.when(region.isin("NORTH EAST", "NORTH WEST"), "NORTH").otherwise(region)


def bucket(x: Column, low: int | None = None, high: int | None = None) -> Column:
    """Text categories: up to low as "1-low", from high as "high+", the numbers between as they are."""
    out = F.when(x <= low, f"1-{low}") if low is not None else None
    if high is not None:
        out = out.when(x >= high, f"{high}+") if out is not None else F.when(x >= high, f"{high}+")
    return out.otherwise(x.cast("int").cast("string"))


def coded(x: Column, names: dict[int, str], above: tuple[int, str] | None = None) -> Column:
    """Category of a code; "Unknown" for the rest and null. above: (code, name) for that code and any larger."""
    out = None
    for k, v in names.items():
        out = F.when(x == k, v) if out is None else out.when(x == k, v)
    if above:
        out = out.when(x >= above[0], above[1])
    return out.otherwise("Unknown")


def heating_type() -> Column:
    """First match in HEATING's order."""
    out = None
    for columns, name in HEATING:
        test = F.lit(False)
        for c in columns:
            test = test | F.coalesce(F.col(c) == 1, F.lit(False))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("Unknown")


def context_variables(catalog: DataFrame) -> DataFrame:
    """The catalog's conditioning variables by their logical names."""
    return catalog.select(
        F.col("PUPRN").alias("household_id"), merged_region(F.col("Region")).alias("region"), F.col("IMD_quintile").alias("imd"), heating_type().alias("heating_type"),
        bucket(F.col("B5"), 3, 9).alias("num_rooms"), bucket(F.col("C1_new"), None, 5).alias("num_occs"), F.col("totalFloorArea").alias("total_floor_area"),
        F.col("currentEnergyRating").alias("epc_rating"), coded(F.col("B1"), BUILDING, (5, "Other")).alias("building_type"), coded(F.col("B9"), AGE_BUILT).alias("age_built"),
        coded(F.col("B4"), TENURE).alias("tenure"), coded(F.col("D4"), MANAGING).alias("managing_financially"), coded(F.col("C5"), HAS_EV).alias("has_ev"), F.col("is_exporter").alias("has_pv"),
    )


def filter_households(catalog: DataFrame, variables: list[str], k: int, limit: float = 0.2, exporter: str = "has_pv") -> tuple[DataFrame, DataFrame]:
    """(catalog that stays with k_group_size, stage report): no exporter, complete, all variables known, groups of k."""
    known = F.lit(True)
    for v in variables:
        known = known & F.col(v).isNotNull()
    first = {"not_exporter": ~F.coalesce(F.col(exporter), F.lit(False)), "complete": complete(limit=limit), "known": known}
    kept = passing(catalog, first)
    sizes = kept.groupBy(*variables).agg(F.count(F.lit(1)).alias("k_group_size"))
    out = catalog.join(sizes, variables, "left")
    stages = first | {"k_group": F.col("k_group_size") >= k}
    return passing(out, stages), stage_report(out, stages)


def category_report(df: DataFrame, variables: list[str]) -> DataFrame:
    """variable, value, n, pct: value counts of each variable."""
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("value")) for v in variables]))
    counts = df.select(rows.alias("_r")).select("_r.*").groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("variable").agg(F.sum("n").alias("total"))
    return counts.join(totals, "variable").select("variable", "value", "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("pct"))
