"""Readers: the driver's tables and the model's own files as readings and household dimensions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EPC, FOLLOW_UP, PARTICIPANT, SURVEY, half_hour, nan_to_null


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def split_of(household: Column) -> Column:
    """Split by the id's remainder, in a form that SQL engines share."""
    r = household % 4
    return F.when(r == 0, "synth").when(r == 1, "train").when(r == 2, "val").otherwise("test")


def event_readings(spark: SparkSession, folder: str) -> DataFrame:
    """events as irregular readings: household = user, fuel = event type, batch = tens of users."""
    e = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.col("user_id").alias("household_id"), split_of(F.col("user_id")).alias("split"), F.floor(F.col("user_id") / 10).alias("batch_id"),
        "event_id", "ts", F.month("ts").alias("month"), F.weekday("ts").alias("dow"), half_hour(F.col("ts")).alias("half_hour"),
        F.col("event_type").alias("fuel"), "value",
    )


def line_readings(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as monthly readings: household = supplier, fuel = return flag; discount is the value with true zeros."""
    x = table(spark, folder, "lineitem")
    return x.select(
        F.col("l_suppkey").alias("household_id"), split_of(F.col("l_suppkey")).alias("split"), F.col("l_returnflag").alias("fuel"),
        F.month("l_shipdate").alias("month"), F.weekday("l_shipdate").alias("dow"), "l_shipdate", "l_orderkey", "l_linenumber",
        F.col("l_quantity").alias("value"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("zero_value"), F.col("l_tax").alias("tax"),
    )


def household_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """customer with its nation and region as the household dimension."""
    c, n, r = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    out = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select(
        F.col("c_custkey").alias("household_id"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"), F.col("c_acctbal").alias("balance"), split_of(F.col("c_custkey")).alias("split"),
    )


# the model's own files


def readings(spark: SparkSession, path: str, columns: list[str] | None = None, households: DataFrame | None = None, split: str | None = None) -> DataFrame:
    """Stored readings (parquet, partitioned by split), pruned to columns, households and split."""
    out = nan_to_null(spark.read.parquet(path))
    if split is not None:
        out = out.where(F.col("split") == split)
    if households is not None:
        out = out.join(households.select("household_id").distinct(), "household_id", "left_semi")
    return out.select(*columns) if columns else out


#: Names of files that hold no household; fixed values.
OTHER_FILES = ("metadata", "catalog", "summary", "conditioning")


def household_files(spark: SparkSession, folder: str, schema: str, patterns: tuple[str, ...] = ("*_tokenised.parquet", "*.parquet")) -> DataFrame:
    """Readings stored a file a household: those of the first pattern that any file of a household matches, with household_id
    from the file's name unless the schema has it. Spark prunes the files by their names; none of the others is opened."""
    file = F.lower(F.col("_metadata.file_name"))
    for pattern in patterns:
        df = spark.read.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
        df = df.where(~file.rlike("|".join(OTHER_FILES)))
        if df.select("_metadata.file_name").limit(1).count():
            break
    if "household_id" not in df.columns:
        df = df.withColumn("household_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(_tokenised)?\.parquet$", 1))
    return nan_to_null(df)


def listed(readings: DataFrame, households: DataFrame, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(readings of the listed households only, listed households without readings).

    A list of at most `most` ids becomes a filter: a table partitioned by household reads those partitions only. A longer one is
    joined."""
    ids = households.select("household_id").where("household_id is not null").distinct()
    few = [r[0] for r in ids.limit(most + 1).collect()]
    own = readings.where(F.col("household_id").isin(few)) if len(few) <= most else readings.join(ids, "household_id", "left_semi")
    return own, ids.join(own.select("household_id"), "household_id", "left_anti")


def household_list(spark: SparkSession, path: str) -> DataFrame | None:
    """The households of the vocabulary at path; None where none were stored with it (all are used then)."""
    try:
        return spark.read.parquet(f"{path.rstrip('/')}_households")
    except AnalysisException:
        return None


def some_households(df: DataFrame, n: int | None, seed: int = 42, key: str = "household_id") -> DataFrame:
    """The readings of n households chosen by a seeded hash: the same ones whatever the order of files."""
    if n is None:
        return df
    ids = df.select(key).distinct().orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
    return df.join(ids, key, "left_semi")


def csv_table(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    return nan_to_null(spark.read.csv(path, header=True, schema=schema, encoding=encoding, enforceSchema=False))


def metadata_files(spark: SparkSession, survey: str, epc: str, participant: str, follow_up: str, exporters: str) -> DataFrame:
    """The catalog: survey inner participant, left EPC, left follow-up (clashes get _fu), exporter flag."""
    s, e, p = csv_table(spark, survey, SURVEY), csv_table(spark, epc, EPC), csv_table(spark, participant, PARTICIPANT)
    f = csv_table(spark, follow_up, FOLLOW_UP, "ISO-8859-1")
    return join_metadata(s, e, p, f, exporter_ids(spark, exporters))


def join_metadata(survey: DataFrame, epc: DataFrame, participant: DataFrame, follow_up: DataFrame, exporters: DataFrame, key: str = "PUPRN") -> DataFrame:
    out = participant.join(survey, key, "inner").join(epc, key, "left")
    clash = set(out.columns) & set(follow_up.columns) - {key}
    out = out.join(follow_up.select(*[F.col(c).alias(f"{c}_fu") if c in clash else F.col(c) for c in follow_up.columns]), key, "left")
    flag = exporters.select(F.col("puprn").alias(key)).distinct().withColumn("is_exporter", F.lit(True))
    return out.join(flag, key, "left").withColumn("is_exporter", F.coalesce("is_exporter", F.lit(False)))


def exporter_ids(spark: SparkSession, path: str) -> DataFrame:
    """The column puprn, else PUPRN, else the first. A missing file raises."""
    df = spark.read.option("caseSensitive", True).csv(path, header=True)
    name = next((c for c in ("puprn", "PUPRN") if c in df.columns), df.columns[0])
    return df.select(F.col(name).cast("string").alias("puprn")).where("puprn IS NOT NULL")


def metadata_view(catalog: DataFrame, columns: dict[str, str], key: str = "PUPRN") -> DataFrame:
    """Logical variables from catalog columns: {variable: column}."""
    return catalog.select(F.col(key).alias("household_id"), *[F.col(c).alias(v) for v, c in columns.items() if c in catalog.columns])


def synthetic_batches(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Synthetic readings stored by batch_id and month; whole-batch rows (month null) count only without month rows."""
    df = nan_to_null(spark.read.parquet(path))
    has = df.groupBy("batch_id").agg(F.max(F.col("file_month").isNotNull()).alias("has")) if "file_month" in df.columns else None
    if has is not None:
        df = df.join(F.broadcast(has), "batch_id").where(~F.col("has") | F.col("file_month").isNotNull()).drop("has")
    if limit is not None:
        df = df.join(df.select("batch_id").distinct().orderBy("batch_id").limit(limit), "batch_id", "left_semi")
    return df


def wide_to_long(df: DataFrame, keep: list[str], suffixes: dict[str, str] | None = None) -> DataFrame:
    """Columns <household>_<suffix> become rows (keep..., household_id, fuel, value)."""
    suffixes = suffixes or {"_elec_net_Wh": "electricity", "_gas_Wh": "gas"}
    found = [(c, c[: -len(s)], f) for c in df.columns for s, f in suffixes.items() if c.endswith(s)]
    pairs = F.explode(F.array(*[F.struct(F.lit(h).alias("household_id"), F.lit(f).alias("fuel"), F.col(c).cast("double").alias("value")) for c, h, f in found]))
    return df.select(*keep, pairs.alias("_r")).select(*keep, "_r.household_id", "_r.fuel", "_r.value")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Stored tokeniser: modality, boundaries, bin_means, zero_aware, value_transform; absent columns get defaults."""
    df = spark.read.parquet(path)
    defaults = {"bin_means": "CAST(NULL AS array<double>)", "zero_aware": "modality = 'gas'", "value_transform": "'none'", "binning": "'quantile'"}
    return df.select("*", *[F.expr(e).alias(c) for c, e in defaults.items() if c not in df.columns])


def bin_edges(vocab: DataFrame | None) -> dict[str, list[float]] | None:
    """{modality: edges of its bins} of a stored vocabulary, the outer ones infinite: a row a modality. None without one, or where
    it holds no boundaries: token analyses are left out then."""
    if vocab is None or "boundaries" not in vocab.columns:
        return None
    rows = vocab.where("boundaries is not null").select("modality", "boundaries").collect()
    return {r["modality"]: [float("-inf"), *r["boundaries"], float("inf")] for r in rows} or None


def survey_row(survey: DataFrame, household, columns: list[str] | None = None, key: str = "PUPRN") -> DataFrame:
    """The survey's columns of one household."""
    own = survey.where(F.col(key) == household)
    return own.select(key, *[c for c in columns if c != key]) if columns else own


def context_tuples(survey: DataFrame, assignment: DataFrame | None = None, split: str | None = None, columns: tuple[str, ...] = ("B5", "C1_new"), key: str = "PUPRN") -> DataFrame:
    """(household_id, columns...), unknown answers as 0; of one split, if named."""
    out = survey.select(F.col(key).alias("household_id"), *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in columns])
    if split is None:
        return out
    return out.join(assignment.where(F.col("split") == split).select("household_id"), "household_id", "left_semi")


def one_complete_household(df: DataFrame, limit: float, seed: int = 42) -> DataFrame:
    """Readings of one household whose every fuel is under the missingness limit, chosen by hash."""
    worst = df.groupBy("household_id", "fuel").agg(F.avg(F.col("value").isNull().cast("int")).alias("m")).groupBy("household_id").agg(F.max("m").alias("m"))
    pick = worst.where(F.col("m") < limit).orderBy(F.xxhash64("household_id", F.lit(seed)), "household_id").limit(1)
    return df.join(pick.select("household_id"), "household_id", "left_semi")
