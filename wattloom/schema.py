"""Tables of the engine and the rules that hold for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One row for each household, fuel and half-hour.
READINGS = "household_id string, split string, ts timestamp_ntz, month int, dow int, half_hour int, fuel string, value double, temp_c double, solar double"
#: Household dimension files: participant summary, EPC (used fields), survey, follow-up survey, exporter list.
PARTICIPANT = "PUPRN string, Region string, IMD_quintile int"
EPC = "PUPRN string, currentEnergyRating string, totalFloorArea double"
SURVEY = (
    "PUPRN string, Survey_version string, Recorded_date string, Collection_method string, Language string, A1 int, A2 int,"
    " B1 int, B4 int, B5 int, B9 int, C1 int, C1_new int, C5 int, D1 int, D2 int, D4 int, B5_err boolean, A301 int,"
    " A302 int, A303 int, A304 int, A305 int, A306 int, A307 int, A308 int, A309 int, A310 int, A3_Other int, A3_sum int,"
    " A301_edit int, A3_err boolean"
)
FOLLOW_UP = "PUPRN string, A1_corr_C double, A1_err boolean, B3_1_yes string, B3_4_yes string, C1 string, D4 string, D5 string"
FUELS = ("electricity", "gas")
SPLITS = ("synth", "train", "val", "test")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column: averages then skip it and counts leave it out."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def half_hour(ts: Column) -> Column:
    """1 to 48, counting from midnight."""
    return (F.hour(ts) * 2 + F.floor(F.minute(ts) / 30) + 1).cast("int")


def with_calendar(df: DataFrame, ts: str = "ts", effective: bool = False) -> DataFrame:
    """month, dow (0 = Monday) and half_hour from the time stamp; effective: from the day a 00:00 reading closes."""
    day = F.to_date(F.col(ts) - F.expr("INTERVAL 30 MINUTES")) if effective else F.to_date(ts)
    return df.withColumns({"month": F.month(day), "dow": F.weekday(day), "half_hour": half_hour(F.col(ts))})


def effective_date(ts: Column) -> Column:
    """A reading stamped 00:00 belongs to the day before."""
    return F.to_date(ts - F.expr("INTERVAL 30 MINUTES"))


def half_hour_label(hh: Column) -> Column:
    """HH:MM of a 0-based half-hour."""
    return F.format_string("%02d:%02d", F.floor(hh / 2).cast("int"), (F.pmod(hh, F.lit(2)) * 30).cast("int"))
