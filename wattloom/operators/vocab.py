"""Value vocabularies: histograms, boundaries, bin means, tokens and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_even, restored, transformed


def histogram(df: DataFrame, value: str = "value", by: tuple[str, ...] = (), transform: str = "none", zeros_apart: bool = False) -> DataFrame:
    """(by..., v, n): counts of values rounded to 0.1, or of the transformed value. zeros_apart leaves exact zeros out."""
    v = transformed(half_even(F.col(value), 1), transform) if transform != "none" else half_even(F.col(value), 1)
    out = df.where(F.col(value).isNotNull()).select(*by, v.alias("v"))
    if zeros_apart:
        out = out.where(F.col("v") != 0)
    return out.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))


def cumulative(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """hist with cdf and total. The window is over distinct values of a group, not over rows."""
    w = Window.partitionBy(*by).orderBy("v") if by else Window.partitionBy(F.lit(0)).orderBy("v")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return hist.select("*", F.sum("n").over(w).alias("cdf"), F.sum("n").over(whole).alias("total"))


def quantile_boundaries(hist: DataFrame, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., i, boundary), i = 1..bins - 1: the first value whose cdf reaches i / bins of the total."""
    c = cumulative(hist, by)
    w = Window.partitionBy(*by).orderBy("v") if by else Window.partitionBy(F.lit(0)).orderBy("v")
    before = F.coalesce(F.lag("cdf").over(w), F.lit(0))
    first = F.floor(before * bins / F.col("total")) + 1  # boundaries above the previous cdf ...
    last = F.least(F.floor(F.col("cdf") * bins / F.col("total")), F.lit(bins - 1))  # ... up to this one
    rows = c.withColumns({"_a": first.cast("int"), "_b": last.cast("int")}).where(F.col("_a") <= F.col("_b"))
    return rows.select(*by, F.explode(F.sequence("_a", "_b")).alias("i"), F.col("v").alias("boundary"))


def uniform_boundaries(hist: DataFrame, bins: int, low: float = 0.0, percentile: float = 99.5, high: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Equal steps from low to the clip (absolute, or a percentile from the cdf); quantile boundaries if that is not above low."""
    c = cumulative(hist, by)
    top = F.lit(high) if high is not None else F.min(F.when(F.col("cdf") >= F.col("total") * percentile / 100, F.col("v")))
    clip = c.groupBy(*by).agg(top.alias("hi"))
    grid = clip.where(F.col("hi") > low).select(*by, "hi", F.explode(F.sequence(F.lit(1), F.lit(bins - 1))).alias("i"))
    even = grid.select(*by, "i", (F.lit(low) + (F.col("hi") - low) / bins * F.col("i")).alias("boundary"))
    flat = clip.where(~(F.col("hi") > low)).drop("hi")
    rest = hist.join(flat, list(by), "left_semi") if by else hist.crossJoin(flat)
    return even.unionByName(quantile_boundaries(rest, bins, by))


def boundary_lists(boundaries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., boundaries): one sorted array a group; its length is the number of bins less one."""
    return boundaries.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "boundary"))), lambda x: x["boundary"]).alias("boundaries"))


def encode(v: Column, boundaries: Column, zero_aware: bool = False, transform: str = "none") -> Column:
    """Token of a value: how many boundaries lie below it (left rule); zero-aware vocabularies keep token 0 for exact zero.

    Null and NaN give the missing token, as does an empty list of boundaries."""
    r = half_even(v, 1)
    x = transformed(r, transform)
    at = F.size(F.filter(boundaries, lambda b: b < x))
    missing = F.size(boundaries) + (2 if zero_aware else 1)
    token = F.when(r == 0, F.lit(0)).otherwise(at + 1) if zero_aware else at
    return F.when(v.isNull() | F.isnan(v) | (F.size(boundaries) == 0), missing).otherwise(token).cast("int")


def layout(boundaries: Column, zero_aware: bool = False) -> dict[str, Column]:
    """bins, missing, sos and size of a vocabulary."""
    bins = F.size(boundaries) + (2 if zero_aware else 1)
    return {"bins": bins, "missing": bins, "sos": bins + 1, "size": bins + 2}


def is_special(token: Column, boundaries: Column, zero_aware: bool = False) -> Column:
    return token >= layout(boundaries, zero_aware)["bins"]


def is_value(token: Column, boundaries: Column, zero_aware: bool = False) -> Column:
    return (token >= 0) & (token < layout(boundaries, zero_aware)["bins"])


def _middle(k: Column, boundaries: Column) -> Column:
    """First or last boundary for the outer bins, else the midpoint."""
    n = F.size(boundaries)
    get = lambda i: F.try_element_at(boundaries, i)
    return F.when(k <= 0, get(F.lit(1))).when(k >= n, get(n)).otherwise((get(k) + get(k + 1)) / 2)


def decode(token: Column, boundaries: Column, means: Column | None = None, zero_aware: bool = False, transform: str = "none") -> Column:
    """Value of a token: its bin mean, else the middle of its bin; special and unknown tokens give null."""
    k = token - 1 if zero_aware else token
    value = _middle(k, boundaries)
    if means is not None:
        value = F.coalesce(F.try_element_at(means, k + 1), value)
    value = restored(value, transform)
    if zero_aware:
        value = F.when(token == 0, F.lit(0.0)).otherwise(value)
    return F.when(is_value(token, boundaries, zero_aware), value)


def bin_means(hist: DataFrame, lists: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., bin_means): count-weighted mean of each bin, the middle of the bin where it is empty."""
    h = hist.join(lists, list(by)) if by else hist.crossJoin(F.broadcast(lists))
    k = F.size(F.filter("boundaries", lambda b: b < F.col("v")))
    m = h.select(*by, k.alias("k"), "v", "n").groupBy(*by, "k").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m"))
    grid = lists.select(*by, "boundaries", F.explode(F.sequence(F.lit(0), F.size("boundaries"))).alias("k"))
    full = grid.join(m, [*by, "k"], "left").select(*by, "k", F.coalesce("m", _middle(F.col("k"), F.col("boundaries"))).alias("m"))
    return full.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("bin_means"))


def build(df: DataFrame, bins: dict[str, int], modality: str = "modality", value: str = "value", zero_aware: tuple[str, ...] = ("gas",), transform: str = "none", binning: str = "quantile", **clip) -> DataFrame:
    """Vocabulary table of a long (modality, value) frame: modality, boundaries, bin_means, zero_aware, value_transform."""
    out = None
    for name, n in bins.items():
        zero = name in zero_aware
        kind = transform if name in ("electricity", "gas") else "none"
        own = df.where(F.col(modality) == name)
        hist = histogram(own, value, (), kind, zero)
        edges = quantile_boundaries(hist, n) if binning == "quantile" else uniform_boundaries(hist, n, **clip)
        lists = boundary_lists(edges)
        row = lists.crossJoin(F.broadcast(bin_means(hist, lists))).select(F.lit(name).alias("modality"), "boundaries", "bin_means", F.lit(zero).alias("zero_aware"), F.lit(kind).alias("value_transform"))
        out = row if out is None else out.unionByName(row)
    return out


def categories(df: DataFrame, variable: str, mask: bool = False) -> DataFrame:
    """(variable, value, token): sorted distinct values as 0..m-1, with a last mask token if asked for."""
    values = df.select(F.col(variable).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    out = values.select(F.lit(variable).alias("variable"), "value", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("value")) - 1).alias("token"))
    if mask:
        out = out.unionByName(values.agg(F.count(F.lit(1)).cast("int").alias("token")).select(F.lit(variable).alias("variable"), F.lit(None).cast("string").alias("value"), "token"))
    return out


def encode_category(df: DataFrame, dictionary: DataFrame, variable: str) -> DataFrame:
    d = dictionary.where((F.col("variable") == variable) & F.col("value").isNotNull()).select(F.col("value").alias("_v"), F.col("token").alias(f"{variable}_token"))
    return df.join(F.broadcast(d), F.col(variable).cast("string") == F.col("_v"), "left").drop("_v")  # a survey's categories


def decode_category(df: DataFrame, dictionary: DataFrame, variable: str) -> DataFrame:
    d = dictionary.where(F.col("variable") == variable).select(F.col("token").alias("_t"), F.col("value").alias(variable))
    return df.join(F.broadcast(d), F.col(f"{variable}_token") == F.col("_t"), "left").drop("_t")


def boolean_token(x: Column) -> Column:
    return F.coalesce(x.cast("int"), F.lit(2))


def floor_area_boundaries(df: DataFrame, column: str = "total_floor_area", bins: int = 10) -> DataFrame:
    hist = df.where(F.col(column).isNotNull()).groupBy(F.bround(column, 0).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return boundary_lists(quantile_boundaries(hist, bins))


def calendar_tokens(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns({"hh": (F.hour(ts) * 2 + F.floor(F.minute(ts) / 30) + 1).cast("int"), "dow": F.weekday(ts), "month": F.month(ts)})


def calendar_values(hh: Column, dow: Column, month: Column) -> tuple[Column, Column, Column]:
    """Special calendar tokens (half-hour 0, weekday 7, month 0) become null."""
    return F.nullif(hh, F.lit(0)), F.nullif(dow, F.lit(7)), F.nullif(month, F.lit(0))


# other rules for placing a value in a bin


def bin_right(v: Column, edges: Column) -> Column:
    """Evaluation rule A: edges at or below the value, less one, from 0; as many bins as edges."""
    return F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e <= v)) - 1)


def bin_inner(v: Column, edges: Column, transform: str = "none") -> Column:
    """Evaluation rule B: inner edges at or below the value; one bin less than edges."""
    x = transformed(v, transform)
    return F.size(F.filter(F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0))), lambda e: e <= x))


def edge_view(edges: Column, transform: str = "none") -> tuple[Column, Column, Column]:
    """Edges in units, centres and widths of the bins between them."""
    e = F.transform(edges, lambda x: restored(x, transform))
    lo, hi = F.slice(e, F.lit(1), F.size(e) - 1), F.slice(e, F.lit(2), F.size(e) - 1)
    return e, F.zip_with(lo, hi, lambda a, b: (a + b) / 2), F.zip_with(lo, hi, lambda a, b: b - a)


def equal_width(df: DataFrame, value: str, low: Column | float, high: Column | float, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., bin 1..bins, n, density): values outside [low, high] are left out, high itself is in the last bin."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    at = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)) + 1, F.lit(bins)).cast("int")
    rows = df.where((F.col(value) >= lo) & (F.col(value) <= hi)).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy(*by).agg(F.sum("n").alias("_t"))
    out = rows.join(total, list(by)) if by else rows.crossJoin(F.broadcast(total))
    return out.select(*by, "bin", "n", (F.col("n") / (F.col("_t") * ((hi - lo) / bins))).alias("density"))
