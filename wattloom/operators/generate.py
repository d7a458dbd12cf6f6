"""Generation of synthetic token series of two fuels from counts of joint transitions.

The model is a table: for each context and pair of last tokens (one of each fuel), how often each token followed. What a sequence
needs of it is what belongs to its constant context, so sequences, dealt into parts of bounded size, meet their slice of the
model in cogroups; the model is never whole in one place, and a slice is bounded by the vocabulary.

Each step draws both fuels by inverse CDF. Special tokens are never drawn. A state that was never seen backs off to the fuel's
own last token in the step's context, then to the step's context alone, then to all tokens alike. Draws are hashes of
(sample, month, position, fuel, seed), so a lost task repeats them and SQL could."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import blocks

#: Sequences of a part.
PART = 500
FUELS = ("elec", "gas")


def joint_transitions(tokens: DataFrame, context: list[str], inner: list[str], key: list[str], order: str = "ts") -> DataFrame:
    """(context..., inner..., fuel, prev_elec, prev_gas, next, n): how often each token of a fuel followed a pair of last tokens.

    tokens: elec and gas, a row a step. Steps with a null token of either fuel give no transition, nor do those after one."""
    w = Window.partitionBy(*key).orderBy(order)
    rows = tokens.select(*dict.fromkeys(context + inner), "elec", "gas", *[F.lag(f).over(w).alias(f"prev_{f}") for f in FUELS])
    rows = rows.where("elec is not null and gas is not null and prev_elec is not null and prev_gas is not null")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("fuel"), F.col(f).alias("next")) for f in FUELS]))
    long = rows.select(*context, *inner, "prev_elec", "prev_gas", each.alias("_x")).select(*context, *inner, "prev_elec", "prev_gas", "_x.*")
    return long.groupBy(*context, *inner, "fuel", "prev_elec", "prev_gas", "next").agg(F.count(F.lit(1)).alias("n"))


def draw(*parts) -> float:
    """A number in [0, 1) from the MD5 of the parts joined by ':'."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16) / 2.0**48


class Tables:
    """One slice of the model: sampling weights of a fuel by state, with back-off."""

    def __init__(self, rows: pd.DataFrame, inner: list[str], bins: dict[str, int], temperature: float):
        self.bins, self.temperature = bins, temperature
        self.levels: list[dict] = [defaultdict(lambda: defaultdict(int)) for _ in range(3)]
        self.known: dict[tuple, np.ndarray] = {}
        columns = [rows[c] for c in (*inner, "fuel", "prev_elec", "prev_gas", "next", "n")]
        for *at, fuel, elec, gas, following, n in zip(*columns):
            if 0 <= following < bins[fuel]:  # special tokens lie beyond the bins
                for level, state in enumerate(self.states(tuple(at), fuel, elec, gas)):
                    self.levels[level][state][int(following)] += int(n)

    @staticmethod
    def states(at: tuple, fuel: str, elec: int, gas: int) -> tuple:
        return (at, fuel, elec, gas), (at, fuel, elec if fuel == "elec" else gas), (at, fuel)

    def cdf(self, at: tuple, fuel: str, elec: int, gas: int) -> np.ndarray:
        for level, state in enumerate(self.states(at, fuel, elec, gas)):
            if state in self.levels[level]:
                if (level, state) not in self.known:
                    p = np.zeros(self.bins[fuel])
                    for token, n in self.levels[level][state].items():
                        p[token] = n ** (1 / self.temperature)
                    self.known[level, state] = np.cumsum(p / p.sum())
                return self.known[level, state]
        return np.arange(1, self.bins[fuel] + 1) / self.bins[fuel]


def generate(
    steps: DataFrame, model: DataFrame, context: list[str], inner: list[str], bins: dict[str, int], start: dict[str, int] | None = None,
    temperature: float = 1.0, seed: int = 42, part: int = PART,
) -> DataFrame:
    """steps(sample_id, month, pos, context..., inner..., ...) with the columns elec and gas.

    context: columns that are constant within a sequence (a sample's month) and by which steps meet the model; inner: those that
    change along it. A sequence begins from the tokens of start (0 unless given); months are independent of each other. Sequences
    whose context the model doesn't hold draw all tokens alike. Columns of steps pass through."""
    first = start or dict.fromkeys(FUELS, 0)
    keys = context or ["_all"]
    steps, model = (df if context else df.withColumn("_all", F.lit(0)) for df in (steps, model))
    sizes = steps.groupBy(*keys).agg(F.count_distinct("sample_id", "month").alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / part).cast("int")).drop("_n")
    dealt = steps.join(sizes, keys).withColumn("_part", F.pmod(F.xxhash64("sample_id", "month"), F.col("_parts"))).drop("_parts")
    slices = model.join(sizes, keys).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - F.lit(1).cast("long")))).drop("_parts")
    slices = slices.select(*[F.col(c).alias(c) for c in slices.columns])  # columns of its own, should both come from one table
    names = [c for c in dealt.columns if c not in ("_part", "_all")]
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", elec int, gas int"

    def run(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        tables, out = Tables(rows, inner, bins, temperature), []
        own = own.sort_values(["sample_id", "month", "pos"])
        for (sample, month), sequence in own.groupby(["sample_id", "month"], sort=False, dropna=False):
            last = dict(first)
            inside = zip(*(sequence[c] for c in inner)) if inner else [()] * len(sequence)
            for pos, at in zip(sequence["pos"], inside):
                drawn = {}
                for fuel in FUELS:
                    u, cdf = draw(sample, month, pos, fuel, seed), tables.cdf(tuple(at), fuel, last["elec"], last["gas"])
                    drawn[fuel] = int(min(np.searchsorted(cdf, u, side="right"), bins[fuel] - 1))
                last = drawn
                out.append((drawn["elec"], drawn["gas"]))
        drawn = np.array(out, np.int32).reshape(-1, 2)
        return own[names].assign(elec=drawn[:, 0], gas=drawn[:, 1])

    return dealt.groupBy(*keys, "_part").cogroup(slices.groupBy(*keys, "_part")).applyInPandas(run, schema)


def values_of(series: DataFrame, means: DataFrame) -> DataFrame:
    """(sample_id, month, pos, fuel, token, value): tokens of both fuels as the means(fuel, token, value) of their bins."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("fuel"), F.col(f).alias("token")) for f in FUELS]))
    long = series.select("sample_id", "month", "pos", each.alias("_x")).select("sample_id", "month", "pos", "_x.*")
    return long.join(F.broadcast(means.select("fuel", "token", "value")), ["fuel", "token"], "left").select("sample_id", "month", "pos", "fuel", "token", "value")  # a row a bin


def month_steps(weather: DataFrame, samples: DataFrame) -> DataFrame:
    """A row for each sample and half-hour of its template household: (sample_id, month, pos, ...)."""
    rows = samples.join(weather, samples["template_id"] == weather["household_id"]).drop("household_id")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("sample_id", "month").orderBy("ts")) - 1)


def batches(series: DataFrame, size: int) -> DataFrame:
    """series with batch_id: samples in batches of about `size`, by hash."""
    n = blocks(series.select("sample_id").distinct().count(), size)
    return series.withColumn("batch_id", F.pmod(F.xxhash64("sample_id"), F.lit(n)))


def run_summary(series: DataFrame, samples: DataFrame) -> DataFrame:
    """sample_id, months and steps generated, and whether the sample failed (no step of it came out)."""
    made = series.groupBy("sample_id").agg(F.count_distinct("month").alias("months"), F.count(F.lit(1)).alias("steps"))
    out = samples.select("sample_id").distinct().join(made, "sample_id", "left").fillna(0, ["months", "steps"])
    return out.withColumn("failed", F.col("steps") == 0)
