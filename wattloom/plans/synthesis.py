"""A whole generation run: sample households, pair them with templates, generate both fuels by month, write batches, sum up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import generate, splits
from ..operators.pairs import hash_bits
from ..operators.shared import stored


def samples_of(pool: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(sample_id, household_id, ...): n rows of pool(household_id, ...) in hash order; where it has fewer, copies of them follow,
    so that sample_id, household and copy joined by '-', is unique."""
    have = pool.count()
    times = max(1, -(-n // max(have, 1)))
    copies = pool.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    chosen = copies.orderBy("_copy", hash_bits("household_id", seed=seed), "household_id").limit(n)
    return chosen.withColumn("sample_id", F.concat_ws("-", "household_id", "_copy")).select("sample_id", *pool.columns)


def run(
    pool: DataFrame, tokens: DataFrame, weather: DataFrame, means: DataFrame, n: int, bins: dict[str, int], context: list[str], inner: list[str],
    batch: int = 10, temperature: float = 1.0, seed: int = 42, order: str = "ts",
) -> dict[str, DataFrame]:
    """samples (with template_id), series (tokens by sample, month and position, with batch_id), values and summary.

    pool: households to sample, with those columns of context that are theirs; tokens: elec and gas of the households to learn
    from, with context and inner; weather: steps (household_id, month, ts, ...) of template households, with the other columns of
    context and inner. Special tokens lie beyond the bins and are never drawn. The series is stored once."""
    samples = splits.templates(samples_of(pool, n, seed), weather.select("household_id"), seed=seed)
    samples = stored(samples, "samples")
    steps = generate.month_steps(weather.withColumnRenamed(order, "ts"), samples.drop("household_id"))
    model = generate.joint_transitions(tokens, context, inner, ["household_id"], order)
    series = generate.generate(steps, model, context, inner, bins, temperature=temperature, seed=seed)
    series = stored(generate.batches(series, batch), "series")
    return {"samples": samples, "series": series, "values": generate.values_of(series, means), "summary": generate.run_summary(series, samples)}


def write(made: dict[str, DataFrame], path: str) -> None:
    """values by batch and month, samples and summary, as Parquet below path."""
    batch = made["series"].select("sample_id", "batch_id").distinct()
    made["values"].join(batch, "sample_id").write.mode("overwrite").partitionBy("batch_id", "month").parquet(f"{path}/values")
    for name in ("samples", "summary"):
        made[name].write.mode("overwrite").parquet(f"{path}/{name}")
