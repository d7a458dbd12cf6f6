"""k-anonymity groups, k-aggregates, masked contexts, prefilters and disclosure control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import hash_bits
from .ranks import BROADCAST_ROWS
from .shared import stored


def k_groups(df: DataFrame, variables: list[str], k: int) -> DataFrame:
    """Tuples of known variables with their size and whether it reaches k."""
    return df.dropna(subset=variables).groupBy(*variables).agg(F.count(F.lit(1)).alias("size")).withColumn("qualifies", F.col("size") >= k)


def k_summary(df: DataFrame, variables: list[str], k: int) -> DataFrame:
    g = k_groups(df, variables, k)
    return g.agg(
        F.count(F.lit(1)).alias("groups"), F.count_if("qualifies").alias("qualifying"), F.sum("size").alias("households"),
        F.coalesce(F.sum(F.when(F.col("qualifies"), F.col("size"))), F.lit(0)).alias("kept"), F.min("size").alias("smallest"), F.max("size").alias("largest"),
        F.avg("size").alias("mean"), F.median("size").alias("median"),
    )


def k_members(df: DataFrame, variables: list[str], k: int) -> DataFrame:
    """Rows of qualifying groups with k_group_size."""
    return df.join(k_groups(df, variables, k).where("qualifies").select(*variables, F.col("size").alias("k_group_size")), variables)


def assert_k(df: DataFrame, variables: list[str], k: int) -> None:
    """Raises if a group is smaller than k."""
    least = df.groupBy(*variables).count().agg(F.min("count")).first()[0]
    if least is not None and least < k:
        raise ValueError(f"a group of {least} households is smaller than {k}")


def k_aggregates(readings: DataFrame, members: DataFrame, variables: list[str], k: int, method: str = "mean", most_groups: int | None = None, seed: int = 42) -> DataFrame:
    """Mean or median of k aligned households (nulls as 0) of each qualifying group; steps that not all k have are left out."""
    order = Window.partitionBy(*variables).orderBy(hash_bits("household_id", seed=seed), "household_id")  # Spark keeps k rows a task
    chosen = members.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    groups = members.groupBy(*variables).agg(F.count(F.lit(1)).alias("k_group_size")).where(F.col("k_group_size") >= k)
    if most_groups is not None:
        groups = groups.orderBy(*variables).limit(most_groups)
    chosen = chosen.select("household_id", *variables).join(groups, variables)
    value = F.coalesce("value", F.lit(0.0))
    out = readings.join(chosen, "household_id").groupBy(*variables, "k_group_size", "fuel", "ts").agg(
        (F.avg(value) if method == "mean" else F.median(value)).alias("value"), F.count_distinct("household_id").alias("_n")
    )
    return out.where(F.col("_n") == k).drop("_n")


def masked_contexts(df: DataFrame, fixed: list[str], others: list[str], k: int, augmentations: int = 1, seed: int = 42, key: str = "household_id") -> DataFrame:
    """One row for each household, augmentation and prefix of a hash-shuffled variable order whose group still has k rows.

    variables: the shown ones in order; var_count: how many; group_size: rows that share their values. The fixed variables
    come first in every order. Rows with a null in any variable take no part.

    The lattice of shown sets is climbed a variable at a time. A level holds the combinations of values (with their numbers)
    under the groups that some household has reached; those meet the variables that households of their group show next, are
    counted, and what is under k goes, with all that would have shown more."""
    every, spark = [*fixed, *others], df.sparkSession
    vs = F.col("_vs")
    base = df.dropna(subset=every).select(key, F.array(*[F.col(v).cast("string") for v in every]).alias("_vs"))
    combos = stored(base.groupBy("_vs").agg(F.count(F.lit(1)).alias("n")), "mask-combos")
    # a group is known by the bits of its shown variables and all values, hidden ones emptied
    own = F.array(*[vs[i] for i in range(len(fixed))], *[F.when(F.col("_mask").bitwiseAND(1 << i) != 0, vs[len(fixed) + i]).otherwise("") for i in range(len(others))])
    drawn = [F.struct(hash_bits(F.col(key), F.col("augmentation"), F.lit(v), seed=seed).alias("h"), F.lit(v).alias("v"), F.lit(i).alias("i")) for i, v in enumerate(others)]
    order = F.sort_array(F.array(*drawn))["i"] if others else F.array().cast("array<int>")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a file of a few MB is one task's, its orders are not
    rows = base.repartition(tasks, key).withColumn("augmentation", F.explode(F.sequence(F.lit(0), F.lit(augmentations - 1)))).withColumn("_order", order)
    level, reached, out = combos.withColumn("_mask", F.lit(0)).withColumn("_own", own), rows.withColumn("_mask", F.lit(0)), None
    grow = lambda i: F.col("_mask").bitwiseOR(F.element_at(F.array(*[F.lit(1 << x) for x in range(len(others))]), i + 1))
    for extra in range(len(others) + 1):
        sizes = stored(level.groupBy("_mask", "_own").agg(F.sum("n").alias("group_size")).where(F.col("group_size") >= k), "mask-sizes")
        few = F.broadcast if sizes.count() <= BROADCAST_ROWS else (lambda x: x)  # a few groups may hold all rows
        reached = stored(reached.withColumn("_own", own).join(few(sizes), ["_mask", "_own"]), "mask-reached")
        shown = [F.col("_order")[i] for i in range(extra)]
        here = reached.select(
            key, "augmentation", F.array(*[F.lit(v) for v in fixed], *[F.element_at(F.array(*[F.lit(v) for v in others]), i + 1) for i in shown]).cast("array<string>").alias("variables"),
            F.array(*[vs[i] for i in range(len(fixed))], *[F.element_at(vs, i + len(fixed) + 1) for i in shown]).cast("array<string>").alias("values"),
            F.lit(len(fixed) + extra).alias("var_count"), "group_size",
        )
        out = here if out is None else out.unionByName(here)
        if extra == len(others):
            break
        steps = reached.select("_mask", "_own", F.col("_order")[extra].alias("_next")).distinct()
        grown = level.join(steps, ["_mask", "_own"]).select("_vs", "n", grow(F.col("_next")).alias("_mask")).distinct()
        level = stored(grown.withColumn("_own", own), "mask-level")
        reached = reached.drop("_own", "group_size").withColumn("_mask", grow(F.col("_order")[extra]))
    return out


def best_contexts(masked: DataFrame, most: int | None = None, key: str = "household_id") -> DataFrame:
    """For each household and augmentation the row with the most variables, at most `most`."""
    if most is not None:
        masked = masked.where(F.col("var_count") <= most)
    rest = [c for c in masked.columns if c not in (key, "augmentation")]
    return masked.groupBy(key, "augmentation").agg(F.max_by(F.struct(*rest), "var_count").alias("_b")).select(key, "augmentation", "_b.*")


def split_contexts(tokenised: DataFrame, assignment: DataFrame, split: str) -> DataFrame:
    return tokenised.join(assignment.where(F.col("split") == split).select("household_id"), "household_id", "left_semi")


def prefilter(readings: DataFrame, exclusions: DataFrame, keys: tuple[str, ...] = ("batch_id", "household_id", "month")) -> tuple[DataFrame, DataFrame]:
    """(readings without the excluded keys, per batch: households fully and partly excluded, months emptied)."""
    mark = exclusions.select(*keys).distinct().withColumn("_x", F.lit(True))
    cells = readings.select(*keys).distinct().join(mark, list(keys), "left").withColumn("_x", F.coalesce("_x", F.lit(False)))
    homes = cells.groupBy("batch_id", "household_id").agg(F.min("_x").alias("full"), F.max("_x").alias("any"))
    months = cells.groupBy("batch_id", "month").agg(F.min("_x").alias("empty"))
    report = homes.groupBy("batch_id").agg(F.count(F.lit(1)).alias("households"), F.count_if("full").alias("fully_excluded"), F.count_if(F.col("any") & ~F.col("full")).alias("partly_excluded"))
    report = report.join(months.groupBy("batch_id").agg(F.count_if("empty").alias("months_emptied")), "batch_id")
    return readings.join(exclusions.select(*keys).distinct(), list(keys), "left_anti"), report


# disclosure control

#: Splits whose rows are about people.
REAL = ("train", "val", "test")


def round_ten(n: Column) -> Column:
    """To the nearest 10, halves to even tens; null stays."""
    return (F.bround(n / 10) * 10).cast("long")


def small_count(n: Column) -> Column:
    return F.coalesce((n > 0) & (n < 10), F.lit(False))


def rounded(df: DataFrame, counts: list[str]) -> DataFrame:
    return df.withColumns({c: round_ten(F.col(c)) for c in counts})


def suppressed(df: DataFrame, group: list[str], counts: list[str], values: list[str]) -> DataFrame:
    """Groups with a small count anywhere lose their values and counts; other counts are rounded. Adds suppressed."""
    test = F.lit(False)
    for c in counts:
        test = test | small_count(F.col(c))
    out = df.withColumn("suppressed", F.max(test).over(Window.partitionBy(*group)))
    hide = lambda c, x: F.when(~F.col("suppressed"), x).alias(c)
    return out.select(*[hide(c, round_ten(F.col(c))) if c in counts else hide(c, F.col(c)) if c in values else F.col(c) for c in df.columns], "suppressed")


def real_rounded(df: DataFrame, counts: list[str], split: str = "split") -> DataFrame:
    """Counts of rows of a real split rounded; those of synthetic rows, about nobody, stay."""
    return df.withColumns({c: F.when(F.col(split).isin(*REAL), round_ten(F.col(c))).otherwise(F.col(c)) for c in counts})


def groups_suppressed(df: DataFrame, group: list[str], count: str, values: list[str], test: tuple[str, ...] = REAL, split: str = "split") -> DataFrame:
    """Groups in which a tested split has a small count lose count and values in all splits; other counts of real splits are rounded."""
    small = F.max(F.col(split).isin(*test) & small_count(F.col(count))).over(Window.partitionBy(*group))
    out = df.withColumn("suppressed", small)
    return real_rounded(out, [count], split).withColumns({c: F.when(~F.col("suppressed"), F.col(c)) for c in [count, *values]})


def tokens_suppressed(df: DataFrame, real: tuple[str, ...] = ("train", "test"), values: tuple[str, ...] = ("f", "cdf")) -> DataFrame:
    """Wide token rows (n_<split>, f_<split>, cdf_<split>): where train's count is 1 to 9, all of the real splits' are null; counts
    are rounded else. Synthetic columns stay."""
    small = small_count(F.col("n_train"))
    out = {f"n_{x}": F.when(~small, round_ten(F.col(f"n_{x}"))) for x in real}
    return df.withColumns(out | {f"{v}_{x}": F.when(~small, F.col(f"{v}_{x}")) for v in values for x in real})


def token_suppressed(df: DataFrame, count: str, values: list[str]) -> DataFrame:
    """Bins whose count is 1 to 9 lose count and values; other counts are rounded. Samples are dropped by select."""
    small = small_count(F.col(count))
    return df.withColumns({count: F.when(~small, round_ten(F.col(count)))} | {v: F.when(~small, F.col(v)) for v in values})
