"""Picks with a total order, samples by digest, and the cluster bootstrap. No result depends on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import md5_draw, rate
from ..sources.files import stored


def pick(df: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key. The order should end in a unique column. Spark keeps n rows a key and task before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def first_n_distinct(df: DataFrame, key: list[str], value: str, order: str, n: int) -> DataFrame:
    """The n values of each key that appear first."""
    return pick(df.groupBy(*key, value).agg(F.min(order).alias(order)), key, [F.col(order), F.col(value)], n)


def majority(df: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The commonest value of each key; on a tie the one seen first."""
    x = df.groupBy(*key, value).agg(F.count("*").alias("votes"), F.min(order).alias("_o"))
    return pick(x, key, [F.col("votes").desc(), F.col("_o")]).drop("_o")


def approved(votes: Column, unanimous: bool) -> Column:
    """Over a group: all votes, or more than half; an empty group isn't approved."""
    return F.coalesce(F.every(votes), F.lit(False)) if unanimous else F.count_if(votes) * 2 > F.count("*")


def round_robin(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows, one of each stratum in turn; the order inside a stratum is a digest's. Strata that run out are passed over."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key))
    return df.withColumn("turn", turn.cast("long")).where(F.col("turn") <= n).orderBy("turn", stratum).limit(n)


def hash_subset(df: DataFrame, stratum: str, key: str, n: int, salt: str) -> DataFrame:
    """The n rows of each stratum with the least digests of salt and key."""
    return pick(df, [stratum], [F.sha2(F.concat(F.lit(salt), F.lit("|"), F.col(key).cast("string")), 256), F.col(key)], n)


def ranged(stats: DataFrame, group: str, unit: str) -> DataFrame:
    """The units in ranges, with the number of each unit's range. It must be stored before numbered() reads it twice, since ranges are drawn from samples."""
    return stats.repartitionByRange(group, unit).withColumn("_range", F.spark_partition_id())


def numbered(stats: DataFrame, group: str, unit: str) -> DataFrame:
    """Adds _i, each unit's place in its group from 0, and _n, the group's size. Places are counted inside ranges; only the ranges' sizes are added up in one task for each group."""
    sizes = stats.groupBy(group, "_range").agg(F.count("*").alias("_c"))
    by = Window.partitionBy(group)
    first = sizes.select(group, "_range", (F.sum("_c").over(by.orderBy("_range")) - F.col("_c")).alias("_first"), F.sum("_c").over(by).alias("_n"))
    place = F.row_number().over(Window.partitionBy(group, "_range").orderBy(unit)) - 1
    return stats.withColumn("_place", place).join(first, [group, "_range"]).withColumn("_i", F.col("_first") + F.col("_place")).drop("_place", "_first", "_range")


def bootstrap(stats: DataFrame, group: str, unit: str, num: str, den: str, replicates: int, seed: str = "b") -> DataFrame:
    """Ratios of sums over resampled units: group, rep, rate. The units are stored, in ranges, so that no task numbers a whole group, and dealt evenly.

    Units of a group are numbered; draw i of a replicate takes unit md5(seed, rep, i) mod n. Each draw is shuffled once, to its unit, and added up by replicate there:
    draws are never grouped by unit or sorted. A paired comparison uses equal seeds over equal unit numbers.
    """
    spark = stats.sparkSession
    ranges = stored(ranged(stats, group, unit), "bootstrap-ranges")
    units = stored(numbered(ranges, group, unit).select(group, "_n", "_i", num, den), "bootstrap-units")
    # Few bytes of units make many draws: without a number Spark would put them all into one task.
    dealt = units.select(group, "_n", F.col("_i").alias("_d")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), group, "_d")
    draws = dealt.select(group, "_n", "_d", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    taken = md5_draw(F.concat_ws("|", F.lit(seed), F.col("rep").cast("string"), F.col("_d").cast("string")), F.col("_n"))
    drawn = draws.select(group, "rep", taken.alias("_i"))
    sums = drawn.join(units.select(group, "_i", num, den).hint("shuffle_hash"), [group, "_i"]).groupBy(group, "rep").agg(F.sum(num).alias("num"), F.sum(den).alias("den"))
    return sums.select(group, "rep", rate(F.col("num"), F.col("den")).alias("rate"))


def interval(reps: DataFrame, by: list[str], value: str = "rate") -> DataFrame:
    """95 % bounds by linear interpolation over the replicates that have a value."""
    p = lambda q: F.percentile(value, F.lit(q))
    return reps.groupBy(*by).agg(F.count(value).alias("replicates"), p(0.025).alias("lo"), p(0.975).alias("hi"))
