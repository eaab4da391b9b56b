"""Rows in order: runs, islands, look-ahead, tails under a budget and bounded ledgers. Each takes the key and the order columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(key: list[str], *order: str) -> Window:
    return Window.partitionBy(*key).orderBy(*order)


def dedupe_consecutive(df: DataFrame, key: list[str], order: list[str], value: Column) -> DataFrame:
    """Drops null values, then rows whose value equals the one before."""
    kept = df.withColumn("_v", value).where("_v IS NOT NULL")
    return kept.withColumn("_p", F.lag("_v").over(ordered(key, *order))).where("NOT _v <=> _p").drop("_v", "_p")


def islands(df: DataFrame, key: list[str], order: list[str], value: Column) -> DataFrame:
    """Adds island, from 1: a running count of the changes of a value."""
    w = ordered(key, *order)
    starts = (~value.eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    return df.withColumn("_s", starts).withColumn("island", F.count_if("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def until_boundary(df: DataFrame, key: list[str], order: list[str], boundary: Column, flag: Column, name: str) -> DataFrame:
    """Whether a flag shows in the rows after this one, up to the next boundary (not included)."""
    w = ordered(key, *order)
    x = df.withColumn("_i", F.count_if(boundary).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_f", F.coalesce(flag, F.lit(False)))
    ahead = F.max("_f").over(Window.partitionBy(*key, "_i").orderBy(*order).rowsBetween(1, Window.unboundedFollowing))
    return x.withColumn(name, F.coalesce(ahead, F.lit(False))).drop("_i", "_f")


def next_value(df: DataFrame, key: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The first later value that isn't null."""
    return df.withColumn(name, F.first_value(value, ignoreNulls=True).over(ordered(key, *order).rowsBetween(1, Window.unboundedFollowing)))


def next_distinct(df: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The first later value that differs from this row's: the value of the next island of rows with a value."""
    x = islands(df.where(F.col(value).isNotNull()), key, order, F.col(value))
    heads = x.groupBy(*key, "island").agg(F.first(value).alias("_v"))
    ahead = heads.withColumn(name, F.lead("_v").over(ordered(key, "island"))).drop("_v")
    return x.join(ahead, [*key, "island"], "left")


def recent_tail(df: DataFrame, key: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """The newest rows whose sizes sum to the budget at most; the newest row always."""
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    x = df.withColumns({"tail_size": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_r": F.row_number().over(w)})
    return x.where((F.col("tail_size") <= budget) | (F.col("_r") == 1)).drop("_r")


def history_tail(df: DataFrame, key: list[str], order: list[str], size: Column, budget: int, last_n: int, pinned: Column | None = None) -> DataFrame:
    """The newest rows of a history, without a gap: those whose sizes sum to the budget at most, the newest row always; with a budget of 0 or
    less the newest last_n. Where a row is pinned, the tail goes back to the newest such row. Adds tail_size, the sum from the row on.

    A null size counts 0. One shuffle by key, all windows share it.
    """
    back = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    so_far = F.sum(F.coalesce(size, F.lit(0))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    x = df.withColumns({"tail_size": so_far, "_r": F.row_number().over(back)})
    near = (F.col("_r") == 1) | (F.col("tail_size") <= budget) if budget > 0 else F.col("_r") <= last_n
    if pinned is not None:
        x = x.withColumn("_p", F.min(F.when(pinned, F.col("_r"))).over(Window.partitionBy(*key)))
        near = near | F.coalesce(F.col("_r") <= F.col("_p"), F.lit(False))
    return x.where(near).drop("_r", "_p")


def bounded_ledger(df: DataFrame, key: list[str], order: list[str], limit: int) -> DataFrame:
    """The newest rows, numbered anew from 1; parent is the number of the row before, null where that row is gone."""
    back = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order)))
    x = df.withColumn("_b", back).where(F.col("_b") <= limit)
    at = F.row_number().over(ordered(key, *order)).cast("long")
    return x.withColumn("entry", at).withColumn("parent", F.when(F.col("entry") > 1, F.col("entry") - 1)).drop("_b")


def nested_numbers(df: DataFrame, key: list[str], order: list[str], main: Column) -> DataFrame:
    """Labels T<main>_<sub>: main grows at main events, sub starts anew in each."""
    w = ordered(key, *order)
    x = df.withColumn("_m", F.count_if(main).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sub = F.row_number().over(Window.partitionBy(*key, "_m").orderBy(*order))
    return x.withColumn("label", F.concat(F.lit("T"), "_m", F.lit("_"), sub)).drop("_m")
