"""Metric rows (section, metric, value, numerator, denominator): merged over chunks, filled, and turned into wide reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import count_if, rate


def merge_chunks(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per metric over its chunks: a ratio of sums if all rows have both parts, a sum if all values are whole, else a mean; null values count as missing."""
    n, parts = F.count("*"), count_if(F.col("numerator").isNotNull() & F.col("denominator").isNotNull())
    whole = count_if(F.col("value") == F.floor("value"))
    x = rows.groupBy(*by).agg(n.alias("chunks"), parts.alias("_parts"), whole.alias("_whole"), F.sum("numerator").alias("numerator_sum"), F.sum("denominator").alias("denominator_sum"), F.sum("value").alias("_sum"), F.avg("value").alias("_avg"), F.count("value").alias("_valued"))
    kind = F.when(F.col("_parts") == F.col("chunks"), "sum_ratio").when((F.col("_whole") == F.col("chunks")), "sum").when(F.col("_valued") > 0, "mean").otherwise("unavailable")
    x = x.withColumn("aggregation", kind)
    value = F.when(kind == "sum_ratio", rate(F.col("numerator_sum"), F.col("denominator_sum"))).when(kind == "sum", F.col("_sum")).when(kind == "mean", F.col("_avg"))
    both = F.col("aggregation") == "sum_ratio"
    return x.withColumn("value", value).select(*by, "aggregation", "value", F.when(both, F.col("numerator_sum")).alias("numerator_sum"), F.when(both, F.col("denominator_sum")).alias("denominator_sum"), "chunks")


def forward_fill_k(rows: DataFrame, chunk: str, fill: str) -> DataFrame:
    """Each chunk gets every k up to the largest of any chunk; a missing k takes the value of the nearest lower one, 0 if there is none."""
    top = rows.agg(F.max("k")).scalar()
    grid = rows.select(chunk).distinct().select(chunk, F.explode(F.sequence(F.lit(1).cast("long"), top)).alias("k"))
    w = Window.partitionBy(chunk).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(rows.select(chunk, "k", fill), [chunk, "k"], "left").withColumn(fill, F.coalesce(F.last(fill, ignorenulls=True).over(w), F.lit(0)))


def balanced_from_parts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Balanced accuracy where no value was given: from the sums of the four counts."""
    side = lambda m: F.sum(F.when(F.col("metric") == m, F.col("value")))
    x = rows.groupBy(*by).agg(*(side(m).alias(m) for m in ("tp", "fn", "tn", "fp")), F.max(F.when(F.col("metric") == "balanced", F.col("value"))).alias("given"))
    made = (rate(F.col("tp"), F.col("tp") + F.col("fn")) + rate(F.col("tn"), F.col("tn") + F.col("fp"))) / 2
    return x.select(*by, F.coalesce("given", made).alias("balanced"))


def wide(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """One row per key and one column per metric; the list of metrics is given, so that no job looks for it."""
    return rows.groupBy(*by).pivot("metric", metrics).agg(F.first("value"))


def stack(*frames: DataFrame) -> DataFrame:
    """All rows with the union of all columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def accuracy(df: DataFrame, by: str, correct: str) -> DataFrame:
    """Accuracy of each group and of all rows (group null, total true); rows without a group count in the total only, rows without a label nowhere."""
    x = df.where(F.col(correct).isNotNull()).rollup(by).agg(F.count("*").alias("n"), count_if(F.col(correct)).alias("right"), F.grouping(by).alias("g"))
    return x.where((F.col("g") == 1) | F.col(by).isNotNull()).select(by, "n", "right", rate(F.col("right"), F.col("n")).alias("accuracy"), (F.col("g") == 1).alias("total"))


def map_totals(df: DataFrame, column: str) -> DataFrame:
    """Sums of map values by key."""
    return df.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def missing_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys that only one side has: the key and side."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    return a.join(b, on, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, on, "left_anti").withColumn("side", F.lit("right")))


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A small report as a table in Markdown; refuses more rows than the limit."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a report of over {limit} rows")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(rows.columns), line(["-"] * len(rows.columns)), *(line("--" if v is None else str(v) for v in r) for r in found)])
