"""Problems: one row each, put together from the trace, the metrics file and the saved results, and the metrics over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import count_if
from .attempts import segments
from .reviews import rank

METRICS = "tries array<boolean>, evaluations array<boolean>, total_model_calls bigint, invocations map<string,bigint>, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, wall_time_seconds double"


def turn_counts(turns: DataFrame, key: str = "uid") -> DataFrame:
    """Per key: turns that no system wrote (a lower bound of its model calls) and those that no evaluator wrote either. turns: key, sender."""
    who = F.lower(F.coalesce("sender", F.lit("")))
    return turns.groupBy(key).agg(count_if(who != "system").alias("model_turns"), count_if((who != "system") & ~who.contains("evaluator")).alias("reasoning_turns"))


def reflective_rounds(events: DataFrame) -> DataFrame:
    """Per uid, over the attempts that a verdict closes: candidates that differ from the one before, the first of each attempt not counted."""
    x = segments(events).where("verdict IS NOT NULL OR answer_key IS NOT NULL")
    attempt = Window.partitionBy("uid", "attempt").orderBy("seq")
    x = x.withColumns({"closed": F.max("verdict").over(Window.partitionBy("uid", "attempt")).isNotNull(), "before": F.last("answer_key", ignorenulls=True).over(attempt.rowsBetween(Window.unboundedPreceding, -1))})
    return x.groupBy("uid").agg(count_if(F.col("closed") & (F.col("answer_key") != F.col("before"))).alias("reflective_rounds"))


def _tries(passed: Column) -> dict[str, Column]:
    """What a list of tries says; all null if there is none."""
    some = F.size(F.coalesce(passed, F.array().cast("array<boolean>"))) > 0
    when = lambda c: F.when(some, c)
    return {"n": when(F.size(passed).cast("long")), "success": when(F.nullif(F.array_position(passed, True), F.lit(0))), "first": when(F.coalesce(F.try_element_at(passed, F.lit(1)), F.lit(False)))}


def records(examples: DataFrame, attempts: DataFrame, metrics: DataFrame, results: DataFrame, key: str = "uid") -> DataFrame:
    """Left joins of all examples on one key, which shuffle each side once; what a side lacks is 0, or null for tier, domain and source.

    examples: key and any of model_turns, reasoning_turns, reflective_rounds. attempts: key, attempts, first_success, first_passed, hints_used.
    metrics: key and METRICS. results: key, tier, domain, source. The sides have a row per key at most.
    Tries of the whole system count for success if metrics have any; else the trace's attempts, else the evaluations in the metrics.
    Model calls are what metrics say (else the agents' invocations), or the trace's turns if those are more.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in examples.columns else F.lit(0)
    system, saved = _tries(F.col("tries")), _tries(F.filter("evaluations", lambda p: p.isNotNull()))
    traced = F.coalesce("attempts", F.lit(0)) > 0
    evaluated = {"n": F.when(traced, F.col("attempts")).otherwise(saved["n"]), "success": F.when(traced, F.col("first_success")).otherwise(saved["success"]), "first": F.when(traced, F.col("first_passed")).otherwise(saved["first"])}
    scoring = {part: F.when(system["n"].isNotNull(), system[part]).otherwise(evaluated[part]) for part in system}
    invoked = F.aggregate(F.map_values("invocations"), F.lit(0).cast("long"), lambda a, b: a + F.coalesce(b, F.lit(0)))
    x = examples.join(attempts, key, "left").join(metrics, key, "left").join(results, key, "left")
    return x.select(
        key, "tier", "domain", "source", scoring["success"].isNotNull().alias("final_passed"), F.coalesce(scoring["first"], F.lit(False)).alias("first_passed"), scoring["success"].alias("first_success"),
        F.coalesce(scoring["n"], F.lit(0)).alias("correction_loops"), F.coalesce(evaluated["n"], F.lit(0)).alias("evaluator_submissions"), F.coalesce("hints_used", F.lit(0)).alias("hints_used"),
        zero("reflective_rounds").alias("reflective_rounds"), zero("reasoning_turns").alias("reasoning_turns"), F.greatest(F.coalesce("total_model_calls", invoked, F.lit(0)), zero("model_turns")).alias("model_calls"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")), F.coalesce("wall_time_seconds", F.lit(0.0)).alias("wall_time_seconds"),
    )


#: metric: (numerator, denominator or None for a plain total).
BASIC = {
    "FinalPassRate": ("final_passed", "n"), "Pass@1": ("first_passed", "n"), "AvgCorrectionAttemptsToSuccess": ("first_success", "final_passed"), "TotalCorrectionAttemptsToSuccess": ("first_success", None),
    "AvgCorrectionLoops": ("correction_loops", "n"), "TotalEvaluatorAttempts": ("evaluator_submissions", None), "AvgReflectiveRefinementRounds": ("reflective_rounds", "n"), "AvgTotalTokens": ("total_tokens", "n"),
    "AvgModelCalls": ("model_calls", "n"), "TotalModelCalls": ("model_calls", None), "AvgReasoningTurns": ("reasoning_turns", "n"),
}


def basic_metrics(problems: DataFrame) -> DataFrame:
    """All basic metrics of records() in one pass: metric, value, numerator, denominator (both null for totals). A mean over nothing is null."""
    parts = sorted({c for pair in BASIC.values() for c in pair if c} - {"n"})
    kinds = dict(problems.dtypes)
    one = problems.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.col(c).cast("long") if kinds[c] == "boolean" else F.col(c)), F.lit(0)).cast("long").alias(c) for c in parts))
    long = lambda c: F.col(c) if c else F.lit(None).cast("long")
    row = lambda m, a, b: F.struct(F.lit(m).alias("metric"), (F.try_divide(F.col(a).cast("double"), F.col(b)) if b else F.col(a).cast("double")).alias("value"), long(b and a).alias("numerator"), long(b).alias("denominator"))
    return one.select(F.inline(F.array(*(row(m, a, b) for m, (a, b) in BASIC.items()))))


def accounting(metrics: DataFrame) -> DataFrame:
    """What a run took: rows, model calls, tokens and seconds; what a row lacks counts as 0."""
    total = lambda c, zero=0: F.coalesce(F.sum(c), F.lit(zero))
    return metrics.agg(
        F.count("*").alias("examples"), total("total_model_calls").alias("model_calls"), total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"),
        total("total_tokens").alias("tokens"), total("wall_time_seconds", 0.0).alias("wall_seconds"),
    )


def paired(rows: DataFrame, unit: list[str], side: str, sides: tuple[str, str]) -> DataFrame:
    """The units that occur on both sides, once each: an intersection by one aggregation instead of a join."""
    has = lambda s: F.bool_or(F.coalesce(F.col(side) == s, F.lit(False)))
    return rows.groupBy(*unit).agg(has(sides[0]).alias("_a"), has(sides[1]).alias("_b")).where("_a AND _b").select(*unit)


def in_order(rows: DataFrame, orders: dict[str, list[str]], *then: str) -> DataFrame:
    """Rows in the fixed order of some columns' values, unknown values last by name, then by other columns."""
    return rows.orderBy(*(c for name, order in orders.items() for c in (rank(F.col(name), order), F.col(name).asc_nulls_last())), *then)


def transition_name(before: Column, after: Column) -> Column:
    """wrong_to_correct and the like; unknown if either label is."""
    word = lambda c: F.when(c, "correct").otherwise("wrong")
    return F.when(before.isNotNull() & after.isNotNull(), F.concat(word(before), F.lit("_to_"), word(after))).otherwise("unknown")


def _suffixes(path: Column) -> Column:
    """Every suffix of a path that begins at a name, longest first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return _each(parts, lambda all_: F.transform(F.sequence(F.lit(1), F.size(all_)), lambda i: F.array_join(F.slice(all_, i, F.size(all_) - i + 1), "/")))


def _each(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def by_path_suffix(records: DataFrame, path: str, targets: DataFrame, suffix: str, keys: list[str] = []) -> DataFrame:
    """Each record with the target whose path is the longest suffix of the record's, `keys` being equal: a record's suffixes meet the targets as
    equal keys, so that no pattern is matched pair by pair. Adds the target's other columns and suffix_names, the names in the suffix.

    Of targets with one suffix and keys, the one with the least other columns counts. A record without any target, a null or an empty
    path keeps its row, with nulls. A record's row is known by its columns: repeated records stay.
    """
    others = [c for c in targets.columns if c not in (suffix, *keys)]
    names = lambda c: F.size(F.filter(F.split(c, "/"), lambda p: p != ""))
    known = targets.where(F.col(suffix).isNotNull()).select(F.array_join(F.filter(F.split(suffix, "/"), lambda p: p != ""), "/").alias("_s"), *keys, F.struct(*others).alias("_t"))
    known = known.groupBy("_s", *keys).agg(F.min("_t").alias("_t"))
    rows = records.select(F.struct("*").alias("_r"), *keys, F.explode_outer(F.when(F.col(path) != "", _suffixes(F.col(path)))).alias("_s"))
    met = rows.join(known, ["_s", *keys], "left").withColumn("_n", F.when(F.col("_t").isNotNull(), names("_s")))
    best = met.groupBy("_r").agg(F.max(F.struct("_n", "_t")).alias("_b"), F.count("*").alias("_c"), F.first(F.greatest(names(F.col(f"_r.{path}")), F.lit(1))).alias("_d"))
    again = F.explode(F.array_repeat(F.lit(0), (F.col("_c") / F.coalesce("_d", F.lit(1))).cast("int")))
    return best.select("_r", "_b", again).select("_r.*", *(F.col(f"_b._t.{c}").alias(c) for c in others), F.col("_b._n").alias("suffix_names"))


def agent_increases(snapshots: DataFrame, by: list[str], order: str, counters: str) -> DataFrame:
    """Sums of an agent's own work from snapshots of cumulative counters: by, order, agent, increase, reset.

    A snapshot is a map of agents to running totals that live longer than an example: what counts is the increase over the agent's snapshot
    before in the same run (`by`). A total below the one before has been reset, and counts as it is; an agent that a snapshot
    doesn't name has no row and keeps its total. A null total counts as none named, an empty or null map gives no rows.
    """
    entry = snapshots.select(*by, order, F.explode(counters).alias("agent", "total")).where("total IS NOT NULL")
    before = F.lag("total").over(Window.partitionBy(*by, "agent").orderBy(order))
    x = entry.withColumn("_b", before).withColumn("reset", F.coalesce(F.col("total") < F.col("_b"), F.lit(False)))
    return x.select(*by, order, "agent", F.when(F.col("reset") | F.col("_b").isNull(), F.col("total")).otherwise(F.col("total") - F.col("_b")).alias("increase"), "reset")
