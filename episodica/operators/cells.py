"""Cells: conditional counts over transitions, ratios of sums, grids and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import count_if, rate, wilson

CELL = ["dataset", "actor", "protocol"]
OUTCOMES = ["unchanged", "changed_still_wrong", "repaired", "harmed", "changed_still_correct", "changed_correctness_unlabeled"]
BUCKETS = ["strict_pre_gate", "gate_confounded", "parser_incomplete", "no_after", "source_link_failure", "other_non_strict"]
ACTIONS = ["revise", "agree", "unknown"]


def summary_counts() -> list[Column]:
    labeled = F.col("before_correct").isNotNull() & F.col("after_correct").isNotNull()
    conflict = lambda s: F.coalesce(F.col(f"{s}_conflict"), F.lit(False))
    out = [F.count("*").alias("review_opportunities"), count_if(F.col("actor_turn_observed")).alias("actor_turn_observed"), count_if(F.col("after_key").isNotNull()).alias("actor_response_observed")]
    out += [count_if(F.col("answer_pair_parsed")).alias("answer_pair_parsed"), count_if(labeled).alias("correctness_pair_labeled")]
    out += [count_if(F.col("bucket") == b).alias(b) for b in BUCKETS]
    out += [count_if(F.col("action") == a).alias(f"review_action_{a}") for a in ACTIONS]
    out += [count_if(conflict("before")).alias("before_conflict"), count_if(conflict("after")).alias("after_conflict"), count_if(conflict("before") | conflict("after")).alias("any_conflict")]
    for prefix, where in (("", F.lit(True)), ("strict_", F.col("bucket") == "strict_pre_gate"), ("gate_", F.col("bucket") == "gate_confounded")):
        out += [count_if(where & (F.col("transition_outcome") == o)).alias(f"{prefix}outcome_{o}") for o in OUTCOMES]
        out += [count_if(where & labeled).alias(f"{prefix}correctness_pair_labeled")] if prefix else []
    return out


def memory_counts() -> list[Column]:
    """What review memory says; of rows with_memory()."""
    route = F.col("route_observed")
    return [count_if("memory_valid").alias("review_memory_provenance_valid"), count_if(route).alias("review_route_observed"), *(count_if(route & (F.col("action") == a)).alias(f"review_route_observed_action_{a}") for a in ACTIONS)]


def cell_summary(labeled: DataFrame, by: list[str] = CELL) -> DataFrame:
    """One pass, partial aggregation: every counter of a cell; those of review memory where the rows have it."""
    return labeled.groupBy(*by).agg(*summary_counts(), *(memory_counts() if "route_observed" in labeled.columns else []))


def pre_wrong_counts(labeled: DataFrame, by: list[str]) -> DataFrame:
    """Labelled pairs that were wrong before: all, strict and gate-confounded ones, and the repaired among each."""
    base = F.coalesce(~F.col("before_correct"), F.lit(False)) & F.col("after_correct").isNotNull()
    parts = (("", base), ("strict_", base & F.col("strict")), ("gate_", base & (F.col("bucket") == "gate_confounded")))
    return labeled.groupBy(*by).agg(*(f for p, c in parts for f in (count_if(c).alias(f"{p}labeled_pre_wrong"), count_if(c & (F.col("transition_outcome") == "repaired")).alias(f"{p}repaired"))))


def _followed(prefix: str, here: Column) -> list[Column]:
    """What became of answers that were wrong before, `here` being the rows: whether they changed, and to what if that is labelled."""
    known = here & F.col("after_correct").isNotNull()
    at = lambda o: known & (F.col("transition_outcome") == o)
    cols = {"pairs": here, "changed": here & F.col("answer_changed"), "unchanged": here & ~F.col("answer_changed"), "labeled": known, "repaired": at("repaired"), "labeled_unchanged": at("unchanged"), "labeled_still_wrong": at("changed_still_wrong"), "changed_labeled": at("changed_still_wrong") | at("repaired")}
    return [count_if(c).alias(f"{prefix}{n}") for n, c in cols.items()]


def revise_counts(labeled: DataFrame, by: list[str]) -> DataFrame:
    """Counters of explicit revisions of answers that were wrong before, strict and gate-confounded."""
    wrong = (F.col("action") == "revise") & F.coalesce(~F.col("before_correct"), F.lit(False))
    out = [c for p, bucket in (("strict_", "strict_pre_gate"), ("gate_", "gate_confounded")) for c in _followed(p, wrong & (F.col("bucket") == bucket))]
    x = labeled.groupBy(*by).agg(*out)
    for p in ("strict", "gate"):
        x = x.withColumns({f"{p}_uptake": rate(F.col(f"{p}_changed"), F.col(f"{p}_pairs")), f"{p}_coverage": rate(F.col(f"{p}_labeled"), F.col(f"{p}_pairs")), f"{p}_repair": rate(F.col(f"{p}_repaired"), F.col(f"{p}_labeled"))})
    return x


def route_counts(labeled: DataFrame, by: list[str]) -> DataFrame:
    """Strict PER pairs that were wrong before, if reviews of unknown action whose memory shows a route count as revisions too; every group has its row, with zeros where it has no such pair. labeled: with_memory()."""
    return route_cells(labeled, by)


def route_cells(labeled: DataFrame, by: list[str] = CELL) -> DataFrame:
    """route_counts() of every cell, with zeros where it has no such pair. labeled: with_memory()."""
    here = (F.col("protocol") == "per") & F.col("strict") & F.coalesce(~F.col("before_correct"), F.lit(False))
    explicit, linked = here & (F.col("action") == "revise"), here & (F.col("action") == "unknown") & F.col("route_observed")
    return labeled.groupBy(*by).agg(count_if(explicit).alias("explicit"), count_if(linked).alias("linked_route"), *_followed("", explicit | linked))


def matrix(labeled: DataFrame, grid: DataFrame) -> DataFrame:
    """The dense matrix: precision, uptake and repair of each grid cell, each as (successes, n, rate, Wilson bounds); cells without rows have n = 0."""
    revise = F.col("action") == "revise"
    strict = F.col("bucket") == "strict_pre_gate"
    wrong = F.coalesce(~F.col("before_correct"), F.lit(False))
    known = F.col("before_correct").isNotNull()
    parts = {
        "precision": (revise & wrong, revise & known),
        "uptake": (revise & strict & wrong & F.col("answer_changed"), revise & strict & wrong),
        "repair": (revise & strict & wrong & F.col("after_correct"), revise & strict & wrong & F.col("after_correct").isNotNull()),
    }
    aggs = [f for k, (a, b) in parts.items() for f in (count_if(a).alias(f"{k}_k"), count_if(b).alias(f"{k}_n"))]
    x = grid.join(labeled.groupBy(*grid.columns).agg(*aggs), grid.columns, "left").na.fill(0, [c for k in parts for c in (f"{k}_k", f"{k}_n")])
    for k in parts:
        lo, hi = wilson(F.col(f"{k}_k"), F.col(f"{k}_n"))
        x = x.withColumns({f"{k}_rate": rate(F.col(f"{k}_k"), F.col(f"{k}_n")), f"{k}_lo": lo, f"{k}_hi": hi})
    return x.withColumns({"label_coverage": rate(F.col("repair_n"), F.col("uptake_n")), "sparse": F.col("uptake_n") < 20})


def directions(m: DataFrame, by: list[str]) -> DataFrame:
    """Cell pairs of the two protocols, compared: a missing rate compares false."""
    side = lambda c, p: F.max(F.when(F.col("protocol") == p, F.col(c)))
    pairs = m.groupBy(*by).agg(*(side(f"{k}_rate", p).alias(f"{p}_{k}") for p in ("per", "broadcast") for k in ("precision", "uptake", "repair")), *(F.coalesce(F.bool_or((F.col("protocol") == p) & F.col("sparse")), F.lit(False)).alias(f"{p}_sparse") for p in ("per", "broadcast")))
    g = lambda a, b: count_if(F.col(a) > F.col(b))
    return pairs.agg(
        F.count("*").alias("cells"), g("per_precision", "broadcast_precision").alias("precision_per_above"), g("per_precision", "per_repair").alias("per_precision_above_repair"),
        g("broadcast_precision", "broadcast_repair").alias("broadcast_precision_above_repair"), g("broadcast_uptake", "per_uptake").alias("uptake_broadcast_above"),
        g("broadcast_repair", "per_repair").alias("repair_broadcast_above"), count_if(F.col("per_sparse")).alias("per_sparse_cells"), count_if(F.col("broadcast_sparse")).alias("broadcast_sparse_cells"),
    )


def comparison_status(summary: DataFrame, by: list[str]) -> DataFrame:
    """Whether a cell pair can be compared at all."""
    n = lambda p: F.max(F.when(F.col("protocol") == p, F.col("strict_pre_gate")))
    x = summary.groupBy(*by).agg(n("per").alias("per_strict"), n("broadcast").alias("broadcast_strict"))
    status = F.when(F.col("per_strict").isNull() | F.col("broadcast_strict").isNull(), "missing_protocol").when((F.col("per_strict") == 0) | (F.col("broadcast_strict") == 0), "refused_zero_strict").otherwise("descriptive")
    return x.withColumn("status", status)


def violations(summary: DataFrame, labeled: DataFrame) -> DataFrame:
    """Counts of broken invariants; all are 0 on sound input. name, violations."""
    total = lambda names: sum((F.col(n) for n in names), F.lit(0))
    cell = summary.agg(
        count_if(total(BUCKETS) != F.col("review_opportunities")).alias("buckets_partition_reviews"),
        count_if(total([f"review_action_{a}" for a in ACTIONS]) != F.col("review_opportunities")).alias("actions_partition_reviews"),
        count_if(total([f"outcome_{o}" for o in OUTCOMES]) != F.col("answer_pair_parsed")).alias("outcomes_partition_parsed"),
        count_if(F.col("strict_pre_gate") > F.col("answer_pair_parsed")).alias("strict_within_parsed"),
    )
    row = labeled.agg(
        count_if(F.col("strict") & (F.col("updates") > 0)).alias("strict_has_no_update"), count_if(F.col("strict") & F.col("after_seq").isNull()).alias("strict_has_after"),
        count_if((F.col("transition_outcome") == "repaired") & ~(F.coalesce(~F.col("before_correct"), F.lit(False)) & F.coalesce(F.col("after_correct"), F.lit(False)))).alias("repaired_means_wrong_to_right"),
        count_if(F.col("after_seq") < F.col("review_seq")).alias("after_follows_review"), count_if(F.col("before_seq") > F.col("review_seq")).alias("before_precedes_review"),
    )
    unpivot = lambda d: d.unpivot([], d.columns, "name", "violations")
    return unpivot(cell).unionByName(unpivot(row))


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df itself; a job over it fails at the first row that breaks the condition."""
    return df.where(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def pooled(cells: DataFrame, by: list[str], num: str, den: str) -> DataFrame:
    """Micro-average: one ratio of sums, never a mean of ratios; and how many cells have a denominator."""
    return cells.groupBy(*by).agg(F.sum(num).alias("num"), F.sum(den).alias("den"), rate(F.sum(num), F.sum(den)).alias("rate"), count_if(F.col(den) > 0).alias("cells"))


def status_sets(df: DataFrame, by: list[str], *columns: str) -> DataFrame:
    return df.groupBy(*by).agg(*(F.to_json(F.array_sort(F.collect_set(c))).alias(f"{c}_json") for c in columns))
