"""Runs: what each trajectory's log amounts to, summaries over a run, labels looked up before any evaluator is asked, and cases chosen for an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.stats import count_if
from ..functions.text import boxed_last
from . import sampling
from .attempts import pass_at_k

# What the log says on acceptance, and marks of a review.
ACCEPTED, REJECTED = "Good score! Accept!", "Bad score! Reject!"
AGREES, REROUTES = r"(?i)\[Agree\]", r"(?i)\[Route:\s*\w+\]|\[(?:Self-Revise|Revise)\]"
PASSES = [r"(?i)\bScore:\s*(True|False)\b", r"(?i)\bEvaluation signal:\s*(PASS|FAIL)\b", r"(?i)\bVerifier:\s*(PASS|FAIL)\b"]


def passed(content: Column) -> Column:
    """True, False or null: the first of three forms that an evaluation has."""
    said = lambda p: F.nullif(F.lower(F.regexp_extract(F.coalesce(content, F.lit("")), p, 1)), F.lit(""))
    return F.coalesce(*map(said, PASSES)).isin("true", "pass")


def collect(log: DataFrame, by: str = "uid") -> DataFrame:
    """One row per trajectory: counts of messages, senders, rounds, polls, evaluations and review marks, confidence_sum, first_passed, correct (1, 0, or -1 if no decision stands) and predicted.

    log: by, seq, round, event_type, stage, sender, content, and optionally score and final_answer. The last decision, final answer and executor's text
    count; a poll's score lies between 1 and 100, 1 if there is none. Nothing is gathered: all parts combine before the shuffle."""
    have = lambda c, kind: F.col(c).cast(kind) if c in log.columns else F.lit(None).cast(kind)
    text = lambda c: F.coalesce(c, F.lit(""))
    stage, sender, content = text("stage"), text("sender"), text("content")
    message, poll = F.col("event_type") == "message", stage.startswith("poll_")
    decided = F.when(content.contains(ACCEPTED), 1).when(content.contains(REJECTED), 0)
    x = log.select(
        by, "seq", "round", poll.alias("poll"), F.when((message | poll) & ~sender.isin("", "system"), sender).alias("speaker"),
        F.when(message & (stage.startswith("executor") | ((stage == "execution") & (sender != "system"))), content).alias("executor"),
        F.when(message & stage.startswith("evaluation"), passed(content)).alias("verdict"),
        F.when(poll, F.greatest(F.lit(1), F.least(F.lit(100), F.coalesce(have("score", "int"), F.regexp_extract(content, r"score\s*=\s*(-?\d+)", 1).try_cast("int"), F.lit(1))))).alias("confidence"),
        F.when(stage == "evaluation_result", F.nullif(F.trim(have("final_answer", "string")), F.lit(""))).alias("final"),
        F.when((stage == "system") & (sender == "system"), decided).alias("decided"),
        F.when(message & (F.lower(stage).rlike("reviewer|self_review") | F.lower(sender).contains("critic")), content).alias("review"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    first = F.min_by("verdict", F.when(F.col("verdict").isNotNull(), F.col("seq")))
    return x.groupBy(by).agg(
        F.count("speaker").alias("messages"), F.countDistinct("speaker").alias("speakers"), F.countDistinct("round").alias("rounds"), count_if(F.col("poll")).alias("polls"),
        F.coalesce(F.sum("confidence"), F.lit(0)).cast("long").alias("confidence_sum"), F.count("verdict").alias("evaluations"), count_if(F.col("verdict")).alias("passes"), first.alias("first_passed"),
        count_if(F.col("review").rlike(AGREES)).alias("agrees"), count_if(F.col("review").rlike(REROUTES)).alias("reroutes"),
        F.coalesce(last("decided"), F.lit(-1)).cast("long").alias("correct"), F.coalesce(last("final"), boxed_last(last("executor")), F.lit("")).alias("predicted"),
    )


def summary(examples: DataFrame) -> DataFrame:
    """One row over a run's examples (correct, first_passed, first_success, tokens, messages, rounds, evaluations, polls, confidence_sum).

    Examples with correct = -1 are not scored; mean tokens are whole numbers, rounded down; empty denominators give 0. No example gives zeros."""
    scored, n = F.col("correct") >= 0, F.count("*")
    zero = lambda a, b: F.coalesce(F.try_divide(F.coalesce(a, F.lit(0)).cast("double"), b.cast("double")), F.lit(0.0))
    part = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    hit = F.when(scored, F.col("first_success"))
    return examples.agg(
        n.alias("examples"), count_if(scored).alias("scored"), F.round(zero(count_if(F.col("correct") == 1), count_if(scored)), 4).alias("accuracy"),
        F.round(zero(count_if(scored & F.col("first_passed")), count_if(scored)), 4).alias("first_accuracy"), part("tokens").alias("total_tokens"), F.coalesce(F.floor(F.try_divide(part("tokens"), n)), F.lit(0)).cast("long").alias("avg_tokens"),
        F.round(zero(part("messages"), n), 2).alias("avg_messages"), F.round(zero(part("rounds"), n), 2).alias("avg_rounds"), F.round(zero(part("evaluations"), n), 2).alias("avg_evaluations"),
        F.round(zero(F.sum(hit), F.count(hit)), 2).alias("avg_attempts_to_success"), part("polls").alias("total_polls"), F.round(zero(part("confidence_sum"), part("polls")), 2).alias("avg_confidence"),
    )


def pass_at_attempt(examples: DataFrame) -> DataFrame:
    """For each k up to the most attempts of a scored example: how many succeeded at k, and the share that did by k (four places)."""
    x = pass_at_k(examples.where("correct >= 0").withColumn("run", F.lit(1)), "run")
    return x.select("k", F.col("gained").alias("solved"), F.round("pass_at_k", 4).alias("pass_at"))


def look_up(candidates: DataFrame, cache: DataFrame, key: list[str], runtime: str = "runtime", position: str = "position") -> DataFrame:
    """Labels that need no evaluator: value, and source `runtime_evaluator` (what the run itself recorded goes first), `cache` (the row written last under the key) or null: those are left to label.

    The cache is reduced to a row per key before the join; candidates stay as they are, nulls in a key match as empty texts do."""
    same = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_k{i}") for i, c in enumerate(key)]
    keys = [f"_k{i}" for i in range(len(key))]
    kept = cache.select(*same, "value", position).groupBy(*keys).agg(F.max_by("value", position).alias("_cached"))
    x = candidates.select("*", *same).join(kept, keys, "left").drop(*keys)
    source = F.when(F.col(runtime).isNotNull(), "runtime_evaluator").when(F.col("_cached").isNotNull(), "cache")
    return x.withColumns({"value": F.coalesce(runtime, "_cached"), "source": source}).drop("_cached")


def judge(candidates: DataFrame, mode: str = "exact", tolerance: float = 0.0) -> DataFrame:
    """Labels of candidates: value and source. candidates: answer, gold, final (the answer that was submitted last) and runtime (what the run said of it).

    Without an answer or a gold answer there is no label (`missing`). The run's own label holds for the answer submitted last, other answers
    are compared: `exact`, `numeric-verifier` within the tolerance, or by the rules of `omni-rule`. Other modes ask a model: `unsupported:MODE`.
    """
    clean = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    answer, gold = clean("answer"), clean("gold")
    modes = {"exact": lambda: rules.exact_match(answer, gold), "numeric-verifier": lambda: rules.exact_match(answer, gold, tolerance), "omni-rule": lambda: rules.math_equal(answer, gold)}
    missing, known = (answer == "") | (gold == ""), F.col("runtime").isNotNull() & (answer == clean("final"))
    compared = modes[mode]() if mode in modes else F.lit(None).cast("boolean")
    x = candidates.withColumn("_compared", compared)
    return x.withColumns({"value": F.when(missing, None).when(known, F.col("runtime")).otherwise(F.col("_compared")), "source": F.when(missing, "missing").when(known, "runtime_evaluator").otherwise(mode if mode in modes else f"unsupported:{mode}")}).drop("_compared")


def submitted_labels(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """What runs' evaluators said of every answer that was submitted, over all trajectories of a problem: by, answer, value, conflict.

    verdicts: by, answer, passed; without an answer or a verdict a row says nothing. Verdicts that differ leave value null. Partial
    aggregation: a popular answer is two booleans a task before the shuffle.
    """
    low, high = F.min("passed"), F.max("passed")
    told = verdicts.where(F.col("passed").isNotNull() & (F.trim(F.coalesce("answer", F.lit(""))) != ""))
    return told.groupBy(*by, F.trim("answer").alias("answer")).agg(F.when(low == high, low).alias("value"), (low != high).alias("conflict"))


def with_submitted(candidates: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """Candidates with the columns that judge() takes the run's own label from: final, runtime; and conflict. A candidate whose verdicts differ is
    compared like one that nobody submitted. candidates: by, answer."""
    said = labels.select(*by, F.col("answer").alias("_answer"), F.col("value").alias("runtime"), F.col("conflict").alias("_conflict"))
    on = [candidates[c].eqNullSafe(said[c]) for c in by] + [F.trim(candidates["answer"]) == said["_answer"]]
    x = candidates.join(said, on, "left").drop(*(said[c] for c in by))
    return x.withColumns({"final": F.col("_answer"), "conflict": F.coalesce("_conflict", F.lit(False))}).drop("_answer", "_conflict")


def saved_evaluations(log: DataFrame, by: str = "uid") -> DataFrame:
    """What the run's evaluator noted last of each trajectory, if anything: by, mode, correct. log: by, seq, event_type, stage, mode, correctness."""
    noted = (F.col("event_type") == "meta") & F.startswith("stage", F.lit("evaluation")) & F.col("correctness").isin(0, 1) & (F.coalesce("mode", F.lit("")) != "")
    return log.where(noted).groupBy(by).agg(F.max_by(F.struct("mode", (F.col("correctness") == 1).alias("correct")), "seq").alias("last")).select(by, "last.*")


def post_evaluation(records: DataFrame, saved: DataFrame, by: str = "uid", extra: str | None = None) -> DataFrame:
    """Scored records: correctness (0 or 1), judge and evaluation_source. records: by, answer, gold.

    Unless an extra mode is asked for, saved evaluations count if all records have one and of one mode; else every record is compared exactly.
    """
    has = records.join(saved, by, "left")
    use = F.lit(extra is None) & has.agg((F.count("*") == F.count("mode")) & F.coalesce(F.min("mode") == F.max("mode"), F.lit(False))).scalar()
    compared = judge(has.withColumns({"final": F.lit(None).cast("string"), "runtime": F.lit(None).cast("boolean")}), extra or "exact")
    return compared.select(
        *records.columns, F.when(use, F.col("correct")).otherwise(F.coalesce("value", F.lit(False))).cast("int").alias("correctness"), F.when(use, F.col("mode")).otherwise(extra or "exact").alias("judge"),
        F.when(use, "per_evaluator").otherwise("extra_post_eval" if extra else "fallback_exact").alias("evaluation_source"),
    )


#: Statuses of Broadcast reviews, the riskiest provenance first.
RISK = ["actor_response_after_protocol_selection", "actor_response_before_gate", "no_actor_response_before_submission", "no_actor_response_before_next_review", "missing_actor_candidate_before", "no_actor_response_observed"]


def audit_cases(pairs: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One review of each group for reading by hand: of a Broadcast group by status, then most updates; of a PER group one with a response, then one with both answers; then the first. order ends ties."""
    broadcast = F.col("protocol") == "broadcast"
    status = F.coalesce(F.array_position(F.array(*map(F.lit, RISK)), F.col("status")), F.lit(0))
    first = F.when(broadcast, F.when(status == 0, 10).otherwise(status)).when(F.col("actor_turn_observed"), 0).otherwise(1)
    both = F.col("before_key").isNotNull() & F.col("after_key").isNotNull()
    second = F.when(broadcast, -F.coalesce("updates", F.lit(0))).when(both, 0).otherwise(1)
    return sampling.pick(pairs, by, [first, second, F.col("review_seq"), *order])


