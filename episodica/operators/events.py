"""What kind of event a message is: native predicates over the log's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: What operators over transitions and labels read of the classified log; no texts.
PARSED = ["uid", "seq", "protocol", "stage", "sender", "is_actor", "is_review", "is_anchor", "is_update", "is_submission", "answer_key", "source_key", "reviewed_key", "action", "positions", "verdict"]
SPECIAL = ["system", "evaluator", "reviewer", "planner"]


def _low(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def classify(messages: DataFrame) -> DataFrame:
    """Adds the predicates and everything that is parsed from text, once, before any window.

    Columns: is_actor, is_review, is_anchor, is_update, is_submission, answer (of actors and submissions), answer_key, source_key,
    reviewed_key, action, verdict (tri-state, of evaluations). `protocol` other than per or broadcast raises.
    """
    stage, sender, kind, role = _low("stage"), _low("sender"), _low("event_type"), _low("role")
    per = F.lower("protocol") == "per"
    known = F.when(F.lower("protocol").isin("per", "broadcast"), F.lower("protocol")).otherwise(F.raise_error(F.concat(F.lit("unsupported protocol: "), F.coalesce("protocol", F.lit("null")))))
    memory, said = stage.contains("candidate_memory"), X.strip(F.coalesce("content", F.lit(""))) != ""
    executor = (kind == "message") & (stage.startswith("executor_") | (stage == "executor")) & (sender == "executor")
    talk = ((kind == "message") & (stage.startswith("discussion_") | (stage == "discussion"))) | ((kind == "summary") & stage.startswith("poll_"))
    peer = talk & ~sender.isin(SPECIAL) & ~role.isin("system", "evaluator")
    positions = X.review_positions(F.col("content"))
    out = messages.withColumn("protocol", known).withColumns(
        {
            "is_actor": ~memory & said & F.when(per, executor).otherwise(peer),
            "is_review": (kind == "message") & ~memory & F.when(per, stage.startswith("reviewer_") & (sender == "reviewer")).otherwise(stage.startswith("approval_") & (F.size(positions) > 0)),
            "is_anchor": ~per & (kind == "message") & stage.startswith("candidate_review_") & ~memory & (sender == "system"),
            "is_update": stage.contains("candidate_update") & ~memory & (sender == "system"),
            "is_submission": stage.contains("submission"),
            "is_evaluation": stage.contains("evaluation") & ~stage.contains("hint") & ~memory & ~stage.contains("submission"),
        }
    )
    # A poll says its candidate in a field of its data, else in its last line for one.
    line = F.try_element_at(F.regexp_extract_all("content", F.lit(r"(?im)^\s*candidate\s*=\s*(.+?)\s*$"), F.lit(1)), F.lit(-1))
    data = X.field_answer(X.json_field(F.col("extra_json"), "candidate_answer")) if "extra_json" in messages.columns else F.lit("")
    polled = F.coalesce(F.nullif(data, F.lit("")), X.field_answer(line))
    polled = F.when((data != "") | line.isNotNull(), polled)
    own = X.explicit_answer(F.col("content"))
    answer = F.when(F.col("is_actor") & stage.startswith("poll_"), F.coalesce(polled, own)).when(F.col("is_actor") | F.col("is_submission"), own)
    return out.withColumns(
        {
            "answer": answer,
            "source_key": F.when(F.col("is_anchor"), F.lower(X.anchor_source(F.col("content")))),
            "reviewed_key": F.when(F.col("is_anchor") | F.col("is_review"), X.normalize_answer(X.reviewed_answer(F.col("content")))),
            "action": F.when(F.col("is_review"), F.when(per, X.per_action(F.col("content")))),
            "positions": F.when(F.col("is_review") & ~per, positions),
            "verdict": F.when(F.col("is_evaluation"), X.pass_fail(F.col("content"))),
        }
    ).withColumn("answer_key", F.when(F.col("answer") != "", X.normalize_answer(F.col("answer"))))
