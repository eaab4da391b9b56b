"""The detail row: everything that is known of one review opportunity, under the metadata of its trajectory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import transitions as T
from .cells import require

#: Of the trajectories' table: uid, and the names that a detail row has for the others.
METADATA = {"dataset": "dataset", "slice_id": "slice_id", "actor": "actor_family", "evaluator": "evaluator_model_id", "protocol": "protocol", "release_status": "release_status", "provenance_status": "provenance_status", "matrix": "matrix_4x2x5", "uid": "trajectory_uid", "problem": "problem_uid"}
CARRY = ("sender", "stage", "answer")
# How a candidate before or after a review was found.
BEFORE_LINK = {"per": "immediate_previous_executor", "broadcast": "anchor_source_answer_match_actor_event"}
AFTER_LINK = {"per": "immediate_next_executor", "broadcast": "next_anchor_source_answer_match_actor_event"}
NO_MEMORY = "not_applicable_broadcast_group_review"
CHECKS = ("immediate", "event_type_valid", "system_authored", "stage_matches", "previous_event_uid_matches", "source_matches", "authority_matches")
#: The checks' names in a detail row.
CHECK_NAMES = {"stage_matches": "stage_matches_review", "previous_event_uid_matches": "previous_event_uid_matches_review", "source_matches": "source_matches_reviewer", "authority_matches": "authority_matches_reviewer"}


def trajectories(meta: DataFrame, members: list[tuple[str, str, str]], only_members: bool = False) -> DataFrame:
    """The trajectories of both review protocols; `matrix` says whether (dataset, slice_id, actor) is one of the few `members`.

    A uid that comes twice raises in the job; other protocols and null ones go. An empty table stays empty.
    """
    inside = [reduce(lambda a, b: a & b, (F.col(c) == v for c, v in zip(("dataset", "slice_id", "actor"), m))) for m in members]
    x = meta.where("protocol IN ('per', 'broadcast')").withColumn("matrix", F.coalesce(reduce(lambda a, b: a | b, inside, F.lit(False)), F.lit(False)))
    x = x.where("matrix") if only_members else x
    by_uid = x.groupBy("uid").agg(F.min(F.struct(*(c for c in x.columns if c != "uid"))).alias("row"), F.count("*").alias("times"))
    return require(by_uid, F.col("times") == 1, "a trajectory comes twice in the metadata").select("uid", "row.*")


def covered(rows: DataFrame, meta: DataFrame, log: DataFrame) -> DataFrame:
    """rows itself; a job over it fails at a trajectory of meta without any event. Events of other trajectories are no matter.

    The check is a branch of a union without rows, since a join may leave a side unread when the other is empty. Ids of events are made distinct before they meet the metadata, so
    that a long trajectory is one row.
    """
    seen = log.select("uid").distinct().select("uid", F.lit(1).alias("seen"))
    by_uid = meta.select("uid", F.lit(0).alias("seen")).unionByName(seen).groupBy("uid").agg(F.min("seen").alias("least"), F.max("seen").alias("most")).where("least = 0")
    failing = F.when(F.col("most") == 1, False).otherwise(F.raise_error(F.lit("a trajectory of the metadata has no events")).cast("boolean"))
    return rows.unionByName(by_uid.where(failing).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema)))


def _json(texts: Column) -> Column:
    """An array of texts as JSON with a blank after each comma, as the reports have it."""
    one = F.transform(texts, lambda t: F.regexp_replace(F.to_json(F.array(t)), r"^\[|\]$", ""))
    return F.concat(F.lit("["), F.array_join(one, ", "), F.lit("]"))


def detail_rows(log: DataFrame, labels: DataFrame, meta: DataFrame) -> DataFrame:
    """One row of 59 columns for each review opportunity of the trajectories in `meta`.

    log: classified, with event_uid, previous_event_uid, extra_json and content; labels: as frozen_labels gives them; meta: of trajectories().
    Texts that aren't there are empty and missing sequences -1; labels and answer_changed are null where unknown. Metadata without events, or twice, raises.
    Trajectories without a review have no row. An event whose metadata has another protocol is left out.
    """
    log = log.join(meta.select("uid", "protocol"), ["uid", "protocol"], "left_semi").withColumn("selected", F.when(F.col("is_update"), X.updated_answer(F.col("content"))))
    x = T.label(T.transitions(log, CARRY), labels, sources=True).join(T.memory_records(log), ["uid", "review_seq"], "left")
    x = x.join(meta.withColumnRenamed("protocol", "meta_protocol"), "uid")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    at = lambda c: F.coalesce(F.col(c), F.lit(-1)).cast("long")
    broadcast = F.col("protocol") == "broadcast"
    link = lambda side, names: F.when(F.col(f"{side}_seq").isNotNull(), F.when(broadcast, names["broadcast"]).otherwise(names["per"])).otherwise("")
    source = lambda s: F.when(no(f"{s}_conflict"), F.concat(F.lit("conflict:"), f"{s}_sources")).otherwise(text(f"{s}_sources"))
    responded = F.col("after_seq").isNotNull() & (text("after_answer") != "")
    out = {
        **{new: F.col(old) for old, new in METADATA.items()},
        "review_id": F.concat(F.col("uid").cast("string"), F.lit(".symmetric_review."), F.col("review_number").cast("string")), "review_action": F.col("action"),
        "review_memory_event_uid": text("memory_event_uid"), "review_memory_sequence_index": at("memory_seq"),
        **{f"review_memory_{f}": text(f"memory_{f}") for f in ("action", "source", "authority", "stage", "previous_event_uid")},
        **{f"review_memory_{CHECK_NAMES.get(c, c)}": no(c) for c in CHECKS},
        "review_memory_provenance_valid": no("memory_valid"), "review_memory_link_status": F.when(broadcast, NO_MEMORY).otherwise(F.col("link_status")), "review_route_observed": no("route_observed"),
        "review_sequence_start": F.col("first_review"), "review_sequence_end": F.col("last_review"),
        "before_sequence_index": at("before_seq"), "before_sender": text("before_sender"), "before_stage": text("before_stage"), "answer_before": text("before_answer"),
        "after_sequence_index": at("after_seq"), "after_sender": text("after_sender"), "after_stage": text("after_stage"), "answer_after": text("after_answer"),
        "before_candidate_link_method": F.when(broadcast, link("before", BEFORE_LINK)).otherwise(BEFORE_LINK["per"]), "after_candidate_link_method": link("after", AFTER_LINK),
        "candidate_alignment": F.col("candidate_alignment"), "actor_turn_observed": F.col("actor_turn_observed"), "actor_response_observed": responded,
        "answer_pair_parsed": F.col("answer_pair_parsed"), "strict_pre_gate_eligible": F.col("strict"), "intervening_system_candidate_updates": F.col("updates"),
        "system_selected_answers_json": _json(F.col("selected")), "system_selected_answer_used_as_after": F.lit(False), "status": F.col("status"), "exclusion_reason": F.col("exclusion_reason"),
        "answer_changed": F.col("answer_changed"), "before_correct": F.col("before_correct"), "before_correct_source": source("before"), "after_correct": F.col("after_correct"), "after_correct_source": source("after"),
        "correctness_pair_labeled": F.col("before_correct").isNotNull() & F.col("after_correct").isNotNull(), "transition_outcome": F.col("transition_outcome"), "primary_eligibility_bucket": F.col("bucket"),
    }
    return covered(x.select(*(c.alias(n) for n, c in out.items())), meta, log)


def checked(rows: DataFrame) -> DataFrame:
    """rows itself; a job over it fails at the first row that says two things that can't both be."""
    c = F.col
    gives = lambda a, b: ~a | b
    strict, valid, route, bucket = c("strict_pre_gate_eligible"), c("review_memory_provenance_valid"), c("review_route_observed"), c("primary_eligibility_bucket")
    sure = {
        "an answer that the system chose stands as the actor's": ~c("system_selected_answer_used_as_after"),
        "a response without a turn": gives(c("actor_response_observed"), c("actor_turn_observed")),
        "a parsed pair without a response": gives(c("answer_pair_parsed"), c("actor_response_observed")),
        "a labelled pair that isn't parsed": gives(c("correctness_pair_labeled"), c("answer_pair_parsed")),
        "a strict row in another bucket": gives(strict, bucket == "strict_pre_gate"),
        "a route without a valid memory record": gives(route, valid & (c("review_memory_action") == "review_route")),
        "a valid memory record that fails a check": gives(valid, reduce(lambda a, b: a & b, (c(f"review_memory_{CHECK_NAMES.get(k, k)}") for k in CHECKS))),
        "a memory record outside PER": gives(valid | route, c("protocol") == "per"),
        "an actor that is no actor": gives(c("after_sequence_index") >= 0, ~F.lower(F.trim("after_sender")).isin("system", "evaluator", "reviewer", "planner")),
        "an answer from a stage that isn't an actor's": gives(c("after_sequence_index") >= 0, F.when(c("protocol") == "per", F.lower("after_stage").startswith("executor")).otherwise(F.lower("after_stage").rlike("^(discussion|poll)"))),
    }
    wrong = [F.when(~F.coalesce(condition, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")) for message, condition in sure.items()]
    return rows.where(F.coalesce(*wrong, F.lit(True)))
