"""Detail rows of review opportunities: metadata that must fit, what updates chose, checks that fail the job, preferred senders."""

import pytest
from pyspark.sql import functions as F

from episodica.functions import text
from episodica.operators import details, events, transitions

LOG = "uid long, seq long, protocol string, event_type string, stage string, sender string, role string, content string, event_uid string, previous_event_uid string, extra_json string"
META = "uid long, protocol string, problem long, dataset string, slice_id string, actor string, evaluator string, release_status string, provenance_status string"
MEMORY = '{"candidate_memory_event": {"action": "review_route", "source": "reviewer", "authority": "internal_reviewer_suggestion", "stage": "reviewer_0"}}'


def _say(uid, seq, protocol, stage, sender, content, role="agent", kind="message", uid_of=None, before=None, extra=None):
    return (uid, seq, protocol, kind, stage, sender, role, content, uid_of, before, extra)


PER = [
    _say(1, 0, "per", "executor_0", "Executor", "so \\boxed{12}"),
    _say(1, 1, "per", "reviewer_0", "Reviewer", "Diagnosis: a slip.\nCandidate Answer: \\boxed{12}"),
    _say(1, 2, "per", "reviewer_0_candidate_memory", "system", "", "system", "summary", None, "sequence:1", MEMORY),
    _say(1, 3, "per", "executor_0", "Executor", "so \\boxed{\\frac{1}{2}}"),
    _say(1, 4, "per", "solver_submission", "system", "Submitted: \\boxed{\\frac{1}{2}}", "system"),
    _say(1, 5, "per", "evaluation", "Evaluator", "Evaluation signal: PASS", "evaluator"),
]
BROADCAST = [
    _say(2, 0, "broadcast", "discussion_0", "Ann", "I say \\boxed{7}"),
    _say(2, 1, "broadcast", "candidate_review_0", "system", "Source: Ann\nCandidate under review: \\boxed{7}", "system"),
    _say(2, 2, "broadcast", "approval_0", "Bob", "Review Position: needs_revision"),
    _say(2, 3, "broadcast", "approval_0", "Eve", "Review Position: approve"),
    _say(2, 4, "broadcast", "approval_0_candidate_update", "system", "Candidate updated from \\boxed{7} to \\boxed{8}", "system"),
    _say(2, 5, "broadcast", "approval_0_candidate_update", "system", "Candidate updated from \\boxed{7} to \\boxed{9}", "system"),
    _say(2, 6, "broadcast", "approval_1_candidate_update", "system", "Current Candidate For Further Review:\n\\boxed{\"x\", 1}", "system"),
    _say(2, 7, "broadcast", "discussion_1", "Bob", "then \\boxed{8}"),
    _say(2, 8, "broadcast", "candidate_review_1", "system", "Source: Bob\nCandidate under review: \\boxed{8}", "system"),
]


def _meta(spark, *rows):
    return spark.createDataFrame([(u, p, u, "d", "s", m, "e", "final", "logged") for u, p, m in rows], META)


def _rows(spark, log, meta):
    log = events.classify(spark.createDataFrame(log, LOG))
    return details.checked(details.detail_rows(log, transitions.frozen_labels(log), details.trajectories(meta, [("d", "s", "m0")])))


def test_both_protocols_in_full(spark):
    found = _rows(spark, PER + BROADCAST, _meta(spark, (1, "per", "m0"), (2, "broadcast", "m1"), (3, "single", "m0")))
    assert len(found.columns) == len(set(found.columns)) == 59
    per, group = found.orderBy("trajectory_uid").collect()
    assert per.matrix_4x2x5 and not group.matrix_4x2x5 and per.review_id == "1.symmetric_review.1"
    assert per.review_memory_link_status == "linked" and per.review_route_observed and per.review_memory_event_uid == "sequence:2" and per.review_memory_sequence_index == 2
    assert (per.answer_before, per.answer_after, per.before_correct, per.after_correct, per.after_correct_source) == ("12", "\\frac{1}{2}", None, True, "runtime_evaluator_submission_sequence_4")
    assert per.strict_pre_gate_eligible and per.transition_outcome == "changed_correctness_unlabeled" and per.system_selected_answers_json == "[]"
    assert (group.review_sequence_start, group.review_sequence_end, group.before_sender, group.after_sender, group.after_stage) == (2, 3, "Ann", "Bob", "discussion_1")
    assert group.system_selected_answers_json == '["8", "\\"x\\", 1"]' and group.intervening_system_candidate_updates == 2
    assert group.primary_eligibility_bucket == "gate_confounded" and group.status == "actor_response_after_protocol_selection"
    assert group.review_memory_link_status == details.NO_MEMORY and group.review_memory_sequence_index == -1 and group.before_correct_source == ""


def test_metadata_that_does_not_fit_fails_the_job(spark):
    with pytest.raises(Exception, match="has no events"):
        _rows(spark, PER, _meta(spark, (1, "per", "m0"), (9, "per", "m0"))).collect()
    with pytest.raises(Exception, match="has no events"):
        _rows(spark, PER, _meta(spark, (1, "broadcast", "m0"))).collect()
    with pytest.raises(Exception, match="comes twice"):
        _rows(spark, PER, _meta(spark, (1, "per", "m0"), (1, "per", "m1"))).collect()
    alone = _rows(spark, PER + BROADCAST, _meta(spark, (2, "broadcast", "m0"))).collect()
    assert [r.trajectory_uid for r in alone] == [2]
    assert _rows(spark, PER, _meta(spark, (1, "per", "m0")).where("false")).collect() == []
    members = details.trajectories(_meta(spark, (1, "per", "m0"), (2, "per", "m1"), (3, None, "m0")), [("d", "s", "m1")], only_members=True)
    assert [(r.uid, r.matrix) for r in members.collect()] == [(2, True)]


@pytest.fixture(scope="module")
def sound(spark):
    """A sound PER row, by itself, so that a test doesn't work it out again."""
    found = _rows(spark, PER, _meta(spark, (1, "per", "m0")))
    return spark.createDataFrame(found.collect(), found.schema)


@pytest.mark.parametrize("name, value, message", [
    ("actor_turn_observed", False, "response without a turn"), ("actor_response_observed", False, "without a response"), ("primary_eligibility_bucket", "no_after", "another bucket"),
    ("review_memory_action", "review_note", "without a valid memory record"), ("review_memory_immediate", False, "fails a check"), ("protocol", "broadcast", "outside PER"),
    ("system_selected_answer_used_as_after", True, "the system chose"), ("after_sender", " Evaluator", "no actor"), ("after_stage", "poll_1", "an actor's"),
])
def test_rows_that_contradict_themselves_fail_the_job(sound, name, value, message):
    assert details.checked(sound).count() == 1
    kind = dict(sound.dtypes)[name]
    with pytest.raises(Exception, match=message):
        details.checked(sound.withColumn(name, F.lit(value).cast(kind))).collect()


def test_what_an_update_chose(spark):
    said = ["Candidate updated from \\boxed{1} to \\boxed{2}", "candidate UPDATED from \\boxed{1}", "Current  candidate for further review : the final answer is 5.", "new: \\boxed{3}", "nothing", "", None, "\\boxed{4} Current Candidate For Further Review: "]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(said)], "i int, c string")
    assert [r.a for r in d.select("i", text.updated_answer(F.col("c")).alias("a")).orderBy("i").collect()] == ["2", "1", "5", "3", "", "", "", "4"]


def test_preferred_sender_or_the_latest(spark):
    rows = [(1, 0, "Ann", True, False, None), (1, 1, "Bob", True, False, None), (1, 2, "sys", False, False, " ANN "), (1, 3, "sys", False, False, "Eve"), (1, 4, "sys", False, False, ""), (1, 5, "sys", False, True, None), (1, 6, "sys", False, False, "Ann"), (1, 7, None, True, False, None), (1, 8, "sys", False, False, "Ann"), (2, 0, "Ann", True, False, "Ann")]
    e = spark.createDataFrame(rows, "uid long, seq long, sender string, is_actor boolean, is_submission boolean, source string")
    found = transitions.previous_actor(e, F.col("source").isNotNull(), F.col("source")).orderBy("uid", "seq").collect()
    assert [tuple(r) for r in found] == [(1, 2, "ann", 0, "Ann", True), (1, 3, "eve", 1, "Bob", False), (1, 4, "", 1, "Bob", False), (1, 6, "ann", None, None, False), (1, 8, "ann", 7, None, False), (2, 0, "ann", None, None, False)]
