"""The registered queries' SQL for DuckDB: named parts and what is made of them."""

from __future__ import annotations

from .adapter import STEPS_SQL

KEYS = "'d' || (uid % 5) AS dataset, 'm' || ((uid // 2) % 2) AS actor, 1 + uid % 10 AS tier, uid // 2 AS problem"

PER = """
  p0 AS (SELECT *, count_if(kind = 'submission') OVER (PARTITION BY uid ORDER BY seq) AS seg FROM s WHERE protocol = 'per' AND kind IN ('executor', 'review', 'submission')),
  p1 AS (SELECT *, last_value(CASE WHEN kind = 'executor' THEN seq END IGNORE NULLS) OVER bw AS bseq, last_value(CASE WHEN kind = 'executor' THEN lower(answer) END IGNORE NULLS) OVER bw AS bkey,
    lead(kind) OVER nw AS nk, lead(seq) OVER nw AS ns, lead(lower(answer)) OVER nw AS na FROM p0
    WINDOW bw AS (PARTITION BY uid, seg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), nw AS (PARTITION BY uid ORDER BY seq)),
  per AS (SELECT uid, 'per' AS protocol, seq AS review_seq, row_number() OVER (PARTITION BY uid ORDER BY seq) AS review_number,
    CASE WHEN k < 40 THEN 'revise' WHEN k < 70 THEN 'agree' ELSE 'unknown' END AS action, bseq AS before_seq, bkey AS before_key,
    CASE WHEN nk = 'executor' THEN ns END AS after_seq, CASE WHEN nk = 'executor' THEN na END AS after_key, coalesce(nk = 'executor', false) AS actor_turn_observed, 0::BIGINT AS updates,
    CASE WHEN bseq IS NULL THEN 'missing_actor_candidate_before' WHEN nk = 'executor' THEN 'actor_response_before_gate' WHEN nk = 'submission' THEN 'no_actor_response_before_submission'
      WHEN nk = 'review' THEN 'no_actor_response_before_next_review' ELSE 'no_actor_response_observed' END AS status,
    CASE WHEN bseq IS NULL THEN 'no_executor_candidate_since_previous_submission' WHEN nk = 'executor' THEN '' WHEN nk = 'submission' THEN 'submission_precedes_next_executor_candidate'
      WHEN nk = 'review' THEN 'additional_review_precedes_executor_response' ELSE 'no_next_executor_candidate' END AS exclusion_reason
    FROM p1 WHERE kind = 'review')"""

BROADCAST = """
  e0 AS (SELECT *, count_if(kind IN ('anchor', 'submission')) OVER (PARTITION BY uid ORDER BY seq) AS iv FROM s WHERE protocol = 'broadcast'),
  e1 AS (SELECT *, max(CASE WHEN kind = 'approval' THEN seq END) OVER (PARTITION BY uid, iv) AS last_review FROM e0),
  i0 AS (SELECT uid, iv, max(CASE WHEN kind IN ('anchor', 'submission') THEN kind END) AS opens, max(CASE WHEN kind IN ('anchor', 'submission') THEN seq END) AS open_seq,
    max(CASE WHEN kind = 'anchor' THEN lower(c_sender) END) AS source, max(CASE WHEN kind = 'anchor' THEN lower(c_answer) END) AS reviewed, max(last_review) AS last_review,
    count(DISTINCT CASE WHEN kind = 'update' THEN k % 2 END) AS updates, coalesce(bool_or(kind = 'discussion' AND seq > last_review), false) AS acted,
    bool_and(CASE WHEN kind = 'approval' THEN k < 50 END) AS all_approve FROM e1 GROUP BY uid, iv),
  i1 AS (SELECT *, lead(opens) OVER w AS n_opens, lead(source) OVER w AS n_source, lead(reviewed) OVER w AS n_reviewed FROM i0 WINDOW w AS (PARTITION BY uid ORDER BY iv)),
  act AS (SELECT uid, iv, lower(sender) AS s_by, lower(answer) AS s_key, seq, seq > last_review AS late FROM e1 WHERE kind = 'discussion'),
  bef AS (SELECT uid, iv + 1 AS iv, s_by, s_key, max(seq) AS before_seq FROM act GROUP BY ALL),
  aft AS (SELECT uid, iv, s_by, s_key, max(seq) AS after_seq FROM act WHERE late GROUP BY uid, iv, s_by, s_key),
  i2 AS (SELECT i.*, bef.before_seq, aft.after_seq FROM (SELECT * FROM i1 WHERE opens = 'anchor' AND last_review IS NOT NULL) i
    LEFT JOIN bef ON bef.uid = i.uid AND bef.iv = i.iv AND bef.s_by = i.source AND bef.s_key = i.reviewed
    LEFT JOIN aft ON aft.uid = i.uid AND aft.iv = i.iv AND aft.s_by = i.n_source AND aft.s_key = i.n_reviewed AND i.n_opens = 'anchor'),
  bro AS (SELECT uid, 'broadcast' AS protocol, open_seq AS review_seq, row_number() OVER (PARTITION BY uid ORDER BY iv) AS review_number,
    CASE WHEN all_approve THEN 'agree' ELSE 'revise' END AS action, before_seq, CASE WHEN before_seq IS NOT NULL THEN reviewed END AS before_key,
    after_seq, CASE WHEN after_seq IS NOT NULL THEN n_reviewed END AS after_key, acted AS actor_turn_observed, updates,
    CASE WHEN before_seq IS NULL THEN 'missing_actor_candidate_before' WHEN n_opens = 'anchor' AND after_seq IS NOT NULL AND updates > 0 THEN 'actor_response_after_protocol_selection'
      WHEN n_opens = 'anchor' AND after_seq IS NOT NULL THEN 'actor_response_before_gate' WHEN n_opens = 'anchor' AND acted THEN 'actor_response_unlinked_to_next_review'
      WHEN n_opens = 'anchor' THEN 'no_actor_response_before_next_review' WHEN n_opens = 'submission' THEN 'no_actor_response_before_submission'
      WHEN acted THEN 'actor_response_unlinked_no_next_review_anchor' ELSE 'no_actor_response_observed' END AS status,
    CASE WHEN before_seq IS NULL THEN 'review_anchor_not_linked_to_actor_source_answer' WHEN n_opens = 'anchor' AND after_seq IS NOT NULL AND updates > 0 THEN 'system_selected_reviewer_proposal_before_actor_response'
      WHEN n_opens = 'anchor' AND after_seq IS NOT NULL THEN '' WHEN n_opens = 'anchor' AND acted THEN 'next_review_anchor_not_linked_to_actor_source_answer'
      WHEN n_opens = 'anchor' THEN 'next_group_review_precedes_actor_response' WHEN n_opens = 'submission' THEN 'consensus_or_submission_precedes_actor_response'
      WHEN acted THEN 'actor_turn_has_no_subsequent_review_anchor' ELSE 'no_linked_later_actor_candidate' END AS exclusion_reason FROM i2)"""

LABELS = """
  f0 AS (SELECT *, coalesce(count_if(kind IN ('pass', 'fail')) OVER (PARTITION BY uid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM s WHERE protocol = 'per' AND kind IN ('submission', 'pass', 'fail')),
  f1 AS (SELECT *, last_value(CASE WHEN kind = 'submission' THEN lower(answer) END IGNORE NULLS) OVER w AS pa, last_value(CASE WHEN kind = 'submission' THEN seq END IGNORE NULLS) OVER w AS ps
    FROM f0 WINDOW w AS (PARTITION BY uid, seg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  lab AS (SELECT uid, pa AS answer_key, CASE WHEN bool_and(kind = 'pass') = bool_or(kind = 'pass') THEN bool_and(kind = 'pass') END AS value, bool_and(kind = 'pass') <> bool_or(kind = 'pass') AS conflict,
    array_to_string(list_sort(list(DISTINCT 'runtime_evaluator_submission_sequence_' || ps)), '+') AS sources FROM f1 WHERE kind IN ('pass', 'fail') AND pa IS NOT NULL GROUP BY uid, pa),
  lab2 AS (SELECT uid, answer_key, value, conflict FROM lab UNION ALL SELECT uid + 1, answer_key, value, conflict FROM lab)"""

_UNALIGNED = f"""
  t AS (SELECT * FROM per UNION ALL SELECT * FROM bro),
  t1 AS (SELECT t.*, b.value AS before_correct, a.value AS after_correct, b.conflict AS before_conflict, a.conflict AS after_conflict,
    t.before_key IS NOT NULL AND t.after_key IS NOT NULL AS answer_pair_parsed FROM t LEFT JOIN lab2 b ON b.uid = t.uid AND b.answer_key = t.before_key LEFT JOIN lab2 a ON a.uid = t.uid AND a.answer_key = t.after_key),
  l AS (SELECT *, before_seq IS NOT NULL AND after_seq IS NOT NULL AND answer_pair_parsed AND updates = 0 AND exclusion_reason = '' AS strict,
    CASE WHEN status LIKE 'missing_actor%' OR status LIKE '%unlinked%' THEN 'source_link_failure' WHEN NOT actor_turn_observed THEN 'no_after' WHEN NOT answer_pair_parsed THEN 'parser_incomplete'
      WHEN updates > 0 THEN 'gate_confounded' WHEN exclusion_reason = '' THEN 'strict_pre_gate' ELSE 'other_non_strict' END AS bucket,
    CASE WHEN NOT answer_pair_parsed THEN 'not_evaluable_unparsed_actor_pair' WHEN before_key = after_key THEN 'unchanged' WHEN NOT before_correct AND after_correct THEN 'repaired'
      WHEN NOT before_correct AND NOT after_correct THEN 'changed_still_wrong' WHEN before_correct AND NOT after_correct THEN 'harmed' WHEN before_correct AND after_correct THEN 'changed_still_correct'
      ELSE 'changed_correctness_unlabeled' END AS transition_outcome, CASE WHEN answer_pair_parsed THEN before_key <> after_key END AS answer_changed, {KEYS} FROM t1)"""

#: Under the whole strict gate: a review that names another candidate than the answer before it isn't strict. And what review memory says.
LABELED = _UNALIGNED.replace("\n  l AS (", "\n  l0 AS (") + """,
  named AS (SELECT uid, seq AS review_seq, CASE WHEN k < 40 THEN lower(answer) END AS reviewed, k % 10 < 6 AS memory_valid, k % 10 < 3 AS route_observed FROM s WHERE protocol = 'per' AND kind = 'review'),
  l1 AS (SELECT l0.*, reviewed IS NOT NULL AND before_key IS NOT NULL AND reviewed <> before_key AS mismatch, coalesce(memory_valid, false) AS memory_valid, coalesce(route_observed, false) AS route_observed FROM l0 LEFT JOIN named USING (uid, review_seq)),
  l AS (SELECT * REPLACE (strict AND NOT mismatch AS strict, CASE WHEN bucket = 'strict_pre_gate' AND mismatch THEN 'other_non_strict' ELSE bucket END AS bucket) FROM l1)"""

#: What the record after a review lacks, by the review's k.
MEMORY = """
  me0 AS (SELECT *, lead(kind) OVER (PARTITION BY uid ORDER BY seq) AS nk FROM s WHERE protocol = 'per'),
  me AS (SELECT uid, seq AS review_seq, CASE WHEN k % 10 < 3 THEN 'review_route' WHEN k % 10 IN (7, 9) THEN '' ELSE 'review_note' END AS memory_action, CASE WHEN k % 10 < 6 THEN 'linked' WHEN k % 10 = 6 THEN 'authority_mismatch'
    WHEN k % 10 = 7 THEN 'malformed_extra_json|stage_mismatch|source_mismatch|authority_mismatch|missing_action' WHEN k % 10 = 8 THEN 'event_type_not_summary|previous_event_uid_mismatch' WHEN nk IS NULL THEN 'no_immediate_next_event'
    ELSE 'missing_extra_json|not_immediate_sequence|event_type_not_summary|' || CASE WHEN nk = 'submission' THEN '' ELSE 'not_system_authored|' END || 'stage_mismatch|previous_event_uid_mismatch|source_mismatch|authority_mismatch|missing_action' END AS link_status FROM me0 WHERE kind = 'review')"""

#: Parts of a detail row: memory records by the review's k, bounds of a group review, what updates chose, sources of labels. Sequences of PER are twice those of the steps.
DETAIL = """
  nx AS (SELECT uid, seq AS review_seq, k % 10 AS g, lead(kind) OVER w AS nk, lead(seq) OVER w AS ns, kind FROM s WHERE protocol = 'per' WINDOW w AS (PARTITION BY uid ORDER BY seq)),
  mem AS (SELECT me.*, g, nk, ns FROM me JOIN nx USING (uid, review_seq)),
  bounds AS (SELECT uid, iv, max(CASE WHEN kind = 'anchor' THEN seq END) AS review_seq, min(CASE WHEN kind = 'approval' THEN seq END) AS lo, max(CASE WHEN kind = 'approval' THEN seq END) AS hi FROM e0 GROUP BY uid, iv),
  sel AS (SELECT uid, iv, '[' || string_agg('"' || answer || '"', ', ' ORDER BY seq) || ']' AS chosen FROM (SELECT uid, iv, k % 2 AS side, min(seq) AS seq, arg_min(answer, seq) AS answer FROM e0 WHERE kind = 'update' GROUP BY ALL) GROUP BY uid, iv),
  labd AS (SELECT uid, pa AS answer_key, CASE WHEN bool_and(kind = 'pass') <> bool_or(kind = 'pass') THEN 'conflict:' ELSE '' END || array_to_string(list_sort(list(DISTINCT 'runtime_evaluator_submission_sequence_' || (2 * ps))), '+') AS source
    FROM f1 WHERE kind IN ('pass', 'fail') AND pa IS NOT NULL GROUP BY uid, pa),
  src AS (SELECT * FROM labd UNION ALL SELECT uid + 1, answer_key, source FROM labd)"""

FINALS = """
  fl AS (SELECT uid, pa AS answer_key, kind = 'pass' AS value, 'runtime_evaluator_submission_sequence_' || ps AS source FROM f1 WHERE kind IN ('pass', 'fail') AND pa IS NOT NULL
    UNION ALL SELECT uid, arg_max(lower(answer), seq), uid % 3 = 0, 'trajectory_final_correct' FROM s WHERE protocol = 'per' AND kind = 'submission' AND uid % 5 <> 0 GROUP BY uid),
  labf AS (SELECT uid, answer_key, CASE WHEN bool_and(value) = bool_or(value) THEN bool_and(value) END AS value, bool_and(value) <> bool_or(value) AS conflict, array_to_string(list_sort(list(DISTINCT source)), '+') AS sources FROM fl GROUP BY uid, answer_key)"""

ATTEMPTS = """
  a0 AS (SELECT *, 1 + coalesce(count_if(kind IN ('pass', 'fail')) OVER (PARTITION BY uid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS attempt, kind IN ('executor', 'submission') AS cand FROM s WHERE protocol = 'per'),
  att AS (SELECT uid, attempt, bool_or(kind = 'pass') AS passed, max(CASE WHEN kind IN ('pass', 'fail') THEN seq END) AS closed_seq, count(*) - 1 AS turns, arg_min(lower(answer), seq) FILTER (cand) AS first_key,
    arg_max(lower(answer), seq) FILTER (cand) AS last_key, count_if(cand)::BIGINT AS candidates, count(DISTINCT answer) FILTER (cand) AS distinct_candidates FROM a0 GROUP BY uid, attempt HAVING closed_seq IS NOT NULL),
  prob0 AS (SELECT uid, count(*) AS attempts, min(CASE WHEN passed THEN attempt END) AS first_success, arg_min(passed, attempt) AS first_passed, arg_max(passed, attempt) AS final_passed FROM att GROUP BY uid),
  prob AS (SELECT *, coalesce(first_success - 1, attempts) AS tries_before_success FROM prob0)"""


def over(body: str, *parts: str) -> str:
    return "WITH " + ",".join((STEPS_SQL, *parts)) + "\n" + body


def labeled(body: str) -> str:
    return over(body, PER, BROADCAST, LABELS, LABELED)


def rate(a: str, b: str) -> str:
    return f"round(({a})::DOUBLE / nullif({b}, 0), 9)"


def count(condition: str) -> str:
    return f"coalesce(count_if({condition}), 0)::BIGINT"


def summary(by: str) -> str:
    """All counters of a cell."""
    from ..operators.cells import ACTIONS, BUCKETS, OUTCOMES

    out = ["count(*) AS review_opportunities", f"{count('actor_turn_observed')} AS actor_turn_observed", f"{count('after_key IS NOT NULL')} AS actor_response_observed", f"{count('answer_pair_parsed')} AS answer_pair_parsed", f"{count('before_correct IS NOT NULL AND after_correct IS NOT NULL')} AS correctness_pair_labeled"]
    out += [f"""{count(f"bucket = '{b}'")} AS {b}""" for b in BUCKETS] + [f"""{count(f"action = '{a}'")} AS review_action_{a}""" for a in ACTIONS]
    out += [f"{count(c)} AS {n}" for c, n in (("before_conflict", "before_conflict"), ("after_conflict", "after_conflict"), ("coalesce(before_conflict, false) OR coalesce(after_conflict, false)", "any_conflict"))]
    for prefix, where in (("", ""), ("strict_", "bucket = 'strict_pre_gate' AND "), ("gate_", "bucket = 'gate_confounded' AND ")):
        out += [f"""{count(f"{where}transition_outcome = '{o}'")} AS {prefix}outcome_{o}""" for o in OUTCOMES]
        out += [f"""{count(f"{where}before_correct IS NOT NULL AND after_correct IS NOT NULL")} AS {prefix}correctness_pair_labeled"""] if prefix else []
    out += [f"{count('memory_valid')} AS review_memory_provenance_valid", f"{count('route_observed')} AS review_route_observed", *(f"""{count(f"route_observed AND action = '{a}'")} AS review_route_observed_action_{a}""" for a in ACTIONS)]
    return f"SELECT {by}, {', '.join(out)} FROM l GROUP BY {by}"


#: Labelled answers that were wrong before and stay, change and stay wrong, or change.
FOLLOWED = (("labeled_unchanged", " AND after_correct IS NOT NULL AND NOT answer_changed"), ("labeled_still_wrong", " AND NOT after_correct AND answer_changed"), ("changed_labeled", " AND after_correct IS NOT NULL AND answer_changed"))


def revise(by: str) -> str:
    out = []
    for p, b in (("strict", "strict_pre_gate"), ("gate", "gate_confounded")):
        h = f"action = 'revise' AND NOT before_correct AND bucket = '{b}'"
        out += [f"{count(h + c)} AS {p}_{n}" for n, c in (("pairs", ""), ("changed", " AND answer_changed"), ("unchanged", " AND NOT answer_changed"), ("labeled", " AND after_correct IS NOT NULL"), ("repaired", " AND after_correct"), *FOLLOWED)]
    rates = [f"{rate(f'{p}_{a}', f'{p}_{b}')} AS {p}_{n}" for p in ("strict", "gate") for n, a, b in (("uptake", "changed", "pairs"), ("coverage", "labeled", "pairs"), ("repair", "repaired", "labeled"))]
    return f"SELECT *, {', '.join(rates)} FROM (SELECT {by}, {', '.join(out)} FROM l GROUP BY {by})"


_FLAGS = {"immediate": "g < 9", "event_type_valid": "g < 8", "system_authored": "g < 9 OR nk = 'submission'", "stage_matches_review": "g < 7 OR g = 8", "previous_event_uid_matches_review": "g < 8", "source_matches_reviewer": "g < 7 OR g = 8", "authority_matches_reviewer": "g < 6 OR g = 8"}
_SCALE = "CASE WHEN l.protocol = 'per' THEN 2 ELSE 1 END"


def detail() -> str:
    """All 59 columns of a detail row."""
    side = lambda s: f"""coalesce({s[0]}.seq * {_SCALE}, -1) AS {s}_sequence_index, coalesce({s[0]}.sender, '') AS {s}_sender, coalesce({s[0]}.stage, '') AS {s}_stage, coalesce({s[0]}.answer, '') AS answer_{s},
      {s}_correct, coalesce(t{s[0]}.source, '') AS {s}_correct_source"""  # noqa: E731
    turn = "(SELECT uid, seq, CASE WHEN protocol = 'per' THEN 'Executor' ELSE sender END AS sender, CASE WHEN protocol = 'per' THEN 'executor_0' ELSE 'discussion_0' END AS stage, answer FROM s)"
    said = lambda yes, text: f"CASE WHEN {yes} THEN {text} ELSE '' END"
    body = f"""SELECT dataset, 's' || ((l.uid // 4) % 2) AS slice_id, l.actor AS actor_family, 'e' || (l.uid % 3) AS evaluator_model_id, l.protocol, CASE WHEN l.uid % 7 = 0 THEN 'provisional' ELSE 'final' END AS release_status,
      CASE WHEN l.uid % 11 = 0 THEN 'rebuilt' ELSE 'logged' END AS provenance_status, (l.uid // 4) % 2 = 0 AS matrix_4x2x5, l.uid AS trajectory_uid, problem AS problem_uid, l.uid || '.symmetric_review.' || review_number AS review_id, action AS review_action,
      CASE WHEN g < 9 THEN 'sequence:' || (2 * l.review_seq + 1) WHEN ns IS NOT NULL THEN 'u' || ns ELSE '' END AS review_memory_event_uid, coalesce(CASE WHEN g < 9 THEN 2 * l.review_seq + 1 ELSE 2 * ns END, -1) AS review_memory_sequence_index,
      coalesce(memory_action, '') AS review_memory_action, {said("g < 7 OR g = 8", "'Reviewer'")} AS review_memory_source, {said("g < 7 OR g = 8", "CASE WHEN g = 6 THEN 'actor' ELSE 'internal_reviewer_suggestion' END")} AS review_memory_authority,
      {said("g < 7 OR g = 8", "'reviewer_0'")} AS review_memory_stage, {said("g < 9", "CASE WHEN g = 8 THEN 'u-1' ELSE 'u' || l.review_seq END")} AS review_memory_previous_event_uid,
      {", ".join(f"coalesce({c}, false) AS review_memory_{n}" for n, c in _FLAGS.items())}, coalesce(link_status = 'linked', false) AS review_memory_provenance_valid, coalesce(link_status, 'not_applicable_broadcast_group_review') AS review_memory_link_status,
      coalesce(link_status = 'linked' AND memory_action = 'review_route', false) AS review_route_observed, coalesce(lo, 2 * l.review_seq) AS review_sequence_start, coalesce(hi, 2 * l.review_seq) AS review_sequence_end, {side("before")}, {side("after")},
      CASE WHEN l.protocol = 'per' THEN 'immediate_previous_executor' WHEN before_seq IS NOT NULL THEN 'anchor_source_answer_match_actor_event' ELSE '' END AS before_candidate_link_method,
      CASE WHEN after_seq IS NULL THEN '' WHEN l.protocol = 'per' THEN 'immediate_next_executor' ELSE 'next_anchor_source_answer_match_actor_event' END AS after_candidate_link_method,
      CASE WHEN before_seq IS NULL THEN 'missing_actor_before' WHEN l.protocol = 'broadcast' THEN 'match' WHEN nm.reviewed IS NULL THEN 'structural_match' WHEN mismatch THEN 'mismatch' ELSE 'match' END AS candidate_alignment,
      actor_turn_observed, after_seq IS NOT NULL AS actor_response_observed, answer_pair_parsed, strict AS strict_pre_gate_eligible, updates AS intervening_system_candidate_updates, coalesce(chosen, '[]') AS system_selected_answers_json,
      false AS system_selected_answer_used_as_after, status, exclusion_reason, answer_changed, before_correct IS NOT NULL AND after_correct IS NOT NULL AS correctness_pair_labeled, transition_outcome, bucket AS primary_eligibility_bucket
    FROM l LEFT JOIN mem ON mem.uid = l.uid AND mem.review_seq = l.review_seq LEFT JOIN bounds o ON o.uid = l.uid AND o.review_seq = l.review_seq LEFT JOIN sel ON sel.uid = o.uid AND sel.iv = o.iv
      LEFT JOIN named nm ON nm.uid = l.uid AND nm.review_seq = l.review_seq LEFT JOIN {turn} b ON b.uid = l.uid AND b.seq = l.before_seq LEFT JOIN {turn} a ON a.uid = l.uid AND a.seq = l.after_seq
      LEFT JOIN src tb ON tb.uid = l.uid AND tb.answer_key = l.before_key LEFT JOIN src ta ON ta.uid = l.uid AND ta.answer_key = l.after_key"""
    return over(body, PER, BROADCAST, LABELS, LABELED, MEMORY, DETAIL)


_Z = 1.959963984540054
MATRIX = f"""
  grid AS (SELECT dataset, actor, protocol FROM (SELECT unnest(['d0', 'd1', 'd2', 'd3', 'd4', 'd5']) AS dataset), (SELECT unnest(['m0', 'm1']) AS actor), (SELECT unnest(['per', 'broadcast']) AS protocol)),
  m0 AS (SELECT dataset, actor, protocol, {count("action = 'revise' AND NOT before_correct")} AS precision_k, {count("action = 'revise' AND before_correct IS NOT NULL")} AS precision_n,
    {count("action = 'revise' AND bucket = 'strict_pre_gate' AND NOT before_correct AND answer_changed")} AS uptake_k, {count("action = 'revise' AND bucket = 'strict_pre_gate' AND NOT before_correct")} AS uptake_n,
    {count("action = 'revise' AND bucket = 'strict_pre_gate' AND NOT before_correct AND after_correct")} AS repair_k, {count("action = 'revise' AND bucket = 'strict_pre_gate' AND NOT before_correct AND after_correct IS NOT NULL")} AS repair_n FROM l GROUP BY ALL),
  m1 AS (SELECT grid.*, {", ".join(f"coalesce({k}_{x}, 0) AS {k}_{x}" for k in ("precision", "uptake", "repair") for x in "kn")} FROM grid LEFT JOIN m0 USING (dataset, actor, protocol)),
  m AS (SELECT *, {", ".join(f"{k}_k::DOUBLE / nullif({k}_n, 0) AS {k}_rate" for k in ("precision", "uptake", "repair"))}, uptake_n < 20 AS sparse FROM m1)"""


def _wilson(k: str, sign: str) -> str:
    p, n = f"{k}_rate", f"{k}_n"
    x = f"({p} + {_Z * _Z} / (2 * {n}) {sign} {_Z} * sqrt({p} * (1 - {p}) / {n} + {_Z * _Z} / (4 * {n}::DOUBLE * {n}))) / (1 + {_Z * _Z} / {n})"
    return f"CASE WHEN {n} > 0 THEN round({'greatest(0.0, ' if sign == '-' else 'least(1.0, '}{x}), 9) END"


def matrix() -> str:
    cols = [f"{k}_k, {k}_n, round({k}_rate, 9) AS {k}_rate, {_wilson(k, '-')} AS {k}_lo, {_wilson(k, '+')} AS {k}_hi" for k in ("precision", "uptake", "repair")]
    return over(f"SELECT dataset, actor, protocol, {', '.join(cols)}, {rate('repair_n', 'uptake_n')} AS label_coverage, sparse FROM m", PER, BROADCAST, LABELS, LABELED, MATRIX)


def directions() -> str:
    side = ", ".join(f"max(CASE WHEN protocol = '{p}' THEN {k}_rate END) AS {p}_{k}" for p in ("per", "broadcast") for k in ("precision", "uptake", "repair"))
    sparse = ", ".join(f"bool_or(protocol = '{p}' AND sparse) AS {p}_sparse" for p in ("per", "broadcast"))
    body = f"""SELECT count(*) AS cells, {count("per_precision > broadcast_precision")} AS precision_per_above, {count("per_precision > per_repair")} AS per_precision_above_repair,
      {count("broadcast_precision > broadcast_repair")} AS broadcast_precision_above_repair, {count("broadcast_uptake > per_uptake")} AS uptake_broadcast_above, {count("broadcast_repair > per_repair")} AS repair_broadcast_above,
      {count("per_sparse")} AS per_sparse_cells, {count("broadcast_sparse")} AS broadcast_sparse_cells FROM (SELECT dataset, actor, {side}, {sparse} FROM m GROUP BY dataset, actor)"""
    return over(body, PER, BROADCAST, LABELS, LABELED, MATRIX)


VIOLATIONS = ["buckets_partition_reviews", "actions_partition_reviews", "outcomes_partition_parsed", "strict_within_parsed", "strict_has_no_update", "strict_has_after", "repaired_means_wrong_to_right", "after_follows_review", "before_precedes_review"]
