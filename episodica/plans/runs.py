"""Queries over what models and evaluators write, rendered from the driver's events, and over whole runs. The SQL works from what each event stands for, without text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import outputs as O
from ..operators import attempts as A
from ..operators import runs as R
from . import adapter, sql
from .catalog import _labeled, _parsed, _problems
from .registry import query


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return adapter.steps(spark, d).select("uid", "seq", "protocol", "kind", "answer", "k", "problem", "actor", "dataset")


def _said(*parts):
    """Parts in a row; strings that begin with `.` name a column."""
    return F.concat(*(F.col(p[1:]).cast("string") if p.startswith(".") else F.lit(p) for p in parts))


@query(sql.over("SELECT uid, seq, CASE WHEN k % 7 < 6 THEN k END AS score, CASE WHEN k % 7 IN (0, 1, 3, 5) THEN true WHEN k % 7 = 2 THEN false END AS ok, CASE WHEN k % 7 = 5 THEN answer END AS inner_answer FROM s"))
def json_objects(spark, d):
    """Objects in a fence, in prose, in quotes of other languages, unclosed, nested, or none."""
    m = F.col("k") % 7
    text = (
        F.when(m == 0, _said('{"score": ', ".k", ', "ok": true}')).when(m == 1, _said('So it is:\n```json\n{"score": ', ".k", ', "ok": true}\n```\nDone.'))
        .when(m == 2, _said('I say {"score": ', ".k", ', "ok": false,} and no more')).when(m == 3, _said("{'score': ", ".k", ", 'ok': True}"))
        .when(m == 4, _said("{score: ", ".k", ', "ok": null')).when(m == 5, _said('I { "more": {"answer": "', ".answer", '", "note": "a } b"}, "score": ', ".k", ', "ok": true }')).otherwise("nothing {here}")
    )
    x = _steps(spark, d).select("uid", "seq", O.json_object(text, "score bigint, ok boolean, more struct<answer: string>").alias("o"))
    return x.select("uid", "seq", "o.score", "o.ok", F.col("o.more.answer").alias("inner_answer"))


@query(sql.over("""SELECT uid, seq, CASE WHEN k % 4 = 3 THEN 1 ELSE k END AS score, k % 2 = 0 AS sure, CASE WHEN k % 3 = 0 THEN '\\boxed{' || answer || '}' ELSE '' END AS answer FROM s"""))
def labelled_fields(spark, d):
    box = F.when(F.col("k") % 3 == 0, _said("Candidate: first \\boxed{Z}, then \\boxed{", ".answer", "}")).otherwise("Candidate: none")
    text = F.concat(F.when(F.col("k") % 4 == 3, "no number").when(F.col("k") % 4 == 1, _said('"Score" = ', ".k")).otherwise(_said("score: ", ".k")), F.when(F.col("k") % 2 == 0, "\nSURE: True\n").otherwise("\n"), box)
    return _steps(spark, d).select("uid", "seq", O.int_field(text, "score").alias("score"), O.bool_field(text, "sure").alias("sure"), O.boxed_field(text, ["Final", "candidate"]).alias("answer"))


@query(sql.over("""SELECT uid, seq, CASE WHEN k % 5 <> 4 THEN k % 10 END AS correctness, CASE WHEN k % 5 <> 4 THEN 3 END AS clarity, CASE WHEN k % 5 <> 4 THEN 'see ' || answer END AS advice,
  k % 3 = 0 AS agrees, CASE WHEN k % 3 = 0 THEN '' ELSE 'no, ' || answer END AS criticism FROM s"""))
def model_verdicts(spark, d):
    k = F.col("k")
    report = F.concat(F.lit("\n1. Correctness: "), k % 10, F.when(k % 5 == 4, "\n").otherwise("\n\n\n2. Clarity: 3\n"), _said("3. Advice: see ", ".answer"))
    critic = F.when(k % 3 == 0, _said(" [Agree] ", ".answer")).otherwise(_said("[Disagree]  no, ", ".answer", "\n"))
    x = _steps(spark, d).select("uid", "seq", O.scored(report, ["Correctness", "Clarity"]).alias("r"), O.critique(critic).alias("c"))
    return x.select("uid", "seq", F.col("r.scores")[0].alias("correctness"), F.col("r.scores")[1].alias("clarity"), "r.advice", "c.agrees", "c.criticism")


@query(sql.over("""SELECT uid, seq, CASE WHEN k % 4 < 2 THEN answer WHEN k % 4 = 2 THEN answer || chr(10) || '## Jusfication' || chr(10) || 'it is ' || k END AS answer, CASE WHEN k % 4 <> 2 THEN CASE WHEN k % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END END AS verdict,
  CASE WHEN k % 4 <> 1 THEN 'it is ' || k END AS justification FROM s"""))
def judge_reports(spark, d):
    """Without a verdict nothing ends the answer but a header on the last line."""
    k = F.col("k")
    text = F.concat(
        F.when(k % 4 == 3, "# Report\n").otherwise(_said("# Report\r\n## Student FinalĠAnswer\n\n", ".answer", "\n")),
        F.when(k % 4 == 2, "\n").otherwise(F.concat(F.lit("\n## Equivalence  Judgement\n"), F.when(k % 2 == 0, "TRUE").otherwise("False"))),
        F.when(k % 4 == 1, "").when(k % 4 == 0, _said("\n## J us t i fica tion\n: it\tis ", ".k", " #\n=== report over ===\nx")).otherwise(_said("\n## Jusfication\nit is ", ".k")),
    )
    return _steps(spark, d).select("uid", "seq", O.judge_report(text).alias("r")).select("uid", "seq", "r.*")


@query(sql.over("""SELECT uid, seq, CASE WHEN k % 10 >= 5 THEN 'ignore' WHEN k >= 50 THEN 'accept' ELSE 'challenge' END AS by_model,
  CASE WHEN k % 10 >= 5 AND k < 50 AND seq % 10 < 5 THEN 'ignore' WHEN k >= 50 AND seq % 10 >= 5 THEN 'accept' ELSE 'challenge' END AS by_two_scores, 'accept' AS logged FROM s"""))
def critique_actions(spark, d):
    repair, harm, sure = F.col("k") / 100, F.col("k") % 10 / 10, F.col("seq") % 10 / 10
    return _steps(spark, d).select(
        "uid", "seq", O.intervention(repair, harm)["action"].alias("by_model"), O.intervention(repair, harm, sure)["action"].alias("by_two_scores"), O.intervention(repair, harm, sure, log_only=True)["action"].alias("logged")
    )


@query(sql.over("""SELECT uid, seq, CASE kind WHEN 'submission' THEN 'protocol_candidate_selection_not_correctness' WHEN 'pass' THEN 'external_evaluator_signal' WHEN 'fail' THEN 'external_evaluator_signal'
  WHEN 'update' THEN 'system_protocol_event_not_correctness' WHEN 'review' THEN 'internal_reviewer_suggestion' WHEN 'approval' THEN 'peer_or_agent_suggestion' WHEN 'executor' THEN 'internal_candidate_proposal'
  ELSE 'internal_observation' END AS authority, CASE WHEN k % 3 = 0 THEN 'executor' ELSE 'planner' END AS route FROM s"""))
def authority_and_route(spark, d):
    kind = F.col("kind")
    action = F.when(kind == "submission", "Select_Revision").when(kind == "approval", "approve").when(kind == "executor", "propose").otherwise("note")
    source = F.when(kind.isin("submission", "update"), "system").when(kind == "pass", "Evaluator").when(kind == "review", "Reviewer").otherwise("Solver")
    stage = F.when(kind == "fail", "evaluation").otherwise("turn")
    route = O.fail_route(F.when(F.col("k") % 3 == 0, "Mind the UNITs").otherwise("the sum is wrong"), F.lit(None).cast("string"))
    return _steps(spark, d).select("uid", "seq", O.authority(action, source, stage).alias("authority"), route.alias("route"))


# Runs


def _run_log(spark: SparkSession, d: str) -> DataFrame:
    """The log with votes as polls, rounds of ten steps, routes in some reviews and a decision after some submissions."""
    x = adapter.messages(spark, d)
    poll, review, decision = F.col("stage") == "approval_0", F.col("stage") == "reviewer_0", F.col("stage").endswith("_submission") & (F.col("k") % 3 < 2)
    k = F.col("k")
    content = F.when(poll, F.concat(F.lit("intent = hold\nscore = "), k * 2 - 40)).when(review & (k % 4 == 0), F.concat("content", F.lit(" [route: Executor]")))
    said = F.when(k % 3 == 0, R.ACCEPTED).otherwise(R.REJECTED)
    return x.select(
        "uid", "seq", F.floor(F.col("seq") / 10).alias("round"), F.when(poll, "poll").otherwise(F.col("event_type")).alias("event_type"), F.when(poll, F.concat(F.lit("poll_"), k % 3)).when(decision, "system").otherwise(F.col("stage")).alias("stage"),
        F.when(decision, "system").otherwise(F.col("sender")).alias("sender"), F.when(decision, said).otherwise(F.coalesce(content, F.col("content"))).alias("content"),
    )


_COLLECTED = """
  co AS (SELECT uid, count_if(kind NOT IN ('anchor', 'update', 'submission'))::BIGINT AS messages, count(DISTINCT CASE WHEN kind IN ('discussion', 'approval') THEN sender WHEN kind = 'executor' THEN 'Executor' WHEN kind = 'review' THEN 'Reviewer' WHEN kind IN ('pass', 'fail') THEN 'Evaluator' END) AS speakers,
    count(DISTINCT seq // 10) AS rounds, count_if(kind = 'approval')::BIGINT AS polls, coalesce(sum(CASE WHEN kind = 'approval' THEN greatest(1, least(100, k * 2 - 40)) END), 0)::BIGINT AS confidence_sum,
    count_if(kind IN ('pass', 'fail'))::BIGINT AS evaluations, count_if(kind = 'pass')::BIGINT AS passes, arg_min(kind = 'pass', seq) FILTER (kind IN ('pass', 'fail')) AS first_passed,
    count_if(kind = 'review' AND k >= 40 AND k < 70)::BIGINT AS agrees, count_if(kind = 'review' AND k % 4 = 0)::BIGINT AS reroutes,
    coalesce(arg_max(k % 3 = 0, seq) FILTER (kind = 'submission' AND k % 3 < 2)::INT, -1)::BIGINT AS correct, coalesce(arg_max(answer, seq) FILTER (kind = 'executor'), '') AS predicted FROM s GROUP BY uid)"""


@query(sql.over("SELECT * FROM co", _COLLECTED))
def run_collected(spark, d):
    return R.collect(_run_log(spark, d))


_EXAMPLES = """
  ex AS (SELECT co.*, prob.first_success, prob.attempts, co.messages * 7 + uid AS tokens FROM co LEFT JOIN prob USING (uid))"""


def _examples(spark: SparkSession, d: str) -> DataFrame:
    tries = _problems(spark, d).select("uid", "first_success", "attempts")
    return R.collect(_run_log(spark, d)).join(tries, "uid", "left").withColumn("tokens", F.col("messages") * 7 + F.col("uid"))


@query(sql.over("""SELECT count(*) AS examples, count_if(correct >= 0)::BIGINT AS scored, round(count_if(correct = 1) / count_if(correct >= 0), 4) AS accuracy, round(count_if(correct >= 0 AND first_passed) / count_if(correct >= 0), 4) AS first_accuracy,
  sum(tokens)::BIGINT AS total_tokens, (sum(tokens)::BIGINT // count(*))::BIGINT AS avg_tokens, round(avg(messages), 2) AS avg_messages, round(avg(rounds), 2) AS avg_rounds, round(avg(evaluations), 2) AS avg_evaluations,
  round(avg(first_success) FILTER (correct >= 0), 2) AS avg_attempts_to_success, sum(polls)::BIGINT AS total_polls, round(sum(confidence_sum) / sum(polls), 2) AS avg_confidence FROM ex""", sql.ATTEMPTS, _COLLECTED, _EXAMPLES))
def run_totals(spark, d):
    return R.summary(_examples(spark, d))


@query(sql.over("""SELECT k, count_if(first_success = k)::BIGINT AS solved, round(count_if(first_success <= k) / count(*), 4) AS pass_at FROM (SELECT * FROM ex WHERE correct >= 0),
  (SELECT unnest(range(1, (SELECT max(attempts) FROM ex WHERE correct >= 0) + 1)) AS k) GROUP BY k""", sql.ATTEMPTS, _COLLECTED, _EXAMPLES))
def run_pass_at_attempt(spark, d):
    return R.pass_at_attempt(_examples(spark, d))


@query(sql.over("""SELECT uid, seq, CASE WHEN c.k % 4 = 0 THEN c.k < 50 ELSE v END AS value, CASE WHEN c.k % 4 = 0 THEN 'runtime_evaluator' WHEN v IS NOT NULL THEN 'cache' END AS source
  FROM (SELECT * FROM s WHERE kind = 'executor') c LEFT JOIN (SELECT problem, answer, arg_max(k < 50, seq) AS v FROM s WHERE kind = 'submission' AND protocol = 'per' GROUP BY ALL) USING (problem, answer)"""))
def label_cache(spark, d):
    s = _steps(spark, d).withColumns({"signature": F.lit("exact"), "gold": F.lit(None).cast("string")})
    candidates = s.where("kind = 'executor'").withColumn("runtime", F.when(F.col("k") % 4 == 0, F.col("k") < 50))
    cache = s.where("kind = 'submission' AND protocol = 'per'").select("signature", "problem", "gold", "answer", (F.col("k") < 50).alias("value"), F.col("seq").alias("position"))
    return R.look_up(candidates, cache, ["signature", "problem", "gold", "answer"]).select("uid", "seq", "value", "source")


_RISK = "CASE " + " ".join(f"WHEN status = '{s}' THEN {i}" for i, s in enumerate(R.RISK)) + " ELSE 9 END"


@query(sql.labeled(f"""SELECT dataset, actor, protocol, uid, review_seq, status FROM (SELECT *, row_number() OVER (PARTITION BY dataset, actor, protocol ORDER BY
  CASE WHEN protocol = 'broadcast' THEN {_RISK} ELSE (NOT actor_turn_observed)::INT END, CASE WHEN protocol = 'broadcast' THEN -updates ELSE (NOT answer_pair_parsed)::INT END, review_seq, uid) AS r FROM l) WHERE r = 1"""))
def audit_cases(spark, d):
    return R.audit_cases(_labeled(spark, d), ["dataset", "actor", "protocol"], [F.col("uid")]).select("dataset", "actor", "protocol", "uid", "review_seq", "status")


@query(sql.over("""SELECT c.problem, c.answer, c.n, coalesce(lo <> hi, false) AS conflict, CASE WHEN lo = hi THEN lo ELSE c.answer = 'a' END AS value, CASE WHEN lo = hi THEN 'runtime_evaluator' ELSE 'exact' END AS source
  FROM (SELECT uid // 6 AS problem, lower(answer) AS answer, count(*) AS n FROM s WHERE kind IN ('executor', 'submission', 'discussion') GROUP BY ALL) c LEFT JOIN sl ON sl.problem = c.problem AND sl.answer = c.answer""", """
  sv AS (SELECT uid // 6 AS problem, kind, last_value(CASE WHEN kind IN ('executor', 'submission', 'discussion') THEN lower(answer) END IGNORE NULLS) OVER (PARTITION BY uid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS answer FROM s),
  sl AS (SELECT problem, answer, bool_and(kind = 'pass') AS lo, bool_or(kind = 'pass') AS hi FROM sv WHERE kind IN ('pass', 'fail') AND answer IS NOT NULL GROUP BY ALL)"""))
def submitted_labels_reused(spark, d):
    """Every candidate's label: what runs said of it wherever it was submitted to the problem, else whether it is the gold answer. Six users share a problem here."""
    log = _parsed(spark, d).withColumn("problem", F.floor(F.col("uid") / 6))
    before = F.last("answer_key", ignorenulls=True).over(Window.partitionBy("uid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    told = log.select("problem", before.alias("answer"), F.col("verdict").alias("passed"))
    candidates = log.where("answer_key IS NOT NULL").groupBy("problem", F.col("answer_key").alias("answer")).agg(F.count("*").alias("n")).withColumn("gold", F.lit("a"))
    return R.judge(R.with_submitted(candidates, R.submitted_labels(told, ["problem"]), ["problem"])).select("problem", "answer", "n", "conflict", "value", "source")


_SIGNALS = """
  ev AS (SELECT *, first_value(CASE WHEN kind IN ('pass', 'fail') THEN kind END IGNORE NULLS) OVER (PARTITION BY uid ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM s WHERE protocol = 'per'),
  sg0 AS (SELECT uid, count_if(kind = 'review') AS reviews, count_if(kind = 'review' AND k BETWEEN 40 AND 69) AS agreements, count_if(kind = 'review' AND k BETWEEN 40 AND 69 AND nxt = 'fail') AS agreed_then_fail,
    count_if(kind = 'review' AND k BETWEEN 40 AND 69 AND nxt = 'pass') AS agreed_then_pass, count(DISTINCT answer) FILTER (kind IN ('executor', 'submission')) AS distinct_candidates,
    count_if(kind = 'review' AND k < 40) AS routes, count_if(kind = 'executor') AS e, count_if(kind = 'review') AS r FROM ev GROUP BY uid),
  tr AS (SELECT uid, count_if(last_key IS NOT NULL AND pk IS NOT NULL) AS pairs, count_if(last_key = pk) AS repeated, count_if(NOT passed AND np IS NOT NULL) AS fails, count_if(NOT passed AND np IS NOT NULL AND nk = last_key) AS unchanged, max(same) AS most
    FROM (SELECT *, lag(last_key) OVER w AS pk, lead(last_key) OVER w AS nk, lead(passed) OVER w AS np, CASE WHEN last_key IS NOT NULL THEN count(*) OVER (PARTITION BY uid, last_key) END AS same FROM att WINDOW w AS (PARTITION BY uid ORDER BY attempt)) GROUP BY uid),
  sg AS (SELECT uid, reviews::BIGINT AS reviews, agreements::BIGINT AS agreements, agreed_then_fail::BIGINT AS agreed_then_fail, agreed_then_pass::BIGINT AS agreed_then_pass, distinct_candidates, coalesce(pairs, 0)::BIGINT AS pairs, coalesce(repeated, 0)::BIGINT AS repeated,
    coalesce(fails, 0)::BIGINT AS fails, coalesce(unchanged, 0)::BIGINT AS unchanged, CASE WHEN e + r > 0 THEN CASE WHEN e = 0 OR r = 0 THEN 0 ELSE abs(e - r)::DOUBLE / (e + r) END END AS imbalance, coalesce(most, 0) >= 3 OR routes >= 3 OR coalesce(unchanged, 0) > 0 AS loops FROM sg0 LEFT JOIN tr USING (uid))"""


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """Of PER trajectories; a review that asks for a revision sends the problem back to the executor."""
    return A.signals(_parsed(spark, d).where("protocol = 'per'").withColumn("route", F.when(F.col("action") == "revise", "executor")))


@query(sql.over("SELECT * REPLACE (round(imbalance, 9) AS imbalance) FROM sg", sql.ATTEMPTS, _SIGNALS))
def process_signals(spark, d):
    return _signals(spark, d)


@query(sql.over("""SELECT *, round(agreements / reviews, 9) AS agreement_rate, round(repeated / pairs, 9) AS repeated_answer_rate, round(unchanged / fails, 9) AS no_change_after_fail_rate, round(wrongly_agreed / trajectories, 9) AS premature_convergence_rate, round(looping / trajectories, 9) AS looping_rate,
    round(agreed_then_fail / (agreed_then_fail + agreed_then_pass), 9) AS wrong_convergence_rate, round(agreed_then_pass / (agreed_then_fail + agreed_then_pass), 9) AS productive_convergence_rate FROM (
  SELECT count(*) AS trajectories, sum(reviews)::BIGINT AS reviews, sum(agreements)::BIGINT AS agreements, sum(agreed_then_fail)::BIGINT AS agreed_then_fail, sum(agreed_then_pass)::BIGINT AS agreed_then_pass, sum(pairs)::BIGINT AS pairs, sum(repeated)::BIGINT AS repeated, sum(fails)::BIGINT AS fails,
    sum(unchanged)::BIGINT AS unchanged, count_if(agreed_then_fail > 0)::BIGINT AS wrongly_agreed, count_if(loops)::BIGINT AS looping, round(avg(distinct_candidates), 9) AS mean_candidates, round(avg(imbalance), 9) AS mean_imbalance FROM sg)""", sql.ATTEMPTS, _SIGNALS))
def process_rates(spark, d):
    return A.signal_rates(_signals(spark, d))
