"""Queries over plain-text traces, which the driver's `events` stand for: even users are PER traces, odd ones broadcast traces.

The turns are rendered as the trace format has them and parsed from text; the SQL works from what each event stands for, without text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import turns as T
from ..functions.stats import count_if
from ..operators import reviews as R
from . import adapter, sql
from .registry import query

KEY = ["uid"]
#: Words that say nothing of a feedback's content.
STOP = ["score", "true", "false", "evaluation", "signal", "pass", "answer", "candidate", "evaluator", "feedback", "from", "with", "that", "this"]


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, protocol, gold, turn_idx, agent_id, agent_name, content."""
    s = adapter.steps(spark, sf_dir)
    box, k, per = F.concat(F.lit("\\boxed{"), "answer", F.lit("}")), F.col("k"), F.col("protocol") == "per"
    kind = lambda *names: F.col("kind").isin(*names)
    say = lambda before, after="": F.concat(F.lit(before), box, F.lit(after))
    hint = kind("executor") & (k >= 90)
    content = (
        F.when(hint, "Evaluation hint: recheck the parity").when(kind("executor"), say("We compute. Candidate Answer: "))
        .when(kind("review") & (k < 30), say("[Route: executor] Fix Instruction: check it. Suggested Revision: ")).when(kind("review") & (k < 50), "Diagnosis: a step is wrong.")
        .when(kind("review") & (k < 80), say("[Agree] Candidate under review: ", " Feedback: it holds")).when(kind("review"), "It looks plausible.")
        .when(per & kind("submission"), say("Final Answer: ")).when(kind("pass"), "Evaluation signal: PASS").when(kind("fail") & (k < 50), "Evaluation signal: FAIL").when(kind("fail"), "Score: False Advice: recheck the parity")
        .when(kind("discussion"), say("I think it is ")).when(kind("anchor"), F.concat(F.lit("Candidate answer under group review: Source: "), "sender", F.lit(" Candidate Answer: "), box))
        .when(kind("approval") & (k < 50), say("Candidate under review: ", " Approve: True Feedback: fine")).when(kind("approval") & (k < 75), say("Candidate under review: ", " Approve: False Feedback: no"))
        .when(kind("approval"), say("Candidate under review: ", " Review Position: propose_correction")).when(kind("update"), say("Current Candidate For Further Review: ", " Instruction: go on"))
        .when(k < 50, "Evaluation signal: FAIL").otherwise("Verifier: PASS")
    )
    name = F.when(hint | kind("pass", "fail"), "Evaluator").when(kind("executor"), "Executor").when(kind("review"), "Reviewer").when(kind("submission"), F.when(per, "Solver").otherwise("Evaluator")).when(kind("anchor", "update"), "system").otherwise(F.col("sender"))
    return s.select("uid", "protocol", F.substring(F.lit("ABCD"), (1 + F.col("uid") % 4).cast("int"), F.lit(1)).alias("gold"), F.col("seq").alias("turn_idx"), F.concat(F.lit("A"), F.length(name)).alias("agent_id"), name.alias("agent_name"), content.alias("content"))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return T.classify(turns(spark, d))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Review episodes of both protocols, judged by the gold answer of their trace."""
    x = _classified(spark, d)
    out = []
    for p, f in (("per", R.per_reviews), ("broadcast", R.group_reviews)):
        e = f(x.where(F.col("protocol") == p), ["uid", "gold"])
        out.append(R.judged(e, lambda c: T.key(c) == T.key(F.col("gold"))).withColumn("protocol", F.lit(p)).select("uid", "protocol", *R.EPISODE, "pre", "post"))
    return out[0].unionByName(out[1])


#: What each event stands for: evaluator, marked, verdict, action, approve, und, grp, upd, named, hint.
_TURNS = """
  tt AS (SELECT uid, seq, protocol, kind, k, answer, sender, substr('ABCD', (1 + uid % 4)::INT, 1) AS gold,
    kind IN ('pass', 'fail') OR (kind = 'executor' AND k >= 90) OR (protocol = 'broadcast' AND kind = 'submission') AS ev,
    kind = 'pass' OR (kind = 'fail' AND k < 50) OR (protocol = 'broadcast' AND kind = 'submission') AS mark,
    CASE WHEN kind = 'pass' THEN true WHEN kind = 'fail' THEN false WHEN protocol = 'broadcast' AND kind = 'submission' THEN k >= 50 END AS verdict,
    kind = 'executor' AND k >= 90 AS hint,
    CASE WHEN kind = 'review' THEN CASE WHEN k < 50 THEN 'revise' WHEN k < 80 THEN 'agree' END END AS act,
    CASE WHEN kind = 'approval' THEN k < 50 END AS approve,
    CASE WHEN kind = 'approval' OR (kind = 'review' AND k >= 50 AND k < 80) THEN answer END AS und,
    CASE WHEN kind = 'anchor' THEN answer END AS grp, CASE WHEN kind = 'update' THEN answer END AS upd,
    CASE WHEN (kind = 'executor' AND k < 90) OR (kind = 'review' AND (k < 30 OR (k >= 50 AND k < 80))) OR (protocol = 'per' AND kind = 'submission') OR kind IN ('discussion', 'anchor', 'approval', 'update') THEN answer END AS named FROM s),
  t2 AS (SELECT *, coalesce(NOT last_value(verdict IGNORE NULLS) OVER b, false) AS after_fail, last_value(CASE WHEN NOT ev THEN named END IGNORE NULLS) OVER b AS prior, last_value(named IGNORE NULLS) OVER b AS latest,
      nullif(first_value(CASE WHEN named IS NOT NULL OR mark THEN coalesce(named, '') END IGNORE NULLS) OVER f, '') AS next_named,
      nullif(first_value(CASE WHEN grp IS NOT NULL OR mark THEN coalesce(grp, '') END IGNORE NULLS) OVER f, '') AS next_group
    FROM tt WINDOW b AS (PARTITION BY uid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY uid ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""

_PER = """
  pe AS (SELECT uid, gold, 'per' AS protocol, seq AS turn, 'Reviewer' AS reviewer, act AS action, coalesce(und, prior, '') AS before,
    CASE WHEN named IS NOT NULL THEN named WHEN act = 'revise' THEN coalesce(next_named, und, prior, '') ELSE coalesce(und, prior, '') END AS after, after_fail FROM t2 WHERE protocol = 'per' AND act IS NOT NULL)"""

_GROUP = """
  g0 AS (SELECT *, count_if(ev OR grp IS NOT NULL) OVER (PARTITION BY uid ORDER BY seq) + coalesce(count_if(upd IS NOT NULL) OVER (PARTITION BY uid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS step FROM t2 WHERE protocol = 'broadcast'),
  g1 AS (SELECT *, max(upd) OVER (PARTITION BY uid, step) AS closed_by FROM g0),
  g2 AS (SELECT *, CASE WHEN und IS NOT DISTINCT FROM lag(und) OVER (PARTITION BY uid, step ORDER BY seq) THEN 0 ELSE 1 END AS new FROM g1 WHERE und IS NOT NULL),
  g3 AS (SELECT *, sum(new) OVER (PARTITION BY uid, step ORDER BY seq) AS part, sum(new) OVER (PARTITION BY uid, step) AS parts FROM g2),
  g4 AS (SELECT uid, gold, step, part, min(seq) AS turn, max(seq) AS final, count(*) AS n_reviews, min(und) AS before, bool_and(approve) AS fine, max(CASE WHEN part = parts THEN closed_by END) AS upd, arg_min(next_group, seq) AS ng0,
    min(seq) AS s0, bool_or(after_fail) FILTER (new = 1) AS after_fail FROM g3 GROUP BY uid, gold, step, part),
  g5 AS (SELECT g4.*, (SELECT arg_min(coalesce(x.und, x.upd), x.seq) FROM t2 x WHERE x.uid = g4.uid AND x.seq > g4.final AND coalesce(x.und, x.upd) <> g4.before) AS other, y.next_group, y.next_named FROM g4 JOIN t2 y ON y.uid = g4.uid AND y.seq = g4.turn),
  gr AS (SELECT uid, gold, 'broadcast' AS protocol, turn, 'broadcast_group' AS reviewer, CASE WHEN fine THEN 'agree' ELSE 'revise' END AS action, before,
    CASE WHEN upd IS NOT NULL THEN upd WHEN NOT fine THEN coalesce(other, next_group, next_named, before) ELSE before END AS after, after_fail, n_reviews FROM g5)"""

_JUDGED = """
  ju AS (SELECT uid, protocol, turn, action, before, after, after_fail, CASE WHEN before <> '' THEN before = gold END AS pre, CASE WHEN after <> '' THEN after = gold END AS post
    FROM (SELECT uid, gold, protocol, turn, action, before, after, after_fail FROM pe UNION ALL SELECT uid, gold, protocol, turn, action, before, after, after_fail FROM gr))"""


@query(sql.over("SELECT uid, turn, reviewer, action, before, after, after_fail FROM pe", _TURNS, _PER))
def trace_per_reviews(spark, d):
    return R.per_reviews(_classified(spark, d).where("protocol = 'per'"), KEY)


@query(sql.over("SELECT uid, turn, reviewer, action, before, after, after_fail, n_reviews FROM gr", _TURNS, _GROUP))
def trace_group_reviews(spark, d):
    return R.group_reviews(_classified(spark, d).where("protocol = 'broadcast'"), KEY)


_SINGLE = """
  si0 AS (SELECT *, CASE WHEN und IS NOT NULL THEN CASE WHEN kind = 'approval' AND k >= 75 THEN 'revise' WHEN kind = 'review' THEN 'agree' END END AS own FROM t2),
  si1 AS (SELECT *, last_value(CASE WHEN NOT ev THEN CASE WHEN own = 'revise' THEN coalesce(next_named, und) WHEN own = 'agree' THEN und ELSE named END END IGNORE NULLS)
    OVER (PARTITION BY uid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM si0),
  si AS (SELECT uid, seq AS turn, CASE WHEN kind = 'review' THEN 'Reviewer' ELSE sender END AS reviewer, own AS action, coalesce(und, held, '') AS before, CASE WHEN own = 'revise' THEN coalesce(next_named, und, held, '') ELSE coalesce(und, held, '') END AS after, after_fail FROM si1 WHERE own IS NOT NULL)"""


@query(sql.over("SELECT uid, turn, reviewer, action, before, after, after_fail FROM si", _TURNS, _SINGLE))
def trace_single_reviews(spark, d):
    """All turns, read as those of agents that review themselves."""
    return R.single_reviews(_classified(spark, d), KEY)


_FEEDBACK = """
  fb0 AS (SELECT *, count(verdict) OVER (PARTITION BY uid ORDER BY seq) AS seg FROM t2),
  fb1 AS (SELECT *, coalesce(bool_or(verdict IS NULL AND NOT hint) OVER (PARTITION BY uid, seg ORDER BY seq), false) AS responds FROM fb0 WHERE seg > 0),
  fb2 AS (SELECT uid, protocol, seg, min(seq) AS turn, bool_or(verdict) AS passed, arg_min(named, seq) FILTER (verdict IS NOT NULL) AS own, arg_min(coalesce(latest, ''), seq) AS latest, count_if(NOT responds)::BIGINT AS feedback_turns, count_if(responds)::BIGINT AS repair_turns FROM fb1 GROUP BY uid, protocol, seg),
  fb3 AS (SELECT *, lead(passed) OVER w AS next_passed, lead(latest) OVER w AS later FROM fb2 WINDOW w AS (PARTITION BY uid ORDER BY seg)),
  fb4 AS (SELECT *, last_value(CASE WHEN passed THEN own WHEN repair_turns > 0 AND next_passed IS NOT NULL THEN nullif(later, '') END IGNORE NULLS) OVER (PARTITION BY uid ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM fb3),
  fb AS (SELECT uid, protocol, turn, coalesce(state, latest, '') AS before, feedback_turns, repair_turns, next_passed FROM fb4 WHERE NOT passed AND repair_turns > 0)"""


@query(sql.over("SELECT uid, turn, before, feedback_turns, repair_turns, next_passed FROM fb", _TURNS, _FEEDBACK))
def trace_feedback(spark, d):
    return R.feedback(_classified(spark, d), KEY, STOP).drop("used")


#: The response's words: a system turn or an evaluator's name, "Feedback:" or "Diagnosis:" in it, or "recheck" and "parity" of the feedback.
_USED = """
  us0 AS (SELECT uid, seg, bool_or(NOT responds AND (hint OR (kind = 'fail' AND k >= 50))) AS asks, bool_or(responds AND hint) AS repeats,
    bool_or(responds AND (hint OR (kind = 'review' AND k >= 30 AND k < 80) OR (kind = 'approval' AND k < 75) OR kind IN ('anchor', 'update'))) AS speaks FROM fb1 GROUP BY uid, seg),
  us AS (SELECT fb4.uid, protocol, next_passed, speaks OR (asks AND repeats) AS used FROM fb4 JOIN us0 USING (uid, seg) WHERE NOT passed AND repair_turns > 0)"""


@query(sql.over(f"""SELECT *, {", ".join(f"{sql.rate(c, 'eligible')} AS {c}_rate" for c in ("used", "learned", "used_fixed", "used_wrong", "ignored_fixed", "ignored_wrong"))} FROM (SELECT protocol, count(*) AS episodes, {sql.count("next_passed IS NOT NULL")} AS eligible,
  {sql.count("used AND next_passed IS NOT NULL")} AS used, {sql.count("next_passed")} AS learned, {sql.count("used AND next_passed")} AS used_fixed, {sql.count("used AND NOT next_passed")} AS used_wrong,
  {sql.count("NOT used AND next_passed")} AS ignored_fixed, {sql.count("NOT used AND NOT next_passed")} AS ignored_wrong FROM us GROUP BY protocol)""", _TURNS, _FEEDBACK, _USED))
def trace_feedback_learning(spark, d):
    return R.learning(R.feedback(_classified(spark, d), ["uid", "protocol"], STOP), ["protocol"])


@query(sql.over(f"""SELECT *, {sql.rate("tp", "tp + fp")} AS precision, {sql.rate("tp", "tp + fn")} AS recall, {sql.rate("fp", "fp + tn")} AS false_alarm, round((tp::DOUBLE / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2, 9) AS balanced,
  {sql.rate("fixed", "wrong_in")} AS fix_wrong, {sql.rate("corrupted", "right_in")} AS corrupt_right, {sql.rate("tn", "tn + fp")} AS agree_right, {sql.rate("fn", "fn + tp")} AS agree_wrong FROM (SELECT protocol, scope, count(*) AS episodes,
  {sql.count("action = 'revise' AND NOT pre")} AS tp, {sql.count("action = 'revise' AND pre")} AS fp, {sql.count("action = 'agree' AND NOT pre")} AS fn, {sql.count("action = 'agree' AND pre")} AS tn, {sql.count("NOT pre AND post IS NOT NULL")} AS wrong_in,
  {sql.count("pre AND post IS NOT NULL")} AS right_in, {sql.count("NOT pre AND post")} AS fixed, {sql.count("pre AND NOT post")} AS corrupted FROM (SELECT *, 'all' AS scope FROM ju UNION ALL SELECT *, 'after_fail' FROM ju WHERE after_fail) GROUP BY protocol, scope)""", _TURNS, _PER, _GROUP, _JUDGED))
def trace_review_behaviour(spark, d):
    return R.behaviour(_judged(spark, d), ["protocol"])


_SEQUENCE = """
  cs0 AS (SELECT *, coalesce(bool_or(grp IS NOT NULL) OVER (PARTITION BY uid), false) AS groups FROM t2),
  cs1 AS (SELECT uid, seq, CASE WHEN groups THEN grp WHEN NOT ev THEN named END AS candidate FROM cs0),
  cs AS (SELECT uid, seq AS turn, candidate FROM (SELECT *, lag(candidate) OVER (PARTITION BY uid ORDER BY seq) AS p FROM cs1 WHERE candidate IS NOT NULL) WHERE p IS DISTINCT FROM candidate)"""


@query(sql.over("SELECT * FROM cs", _TURNS, _SEQUENCE))
def trace_candidates(spark, d):
    return R.candidates(_classified(spark, d), KEY)


_ATTEMPT = """
  ac0 AS (SELECT *, 1 + coalesce(count(verdict) OVER (PARTITION BY uid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS attempt FROM t2),
  ac1 AS (SELECT *, coalesce(bool_or(grp IS NOT NULL) OVER (PARTITION BY uid, attempt), false) AS groups FROM ac0),
  ac AS (SELECT uid, attempt, coalesce(arg_max(CASE WHEN groups THEN grp WHEN NOT ev THEN named END, seq) FILTER (CASE WHEN groups THEN grp WHEN NOT ev THEN named END IS NOT NULL), '') AS candidate FROM ac1 GROUP BY uid, attempt HAVING count(verdict) > 0)"""


@query(sql.over("SELECT * FROM ac", _TURNS, _ATTEMPT))
def trace_attempt_candidates(spark, d):
    return R.attempt_candidates(_classified(spark, d), KEY)


def _coupled(spark: SparkSession, d: str) -> DataFrame:
    """Episodes with a saved incorporation label for two in three, as an earlier run would have left."""
    e = _judged(spark, d)
    legacy = e.where("turn % 3 <> 0").select("uid", "turn", ((F.col("turn") + F.col("uid")) % 2 == 0).alias("incorporated"))
    # Here C and D are spellings of one answer.
    plain = lambda c: F.when(c == "D", "C").otherwise(c)
    return R.coupling(e, legacy, KEY, lambda a, b: plain(a) == plain(b))


_COUPLED = """
  cu0 AS (SELECT *, before <> '' AND after <> '' AS eligible, CASE WHEN before <> '' AND after <> '' THEN before <> after END AS changed,
    CASE WHEN before <> '' AND after <> '' THEN replace(before, 'D', 'C') = replace(after, 'D', 'C') END AS same, CASE WHEN turn % 3 <> 0 THEN (turn + uid) % 2 = 0 END AS incorporated FROM ju),
  cu AS (SELECT *, CASE WHEN changed IS NULL THEN 'ineligible' WHEN NOT changed THEN 'unchanged' WHEN same THEN 'changed_but_equivalent' WHEN post THEN 'changed_and_repaired' WHEN NOT post THEN 'changed_but_still_wrong' ELSE 'changed_unknown' END AS outcome,
    changed <> incorporated AS disagrees FROM cu0)"""
_RATES = {"strict_rate": ("changed", "eligible"), "equivalent_rate": ("equivalent_changed", "equivalent_eligible"), "repaired_rate": ("repaired", "eligible"), "still_wrong_rate": ("still_wrong", "eligible"), "unchanged_rate": ("unchanged", "eligible"), "repair_given_change": ("repaired", "changed"), "legacy_rate": ("legacy_incorporated", "legacy_eligible"), "disagreement_rate": ("disagreements", "legacy_eligible")}


@query(sql.over(f"""SELECT *, {", ".join(f"{sql.rate(a, b)} AS {n}" for n, (a, b) in _RATES.items())} FROM (SELECT protocol, grouping(protocol) = 1 AS total, count(*) AS useful, {sql.count("eligible")} AS eligible, {sql.count("changed")} AS changed,
  {sql.count("same IS NOT NULL")} AS equivalent_eligible, {sql.count("NOT same")} AS equivalent_changed, {sql.count("changed AND same")} AS only_spelling, {sql.count("outcome = 'changed_and_repaired'")} AS repaired, {sql.count("outcome = 'changed_but_still_wrong'")} AS still_wrong,
  {sql.count("outcome = 'unchanged'")} AS unchanged, {sql.count("incorporated IS NOT NULL")} AS legacy_eligible, {sql.count("incorporated")} AS legacy_incorporated, {sql.count("disagrees")} AS disagreements FROM cu WHERE action = 'revise' AND NOT pre GROUP BY GROUPING SETS ((), (protocol)))""", _TURNS, _PER, _GROUP, _JUDGED, _COUPLED))
def trace_strict_coupling(spark, d):
    return R.coupling_counts(_coupled(spark, d), "protocol")


@query(sql.over("""SELECT protocol, CASE WHEN disagrees THEN 'legacy_disagreement' ELSE outcome END AS stratum, count(*) AS n FROM cu WHERE action = 'revise' AND NOT pre GROUP BY ALL""", _TURNS, _PER, _GROUP, _JUDGED, _COUPLED))
def trace_audit_strata(spark, d):
    return _coupled(spark, d).where("action = 'revise' AND NOT pre").groupBy("protocol", "stratum").agg(F.count("*").alias("n"))


@query(sql.over(f"""SELECT uid, turn, protocol, stratum, round FROM (SELECT *, row_number() OVER (PARTITION BY protocol, stratum ORDER BY md5('s|' || uid || '|' || turn), uid, turn) AS round FROM (SELECT *, CASE WHEN disagrees THEN 'legacy_disagreement' ELSE outcome END AS stratum FROM cu WHERE action = 'revise' AND NOT pre AND (eligible OR incorporated IS NOT NULL)))
  ORDER BY round, list_position({R.PROTOCOLS}, protocol), list_position({R.STRATA}, stratum) LIMIT 50""", _TURNS, _PER, _GROUP, _JUDGED, _COUPLED))
def trace_audit_sample(spark, d):
    return R.audit_sample(_coupled(spark, d), ["uid", "turn"], 50, "s").select("uid", "turn", "protocol", "stratum", "round")


@query(sql.over(f"""SELECT p.uid, p.protocol, coalesce(review_episodes, 0) AS review_episodes, coalesce(revise_episodes, 0) AS revise_episodes, coalesce(agree_episodes, 0) AS agree_episodes, coalesce(useful, 0) AS useful, coalesce(misleading, 0) AS misleading,
  coalesce(useful_incorporated, 0) AS useful_incorporated, coalesce(misleading_incorporated, 0) AS misleading_incorporated, coalesce(useful_repaired, 0) AS useful_repaired, coalesce(misleading_harmed, 0) AS misleading_harmed, coalesce(changed, 0) AS changed,
  coalesce(changed_and_repaired, 0) AS changed_and_repaired, coalesce(unchanged, 0) AS unchanged FROM (SELECT DISTINCT uid, protocol FROM s) p LEFT JOIN (SELECT uid, count(*) AS review_episodes, {sql.count("action = 'revise'")} AS revise_episodes, {sql.count("action = 'agree'")} AS agree_episodes,
  {sql.count("action = 'revise' AND NOT pre")} AS useful, {sql.count("action = 'revise' AND pre")} AS misleading, {sql.count("action = 'revise' AND NOT pre AND incorporated")} AS useful_incorporated, {sql.count("action = 'revise' AND pre AND incorporated")} AS misleading_incorporated,
  {sql.count("action = 'revise' AND NOT pre AND post")} AS useful_repaired, {sql.count("action = 'revise' AND pre AND NOT post")} AS misleading_harmed, {sql.count("action = 'revise' AND NOT pre AND changed")} AS changed,
  {sql.count("action = 'revise' AND NOT pre AND changed AND post")} AS changed_and_repaired, {sql.count("action = 'revise' AND NOT pre AND outcome = 'unchanged'")} AS unchanged FROM cu GROUP BY uid) c USING (uid)""", _TURNS, _PER, _GROUP, _JUDGED, _COUPLED))
def problem_review_counts(spark, d):
    """A row for each problem, reviewed or not, with its review counters."""
    e, useful, misleading = _coupled(spark, d), (F.col("action") == "revise") & ~F.col("pre"), (F.col("action") == "revise") & F.col("pre")
    counts = {
        "revise_episodes": F.col("action") == "revise", "agree_episodes": F.col("action") == "agree", "useful": useful, "misleading": misleading, "useful_incorporated": useful & F.col("incorporated"), "misleading_incorporated": misleading & F.col("incorporated"),
        "useful_repaired": useful & F.col("post"), "misleading_harmed": misleading & ~F.col("post"), "changed": useful & F.col("changed"), "changed_and_repaired": useful & F.col("changed") & F.col("post"), "unchanged": useful & (F.col("outcome") == "unchanged"),
    }
    per = e.groupBy("uid").agg(F.count("*").alias("review_episodes"), *(count_if(c).alias(n) for n, c in counts.items()))
    return adapter.steps(spark, d).select("uid", "protocol").distinct().join(per, "uid", "left").na.fill(0, ["review_episodes", *counts])
