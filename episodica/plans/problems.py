"""Queries over problems: the driver's log with a metrics file and saved results beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cells
from ..operators import problems as P
from ..operators import runs as R
from . import adapter, sql
from .catalog import _labeled, _parsed, _problems, _remembered
from .registry import query

_SUBMISSIONS = "protocol = 'per' AND kind = 'submission'"

#: What the tables stand for. Metrics: of trajectories that submitted something; their tries are noted if one has k >= 90. Results: of those that passed.
_FILES = f"""
  mx AS (SELECT uid, CASE WHEN max(k) >= 90 THEN list(k < 50 ORDER BY seq) END AS tries, [false, NULL, sum(k) % 2 = 0] AS evaluations, CASE WHEN min(k) < 20 THEN 2 * count(*) END AS total_model_calls, 3 * count(*) AS invoked,
    sum(k)::BIGINT AS prompt_tokens, count(*) AS completion_tokens, CASE WHEN max(k) >= 10 THEN sum(k)::BIGINT + count(*) END AS total_tokens, max(k) / 4 AS wall_time_seconds FROM s WHERE {_SUBMISSIONS} GROUP BY uid),
  rx AS (SELECT DISTINCT uid, tier, dataset AS domain, actor AS source FROM s WHERE kind = 'pass'),
  tx AS (SELECT uid, count_if(kind IN ('executor', 'review', 'pass', 'fail'))::BIGINT AS model_turns, count_if(kind IN ('executor', 'review'))::BIGINT AS reasoning_turns FROM s WHERE protocol = 'per' GROUP BY uid),
  ax AS (SELECT uid, attempt, seq, lower(answer) AS answer_key FROM a0 JOIN att USING (uid, attempt) WHERE cand),
  ix AS (SELECT uid, count_if(answer_key <> before)::BIGINT AS reflective_rounds FROM (SELECT *, lag(answer_key) OVER (PARTITION BY uid, attempt ORDER BY seq) AS before FROM ax) GROUP BY uid),
  jx AS (SELECT uid, rx.tier, domain, source, coalesce(attempts, 0) > 0 AS traced, coalesce(len(tries), 0) > 0 AS tried, attempts, prob.first_success, prob.first_passed, tries, list_filter(evaluations, lambda p: p IS NOT NULL) AS evaluations,
      coalesce(tries_before_success, 0) AS hints_used, coalesce(reflective_rounds, 0) AS reflective_rounds, reasoning_turns, greatest(coalesce(total_model_calls, invoked, 0), model_turns) AS model_calls,
      coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens, coalesce(total_tokens, 0) AS total_tokens, coalesce(wall_time_seconds, 0) AS wall_time_seconds
    FROM tx LEFT JOIN prob USING (uid) LEFT JOIN mx USING (uid) LEFT JOIN rx USING (uid) LEFT JOIN ix USING (uid)),
  kx AS (SELECT *, CASE WHEN tried THEN nullif(list_position(tries, true), 0) WHEN traced THEN first_success ELSE nullif(list_position(evaluations, true), 0) END AS success,
      CASE WHEN traced THEN attempts ELSE coalesce(len(evaluations), 0) END AS submissions, CASE WHEN tried THEN tries[1] WHEN traced THEN first_passed ELSE evaluations[1] END AS first FROM jx),
  px AS (SELECT uid, tier, domain, source, success IS NOT NULL AS final_passed, coalesce(first, false) AS first_passed, success::BIGINT AS first_success, (CASE WHEN tried THEN len(tries) ELSE submissions END)::BIGINT AS correction_loops,
      submissions::BIGINT AS evaluator_submissions, hints_used, reflective_rounds, reasoning_turns, model_calls, prompt_tokens, completion_tokens, total_tokens, wall_time_seconds FROM kx)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("k"), F.count("*")
    in_turn = F.transform(F.array_sort(F.collect_list(F.struct("seq", (k < 50).alias("ok")))), lambda t: t["ok"])
    return adapter.steps(spark, d).where(_SUBMISSIONS).groupBy("uid").agg(
        F.when(F.max(k) >= 90, in_turn).alias("tries"), F.array(F.lit(False), F.lit(None).cast("boolean"), F.sum(k) % 2 == 0).alias("evaluations"), F.when(F.min(k) < 20, 2 * n).alias("total_model_calls"),
        F.create_map(F.lit("Solver"), 2 * n, F.lit("Critic"), n).alias("invocations"), F.sum(k).alias("prompt_tokens"), n.alias("completion_tokens"), F.when(F.max(k) >= 10, F.sum(k) + n).alias("total_tokens"), (F.max(k) / 4).alias("wall_time_seconds"),
    )


def _records(spark: SparkSession, d: str) -> DataFrame:
    log = _parsed(spark, d).where("protocol = 'per'")
    steps = adapter.steps(spark, d)
    written = F.when(F.col("kind") == "submission", "system").when(F.col("kind").isin("pass", "fail"), "Evaluator").otherwise("Solver")
    turns = P.turn_counts(steps.where("protocol = 'per'").select("uid", written.alias("sender")))
    attempts = _problems(spark, d).select("uid", "attempts", "first_success", "first_passed", F.col("tries_before_success").alias("hints_used"))
    results = steps.where("kind = 'pass'").groupBy("uid").agg(F.min("tier").alias("tier"), F.min("dataset").alias("domain"), F.min("actor").alias("source"))
    return P.records(turns.join(P.reflective_rounds(log), "uid", "left"), attempts, _metrics(spark, d), results)


@query(sql.over("SELECT * FROM px", sql.ATTEMPTS, _FILES))
def problem_table(spark, d):
    return _records(spark, d)


_METRIC_ROWS = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {f'round(coalesce(sum({a}::BIGINT), 0) / nullif({b_sum}, 0), 9)' if b else f'coalesce(sum({a}::BIGINT), 0)'}::DOUBLE AS value, {f'coalesce(sum({a}::BIGINT), 0)::BIGINT' if b else 'NULL::BIGINT'} AS numerator, {f'{b_sum}::BIGINT' if b else 'NULL::BIGINT'} AS denominator FROM px"
    for m, (a, b) in P.BASIC.items() for b_sum in ["count(*)" if b == "n" else f"coalesce(sum({b}::BIGINT), 0)"]
)


@query(sql.over(_METRIC_ROWS, sql.ATTEMPTS, _FILES))
def basic_metrics_full(spark, d):
    return P.basic_metrics(_records(spark, d))


@query(sql.over("SELECT count(*) AS examples, sum(coalesce(total_model_calls, 0))::BIGINT AS model_calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(coalesce(total_tokens, 0))::BIGINT AS tokens, round(sum(wall_time_seconds), 9) AS wall_seconds FROM mx", sql.ATTEMPTS, _FILES))
def runtime_accounting(spark, d):
    return P.accounting(_metrics(spark, d))


@query(sql.over("SELECT problem FROM s WHERE protocol = 'per' INTERSECT SELECT problem FROM s WHERE protocol = 'broadcast'"))
def paired_problems(spark, d):
    return P.paired(adapter.steps(spark, d), ["problem"], "protocol", ("per", "broadcast"))


@query(sql.labeled("""SELECT protocol, CASE WHEN before_correct IS NULL OR after_correct IS NULL THEN 'unknown' ELSE CASE WHEN before_correct THEN 'correct' ELSE 'wrong' END || '_to_' || CASE WHEN after_correct THEN 'correct' ELSE 'wrong' END END AS name, count(*) AS n
  FROM l GROUP BY ALL"""))
def transition_names(spark, d):
    return _labeled(spark, d).groupBy("protocol", P.transition_name(F.col("before_correct"), F.col("after_correct")).alias("name")).agg(F.count("*").alias("n"))


@query(sql.over("SELECT uid, seq, k % 7 IN (3, 4, 5) AS says FROM s"))
def meaningful_turns(spark, d):
    """Fillers in several spellings, a short word, a lone box and a sentence."""
    texts = ["  No\n Comments ", "ok", "", "\\boxed{}", "so it is", "none of them", "[EMPTY]"]
    said = F.element_at(F.array(*map(F.lit, texts)), F.col("k") % 7 + 1)
    return adapter.steps(spark, d).select("uid", "seq", text.meaningful(said).alias("says"))


_HERE = "protocol = 'per' AND strict AND NOT before_correct AND (action = 'revise' OR (action = 'unknown' AND route_observed))"
_ROUTES = (("explicit", " AND action = 'revise'"), ("linked_route", " AND action = 'unknown'"), ("pairs", ""), ("changed", " AND answer_changed"), ("unchanged", " AND NOT answer_changed"), ("labeled", " AND after_correct IS NOT NULL"), ("repaired", " AND after_correct AND answer_changed"))


@query(sql.labeled(f"""SELECT dataset, actor, protocol, {", ".join(f"{sql.count(_HERE + c)} AS {n}" for n, c in (*_ROUTES, *sql.FOLLOWED))} FROM l GROUP BY dataset, actor, protocol"""))
def route_sensitivity_cells(spark, d):
    return cells.route_cells(_remembered(spark, d))


_JUDGED = """
  fx AS (SELECT uid, arg_max(answer, seq) FILTER (kind = 'submission') AS final, arg_max(kind = 'pass', seq) FILTER (kind IN ('pass', 'fail')) AS runtime, substr('ABCD', (1 + (uid // 2) % 4)::INT, 1) AS gold FROM s WHERE protocol = 'per' GROUP BY uid)"""


def _finals(spark: SparkSession, d: str) -> DataFrame:
    """Of each PER trajectory the answer submitted last, the last verdict and its mode, and the gold answer of its problem."""
    said = lambda c, kinds: F.max_by(c, F.when(F.col("kind").isin(*kinds), F.col("seq")))
    gold = F.substring(F.lit("ABCD"), (1 + F.floor(F.col("uid") / 2) % 4).cast("int"), F.lit(1))
    return adapter.steps(spark, d).where("protocol = 'per'").groupBy("uid").agg(said("answer", ["submission"]).alias("final"), said(F.col("kind") == "pass", ["pass", "fail"]).alias("runtime")).withColumn("gold", gold)


@query(sql.over("""SELECT uid, seq, CASE WHEN k % 9 = 0 THEN NULL WHEN answer = final AND runtime IS NOT NULL THEN runtime ELSE answer = gold END AS value,
  CASE WHEN k % 9 = 0 THEN 'missing' WHEN answer = final AND runtime IS NOT NULL THEN 'runtime_evaluator' ELSE 'exact' END AS source FROM s JOIN fx USING (uid) WHERE kind = 'executor'""", _JUDGED))
def candidate_labels(spark, d):
    """Some candidates are blank."""
    x = adapter.steps(spark, d).where("kind = 'executor'").join(_finals(spark, d), "uid").withColumn("answer", F.when(F.col("k") % 9 == 0, " ").otherwise(F.col("answer")))
    return R.judge(x).select("uid", "seq", "value", "source")


@query(sql.over("""SELECT uid, CASE WHEN a THEN ok ELSE coalesce(final = gold, false) END::INT AS correctness, CASE WHEN a THEN 'rule' ELSE 'exact' END AS judge, CASE WHEN a THEN 'per_evaluator' ELSE 'fallback_exact' END AS evaluation_source
  FROM fx LEFT JOIN (SELECT uid, arg_max(kind = 'pass', seq) AS ok FROM s WHERE kind IN ('pass', 'fail') GROUP BY uid) USING (uid), (SELECT bool_and(runtime IS NOT NULL) AS a FROM fx)""", _JUDGED))
def post_evaluation(spark, d):
    log = adapter.steps(spark, d).where("kind IN ('pass', 'fail')").select("uid", "seq", F.lit("meta").alias("event_type"), F.lit("evaluation").alias("stage"), F.lit("rule").alias("mode"), (F.col("kind") == "pass").cast("int").alias("correctness"))
    x = _finals(spark, d).select("uid", F.col("final").alias("answer"), "gold")
    return R.post_evaluation(x, R.saved_evaluations(log)).select("uid", "correctness", "judge", "evaluation_source")


@query("""WITH r AS (SELECT o_orderkey, '/scratch/r' || (o_orderkey % 3) || '/' || substr(o_orderpriority, 1, 1) || '/c' || (o_custkey % 10) || '/run.trace' AS path, o_orderkey % 2 AS example FROM orders),
  t AS (SELECT n_nationkey AS problem, n_nationkey % 2 AS example, CASE WHEN n_nationkey < 15 THEN (1 + n_nationkey % 5) || '/' ELSE '' END || 'c' || (n_nationkey % 10) || '/run.trace' AS suffix, CASE WHEN n_nationkey < 15 THEN 3 ELSE 2 END AS names FROM nation),
  m AS (SELECT o_orderkey, problem, names, row_number() OVER (PARTITION BY o_orderkey ORDER BY names DESC, problem) AS place FROM r JOIN t ON r.example = t.example AND ends_with(r.path, '/' || t.suffix))
  SELECT problem, names AS suffix_names, count(*) AS records FROM r LEFT JOIN (SELECT * FROM m WHERE place = 1) USING (o_orderkey) GROUP BY ALL""")
def episodes_by_suffix(spark, d):
    """Trace records of orders, placed under problems by the longest suffix of their path; one row for those without any."""
    orders, nation = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "nation"))
    path = F.concat(F.lit("/scratch/r"), F.col("o_orderkey") % 3, F.lit("/"), F.substring("o_orderpriority", 1, 1), F.lit("/c"), F.col("o_custkey") % 10, F.lit("/run.trace"))
    n = F.col("n_nationkey")
    suffix = F.concat(F.when(n < 15, F.concat(1 + n % 5, F.lit("/"))).otherwise(""), F.lit("c"), n % 10, F.lit("/run.trace"))
    found = P.by_path_suffix(orders.select("o_orderkey", path.alias("path"), (F.col("o_orderkey") % 2).alias("example")), "path", nation.select(n.alias("problem"), (n % 2).alias("example"), suffix.alias("suffix")), "suffix", ["example"])
    return found.groupBy("problem", "suffix_names").agg(F.count("*").alias("records"))


@query("""WITH c AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, event_type AS agent, count(*) AS n FROM events GROUP BY ALL),
  s AS (SELECT user_id, day, agent, sum(n) OVER (PARTITION BY user_id, agent, CASE WHEN user_id % 2 = 0 THEN day // 5 END ORDER BY day) AS total FROM c),
  b AS (SELECT *, lag(total) OVER (PARTITION BY user_id, agent ORDER BY day) AS before FROM s)
  SELECT agent, sum(CASE WHEN before IS NULL OR total < before THEN total ELSE total - before END)::BIGINT AS work, count_if(total < before)::BIGINT AS resets, count_if(before IS NOT NULL)::BIGINT AS carried FROM b GROUP BY agent""")
def agent_work(spark, d):
    """Work by agent from daily snapshots of counters that run on, and that start anew every five days for every second user."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    n = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", day.alias("day"), F.col("event_type").alias("agent")).agg(F.count("*").alias("n"))
    run = F.when(F.col("user_id") % 2 == 0, F.floor(F.col("day") / 5))
    totals = n.withColumn("total", F.sum("n").over(Window.partitionBy("user_id", "agent", run).orderBy("day")))
    snapshots = totals.groupBy("user_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("agent", "total"))).alias("counters"))
    x = P.agent_increases(snapshots, ["user_id"], "day", "counters")
    first = F.row_number().over(Window.partitionBy("user_id", "agent").orderBy("day")) == 1
    return x.withColumn("first", first).groupBy("agent").agg(F.sum("increase").alias("work"), F.count_if("reset").alias("resets"), F.count_if(~F.col("first")).alias("carried"))
