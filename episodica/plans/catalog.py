"""Registered queries of the library itself and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import forms, rules, text, tokens
from ..functions.stats import count_if, rate
from ..operators import attempts as A
from ..operators import admission, cells, details, events, reports, sampling, sequences, transitions
from ..sources import files
from ..streaming import live
from . import adapter, sql
from .registry import ORACLE, QUERIES, query

def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return events.classify(adapter.messages(spark, d))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """The log without its texts, parsed once a session, for plans that read it in several branches."""
    return files.stored_once(spark, "parsed-log", f"{d}/events.parquet", lambda: _log(spark, d).select(events.PARSED))


def _keys(df: DataFrame) -> DataFrame:
    """The cell of a trajectory follows from its id in this log."""
    u = F.col("uid")
    return df.withColumns({"dataset": F.concat(F.lit("d"), u % 5), "actor": F.concat(F.lit("m"), F.floor(u / 2) % 2), "tier": 1 + u % 10, "problem": F.floor(u / 2)})


def _labels(log: DataFrame) -> DataFrame:
    """Verdicts of a problem's PER trajectory label the answers of both its trajectories."""
    return transitions.frozen_labels(log).withColumn("uid", F.explode(F.array("uid", F.col("uid") + 1)))


def _labeled(spark: SparkSession, d: str) -> DataFrame:
    log = _parsed(spark, d)
    return _keys(transitions.label(transitions.transitions(log), _labels(log)))


def _remembered(spark: SparkSession, d: str) -> DataFrame:
    """_labeled with what review memory says; the log with memory has every number twice as high."""
    links = files.stored_once(spark, "memory-links", f"{d}/events.parquet", lambda: transitions.memory_link(events.classify(adapter.memory_log(spark, d))))
    return transitions.with_memory(_labeled(spark, d), links.withColumn("review_seq", (F.col("review_seq") / 2).cast("long")))


def also_aligned(f: Callable[..., DataFrame]):
    """NAME_aligned is an older name of NAME."""
    QUERIES[f"{f.__name__}_aligned"], ORACLE[f"{f.__name__}_aligned"] = QUERIES[f.__name__], ORACLE[f.__name__]
    return f


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    return A.attempts(_parsed(spark, d).where("protocol = 'per'"))


def _problems(spark: SparkSession, d: str) -> DataFrame:
    return _keys(A.problems(_attempts(spark, d)))


FIELDS = ", ".join(transitions.FIELDS)


@query(sql.over(f"SELECT {FIELDS} FROM per", sql.PER))
def per_transitions(spark, d):
    return transitions.per_transitions(_parsed(spark, d)).select(*transitions.FIELDS)


@query(sql.over(f"SELECT {FIELDS} FROM bro", sql.BROADCAST))
def broadcast_transitions(spark, d):
    return transitions.broadcast_transitions(_parsed(spark, d)).select(*transitions.FIELDS)


@query(sql.over("SELECT uid, answer_key, value, conflict, sources FROM lab", sql.LABELS))
def frozen_labels(spark, d):
    return transitions.frozen_labels(_parsed(spark, d))


@query(sql.over(f"SELECT uid, count(*) AS keys, {sql.count('conflict')} AS conflicts FROM lab GROUP BY uid", sql.LABELS))
def label_conflicts(spark, d):
    return transitions.frozen_labels(_parsed(spark, d)).groupBy("uid").agg(F.count("*").alias("keys"), count_if(F.col("conflict")).alias("conflicts"))


@also_aligned
@query(sql.labeled("SELECT uid, protocol, review_seq, status, before_key, after_key, before_correct, after_correct, strict, bucket, transition_outcome, answer_changed FROM l"))
def labeled_transitions(spark, d):
    return _labeled(spark, d).select("uid", "protocol", "review_seq", "status", "before_key", "after_key", "before_correct", "after_correct", "strict", "bucket", "transition_outcome", "answer_changed")


@also_aligned
@query(sql.labeled(sql.summary("dataset, actor, protocol")))
def per_cell_summary(spark, d):
    return cells.cell_summary(_remembered(spark, d))


@also_aligned
@query(sql.labeled(sql.revise("dataset, protocol")))
def revise_conditioned(spark, d):
    return cells.revise_counts(_labeled(spark, d), ["dataset", "protocol"])


_ROUTED = "(protocol = 'per' AND strict AND NOT before_correct AND (action = 'revise' OR (action = 'unknown' AND route_observed)))"


@query(sql.labeled(f"""SELECT dataset, {sql.count(f"{_ROUTED} AND action = 'revise'")} AS explicit, {sql.count(f"{_ROUTED} AND action = 'unknown'")} AS linked_route, {sql.count(_ROUTED)} AS pairs, {sql.count(f"{_ROUTED} AND answer_changed")} AS changed,
  {sql.count(f"{_ROUTED} AND NOT answer_changed")} AS unchanged, {sql.count(f"{_ROUTED} AND after_correct IS NOT NULL")} AS labeled, {sql.count(f"{_ROUTED} AND after_correct AND answer_changed")} AS repaired,
  {", ".join(f"{sql.count(_ROUTED + c)} AS {n}" for n, c in sql.FOLLOWED)} FROM l GROUP BY dataset"""))
def route_sensitivity(spark, d):
    return cells.route_counts(_remembered(spark, d), ["dataset"])


@query(sql.over("SELECT uid, review_seq * 2 AS review_seq, memory_action, link_status = 'linked' AS memory_valid, link_status = 'linked' AND memory_action = 'review_route' AS route_observed, link_status FROM me", sql.MEMORY))
def memory_links(spark, d):
    return transitions.memory_link(events.classify(adapter.memory_log(spark, d)))


@query(sql.labeled(f"""SELECT dataset, actor, {", ".join(f"{sql.count(f'NOT before_correct AND after_correct IS NOT NULL{c}')} AS {p}labeled_pre_wrong, {sql.count(f'NOT before_correct AND after_correct AND answer_changed{c}')} AS {p}repaired"
  for p, c in (("", ""), ("strict_", " AND strict"), ("gate_", " AND bucket = 'gate_confounded'")))} FROM l GROUP BY dataset, actor"""))
def pre_wrong_labeled(spark, d):
    return cells.pre_wrong_counts(_labeled(spark, d), ["dataset", "actor"])


def _detail(spark: SparkSession, d: str) -> DataFrame:
    log = files.stored_once(spark, "detail-log", f"{d}/events.parquet", lambda: events.classify(adapter.full_log(spark, d)))
    members = [(f"d{i}", "s0", f"m{j}") for i in range(5) for j in range(2)]
    return details.checked(details.detail_rows(log, _labels(log), details.trajectories(adapter.trajectories(spark, d), members)))


@query(sql.detail())
def detail_rows(spark, d):
    """Every review opportunity in full, with its memory record's checks, both turns, labels and their sources."""
    return _detail(spark, d)


@query(sql.over("""SELECT a.uid, a.seq, lower(a.c_sender) AS preferred, coalesce(max(CASE WHEN lower(t.sender) = lower(a.c_sender) THEN t.seq END), max(t.seq)) AS before_seq,
  coalesce(arg_max(t.sender, t.seq) FILTER (lower(t.sender) = lower(a.c_sender)), arg_max(t.sender, t.seq)) AS before_sender, coalesce(bool_or(lower(t.sender) = lower(a.c_sender)), false) AS by_preferred
  FROM (SELECT * FROM s WHERE kind = 'anchor') a LEFT JOIN (SELECT uid, seq, sender FROM s WHERE protocol = 'broadcast' AND kind = 'discussion') t ON t.uid = a.uid AND t.seq < a.seq
    AND NOT EXISTS (SELECT 1 FROM s g WHERE g.uid = a.uid AND g.protocol = 'broadcast' AND g.kind = 'submission' AND g.seq > t.seq AND g.seq < a.seq) GROUP BY ALL"""))
def preferred_actors(spark, d):
    """The turn before each anchor, of the source that it names if it has spoken since the last submission."""
    return transitions.previous_actor(_parsed(spark, d), F.col("is_anchor"), F.col("source_key"))


@query(sql.over("SELECT uid, answer_key, value, conflict, sources FROM labf", sql.LABELS, sql.FINALS))
def frozen_labels_with_finals(spark, d):
    return transitions.frozen_labels(_parsed(spark, d), adapter.finals(spark, d))


@also_aligned
@query(sql.labeled(f"""SELECT protocol, sum(strict_pairs)::BIGINT AS den, sum(strict_changed)::BIGINT AS num, {sql.rate("sum(strict_changed)", "sum(strict_pairs)")} AS rate, {sql.count("strict_pairs > 0")} AS cells FROM ({sql.revise("dataset, protocol")}) GROUP BY protocol"""))
def pooled_uptake(spark, d):
    return cells.pooled(cells.revise_counts(_labeled(spark, d), ["dataset", "protocol"]), ["protocol"], "strict_changed", "strict_pairs")


def _grid(spark: SparkSession) -> DataFrame:
    """Every cell of the report: a fixed list, which the data may not fill."""
    return spark.createDataFrame([(f"d{i}", f"m{j}", p) for i in range(6) for j in range(2) for p in ("per", "broadcast")], "dataset string, actor string, protocol string")


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return cells.matrix(_labeled(spark, d), _grid(spark))


@also_aligned
@query(sql.matrix())
def matrix_2x5(spark, d):
    return _matrix(spark, d)


@also_aligned
@query(sql.directions())
def matrix_direction_counters(spark, d):
    return cells.directions(_matrix(spark, d), ["dataset", "actor"])


@also_aligned
@query(sql.labeled("""SELECT dataset, actor, per_strict, broadcast_strict, CASE WHEN per_strict IS NULL OR broadcast_strict IS NULL THEN 'missing_protocol' WHEN per_strict = 0 OR broadcast_strict = 0 THEN 'refused_zero_strict'
  ELSE 'descriptive' END AS status FROM (SELECT dataset, actor, CASE WHEN bool_or(protocol = 'per') THEN count_if(protocol = 'per' AND bucket = 'strict_pre_gate')::BIGINT END AS per_strict,
  CASE WHEN bool_or(protocol = 'broadcast') THEN count_if(protocol = 'broadcast' AND bucket = 'strict_pre_gate')::BIGINT END AS broadcast_strict FROM l GROUP BY dataset, actor)"""))
def comparison_gate(spark, d):
    return cells.comparison_status(cells.cell_summary(_labeled(spark, d)), ["dataset", "actor"])


@query("SELECT unnest([" + ", ".join(f"'{v}'" for v in sql.VIOLATIONS) + "]) AS name, 0::BIGINT AS violations")
def partition_invariants(spark, d):
    x = _labeled(spark, d)
    return cells.violations(cells.cell_summary(x), x)


@also_aligned
@query(sql.labeled("SELECT protocol, to_json(list_sort(list(DISTINCT status)))::VARCHAR AS status_json, to_json(list_sort(list(DISTINCT bucket)))::VARCHAR AS bucket_json FROM l GROUP BY protocol"))
def status_sets(spark, d):
    return cells.status_sets(_labeled(spark, d), ["protocol"], "status", "bucket")


@query(sql.labeled("SELECT protocol, status, count(*) AS n FROM l GROUP BY protocol, status"))
def status_counts(spark, d):
    return _labeled(spark, d).groupBy("protocol", "status").agg(F.count("*").alias("n"))


@query(sql.labeled("SELECT uid, review_seq, dataset, actor, tier, problem FROM t LEFT JOIN (SELECT DISTINCT uid, dataset, actor, tier, problem FROM s) USING (uid)"))
def events_with_metadata(spark, d):
    """Every review, with its trajectory's metadata."""
    meta = adapter.steps(spark, d).select("uid", "dataset", "actor", "tier", "problem").distinct()
    return transitions.transitions(_parsed(spark, d)).select("uid", "review_seq").join(meta, "uid", "left")


QUERIES["events_with_all_metadata"], ORACLE["events_with_all_metadata"] = QUERIES["events_with_metadata"], ORACLE["events_with_metadata"]  # an older name


# Attempts


@query(sql.over("SELECT * FROM att", sql.ATTEMPTS))
def attempts(spark, d):
    return _attempts(spark, d)


@query(sql.over("SELECT * FROM prob", sql.ATTEMPTS))
def first_success(spark, d):
    return A.problems(_attempts(spark, d))


_PASS = f"""
  pk AS (SELECT tier, k, problems, count_if(first_success <= k)::BIGINT AS passed, count_if(first_success = k)::BIGINT AS gained FROM (SELECT *, 1 + uid % 10 AS tier FROM prob) p
    JOIN (SELECT tier, count(*) AS problems, unnest(range(1, max(attempts) + 1)) AS k FROM (SELECT *, 1 + uid % 10 AS tier FROM prob) GROUP BY tier) USING (tier) GROUP BY tier, k, problems)"""


@query(sql.over(f"SELECT *, {sql.rate('passed', 'problems')} AS pass_at_k, {sql.rate('gained', 'problems')} AS marginal_gain, {sql.rate('gained', 'problems - passed + gained')} AS conditional_recovery FROM pk", sql.ATTEMPTS, _PASS))
def outer_pass_at_k(spark, d):
    return A.pass_at_k(_problems(spark, d), "tier")


@query(sql.over("SELECT uid, round(coalesce(1.0 / first_success / (1 + 0.5 * tries_before_success), 0), 9)::DOUBLE AS score FROM prob", sql.ATTEMPTS))
def hint_scores(spark, d):
    return _problems(spark, d).select("uid", A.reciprocal_score(F.col("first_success"), F.col("tries_before_success")).alias("score"))


@query(sql.over("SELECT round(avg(m), 9) AS macro, count(*) AS groups FROM (SELECT 1 + uid % 10 AS tier, avg(coalesce(1.0 / first_success, 0)) AS m FROM prob GROUP BY 1)", sql.ATTEMPTS))
def dmras(spark, d):
    return A.macro_average(_problems(spark, d).withColumn("score", F.coalesce(1.0 / F.col("first_success"), F.lit(0.0))), "tier", "score")


@query(sql.over("SELECT domain, count(*) AS n, count_if(final_passed)::BIGINT AS passed FROM (SELECT *, unnest(['x' || uid % 3, 'y' || uid % 4]) AS domain FROM prob) GROUP BY domain", sql.ATTEMPTS))
def domain_scores(spark, d):
    domains = F.array(F.concat(F.lit("x"), F.col("uid") % 3), F.concat(F.lit("y"), F.col("uid") % 4))
    return _problems(spark, d).withColumn("domain", F.explode(domains)).groupBy("domain").agg(F.count("*").alias("n"), count_if(F.col("final_passed")).alias("passed"))


@query(sql.over(f"""SELECT count(*) AS problems, {sql.rate("count_if(final_passed)", "count(*)")} AS final_pass_rate, {sql.rate("count_if(first_passed)", "count(*)")} AS pass_at_1,
  round(avg(CASE WHEN first_success IS NOT NULL THEN first_success END), 9) AS attempts_to_success, sum(attempts)::BIGINT AS attempts FROM prob""", sql.ATTEMPTS))
def basic_metrics(spark, d):
    x = _problems(spark, d)
    return x.agg(F.count("*").alias("problems"), rate(count_if(F.col("final_passed")), F.count("*")).alias("final_pass_rate"), rate(count_if(F.col("first_passed")), F.count("*")).alias("pass_at_1"), F.avg("first_success").alias("attempts_to_success"), F.sum("attempts").alias("attempts"))


@query(sql.over(f"""SELECT count_if(changed AND np)::BIGINT AS changed_fixed, count_if(changed AND NOT np)::BIGINT AS changed_failed, count_if(NOT changed AND np)::BIGINT AS same_fixed, count_if(NOT changed AND NOT np)::BIGINT AS same_failed,
  {sql.rate("count_if(changed AND np)", "count_if(changed)")} AS repair_if_changed FROM (SELECT passed, last_key, np, nk <> last_key AS changed, nk FROM (SELECT *, lead(passed) OVER w AS np, lead(last_key) OVER w AS nk FROM att WINDOW w AS (PARTITION BY uid ORDER BY attempt)))
  WHERE NOT passed AND np IS NOT NULL AND last_key IS NOT NULL AND nk IS NOT NULL""", sql.ATTEMPTS))
def system_feedback(spark, d):
    return A.system_feedback(_attempts(spark, d))


_INNER = "".join(f", {sql.rate(a, b)} AS {n}" for n, a, b in (("repair", "wc", "ww + wc"), ("harm", "cw", "cw + cc"), ("preservation", "cc", "cw + cc"), ("neglect", "neglected", "ww + wc"), ("try_but_fail", "failed_try", "ww + wc"), ("net_gain", "wc - cw", "pairs")))


@query(sql.labeled(f"""SELECT *{_INNER} FROM (SELECT tier, {sql.count("NOT before_correct AND NOT after_correct")} AS ww, {sql.count("NOT before_correct AND after_correct")} AS wc, {sql.count("before_correct AND NOT after_correct")} AS cw,
  {sql.count("before_correct AND after_correct")} AS cc, {sql.count("NOT before_correct AND NOT answer_changed")} AS neglected, {sql.count("NOT before_correct AND NOT after_correct AND answer_changed")} AS failed_try, count(*) AS pairs, grouping(tier) = 1 AS all_rows
  FROM l WHERE before_correct IS NOT NULL AND after_correct IS NOT NULL GROUP BY GROUPING SETS ((), (tier)))"""))
def inner_loop_rates(spark, d):
    return A.inner_rates(_labeled(spark, d), ["tier"])


@query(sql.labeled(f"""SELECT *, {sql.rate("tp", "tp + fp")} AS precision, {sql.rate("tp", "tp + fn")} AS recall, {sql.rate("fp", "fp + tn")} AS false_alarm, round((tp::DOUBLE / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2, 9) AS balanced FROM
  (SELECT protocol, {sql.count("action = 'revise' AND NOT before_correct")} AS tp, {sql.count("action = 'revise' AND before_correct")} AS fp, {sql.count("action = 'agree' AND NOT before_correct")} AS fn, {sql.count("action = 'agree' AND before_correct")} AS tn
  FROM l WHERE action IN ('revise', 'agree') AND before_correct IS NOT NULL GROUP BY protocol)"""))
def review_confusion(spark, d):
    return A.confusion(_labeled(spark, d), ["protocol"])


@query(sql.labeled("""SELECT cell, count(x.uid) AS n FROM (SELECT a || '_' || b || '_' || c AS cell FROM (SELECT unnest(['wrong', 'correct']) AS a), (SELECT unnest(['agree', 'revise']) AS b), (SELECT unnest(['wrong', 'correct']) AS c))
  LEFT JOIN (SELECT uid, CASE WHEN before_correct THEN 'correct' ELSE 'wrong' END || '_' || action || '_' || CASE WHEN after_correct THEN 'correct' ELSE 'wrong' END AS cell FROM l WHERE before_correct IS NOT NULL AND after_correct IS NOT NULL) x USING (cell) GROUP BY cell"""))
def review_tensor(spark, d):
    return A.review_tensor(_labeled(spark, d))


_DONE = "CASE action WHEN 'agree' THEN NOT answer_changed WHEN 'revise' THEN answer_changed END"


@query(sql.labeled(f"""SELECT protocol, count(*) AS episodes, count(done) AS eligible, {sql.count("done")} AS incorporated, {sql.count("done AND transition_outcome = 'repaired'")} AS useful, {sql.count("done AND action = 'revise' AND before_correct AND NOT after_correct")} AS misled,
  {sql.count("done AND action = 'revise' AND before_correct")} AS harmful FROM (SELECT *, {_DONE} AS done FROM l) GROUP BY protocol"""))
def feedback_incorporation(spark, d):
    return A.incorporation(_labeled(spark, d), ["protocol"])


@also_aligned
@query(sql.labeled(f"""SELECT protocol, grouping(protocol) = 1 AS total, {sql.count("action = 'revise' AND NOT before_correct")} AS useful_revisions, {sql.count("action = 'revise' AND NOT before_correct AND strict")} AS eligible,
  {sql.count("action = 'revise' AND NOT before_correct AND strict AND answer_changed")} AS coupled, {sql.rate("count_if(action = 'revise' AND NOT before_correct AND strict AND answer_changed)", "count_if(action = 'revise' AND NOT before_correct AND strict)")} AS coupling FROM l GROUP BY GROUPING SETS ((), (protocol))"""))
def strict_coupling_by_protocol(spark, d):
    useful = (F.col("action") == "revise") & F.coalesce(~F.col("before_correct"), F.lit(False))
    a, b = count_if(useful & F.col("strict")), count_if(useful & F.col("strict") & F.col("answer_changed"))
    x = _labeled(spark, d).rollup("protocol").agg((F.grouping("protocol") == 1).alias("total"), count_if(useful).alias("useful_revisions"), a.alias("eligible"), b.alias("coupled"))
    return x.withColumn("coupling", rate(F.col("coupled"), F.col("eligible")))


_PROCESS = """
  c0 AS (SELECT uid, seq, sender, lower(answer) AS key, lag(lower(answer)) OVER (PARTITION BY uid ORDER BY seq) AS prev FROM s WHERE kind IN ('executor', 'submission', 'discussion')),
  c1 AS (SELECT uid, key, count(*) AS n, count_if(key = prev) AS again FROM c0 GROUP BY uid, key),
  c2 AS (SELECT uid, count(*) AS distinct_candidates, sum(again)::BIGINT AS repeats, max(n) AS commonest, max(n) >= 3 AS loops FROM c1 GROUP BY uid),
  sp AS (SELECT uid, CASE WHEN kind = 'executor' THEN 'Executor' WHEN kind = 'review' THEN 'Reviewer' WHEN kind IN ('submission', 'anchor', 'update') THEN 'system' WHEN kind IN ('pass', 'fail') THEN 'Evaluator' ELSE sender END AS sender FROM s)"""


@query(sql.over("""SELECT u.*, distinct_candidates, repeats, commonest, loops FROM (SELECT uid, round((max(n) - min(n))::DOUBLE / sum(n), 9) AS imbalance, count(*) AS speakers FROM (SELECT uid, sender, count(*) AS n FROM sp GROUP BY ALL) GROUP BY uid) u LEFT JOIN c2 USING (uid)""", _PROCESS))
def diagnostics(spark, d):
    return A.process(_parsed(spark, d))


@query(sql.over("SELECT sender, count(*) AS turns, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM sp GROUP BY sender", _PROCESS))
def turn_share(spark, d):
    return A.turn_share(_parsed(spark, d))


# Sequences


@query(sql.over("SELECT uid, seq, answer FROM (SELECT *, lag(answer) OVER (PARTITION BY uid ORDER BY seq) AS p FROM s WHERE k >= 10) WHERE p IS DISTINCT FROM answer"))
def dedupe_consecutive(spark, d):
    return sequences.dedupe_consecutive(adapter.steps(spark, d), ["uid"], ["seq"], F.when(F.col("k") >= 10, F.col("answer"))).select("uid", "seq", "answer")


_ISLAND = "(SELECT *, sum(chg) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AND turn <> min(turn) OVER (PARTITION BY conv_id) THEN 0 ELSE 1 END AS chg FROM conversations))"


@query(f"SELECT conv_id, island::BIGINT AS island, count(*) AS rows_, min(turn) AS first_turn FROM {_ISLAND} GROUP BY conv_id, island")
def group_islands(spark, d):
    x = sequences.islands(_table(spark, d, "conversations"), ["conv_id"], ["turn"], F.col("role"))
    return x.groupBy("conv_id", "island").agg(F.count("*").alias("rows_"), F.min("turn").alias("first_turn"))


@query(sql.over("""SELECT uid, seq, coalesce(max(k >= 90) OVER (PARTITION BY uid, seg ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS hint FROM (SELECT *, count_if(kind IN ('pass', 'fail')) OVER (PARTITION BY uid ORDER BY seq) AS seg FROM s)"""))
def look_ahead_hint(spark, d):
    return sequences.until_boundary(adapter.steps(spark, d), ["uid"], ["seq"], F.col("kind").isin("pass", "fail"), F.col("k") >= 90, "hint").select("uid", "seq", "hint")


@query(sql.over("SELECT uid, seq, first_value(CASE WHEN kind IN ('pass', 'fail') THEN kind END IGNORE NULLS) OVER (PARTITION BY uid ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS verdict FROM s WHERE protocol = 'per'"))
def next_verdict(spark, d):
    x = adapter.steps(spark, d).where("protocol = 'per'")
    return sequences.next_value(x, ["uid"], ["seq"], F.when(F.col("kind").isin("pass", "fail"), F.col("kind")), "verdict").select("uid", "seq", "verdict")


@query(sql.over("SELECT a.uid, a.seq, (SELECT arg_min(b.answer, b.seq) FROM s b WHERE b.uid = a.uid AND b.seq > a.seq AND b.answer <> a.answer) AS later FROM s a"))
def next_distinct_candidate(spark, d):
    return sequences.next_distinct(adapter.steps(spark, d), ["uid"], ["seq"], "answer", "later").select("uid", "seq", "later")


@query("SELECT conv_id, turn, tail_size::BIGINT AS tail_size FROM (SELECT *, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tail_size, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE tail_size <= 200 OR r = 1")
def recent_tail_budget(spark, d):
    return sequences.recent_tail(_table(spark, d, "conversations"), ["conv_id"], ["turn"], F.char_length(F.coalesce("text", F.lit(""))), 200).select("conv_id", "turn", "tail_size")


@query("""SELECT conv_id, turn, tail_size FROM (SELECT *, min(CASE WHEN role = 'user' THEN r END) OVER (PARTITION BY conv_id) AS p FROM (SELECT conv_id, turn, role, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS tail_size,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)) WHERE r = 1 OR tail_size <= 200 OR r <= p""")
def history_tail(spark, d):
    """The newest turns of at most 200 characters, and whatever goes back to the last question of the user."""
    return sequences.history_tail(_table(spark, d, "conversations"), ["conv_id"], ["turn"], F.char_length(F.coalesce("text", F.lit(""))).cast("long"), 200, 0, F.col("role") == "user").select("conv_id", "turn", "tail_size")


@query()
def token_tail(spark, d):
    """The newest turns of each conversation that take 300 tokens at most, four more for each turn's frame. No SQL: tests hold the counts and cuts against the tokenizer."""
    x = _table(spark, d, "conversations").withColumn("n_tokens", tokens.token_count(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")))
    return sequences.history_tail(x, ["conv_id"], ["turn"], F.col("n_tokens") + 4, 300, 0).select("conv_id", "turn", "n_tokens", "tail_size")


@query()
def fitted_prompts(spark, d):
    """Every document cut to 256 tokens, front and back kept. No SQL, as above. Rows are dealt to all tasks, however few the files' parts are."""
    fit = tokens.fit_tokens(F.col("text"), public_tokenizers.path("byte_bpe_50k.json"), 256)
    dealt = _table(spark, d, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select("doc_id", fit.alias("prompt"))


@query("SELECT conv_id, turn, entry, CASE WHEN entry > 1 THEN entry - 1 END AS parent FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS entry FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 3)")
def bounded_ledger(spark, d):
    return sequences.bounded_ledger(_table(spark, d, "conversations"), ["conv_id"], ["turn"], 3).select("conv_id", "turn", "entry", "parent")


@query(sql.over("SELECT uid, seq, 'T' || m || '_' || row_number() OVER (PARTITION BY uid, m ORDER BY seq) AS label FROM (SELECT *, count_if(kind = 'discussion') OVER (PARTITION BY uid ORDER BY seq) AS m FROM s WHERE protocol = 'broadcast')"))
def turn_labels(spark, d):
    x = adapter.steps(spark, d).where("protocol = 'broadcast'")
    return sequences.nested_numbers(x, ["uid"], ["seq"], F.col("kind") == "discussion").select("uid", "seq", "label")


# Picks and samples


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest_wins(spark, d):
    return sampling.pick(_table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def first_wins(spark, d):
    return sampling.pick(_table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], [F.col("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id, user_id) AS r FROM (SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY ALL)) WHERE r <= 24")
def first_n_distinct(spark, d):
    return sampling.first_n_distinct(_table(spark, d, "events"), ["event_type"], "user_id", "event_id", 24)


_RANK = "CASE WHEN status = 'actor_response_before_gate' THEN 0 WHEN status LIKE 'no_actor%' THEN 1 ELSE 9 END"


@query(sql.labeled(f"SELECT dataset, protocol, uid, review_seq, status FROM (SELECT *, row_number() OVER (PARTITION BY dataset, protocol ORDER BY {_RANK}, updates DESC, review_seq, uid) AS r FROM l) WHERE r = 1"))
def argmin_per_condition(spark, d):
    return sampling.pick(_labeled(spark, d), ["dataset", "protocol"], [F.expr(_RANK), F.col("updates").desc(), F.col("review_seq"), F.col("uid")]).select("dataset", "protocol", "uid", "review_seq", "status")


@query(sql.over("SELECT uid, answer, votes FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY votes DESC, o) AS r FROM (SELECT uid, answer, count(*) AS votes, min(seq) AS o FROM s GROUP BY ALL)) WHERE r = 1"))
def majority_revision(spark, d):
    return sampling.majority(adapter.steps(spark, d), ["uid"], "answer", "seq")


@query(sql.over("SELECT uid, bool_and(k < 50) AS unanimous, count_if(k < 50) * 2 > count(*) AS by_majority FROM s WHERE kind = 'approval' GROUP BY uid"))
def approval_policy(spark, d):
    x = adapter.steps(spark, d).where("kind = 'approval'")
    return x.groupBy("uid").agg(sampling.approved(F.col("k") < 50, True).alias("unanimous"), sampling.approved(F.col("k") < 50, False).alias("by_majority"))


@query("SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7' || doc_id), doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 60")
def stratified_round_robin(spark, d):
    return sampling.round_robin(_table(spark, d, "documents"), "source", "doc_id", 60, "7").select("doc_id", "source", "turn")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('salt|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 20")
def hash_subset(spark, d):
    return sampling.hash_subset(_table(spark, d, "documents"), "lang", "doc_id", 20, "salt").select("doc_id", "lang")


_BOOT = """
  st AS (SELECT protocol, problem, count_if(answer_changed)::BIGINT AS num, count_if(answer_pair_parsed)::BIGINT AS den FROM l GROUP BY ALL),
  un AS (SELECT *, row_number() OVER (PARTITION BY protocol ORDER BY problem) - 1 AS i, count(*) OVER (PARTITION BY protocol) AS n FROM st),
  dr AS (SELECT protocol, rep, ('0x' || substr(md5('b|' || rep || '|' || i), 1, 8))::BIGINT % n AS i FROM un, range(1, 1001) r(rep)),
  rp AS (SELECT protocol, rep, sum(num)::DOUBLE / nullif(sum(den), 0) AS rate FROM dr JOIN un USING (protocol, i) GROUP BY protocol, rep)"""


def _replicates(spark: SparkSession, d: str, replicates: int) -> DataFrame:
    stats = _labeled(spark, d).groupBy("protocol", "problem").agg(count_if(F.col("answer_changed")).alias("num"), count_if(F.col("answer_pair_parsed")).alias("den"))
    return sampling.bootstrap(stats, "protocol", "problem", "num", "den", replicates)


def also_1000(f: Callable[..., DataFrame]):
    """NAME_1000 is an older name of NAME."""
    QUERIES[f"{f.__name__}_1000"], ORACLE[f"{f.__name__}_1000"] = QUERIES[f.__name__], ORACLE[f.__name__]
    return f


@also_1000
@query(sql.over("SELECT protocol, count(rate) AS replicates, round(quantile_cont(rate, 0.025), 9) AS lo, round(quantile_cont(rate, 0.975), 9) AS hi FROM rp GROUP BY protocol", sql.PER, sql.BROADCAST, sql.LABELS, sql.LABELED, _BOOT))
def bootstrap_ci(spark, d, replicates=1000):
    return sampling.interval(_replicates(spark, d, replicates), ["protocol"])


@also_1000
@query(sql.over("SELECT 1 AS one, count(delta) AS replicates, round(quantile_cont(delta, 0.025), 9) AS lo, round(quantile_cont(delta, 0.975), 9) AS hi FROM (SELECT rep, max(CASE WHEN protocol = 'broadcast' THEN rate END) - max(CASE WHEN protocol = 'per' THEN rate END) AS delta FROM rp GROUP BY rep)", sql.PER, sql.BROADCAST, sql.LABELS, sql.LABELED, _BOOT))
def paired_delta_ci(spark, d, replicates=1000):
    side = lambda p: F.max(F.when(F.col("protocol") == p, F.col("rate")))
    x = _replicates(spark, d, replicates).groupBy("rep").agg((side("broadcast") - side("per")).alias("rate"))
    return sampling.interval(x.withColumn("one", F.lit(1)), ["one"])


# Reports


_CHUNK = """
  ch AS (SELECT day(ts) AS chunk, event_type AS metric, CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN round(avg(value), 6) ELSE count(*) END::DOUBLE AS value,
    CASE WHEN event_type IN ('click', 'view') THEN count_if(user_id % 2 = 0)::DOUBLE END AS numerator, CASE WHEN event_type = 'click' THEN count(*)::DOUBLE END AS denominator FROM events GROUP BY day(ts), event_type)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    e, t = _table(spark, d, "events"), F.col("metric")
    x = e.groupBy(F.dayofmonth("ts").cast("long").alias("chunk"), F.col("event_type").alias("metric")).agg(F.count("*").cast("double").alias("n"), F.round(F.avg("value"), 6).alias("m"), count_if(F.col("user_id") % 2 == 0).cast("double").alias("even"))
    return x.select("chunk", "metric", F.when(t == "error", F.col("m")).when(t != "view", F.col("n")).alias("value"), F.when(t.isin("click", "view"), F.col("even")).alias("numerator"), F.when(t == "click", F.col("n")).alias("denominator"))


@query(sql.over("""SELECT metric, kind AS aggregation, round(CASE kind WHEN 'sum_ratio' THEN ns / nullif(ds, 0) WHEN 'sum' THEN vs WHEN 'mean' THEN va END, 9) AS value, CASE WHEN kind = 'sum_ratio' THEN ns END AS numerator_sum, CASE WHEN kind = 'sum_ratio' THEN ds END AS denominator_sum, chunks
  FROM (SELECT metric, count(*) AS chunks, sum(numerator) AS ns, sum(denominator) AS ds, sum(value) AS vs, avg(value) AS va, CASE WHEN count_if(numerator IS NOT NULL AND denominator IS NOT NULL) = count(*) THEN 'sum_ratio' WHEN count_if(value = floor(value)) = count(*) THEN 'sum' WHEN count(value) > 0 THEN 'mean' ELSE 'unavailable' END AS kind FROM ch GROUP BY metric)""", _CHUNK))
def chunk_to_tier(spark, d):
    return reports.merge_chunks(_chunks(spark, d), ["metric"])


@query("""WITH r AS (SELECT user_id AS chunk, 1 + day(ts) % 7 AS k, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT chunk, k FROM (SELECT DISTINCT chunk FROM r), (SELECT unnest(range(1, max(k) + 1)) AS k FROM r))
  SELECT chunk, k, coalesce(last_value(n IGNORE NULLS) OVER (PARTITION BY chunk ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS n FROM g LEFT JOIN r USING (chunk, k)""")
def forward_fill_k(spark, d):
    x = _table(spark, d, "events").groupBy(F.col("user_id").alias("chunk"), (1 + F.dayofmonth("ts") % 7).cast("long").alias("k")).agg(F.count("*").alias("n"))
    return reports.forward_fill_k(x, "chunk", "n")


@query("""SELECT chunk, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 9) AS balanced FROM (SELECT day(ts) AS chunk, count_if(event_type = 'view')::DOUBLE AS tp, count_if(event_type = 'click')::DOUBLE AS fn, count_if(event_type = 'purchase')::DOUBLE AS tn, count_if(event_type = 'signup')::DOUBLE AS fp FROM events GROUP BY 1)""")
def derived_balanced_accuracy(spark, d):
    names = {"view": "tp", "click": "fn", "purchase": "tn", "signup": "fp"}
    metric = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in names.items()))
    x = _table(spark, d, "events").groupBy(F.dayofmonth("ts").cast("long").alias("chunk"), metric.alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return reports.balanced_from_parts(x, ["chunk"])


@query(sql.over("SELECT chunk, max(CASE WHEN metric = 'click' THEN value END) AS click, max(CASE WHEN metric = 'error' THEN value END) AS error, max(CASE WHEN metric = 'signup' THEN value END) AS signup FROM ch GROUP BY chunk", _CHUNK))
def pivot_wide(spark, d):
    return reports.wide(_chunks(spark, d), ["chunk"], ["click", "error", "signup"])


@query("SELECT r_name AS name, r_regionkey AS region, NULL AS nation FROM region UNION ALL SELECT n_name, n_regionkey, n_nationkey FROM nation")
def column_union(spark, d):
    return reports.stack(_table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")), _table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation")))


@query(f"SELECT lang, count(*) AS n, {sql.count('quality = 1')} AS right_, {sql.rate('count_if(quality = 1)', 'count(*)')} AS accuracy, grouping(lang) = 1 AS total FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY GROUPING SETS ((), (lang)) HAVING grouping(lang) = 1 OR lang IS NOT NULL")
def accuracy_by_tier(spark, d):
    x = _table(spark, d, "documents").select("doc_id", "lang").join(_table(spark, d, "labels"), "doc_id")
    return reports.accuracy(x.withColumn("ok", F.col("quality") == 1), "lang", "ok").withColumnRenamed("right", "right_")


@query("SELECT event_type AS key, sum(n)::BIGINT AS total FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def run_summary(spark, d):
    per = _table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return reports.map_totals(per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m")), "m")


# Labels and keys


@query("SELECT doc_id, lang, CASE WHEN quality = 1 THEN true WHEN quality = 0 THEN false END AS value FROM documents LEFT JOIN labels USING (doc_id)")
def runtime_label_reuse(spark, d):
    return _table(spark, d, "documents").select("doc_id", "lang").join(_table(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", text.tri_bool(F.col("quality")).alias("value"))


@query("SELECT count_if(l.doc_id IS NOT NULL)::BIGINT AS mapped, count_if(l.doc_id IS NULL)::BIGINT AS unmapped FROM documents d LEFT JOIN labels l USING (doc_id)")
def unmapped_counts(spark, d):
    x = _table(spark, d, "documents").select("doc_id").join(_table(spark, d, "labels").select("doc_id", F.lit(True).alias("m")), "doc_id", "left")
    return x.agg(count_if(F.col("m")).alias("mapped"), count_if(F.col("m").isNull()).alias("unmapped"))


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def verdict_key_check(spark, d):
    return reports.missing_keys(_table(spark, d, "documents"), _table(spark, d, "labels"), ["doc_id"])


@query(sql.over("SELECT problem, a.n AS per_events, b.n AS broadcast_events, b.n - a.n AS delta FROM (SELECT problem, count(*) AS n FROM s WHERE protocol = 'per' GROUP BY 1) a JOIN (SELECT problem, count(*) AS n FROM s WHERE protocol = 'broadcast' GROUP BY 1) b USING (problem)"))
def plain_vs_hint(spark, d):
    by = adapter.steps(spark, d).groupBy("problem").agg(F.nullif(count_if(F.col("protocol") == "per"), F.lit(0)).alias("per_events"), F.nullif(count_if(F.col("protocol") == "broadcast"), F.lit(0)).alias("broadcast_events"))
    return by.withColumn("delta", F.col("broadcast_events") - F.col("per_events")).where("delta IS NOT NULL")


@query("SELECT item_id AS position, nullif(trim(text), '') AS problem, NULL::VARCHAR AS answer, NULL::VARCHAR AS tier FROM benchmark")
def problem_loader_coalesce(spark, d):
    return files.problems(_table(spark, d, "benchmark"), "item_id")


# Text


@query("SELECT conv_id, turn, len(list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9_-]{3,}')), lambda w: w NOT IN ('that', 'this', 'with')))::BIGINT AS words FROM conversations")
def keyword_overlap(spark, d):
    return _table(spark, d, "conversations").select("conv_id", "turn", F.size(text.keywords(F.col("text"), ["that", "this", "with"])).cast("long").alias("words"))


@query("SELECT page_id, left(trim(regexp_replace(coalesce(html, ''), '\\s+', ' ', 'g')), 240) AS excerpt FROM pages")
def excerpt(spark, d):
    return _table(spark, d, "pages").select("page_id", text.excerpt(F.col("html")).alias("excerpt"))


@query("SELECT uid, seq, answer_key FROM (" + sql.over("SELECT uid, seq, lower(answer) AS answer_key FROM s WHERE kind IN ('executor', 'submission', 'discussion')") + ")")
def normalize_answer(spark, d):
    return _parsed(spark, d).where("answer_key IS NOT NULL").select("uid", "seq", "answer_key")


@query(sql.over("SELECT uid, seq, lower(answer) AS inner_key FROM s WHERE kind IN ('executor', 'submission', 'discussion')"))
def boxed_last(spark, d):
    x = adapter.messages(spark, d).where("stage IN ('executor_0', 'solver_submission', 'consensus_submission', 'discussion_0')")
    return x.select("uid", "seq", F.lower(text.boxed_last(F.col("content"))).alias("inner_key"))


@query(sql.over("SELECT uid, seq, [answer] AS boxes FROM s WHERE kind IN ('executor', 'submission', 'discussion')"))
def boxed_all(spark, d):
    x = adapter.messages(spark, d).where("stage IN ('executor_0', 'solver_submission', 'consensus_submission', 'discussion_0')")
    return x.select("uid", "seq", text.boxed_all(F.col("content")).alias("boxes"))


@query("SELECT l_orderkey, l_linenumber, l_quantity = l_tax * 100 AS same FROM lineitem")
def exact_match(spark, d):
    x = _table(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", rules.exact_match(F.col("l_quantity").cast("string"), (F.col("l_tax") * 100).cast("string")).alias("same"))


QUERIES["exact_match_all"], ORACLE["exact_match_all"] = QUERIES["exact_match"], ORACLE["exact_match"]  # an older name


@query(sql.over("SELECT uid, seq, k % 3 = k % 2 AS same FROM s"))
def math_equal_rule(spark, d):
    x = adapter.steps(spark, d)
    return x.select("uid", "seq", rules.math_equal(F.concat(F.lit("\\frac{"), F.col("k") % 3, F.lit("}{2}")), F.concat((F.col("k") % 2 / 2).cast("string"))).alias("same"))


@query(sql.over("SELECT (k / 8.0)::DOUBLE AS number, count(*) AS answers, count(DISTINCT k % 4) AS spellings FROM s GROUP BY k"))
def answers_by_form(spark, d):
    """Answers that mean the same number, in four spellings, grouped by their form: no pair of texts is compared."""
    k, m = F.col("k").cast("string"), F.col("k") % 4
    said = F.when(m == 0, F.concat(F.lit("\\frac{"), k, F.lit("}{8}"))).when(m == 1, F.concat(k, F.lit("/8"))).when(m == 2, F.concat(F.lit("$x = \\dfrac{2 \\cdot "), k, F.lit("}{4^2}$."))).otherwise(F.concat((F.col("k") / 8).cast("string"), F.lit(" \\text{ cm}")))
    x = adapter.steps(spark, d).select(m.alias("spelling"), forms.math_form(said).alias("f")).where("f.shape = '#'")
    return x.groupBy(F.col("f.numbers")[0].alias("number")).agg(F.count("*").alias("answers"), F.countDistinct("spelling").alias("spellings"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, len(regexp_extract_all(coalesce(html, ''), '<a '))::BIGINT AS links FROM pages")
def regex_extracts(spark, d):
    return _table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.size(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("(<a )"), F.lit(1))).cast("long").alias("links"))


# Time


@query("""WITH RECURSIVE q AS (SELECT event_id, user_id % 16 AS worker, epoch_us(ts) // 21600 AS due, CASE WHEN event_type = 'error' THEN 2000000 END AS wait, row_number() OVER (PARTITION BY user_id % 16 ORDER BY epoch_us(ts) // 21600, event_id) AS i FROM events),
  f AS (SELECT worker, i, event_id, due, due AS admitted, [due] AS gone, due + wait AS cool FROM q WHERE i = 1
    UNION ALL SELECT worker, i, event_id, due, admitted, list_append(gone, admitted)[-18:], greatest(cool, admitted + wait) FROM (
      SELECT q.worker, q.i, q.event_id, q.due, q.wait, f.gone, f.cool, greatest(q.due, f.admitted, f.cool, CASE WHEN len(f.gone) = 18 THEN f.gone[1] + 1000001 END) AS admitted FROM f JOIN q ON q.worker = f.worker AND q.i = f.i + 1))
  SELECT event_id, worker, admitted, admitted - due AS waited FROM f""")
def request_admission(spark, d):
    """When each event would go out as a request: six hours of the log are a second, 18 requests a second may go out of a worker, and an error closes it for two."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21600)
    x = _table(spark, d, "events").select("event_id", (F.col("user_id") % 16).alias("worker"), at.alias("at"), F.when(F.col("event_type") == "error", F.lit(2_000_000).cast("long")).alias("wait"))
    return admission.admit(x, "worker", "at", "event_id", "wait").select("event_id", "worker", "admitted", "waited")


@query("SELECT ts, user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS recent FROM events")
def request_rate(spark, d):
    """Events of a user in the hour up to each."""
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    x = _table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return x.select("ts", "user_id", "event_id", F.count("*").over(w).alias("recent"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark, d):
    return live.tumbling(_table(spark, d, "events"), "ts", "1 hour", ["event_type"])


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (SELECT *, sum(CASE WHEN ts < p + INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, g""")
def session(spark, d):
    return live.sessions(_table(spark, d, "events"), "ts", "30 minutes", ["user_id"])
