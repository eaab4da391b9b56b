"""Reads the driver's `events` table as the message log of two review protocols, with rendered text to parse.

Even users are PER trajectories: view executor, click reviewer, purchase submission, signup PASS, error FAIL. Odd users are Broadcast ones:
view discussion, click review anchor, purchase approval, signup candidate update, error submission.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event: uid, seq, protocol, kind, answer, sender, k, keys of the cell, and the candidate of an anchor.

    Users are dealt to a fixed number of tasks: rows are few bytes here, so that Spark would put them all into one or two, but the texts made of them are costly to read.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id")
    per = F.col("user_id") % 2 == 0
    kinds = {"view": ("executor", "discussion"), "click": ("review", "anchor"), "purchase": ("submission", "approval"), "signup": ("pass", "update"), "error": ("fail", "submission")}
    kind = F.coalesce(*(F.when(F.col("event_type") == t, F.when(per, a).otherwise(b)) for t, (a, b) in kinds.items()))
    out = e.select(
        F.col("user_id").alias("uid"), F.col("event_id"), F.col("ts"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("seq"),
        F.when(per, "per").otherwise("broadcast").alias("protocol"), kind.alias("kind"),
        F.substring(F.lit("ABCD"), (1 + F.floor("value") % 4).cast("int"), F.lit(1)).alias("answer"),
        F.substring(F.lit("MRT"), (1 + F.floor(F.col("value") * 10) % 3).cast("int"), F.lit(1)).alias("sender"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat(F.lit("d"), F.col("user_id") % 5).alias("dataset"), F.concat(F.lit("m"), F.floor(F.col("user_id") / 2) % 2).alias("actor"),
        (1 + F.col("user_id") % 10).alias("tier"), F.floor(F.col("user_id") / 2).alias("problem"),
    )
    # An anchor names the latest earlier actor's answer, or now and then its own.
    back = Window.partitionBy("uid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    actor = F.when(F.col("kind") == "discussion", F.struct("sender", "answer"))
    seen = F.last(actor, ignorenulls=True).over(back)
    copied = F.when(F.col("k") % 5 != 0, seen)
    return out.withColumns({"c_sender": F.coalesce(copied["sender"], F.col("sender")), "c_answer": F.coalesce(copied["answer"], F.col("answer"))})


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a producer would write it: event_type, stage, sender, role, content."""
    box = lambda c: F.concat(F.lit("\\boxed{"), F.col(c), F.lit("}"))
    pick = lambda **by: F.coalesce(*(F.when(F.col("kind") == k, v if not isinstance(v, str) else F.lit(v)) for k, v in by.items()), F.lit(""))
    k = F.col("k")
    review = F.when(k < 40, F.concat(F.lit("Diagnosis: a step is wrong.\nCandidate Answer: "), box("answer"))).when(k < 70, "[Agree] the result holds.").otherwise("It looks plausible.")
    approval = F.concat(F.lit("Review Position: "), F.when(k < 50, "approve").otherwise("needs_revision"))
    per = F.col("protocol") == "per"
    return steps(spark, sf_dir).select(
        "uid", "seq", "protocol", "k", "dataset", "actor", "tier", "problem", "event_id", "ts",
        F.lit("message").alias("event_type"),
        pick(executor="executor_0", review="reviewer_0", submission=F.when(per, "solver_submission").otherwise("consensus_submission"), **{"pass": "evaluation", "fail": "evaluation"},
             discussion="discussion_0", anchor="candidate_review_0", approval="approval_0", update=F.concat(F.lit("approval_"), k % 2, F.lit("_candidate_update"))).alias("stage"),
        pick(executor="Executor", review="Reviewer", submission="system", **{"pass": "Evaluator", "fail": "Evaluator"}, discussion=F.col("sender"), anchor="system", approval=F.col("sender"), update="system").alias("sender"),
        F.when(F.col("kind").isin("pass", "fail"), "evaluator").when(F.col("kind").isin("anchor", "update", "submission"), "system").otherwise("agent").alias("role"),
        pick(executor=F.concat(F.lit("We compute step by step.\nSo the result is "), box("answer"), F.lit(".")), review=review, submission=F.concat(F.lit("Submitted: "), box("answer")),
             **{"pass": "Evaluation signal: PASS", "fail": "Evaluation signal: FAIL"}, discussion=F.concat(F.lit("I think it is "), box("answer")),
             anchor=F.concat(F.lit("Source: "), F.col("c_sender"), F.lit("\nCandidate under review: "), box("c_answer")), approval=approval, update=F.concat(F.lit("Candidate updated to "), box("answer"))).alias("content"),
    )


def memory_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PER part of the log with a memory record after most reviews, some of them broken; seq is twice that of steps()."""
    base = messages(spark, sf_dir).where("protocol = 'per'").select(
        "uid", (F.col("seq") * 2).alias("seq"), "protocol", "event_type", "stage", "sender", "role", "content", F.concat(F.lit("u"), F.col("seq")).alias("event_uid"),
        F.lit(None).cast("string").alias("previous_event_uid"), F.lit(None).cast("string").alias("extra_json"), (F.col("k") % 10).alias("d"),
    )
    d = F.col("d")
    said = F.to_json(F.struct(F.when(d < 3, "review_route").otherwise("review_note").alias("action"), F.lit("Reviewer").alias("source"), F.when(d == 6, "actor").otherwise("internal_reviewer_suggestion").alias("authority"), F.lit("reviewer_0").alias("stage")))
    memory = base.where("stage = 'reviewer_0' AND d < 9").select(
        "uid", (F.col("seq") + 1).alias("seq"), "protocol", F.when(d == 8, "meta").otherwise("summary").alias("event_type"), F.lit("reviewer_0_candidate_memory").alias("stage"), F.lit("system").alias("sender"), F.lit("system").alias("role"), F.lit("").alias("content"),
        F.lit(None).cast("string").alias("event_uid"), F.when(d == 8, "u-1").otherwise(F.col("event_uid")).alias("previous_event_uid"), F.when(d == 7, "{broken").otherwise(F.concat(F.lit('{"candidate_memory_event": '), said, F.lit("}"))).alias("extra_json"), "d",
    )
    return base.unionByName(memory).drop("d")


def full_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memory_log with the Broadcast trajectories, which have no memory; their seq is that of steps()."""
    return memory_log(spark, sf_dir).unionByName(messages(spark, sf_dir).where("protocol = 'broadcast'").select("uid", "seq", "protocol", "event_type", "stage", "sender", "role", "content"), allowMissingColumns=True)


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the trajectories' table says of each: uid, protocol, problem, dataset, slice_id, actor, evaluator, release_status, provenance_status."""
    u, text = F.col("uid"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("uid")).distinct().select(
        "uid", F.when(u % 2 == 0, "per").otherwise("broadcast").alias("protocol"), F.floor(u / 2).alias("problem"), text("d", u % 5).alias("dataset"), text("s", F.floor(u / 4) % 2).alias("slice_id"),
        text("m", F.floor(u / 2) % 2).alias("actor"), text("e", u % 3).alias("evaluator"), F.when(u % 7 == 0, "provisional").otherwise("final").alias("release_status"), F.when(u % 11 == 0, "rebuilt").otherwise("logged").alias("provenance_status"),
    )


def finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each PER trajectory's last submitted answer, and what its producer said of it: uid, answer_key, value (null for some)."""
    s = steps(spark, sf_dir).where("protocol = 'per' AND kind = 'submission'")
    return s.groupBy("uid").agg(F.lower(F.max_by("answer", "seq")).alias("answer_key")).withColumn("value", F.when(F.col("uid") % 5 != 0, F.col("uid") % 3 == 0))


#: The same steps for DuckDB, from the kinds and answers, without any text.
STEPS_SQL = """
  b AS (SELECT user_id AS uid, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
    CASE WHEN user_id % 2 = 0 THEN 'per' ELSE 'broadcast' END AS protocol,
    CASE event_type WHEN 'view' THEN CASE WHEN user_id % 2 = 0 THEN 'executor' ELSE 'discussion' END
      WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'review' ELSE 'anchor' END
      WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'submission' ELSE 'approval' END
      WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'pass' ELSE 'update' END
      WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'fail' ELSE 'submission' END END AS kind,
    substr('ABCD', (1 + floor(value)::BIGINT % 4)::INT, 1) AS answer, substr('MRT', (1 + floor(value * 10)::BIGINT % 3)::INT, 1) AS sender,
    json_extract_string(props, '$.k')::INT AS k, 'd' || (user_id % 5) AS dataset, 'm' || ((user_id // 2) % 2) AS actor,
    1 + user_id % 10 AS tier, user_id // 2 AS problem FROM events),
  s AS (SELECT *, CASE WHEN k % 5 <> 0 THEN coalesce(last_value(CASE WHEN kind = 'discussion' THEN sender END IGNORE NULLS) OVER w, sender) ELSE sender END AS c_sender,
    CASE WHEN k % 5 <> 0 THEN coalesce(last_value(CASE WHEN kind = 'discussion' THEN answer END IGNORE NULLS) OVER w, answer) ELSE answer END AS c_answer
    FROM b WINDOW w AS (PARTITION BY uid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
