"""Attempts of a trajectory: what lies between two verdicts, and the scores made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import count_if, rate

def segments(events: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Adds attempt, from 1: a row belongs to the attempt that the next verdict closes, the verdict's row included."""
    before = Window.partitionBy("uid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("attempt", 1 + F.count_if(F.col(verdict).isNotNull()).over(before))


def attempts(events: DataFrame) -> DataFrame:
    """One row per verdict: passed, closed_seq, turns before it, first and last candidate key, candidates and distinct candidates.
    Rows after the last verdict belong to none. events: uid, seq, verdict, answer_key."""
    keyed = F.when(F.col("answer_key").isNotNull(), F.col("seq"))
    x = segments(events).groupBy("uid", "attempt").agg(
        F.max("verdict").alias("passed"), F.max(F.when(F.col("verdict").isNotNull(), F.col("seq"))).alias("closed_seq"), (F.count("*") - 1).alias("turns"),
        F.min_by("answer_key", keyed).alias("first_key"), F.max_by("answer_key", keyed).alias("last_key"), F.count("answer_key").alias("candidates"), F.countDistinct("answer_key").alias("distinct_candidates"),
    )
    return x.where("closed_seq IS NOT NULL")


def problems(att: DataFrame) -> DataFrame:
    """One row per trajectory that had a verdict: attempts, first_success, first_passed, final_passed, tries_before_success (all if there is none)."""
    x = att.groupBy("uid").agg(F.count("*").alias("attempts"), F.min(F.when(F.col("passed"), F.col("attempt"))).alias("first_success"), F.min_by("passed", "attempt").alias("first_passed"), F.max_by("passed", "attempt").alias("final_passed"))
    return x.withColumn("tries_before_success", F.coalesce(F.col("first_success") - 1, F.col("attempts")))


def pass_at_k(probs: DataFrame, by: str) -> DataFrame:
    """For each group and k up to its most attempts: how many passed within k, the gain at k and the recovery among those not yet passed.

    Each trajectory adds to one k only; the sums over k run over that small histogram, not over trajectories."""
    hist = probs.groupBy(by, F.coalesce("first_success", F.lit(0)).alias("k")).agg(F.count("*").alias("n"))
    most = probs.groupBy(by).agg(F.max("attempts").alias("most"), F.count("*").alias("problems"))
    grid = most.select(by, "problems", F.explode(F.sequence(F.lit(1).cast("long"), "most")).alias("k"))
    x = grid.join(hist.where("k > 0"), [by, "k"], "left").withColumn("gained", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(by).orderBy("k")
    x = x.withColumn("passed", F.sum("gained").over(w))
    return x.select(by, "k", "problems", "passed", "gained", rate(F.col("passed"), F.col("problems")).alias("pass_at_k"), rate(F.col("gained"), F.col("problems")).alias("marginal_gain"), rate(F.col("gained"), F.col("problems") - F.col("passed") + F.col("gained")).alias("conditional_recovery"))


def reciprocal_score(first_success: Column, hints: Column, penalty: float = 0.5) -> Column:
    """1 / attempt of the first success, less a share for each hint; 0 without success."""
    return F.coalesce(1.0 / first_success / (1 + penalty * hints), F.lit(0.0))


def macro_average(scored: DataFrame, by: str, score: str) -> DataFrame:
    """Mean of the groups' means; a null group is left out."""
    return scored.where(F.col(by).isNotNull()).groupBy(by).agg(F.avg(score).alias("m")).agg(F.avg("m").alias("macro"), F.count("*").alias("groups"))


def inner_rates(labeled: DataFrame, by: list[str]) -> DataFrame:
    """Shares of the four transitions between labelled answers, over all rows and for each group: one pass by grouping sets. all_rows marks the total."""
    x = labeled.where("before_correct IS NOT NULL AND after_correct IS NOT NULL")
    b, a, same = F.col("before_correct"), F.col("after_correct"), ~F.col("answer_changed")
    counts = {"ww": ~b & ~a, "wc": ~b & a, "cw": b & ~a, "cc": b & a, "neglected": ~b & same, "failed_try": ~b & ~a & ~same}
    g = x.rollup(*by).agg(*(count_if(c).alias(k) for k, c in counts.items()), F.count("*").alias("pairs"), F.grouping_id().alias("level"))
    g = g.where(F.col("level").isin(0, 2 ** len(by) - 1)).withColumn("all_rows", F.col("level") > 0).drop("level")
    wrong, right = F.col("ww") + F.col("wc"), F.col("cw") + F.col("cc")
    return g.withColumns({"repair": rate(F.col("wc"), wrong), "harm": rate(F.col("cw"), right), "preservation": rate(F.col("cc"), right), "neglect": rate(F.col("neglected"), wrong), "try_but_fail": rate(F.col("failed_try"), wrong), "net_gain": rate(F.col("wc") - F.col("cw"), F.col("pairs"))})


def confusion(labeled: DataFrame, by: list[str]) -> DataFrame:
    """A reviewer as a detector of wrong answers: tp, fp, fn, tn over labelled decisions of known action; precision, recall, false alarms, balanced accuracy."""
    x = labeled.where("action IN ('revise', 'agree') AND before_correct IS NOT NULL")
    flag, wrong = F.col("action") == "revise", ~F.col("before_correct")
    g = x.groupBy(*by).agg(count_if(flag & wrong).alias("tp"), count_if(flag & ~wrong).alias("fp"), count_if(~flag & wrong).alias("fn"), count_if(~flag & ~wrong).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return g.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "false_alarm": rate(fp, fp + tn), "balanced": (rate(tp, tp + fn) + rate(tn, tn + fp)) / 2})


def review_tensor(labeled: DataFrame) -> DataFrame:
    """All eight cells wrong/correct x agree/revise x wrong/correct with their counts, zeros included. cell, n."""
    name = lambda c: F.when(c, "correct").otherwise("wrong")
    x = labeled.where("action IN ('revise', 'agree') AND before_correct IS NOT NULL AND after_correct IS NOT NULL")
    cell = F.concat_ws("_", name(F.col("before_correct")), "action", name(F.col("after_correct")))
    cells = [f"{a}_{b}_{c}" for a in ("wrong", "correct") for b in ("agree", "revise") for c in ("wrong", "correct")]
    return x.agg(*(count_if(cell == c).alias(c) for c in cells)).unpivot([], cells, "cell", "n")


def incorporation(labeled: DataFrame, by: list[str]) -> DataFrame:
    """Whether the actor took a decision up: agree by keeping the answer, revise by changing it; useful where it repaired, misled where it harmed."""
    done = F.when(F.col("action") == "agree", ~F.col("answer_changed")).when(F.col("action") == "revise", F.col("answer_changed"))
    x = labeled.withColumn("done", done)
    harmful = F.col("done") & (F.col("action") == "revise") & F.col("before_correct")
    return x.groupBy(*by).agg(
        F.count("*").alias("episodes"), F.count("done").alias("eligible"), count_if(F.col("done")).alias("incorporated"), count_if(F.col("done") & (F.col("transition_outcome") == "repaired")).alias("useful"), count_if(harmful & ~F.col("after_correct")).alias("misled"), count_if(harmful).alias("harmful"),
    )


def system_feedback(att: DataFrame) -> DataFrame:
    """After each failed verdict with an attempt after it: changed by fixed, as a 2 x 2 table over all such episodes."""
    w = Window.partitionBy("uid").orderBy("attempt")
    x = att.withColumns({"next_passed": F.lead("passed").over(w), "next_key": F.lead("last_key").over(w)}).where("NOT passed AND next_passed IS NOT NULL AND last_key IS NOT NULL AND next_key IS NOT NULL")
    changed, fixed = F.col("next_key") != F.col("last_key"), F.col("next_passed")
    out = x.agg(count_if(changed & fixed).alias("changed_fixed"), count_if(changed & ~fixed).alias("changed_failed"), count_if(~changed & fixed).alias("same_fixed"), count_if(~changed & ~fixed).alias("same_failed"))
    return out.withColumn("repair_if_changed", rate(F.col("changed_fixed"), F.col("changed_fixed") + F.col("changed_failed")))


def process(events: DataFrame, looping: int = 3) -> DataFrame:
    """Per trajectory: distinct candidates, repeats of the answer just before, the commonest answer's count, and the imbalance of turns."""
    w = Window.partitionBy("uid").orderBy("seq")
    c = events.where("answer_key IS NOT NULL").withColumn("again", F.col("answer_key").eqNullSafe(F.lag("answer_key").over(w)))
    per_key = c.groupBy("uid", "answer_key").agg(F.count("*").alias("n"), count_if(F.col("again")).alias("again"))
    answers = per_key.groupBy("uid").agg(F.count("*").alias("distinct_candidates"), F.sum("again").alias("repeats"), F.max("n").alias("commonest"), (F.max("n") >= looping).alias("loops"))
    turns = events.groupBy("uid", "sender").agg(F.count("*").alias("n")).groupBy("uid").agg(rate(F.max("n") - F.min("n"), F.sum("n")).alias("imbalance"), F.count("*").alias("speakers"))
    return turns.join(answers, "uid", "left")


def signals(events: DataFrame, looping: int = 3) -> DataFrame:
    """Per trajectory what its agreements, attempts, routes and turns say of loops and convergence.

    reviews, agreements, agreed_then_fail and agreed_then_pass (by the next verdict); pairs of attempts next to each other that both have an answer, and
    repeated ones; fails with a verdict after them, and unchanged ones; loops (an attempt's answer or a route `looping` times, or an unchanged
    one); distinct_candidates; imbalance of the agents' turns (0 with one speaker, null without any). events: uid, seq, sender, action, route (or
    null), verdict, answer_key. Every step is keyed by uid; a trajectory without attempts has zeros.
    """
    key = Window.partitionBy("uid").orderBy("seq")
    x = events.withColumn("_later", F.first("verdict", ignorenulls=True).over(key.rowsBetween(1, Window.unboundedFollowing)))
    agreed = F.col("action") == "agree"
    counts = [F.count("action").alias("reviews"), count_if(agreed).alias("agreements"), count_if(agreed & ~F.col("_later")).alias("agreed_then_fail"), count_if(agreed & F.col("_later")).alias("agreed_then_pass")]
    base = x.groupBy("uid").agg(*counts, F.countDistinct("answer_key").alias("distinct_candidates"))
    near = Window.partitionBy("uid").orderBy("attempt")
    same = F.when(F.col("last_key").isNotNull(), F.count("*").over(Window.partitionBy("uid", "last_key")))
    att = attempts(events).withColumns({"_before": F.lag("last_key").over(near), "_next": F.lead("last_key").over(near), "_judged": F.lead("passed").over(near).isNotNull(), "_same": same})
    failed = ~F.col("passed") & F.col("_judged")
    tried = att.groupBy("uid").agg(
        count_if(F.col("last_key").isNotNull() & F.col("_before").isNotNull()).alias("pairs"), count_if(F.col("last_key") == F.col("_before")).alias("repeated"),
        count_if(failed).alias("fails"), count_if(failed & (F.col("last_key") == F.col("_next"))).alias("unchanged"), F.max("_same").alias("_most"),
    )
    routes = events.where("route IS NOT NULL").groupBy("uid", "route").agg(F.count("*").alias("n")).groupBy("uid").agg(F.max("n").alias("_routes"))
    spoken = events.where(~F.lower("sender").isin("system", "evaluator")).groupBy("uid", "sender").agg(F.count("*").alias("n"))
    turns = spoken.groupBy("uid").agg(rate(F.max("n") - F.min("n"), F.sum("n")).alias("imbalance"))
    out = base.join(tried, "uid", "left").join(routes, "uid", "left").join(turns, "uid", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("pairs", "repeated", "fails", "unchanged", "_most", "_routes")}
    loops = (F.col("_most") >= looping) | (F.col("_routes") >= looping) | (F.col("unchanged") > 0)
    return out.withColumns(zero).withColumn("loops", loops).drop("_most", "_routes")


def signal_rates(per_trajectory: DataFrame) -> DataFrame:
    """signals() over all trajectories: one row of sums and rates."""
    total = ("reviews", "agreements", "agreed_then_fail", "agreed_then_pass", "pairs", "repeated", "fails", "unchanged")
    one = per_trajectory.agg(
        F.count("*").alias("trajectories"), *(F.sum(c).alias(c) for c in total), count_if(F.col("agreed_then_fail") > 0).alias("wrongly_agreed"), count_if(F.col("loops")).alias("looping"),
        F.avg("distinct_candidates").alias("mean_candidates"), F.avg("imbalance").alias("mean_imbalance"),
    )
    of = {"agreement_rate": ("agreements", "reviews"), "repeated_answer_rate": ("repeated", "pairs"), "no_change_after_fail_rate": ("unchanged", "fails"), "premature_convergence_rate": ("wrongly_agreed", "trajectories"), "looping_rate": ("looping", "trajectories")}
    later = F.col("agreed_then_fail") + F.col("agreed_then_pass")
    return one.withColumns({k: rate(F.col(a), F.col(b)) for k, (a, b) in of.items()} | {"wrong_convergence_rate": rate(F.col("agreed_then_fail"), later), "productive_convergence_rate": rate(F.col("agreed_then_pass"), later)})


def turn_share(events: DataFrame) -> DataFrame:
    """Each sender's part of all turns."""
    by = events.groupBy("sender").agg(F.count("*").alias("turns"))
    return by.withColumn("share", rate(F.col("turns"), F.sum("turns").over(Window.partitionBy(F.lit(0)))))
