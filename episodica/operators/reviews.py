"""Episodes of plain-text traces: reviews of one reviewer, of a group or of an agent itself, and what follows a failed verdict.

The input is turns.classify()'s. A trace's example never meets another in a plan: every window has its key, so that one exchange serves
all. Candidates are '' where there is none, as in the traces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import turns as T
from ..functions.stats import count_if, rate

EPISODE = ["turn", "reviewer", "action", "before", "after", "after_fail"]


def _up_to(w: Window, last: int) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, last)


def _later(w: Window, first: int = 1) -> Window:
    return w.rowsBetween(first, Window.unboundedFollowing)


def _some(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _after_fail(w: Window) -> Column:
    """Whether the latest verdict was a failure."""
    return F.coalesce(~F.last(F.when(F.col("is_evaluator"), F.col("verdict")), ignorenulls=True).over(_up_to(w, -1)), F.lit(False))


def _next_named(w: Window) -> Column:
    """The next candidate of any turn, '' if an evaluator's word comes before one."""
    return F.first(F.when((F.col("named") != "") | F.col("marked"), F.col("named")), ignorenulls=True).over(_later(w))


def per_reviews(turns: DataFrame, key: list[str]) -> DataFrame:
    """Decisions of a reviewer: the key, turn, reviewer, action, before, after, after_fail.

    Before is the candidate that the review names as under review, else the latest one of any turn that isn't an evaluator's. After is
    the reviewer's own candidate, for a revision else the next one named; else nothing changes.
    """
    w = Window.partitionBy(*key).orderBy("turn_idx")
    last = F.last(F.when(~F.col("is_evaluator"), _some(F.col("named"))), ignorenulls=True).over(_up_to(w, -1))
    x = turns.withColumns({"last": F.coalesce(last, F.lit("")), "next": _next_named(w), "after_fail": _after_fail(w)}).where("is_reviewer AND NOT is_evaluator AND action IS NOT NULL")
    before = F.coalesce(_some(F.col("under_review")), F.col("last"))
    after = F.when(F.col("named") != "", F.col("named")).when(F.col("action") == "revise", F.coalesce(_some(F.col("next")), before)).otherwise(before)
    return x.select(*key, F.col("turn_idx").alias("turn"), F.col("agent_name").alias("reviewer"), "action", before.alias("before"), after.alias("after"), "after_fail")


def single_reviews(turns: DataFrame, key: list[str]) -> DataFrame:
    """Decisions of an agent that reviews itself, as per_reviews; what an episode ends with is the latest candidate for the next one."""
    w = Window.partitionBy(*key).orderBy("turn_idx")
    x = turns.withColumn("next", _next_named(w))
    left = F.when(F.col("own_action").isNull(), F.col("named")).when(F.col("own_action") == "revise", F.coalesce(_some(F.col("next")), F.col("under_review"))).otherwise(F.col("under_review"))
    last = F.last(F.when(~F.col("is_evaluator"), _some(left)), ignorenulls=True).over(_up_to(w, -1))
    x = x.withColumns({"last": F.coalesce(last, F.lit("")), "after_fail": _after_fail(w)}).where("NOT is_evaluator AND own_action IS NOT NULL")
    before = F.coalesce(_some(F.col("under_review")), F.col("last"))
    after = F.when(F.col("own_action") == "revise", F.coalesce(_some(F.col("next")), before)).otherwise(before)
    return x.select(*key, F.col("turn_idx").alias("turn"), F.col("agent_name").alias("reviewer"), F.col("own_action").alias("action"), before.alias("before"), after.alias("after"), "after_fail")


def group_reviews(turns: DataFrame, key: list[str]) -> DataFrame:
    """Peers' reviews of one candidate in one step are one episode: the key, turn (of the first), reviewer, action, before, after, after_fail, n_reviews.

    A step ends with an evaluator's turn, a new candidate for the group, or an update of the candidate; inside it an episode ends where
    another candidate is reviewed. One objection makes it a revision. After is the update that ends it, for a revision else the next
    other candidate reviewed or updated, else the next for the group, else the next one named; else nothing changes.
    """
    w = Window.partitionBy(*key).orderBy("turn_idx")
    opens, ends = F.col("is_evaluator") | (F.col("grouped") != ""), T.is_real(F.col("updated"))
    voted = (F.col("under_review") != "") & F.col("approve").isNotNull()
    value = F.when(voted, F.col("under_review")).when(ends, F.col("updated"))
    x = turns.withColumns({"step": F.count_if(opens).over(_up_to(w, 0)) + F.count_if(ends & ~opens).over(_up_to(w, -1)), "value": value, "vkey": T.key(value)})
    x = x.withColumn("vkey", F.when(F.col("value").isNotNull(), F.col("vkey")))
    other = F.col("vkey").isNotNull() & ~F.col("vkey").eqNullSafe(F.last("vkey", ignorenulls=True).over(_up_to(w, -1)))
    x = x.withColumns(
        {
            "head": F.when(other, F.col("value")), "review": voted & ~opens & ~ends, "closing": F.when(ends & ~opens, F.col("updated")),
            "next_group": F.first(F.when(T.is_real(F.col("grouped")), F.col("grouped")).when(F.col("marked"), F.lit("")), ignorenulls=True).over(_later(w)),
            "next_named": _next_named(w), "after_fail": _after_fail(w),
        }
    )
    x = x.withColumns({"next_other": F.first("head", ignorenulls=True).over(_later(w)), "closed_by": F.last("closing", ignorenulls=True).over(Window.partitionBy(*key, "step"))})
    inside = Window.partitionBy(*key, "step").orderBy("turn_idx")
    r = x.where("review").withColumn("new", ~F.col("vkey").eqNullSafe(F.lag("vkey").over(inside)))
    r = r.withColumns({"part": F.count_if("new").over(_up_to(inside, 0)), "parts": F.count_if("new").over(Window.partitionBy(*key, "step"))})
    first, last = (lambda c: F.min_by(c, "turn_idx")), (lambda c: F.max_by(c, "turn_idx"))
    g = r.groupBy(*key, "step", "part").agg(
        F.min("turn_idx").alias("turn"), F.when(F.every("approve"), "agree").otherwise("revise").alias("action"), first("under_review").alias("before"), F.count("*").alias("n_reviews"),
        F.max(F.when(F.col("part") == F.col("parts"), F.col("closed_by"))).alias("update"), last("next_other").alias("other"), first("next_group").alias("next_group"), first("next_named").alias("next_named"), first("after_fail").alias("after_fail"),
    )
    found = F.coalesce(F.col("other"), _some(F.col("next_group")), _some(F.col("next_named")), F.col("before"))
    after = F.when(F.col("update").isNotNull(), F.col("update")).when(F.col("action") == "revise", found).otherwise(F.col("before"))
    return g.select(*key, "turn", F.lit("broadcast_group").alias("reviewer"), "action", "before", after.alias("after"), "after_fail", "n_reviews")


def feedback(turns: DataFrame, key: list[str], stop: list[str]) -> DataFrame:
    """What follows a failed verdict: the key, turn, before, feedback_turns, repair_turns, used, next_passed.

    Feedback is the verdict's turn and the hints right after it, the response all further turns up to the next verdict; without a response
    there is no episode. Before is the candidate that the state holds: of a passing verdict its own, after a failure with a response
    the latest one before the next verdict.
    """
    w = Window.partitionBy(*key).orderBy("turn_idx")
    at = F.when(F.col("is_evaluator"), F.col("verdict"))
    x = turns.withColumns({"at": at, "latest": F.last(_some(F.col("named")), ignorenulls=True).over(_up_to(w, -1))})
    x = x.withColumn("seg", F.count("at").over(_up_to(w, 0))).where("seg > 0")
    inside = Window.partitionBy(*key, "seg").orderBy("turn_idx")
    plain = F.col("at").isNull() & ~F.col("follows_up")
    x = x.withColumn("responds", F.coalesce(F.max(plain).over(_up_to(inside, 0)), F.lit(False)))
    texts = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("turn_idx", F.concat("agent_name", F.lit(": "), "content").alias("named"), "content")))), lambda s: s["content"]), "\n")
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("responds"), F.struct("turn_idx", F.concat(F.lit("T"), "turn_idx", F.lit(" "), "agent_name", F.lit(": "), "content").alias("s"))))), lambda s: s["s"]), "\n")
    g = x.groupBy(*key, "seg").agg(
        F.min("turn_idx").alias("turn"), F.max("at").alias("passed"), F.min_by("named", "turn_idx").alias("own"), F.min_by("latest", "turn_idx").alias("latest"),
        count_if(~F.col("responds")).alias("feedback_turns"), count_if(F.col("responds")).alias("repair_turns"), texts(~F.col("responds")).alias("said"), path.alias("path"),
    )
    by = Window.partitionBy(*key).orderBy("seg")
    g = g.withColumns({"next_passed": F.lead("passed").over(by), "then": F.lead("latest").over(by)})
    state = F.when(F.col("passed"), _some(F.col("own"))).when((F.col("repair_turns") > 0) & F.col("next_passed").isNotNull(), F.col("then"))
    g = g.withColumn("state", F.last(state, ignorenulls=True).over(_up_to(by, -1))).where("NOT passed AND repair_turns > 0")
    before = F.coalesce("state", "latest", F.lit(""))
    return g.select(*key, "turn", before.alias("before"), "feedback_turns", "repair_turns", T.uses_feedback(F.col("said"), F.col("path"), stop).alias("used"), "next_passed")


def candidates(turns: DataFrame, key: list[str], by: list[str] = ()) -> DataFrame:
    """The candidates of each example (or part of it) in order, none twice in a row: the key, turn, candidate.

    A broadcast example that has candidates for the group counts these only; else every turn but evaluators' counts. turns: also protocol.
    """
    part = [*key, *by]
    group = T.is_real(F.col("grouped")) & (F.col("protocol") == "broadcast")
    x = turns.withColumn("groups", F.max(group).over(Window.partitionBy(*part)))
    value = F.when(F.col("groups"), F.when(group, F.col("grouped"))).when(~F.col("is_evaluator") & T.is_real(F.col("named")), F.col("named"))
    x = x.withColumn("candidate", value).where("candidate IS NOT NULL")
    same = T.key(F.col("candidate")).eqNullSafe(F.lag(T.key(F.col("candidate"))).over(Window.partitionBy(*part).orderBy("turn_idx")))
    return x.withColumn("same", same).where("NOT same").select(*part, F.col("turn_idx").alias("turn"), "candidate")


def attempt_candidates(turns: DataFrame, key: list[str]) -> DataFrame:
    """The last candidate before each verdict, '' if there is none: the key, attempt, candidate."""
    w = Window.partitionBy(*key).orderBy("turn_idx")
    at = F.when(F.col("is_evaluator"), F.col("verdict"))
    x = turns.withColumn("attempt", 1 + F.count(at).over(_up_to(w, -1)))
    last = candidates(x.where(at.isNull()), key, ["attempt"]).groupBy(*key, "attempt").agg(F.max_by("candidate", "turn").alias("candidate"))
    return x.where(at.isNotNull()).select(*key, "attempt").join(last, [*key, "attempt"], "left").select(*key, "attempt", F.coalesce("candidate", F.lit("")).alias("candidate"))


def judged(episodes: DataFrame, correct) -> DataFrame:
    """Adds pre and post by correct(candidate): null where there is no candidate."""
    return episodes.withColumns({n: F.when(F.col(c) != "", correct(F.col(c))) for n, c in (("pre", "before"), ("post", "after"))})


def behaviour(episodes: DataFrame, by: list[str]) -> DataFrame:
    """The reviewer as a detector and as a repairer, over all judged episodes and over those after a failed verdict: by, scope, counts and rates."""
    scopes = F.explode(F.when(F.col("after_fail"), F.array(F.lit("all"), F.lit("after_fail"))).otherwise(F.array(F.lit("all"))))
    x = episodes.withColumn("scope", scopes)
    flag, right, wrong = F.col("action") == "revise", F.col("pre"), ~F.col("pre")
    known = F.col("pre").isNotNull() & F.col("post").isNotNull()
    g = x.groupBy(*by, "scope").agg(
        F.count("*").alias("episodes"), count_if(flag & wrong).alias("tp"), count_if(flag & right).alias("fp"), count_if(~flag & wrong).alias("fn"), count_if(~flag & right).alias("tn"),
        count_if(known & wrong).alias("wrong_in"), count_if(known & right).alias("right_in"), count_if(wrong & F.col("post")).alias("fixed"), count_if(right & ~F.col("post")).alias("corrupted"),
    )
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return g.withColumns(
        {
            "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "false_alarm": rate(fp, fp + tn), "balanced": (rate(tp, tp + fn) + rate(tn, tn + fp)) / 2,
            "fix_wrong": rate(F.col("fixed"), F.col("wrong_in")), "corrupt_right": rate(F.col("corrupted"), F.col("right_in")), "agree_right": rate(tn, tn + fp), "agree_wrong": rate(fn, fn + tp),
        }
    )


def learning(episodes: DataFrame, by: list[str]) -> DataFrame:
    """What became of feedback: used or not by fixed or not, over episodes where both are known."""
    known = F.col("used").isNotNull() & F.col("next_passed").isNotNull()
    u, p = F.col("used"), F.col("next_passed")
    g = episodes.groupBy(*by).agg(F.count("*").alias("episodes"), count_if(known).alias("eligible"), count_if(known & u).alias("used"), count_if(known & p).alias("learned"), count_if(u & p).alias("used_fixed"), count_if(u & ~p).alias("used_wrong"), count_if(~u & p).alias("ignored_fixed"), count_if(~u & ~p).alias("ignored_wrong"))
    return g.withColumns({f"{c}_rate": rate(F.col(c), F.col("eligible")) for c in ("used", "learned", "used_fixed", "used_wrong", "ignored_fixed", "ignored_wrong")})


# The strata of an audit and of its protocols, in their order.
STRATA = ["legacy_disagreement", "changed_but_equivalent", "changed_but_still_wrong", "changed_and_repaired", "unchanged", "changed_unknown", "ineligible"]
PROTOCOLS = ["per", "broadcast"]


def rank(x: Column, order: list[str]) -> Column:
    """The place in a fixed order; 99 for what isn't in it."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), x), F.lit(0)) - 1, F.lit(99))


def coupling(episodes: DataFrame, legacy: DataFrame | None, key: list[str], equal) -> DataFrame:
    """Each judged episode with: eligible, changed, equivalent_eligible, equivalent_changed, only_spelling, outcome, incorporated, disagrees, stratum.

    A change counts between two answers' keys; equal(before, after) says if they mean the same. `legacy` has the key, turn and incorporated.
    """
    some = (F.col("before") != "") & (F.col("after") != "")
    x = episodes.join(legacy, [*key, "turn"], "left") if legacy is not None else episodes.withColumn("incorporated", F.lit(None).cast("boolean"))
    x = x.withColumns({"eligible": some, "changed": F.when(some, T.key(F.col("before")) != T.key(F.col("after"))), "same": F.when(some, equal(F.col("before"), F.col("after")))})
    x = x.withColumns({"equivalent_eligible": F.col("same").isNotNull(), "equivalent_changed": ~F.col("same"), "only_spelling": F.col("changed") & F.col("same")})
    outcome = (
        F.when(F.col("changed").isNull(), "ineligible").when(~F.col("changed"), "unchanged").when(F.col("only_spelling"), "changed_but_equivalent")
        .when(F.col("post"), "changed_and_repaired").when(~F.col("post"), "changed_but_still_wrong").otherwise("changed_unknown")
    )
    x = x.withColumns({"outcome": outcome, "disagrees": F.col("changed") != F.col("incorporated")}).drop("same")
    return x.withColumn("stratum", F.when(F.coalesce("disagrees", F.lit(False)), "legacy_disagreement").otherwise(F.col("outcome")))


def coupling_counts(records: DataFrame, by: str) -> DataFrame:
    """Counts and rates over revisions of wrong answers, over all rows and for each group in one pass: by, total, ..."""
    x = records.where((F.col("action") == "revise") & ~F.col("pre"))
    e, old = F.col("eligible"), F.col("incorporated").isNotNull()
    at = lambda s: count_if(e & (F.col("outcome") == s))
    g = x.rollup(by).agg(
        (F.grouping(by) == 1).alias("total"), F.count("*").alias("useful"), count_if(e).alias("eligible"), count_if(e & F.col("changed")).alias("changed"), count_if("equivalent_eligible").alias("equivalent_eligible"),
        count_if("equivalent_changed").alias("equivalent_changed"), count_if(e & F.col("only_spelling")).alias("only_spelling"), at("changed_and_repaired").alias("repaired"), at("changed_but_still_wrong").alias("still_wrong"),
        at("unchanged").alias("unchanged"), count_if(old).alias("legacy_eligible"), count_if(F.col("incorporated")).alias("legacy_incorporated"), count_if(old & F.col("disagrees")).alias("disagreements"),
    )
    r = {"strict_rate": ("changed", "eligible"), "equivalent_rate": ("equivalent_changed", "equivalent_eligible"), "repaired_rate": ("repaired", "eligible"), "still_wrong_rate": ("still_wrong", "eligible"), "unchanged_rate": ("unchanged", "eligible"), "repair_given_change": ("repaired", "changed"), "legacy_rate": ("legacy_incorporated", "legacy_eligible"), "disagreement_rate": ("disagreements", "legacy_eligible")}
    return g.withColumns({n: rate(F.col(a), F.col(b)) for n, (a, b) in r.items()})


def audit_sample(records: DataFrame, unit: list[str], n: int, seed: str) -> DataFrame:
    """n useful revisions, one of each protocol and stratum in turn, in the fixed order; inside a stratum the order is a digest's."""
    x = records.where((F.col("action") == "revise") & ~F.col("pre") & (F.col("eligible") | F.col("incorporated").isNotNull()))
    drawn = F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in unit)))
    turn = F.row_number().over(Window.partitionBy("protocol", "stratum").orderBy(drawn, *unit))
    order = [F.col("round"), rank(F.col("protocol"), PROTOCOLS), rank(F.col("stratum"), STRATA), F.col("protocol"), F.col("stratum")]
    return x.withColumn("round", turn.cast("long")).where(F.col("round") <= n).orderBy(*order).limit(n)
