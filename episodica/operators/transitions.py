"""Review opportunities: each decision of a reviewer, with the actor's answer before and after it.

Trajectories never meet in a plan: every window and join has the trajectory in its key, so that one exchange by trajectory serves all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ["uid", "protocol", "review_seq", "review_number", "action", "before_seq", "before_key", "after_seq", "after_key", "actor_turn_observed", "updates", "status", "exclusion_reason"]


# The status, reason, outcome, bucket and link texts below are what readers of the results look for.


def _w() -> Window:
    return Window.partitionBy("uid").orderBy("seq")


def _to(last: int) -> Window:
    """All rows up to this one (0) or to the one before it (-1)."""
    return _w().rowsBetween(Window.unboundedPreceding, last)


def alignment(before_seq: Column, before: Column, reviewed: Column, adjacent: Column) -> Column:
    """How the candidate that a review names stands to the actor's answer before it. `adjacent`: before is the turn that the review follows."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(before_seq.isNull(), "missing_actor_before").when(some(before) & some(reviewed), F.when(before == reviewed, "match").otherwise("mismatch"))
        .when(adjacent, "structural_match").otherwise("unverifiable")
    )


def per_transitions(events: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """PER: before is the latest executor turn since the last submission; after is the next event of (submission, review, executor turn)
    if that is an executor turn. An event that is both review and submission counts as a submission.

    carry: columns of both turns to return as before_NAME and after_NAME, with first_review, last_review and selected (what updates chose)."""
    kind = F.when(F.col("is_submission"), "submission").when(F.col("is_review"), "review").when(F.col("is_actor"), "actor")
    e = events.where("protocol = 'per'").withColumn("kind", kind).where("kind IS NOT NULL").withColumn("seg", F.count_if(F.col("kind") == "submission").over(_to(0)))
    turn = F.struct("seq", "answer_key", *carry)
    back = Window.partitionBy("uid", "seg").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumns({"before": F.last(F.when(F.col("kind") == "actor", turn), ignorenulls=True).over(back), "next_kind": F.lead("kind").over(_w()), "next": F.lead(turn).over(_w())})
    acted = F.col("next_kind") == "actor"
    none, parsed = F.col("before").isNull(), F.col("next")["answer_key"].isNotNull()
    status = (
        F.when(none, "missing_actor_candidate_before").when(acted & parsed, "actor_response_before_gate").when(acted, "actor_response_unparsed_before_gate")
        .when(F.col("next_kind") == "submission", "no_actor_response_before_submission").when(F.col("next_kind") == "review", "no_actor_response_before_next_review").otherwise("no_actor_response_observed")
    )
    why = (
        F.when(none, "no_executor_candidate_since_previous_submission").when(acted & parsed, "").when(acted, "next_executor_answer_unparsed")
        .when(F.col("next_kind") == "submission", "submission_precedes_next_executor_candidate").when(F.col("next_kind") == "review", "additional_review_precedes_executor_response").otherwise("no_next_executor_candidate")
    )
    return e.where("kind = 'review'").select(
        "uid", "protocol", F.col("seq").alias("review_seq"), F.row_number().over(_w()).cast("long").alias("review_number"), "action",
        F.col("before")["seq"].alias("before_seq"), F.col("before")["answer_key"].alias("before_key"),
        F.when(acted, F.col("next")["seq"]).alias("after_seq"), F.when(acted, F.col("next")["answer_key"]).alias("after_key"),
        F.coalesce(acted, F.lit(False)).alias("actor_turn_observed"), F.lit(0).cast("long").alias("updates"), status.alias("status"), why.alias("exclusion_reason"),
        alignment(F.col("before")["seq"], F.col("before")["answer_key"], F.col("reviewed_key"), F.lit(True)).alias("candidate_alignment"),
        *(f for c in carry for f in (F.col("before")[c].alias(f"before_{c}"), F.when(acted, F.col("next")[c]).alias(f"after_{c}"))),
        *((F.col("seq").alias("first_review"), F.col("seq").alias("last_review"), F.array().cast("array<string>").alias("selected")) if carry else ()),
    )


def broadcast_transitions(events: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Broadcast: an anchor opens an interval that the next anchor or submission closes. An interval with reviews is one opportunity; its
    actors link to anchors by equal source and answer key.

    carry: as in per_transitions; then events have `selected`, what an update chose. Of updates of one stage the first counts."""
    e = events.where("protocol = 'broadcast'").withColumn("bound", F.col("is_anchor") | F.col("is_submission"))
    e = e.withColumn("iv", F.count_if("bound").over(_to(0)))
    reviewed = F.max(F.when(F.col("is_review"), F.col("seq"))).over(Window.partitionBy("uid", "iv"))
    e = e.withColumn("last_review", reviewed)
    first = lambda c: F.min_by(c, "seq")
    iv = e.groupBy("uid", "iv").agg(
        F.max(F.when(F.col("bound"), F.when(F.col("is_submission"), "submission").otherwise("anchor"))).alias("opens"),
        first(F.when(F.col("bound"), F.col("seq"))).alias("open_seq"), first(F.col("source_key")).alias("source"), first(F.col("reviewed_key")).alias("reviewed"),
        F.max("last_review").alias("last_review"), F.countDistinct(F.when(F.col("is_update"), F.lower("stage"))).alias("updates"),
        F.coalesce(F.bool_or(F.col("is_actor") & (F.col("seq") > F.col("last_review"))), F.lit(False)).alias("acted"),
        F.flatten(F.array_sort(F.collect_list("positions"))).alias("positions"),
        *((F.min(F.when(F.col("is_review"), F.col("seq"))).alias("first_review"), F.array_sort(F.collect_list(F.when(F.col("is_update"), F.struct("seq", F.lower("stage").alias("stage"), "selected")))).alias("chosen")) if carry else ()),
    )
    by = Window.partitionBy("uid").orderBy("iv")
    iv = iv.withColumns({f"next_{c}": F.lead(c).over(by) for c in ("opens", "source", "reviewed")}).where("opens = 'anchor' AND last_review IS NOT NULL")
    actors = e.where("is_actor AND answer_key IS NOT NULL").select("uid", "iv", F.lower(F.trim("sender")).alias("by"), F.col("answer_key").alias("key"), "seq", (F.col("seq") > F.col("last_review")).alias("late"), *carry)
    last = lambda side: [F.max("seq").alias(f"{side}_seq"), *(F.max_by(c, "seq").alias(f"{side}_{c}") for c in carry)]
    before = actors.groupBy("uid", (F.col("iv") + 1).alias("iv"), "by", "key").agg(*last("before"))
    after = actors.where("late").groupBy("uid", "iv", "by", "key").agg(*last("after"))
    on = lambda s, k: [F.col("i.uid") == F.col("a.uid"), F.col("i.iv") == F.col("a.iv"), F.col(s) == F.col("a.by"), F.col(k) == F.col("a.key"), F.col(s) != "", F.col(k) != ""]
    x = iv.alias("i").join(before.alias("a"), on("i.source", "i.reviewed"), "left").select("i.*", "before_seq", *(f"before_{c}" for c in carry))
    x = x.alias("i").join(after.alias("a"), [*on("i.next_source", "i.next_reviewed"), F.col("i.next_opens") == "anchor"], "left").select("i.*", "after_seq", *(f"after_{c}" for c in carry))
    linked, some = F.col("after_seq").isNotNull(), F.col("updates") > 0
    anchor, gate = F.col("next_opens") == "anchor", F.col("next_opens") == "submission"
    pairs = [
        (F.col("before_seq").isNull(), "missing_actor_candidate_before", "review_anchor_not_linked_to_actor_source_answer"),
        (anchor & linked & some, "actor_response_after_protocol_selection", "system_selected_reviewer_proposal_before_actor_response"),
        (anchor & linked, "actor_response_before_gate", ""),
        (anchor & F.col("acted"), "actor_response_unlinked_to_next_review", "next_review_anchor_not_linked_to_actor_source_answer"),
        (anchor, "no_actor_response_before_next_review", "next_group_review_precedes_actor_response"),
        (gate, "no_actor_response_before_submission", "consensus_or_submission_precedes_actor_response"),
        (F.col("acted"), "actor_response_unlinked_no_next_review_anchor", "actor_turn_has_no_subsequent_review_anchor"),
    ]
    pick = lambda i, last: F.coalesce(*(F.when(c[0], c[i]) for c in pairs), F.lit(last))
    from ..functions.text import broadcast_action

    first_of_stage = F.filter("chosen", lambda u, i: F.array_position(F.col("chosen")["stage"], u["stage"]) == i + 1)
    chosen = F.filter(F.transform(first_of_stage, lambda u: u["selected"]), lambda a: a != "")
    return x.select(
        "uid", F.lit("broadcast").alias("protocol"), F.col("open_seq").alias("review_seq"), F.row_number().over(by).cast("long").alias("review_number"),
        broadcast_action(F.col("positions")).alias("action"), "before_seq", F.when(F.col("before_seq").isNotNull(), F.col("reviewed")).alias("before_key"),
        "after_seq", F.when(linked, F.col("next_reviewed")).alias("after_key"), F.col("acted").alias("actor_turn_observed"), F.col("updates").cast("long").alias("updates"),
        pick(1, "no_actor_response_observed").alias("status"), pick(2, "no_linked_later_actor_candidate").alias("exclusion_reason"),
        alignment(F.col("before_seq"), F.col("reviewed"), F.col("reviewed"), F.lit(False)).alias("candidate_alignment"),
        *(f"{side}_{c}" for c in carry for side in ("before", "after")), *(("first_review", "last_review", chosen.alias("selected")) if carry else ()),
    )


def transitions(events: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return per_transitions(events, carry).unionByName(broadcast_transitions(events, carry))


def previous_actor(events: DataFrame, asks: Column, preferred: Column) -> DataFrame:
    """For each event that asks: the latest actor turn before it since the last submission, of the preferred sender if there is one, else of anyone.

    Returns uid, seq, preferred (trimmed, lower case), before_seq, before_sender, by_preferred. Without a preferred sender (null or blank) the latest of all is taken;
    without any turn the last three are null, null and false. Turns and questions are rows of their own, so that a sender's turns stand beside its questions.
    """
    key = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    e = events.withColumn("seg", F.count_if("is_submission").over(_to(0)))
    turn = e.where(F.col("is_actor") & ~F.col("is_submission")).select("uid", "seg", "seq", key(F.col("sender")).alias("who"), F.struct("seq", "sender").alias("turn"))
    ask = e.where(asks).select("uid", "seg", "seq", key(preferred).alias("who"), F.lit(True).alias("asks"))
    x = turn.unionByName(ask, allowMissingColumns=True)
    before = lambda *by: F.last("turn", ignorenulls=True).over(Window.partitionBy("uid", *by).orderBy("seq").rangeBetween(Window.unboundedPreceding, -1))
    x = x.withColumns({"any": before("seg"), "own": before("seg", "who")}).where("asks")
    found = F.when(F.col("who") != "", F.col("own"))
    best = F.coalesce(found, F.col("any"))
    return x.select("uid", "seq", F.col("who").alias("preferred"), best["seq"].alias("before_seq"), best["sender"].alias("before_sender"), found.isNotNull().alias("by_preferred"))


def memory_records(log: DataFrame) -> DataFrame:
    """The event right after each PER review, checked as its memory record: what it says, each check as a boolean, and link_status.

    link_status is "linked" or all reasons against it, joined by |. Only a record without any counts. log: classified, with event_uid,
    previous_event_uid and extra_json. Texts that aren't there are empty, a missing event has sequence -1; events without an id go by "sequence:N".
    """
    w = Window.partitionBy("uid").orderBy("seq")
    cols = ["seq", "event_type", "sender", "role", "stage", "event_uid", "previous_event_uid", "extra_json"]
    m = log.where("protocol = 'per'").withColumn("n", F.lead(F.struct(*cols)).over(w)).where("is_review")
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    named = lambda uid, seq: F.when(clean(uid) != "", clean(uid)).otherwise(F.concat(F.lit("sequence:"), seq))
    n, extra = F.col("n"), clean(F.col("n")["extra_json"])
    payload = F.get_json_object(extra, "$.candidate_memory_event")
    field = lambda f: clean(F.get_json_object(payload, f"$.{f}"))
    unread = (
        F.when(extra == "", "missing_extra_json").when(F.try_parse_json(extra).isNull(), "malformed_extra_json")
        .when(~extra.startswith("{"), "extra_json_not_object").when(~F.coalesce(payload, F.lit("")).startswith("{"), "missing_candidate_memory_event")
    )
    stage = clean(F.col("stage"))
    x = m.select(
        "uid", F.col("seq").alias("review_seq"), n.isNotNull().alias("there"), unread.alias("unread"), F.when(n.isNull(), "").otherwise(named(n["event_uid"], n["seq"])).alias("memory_event_uid"),
        F.coalesce(n["seq"], F.lit(-1)).cast("long").alias("memory_seq"), *(field(f).alias(f"memory_{f}") for f in ("action", "source", "authority", "stage")), clean(n["previous_event_uid"]).alias("memory_previous_event_uid"),
        (n["seq"] == F.col("seq") + 1).alias("immediate"), (F.lower(clean(n["event_type"])) == "summary").alias("event_type_valid"),
        ((F.lower(clean(n["sender"])) == "system") & (F.lower(clean(n["role"])) == "system")).alias("system_authored"),
        ((stage != "") & (clean(n["stage"]) == F.concat(stage, F.lit("_candidate_memory"))) & (field("stage") == stage)).alias("stage_matches"),
        (clean(n["previous_event_uid"]) == named(F.col("event_uid"), F.col("seq"))).alias("previous_event_uid_matches"),
        ((field("source") != "") & (F.lower(field("source")) == F.lower(clean(F.col("sender"))))).alias("source_matches"), (field("authority") == "internal_reviewer_suggestion").alias("authority_matches"),
    )
    said = {"immediate": "not_immediate_sequence", "event_type_valid": "event_type_not_summary", "system_authored": "not_system_authored", "stage_matches": "stage_mismatch", "previous_event_uid_matches": "previous_event_uid_mismatch", "source_matches": "source_mismatch", "authority_matches": "authority_mismatch"}
    x = x.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in said})
    against = F.concat_ws("|", "unread", *(F.when(~F.col(c), why) for c, why in said.items()), F.when(F.col("memory_action") == "", "missing_action"))
    x = x.withColumn("link_status", F.when(~F.col("there"), "no_immediate_next_event").when(against == "", "linked").otherwise(against))
    valid = F.col("link_status") == "linked"
    return x.withColumns({"memory_valid": valid, "route_observed": valid & (F.col("memory_action") == "review_route")}).drop("there", "unread")


def memory_link(log: DataFrame) -> DataFrame:
    """memory_records, in short: uid, review_seq, memory_action, memory_valid, route_observed, link_status."""
    return memory_records(log).select("uid", "review_seq", "memory_action", "memory_valid", "route_observed", "link_status")


def with_memory(labeled: DataFrame, links: DataFrame) -> DataFrame:
    """Adds memory_valid and route_observed, false without a record."""
    x = labeled.join(links.select("uid", "review_seq", "memory_valid", "route_observed"), ["uid", "review_seq"], "left")
    return x.na.fill(False, ["memory_valid", "route_observed"])


def outcome(before: Column, after: Column, bc: Column, ac: Column) -> Column:
    """Seven outcomes of a pair of keys and tri-state labels."""
    f, t = lambda c: F.coalesce(~c, F.lit(False)), lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(F.coalesce(before, F.lit("")).eqNullSafe("") | F.coalesce(after, F.lit("")).eqNullSafe(""), "not_evaluable_unparsed_actor_pair")
        .when(before == after, "unchanged").when(f(bc) & t(ac), "repaired").when(f(bc) & f(ac), "changed_still_wrong").when(t(bc) & f(ac), "harmed").when(t(bc) & t(ac), "changed_still_correct")
        .otherwise("changed_correctness_unlabeled")
    )


def frozen_labels(events: DataFrame, finals: DataFrame | None = None) -> DataFrame:
    """uid, answer_key, value, conflict, sources: what runtime verdicts, and final judgements if given, say of submitted answers.

    A verdict takes the latest submission with an answer since the verdict before it; unequal judgements of one key leave value null.
    finals: uid, answer_key, value of each trajectory's final answer; those without an answer or a value say nothing.
    """
    e = events.where("is_submission OR verdict IS NOT NULL").withColumn("at", F.count_if(F.col("verdict").isNotNull()).over(_to(-1)))
    inside = Window.partitionBy("uid", "at").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    pending = F.last(F.when(F.col("is_submission") & F.col("answer_key").isNotNull(), F.struct("seq", "answer_key")), ignorenulls=True).over(inside)
    v = e.withColumn("pending", pending).where("verdict IS NOT NULL AND pending IS NOT NULL")
    said = v.select("uid", F.col("pending")["answer_key"].alias("answer_key"), F.col("verdict").alias("value"), F.concat(F.lit("runtime_evaluator_submission_sequence_"), F.col("pending")["seq"]).alias("source"))
    if finals is not None:
        said = said.unionByName(finals.where("value IS NOT NULL AND answer_key <> ''").select("uid", "answer_key", "value", F.lit("trajectory_final_correct").alias("source")))
    low, high = F.min("value"), F.max("value")
    return said.groupBy("uid", "answer_key").agg(F.when(low == high, low).alias("value"), (low != high).alias("conflict"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))


def label(pairs: DataFrame, labels: DataFrame, aligned: bool = True, sources: bool = False) -> DataFrame:
    """Adds before_correct, after_correct (tri-state), conflicts, transition_outcome, answer_pair_parsed, strict, bucket.

    A strict pair's review speaks of the answer before it; aligned=False leaves this condition out. sources: also before_sources, after_sources.
    """
    side = lambda s: labels.select("uid", F.col("answer_key").alias(f"{s}_key"), F.col("value").alias(f"{s}_correct"), F.col("conflict").alias(f"{s}_conflict"), *([F.col("sources").alias(f"{s}_sources")] if sources else []))
    x = pairs.join(side("before"), ["uid", "before_key"], "left").join(side("after"), ["uid", "after_key"], "left")
    both = F.col("before_key").isNotNull() & F.col("after_key").isNotNull()
    strict = F.col("before_seq").isNotNull() & F.col("after_seq").isNotNull() & both & (F.col("updates") == 0) & (F.col("exclusion_reason") == "")
    if aligned:
        strict = strict & F.col("candidate_alignment").isin("match", "structural_match")
    bucket = (
        F.when(F.col("status").startswith("missing_actor") | F.col("status").contains("unlinked"), "source_link_failure").when(~F.col("actor_turn_observed"), "no_after")
        .when(~both, "parser_incomplete").when(F.col("updates") > 0, "gate_confounded").when(strict, "strict_pre_gate").otherwise("other_non_strict")
    )
    return x.withColumns({"answer_pair_parsed": both, "strict": strict, "bucket": bucket, "transition_outcome": outcome(F.col("before_key"), F.col("after_key"), F.col("before_correct"), F.col("after_correct")), "answer_changed": F.when(both, F.col("before_key") != F.col("after_key"))})
