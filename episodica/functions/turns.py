"""What a turn of a plain-text trace says: verdicts, review actions, approvals and the candidates it names. Native expressions over one line of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

# The words that the trace format puts around its fields.
UNDER_REVIEW = "Candidate under review:"
AFTER_IT = ["Approve:", "Review Position:", "Feedback:", "Peer Review:", "Proposed Correction:", "Suggested Revision:"]
GROUP = ["Candidate answer under group review:", "Source:", "Candidate Answer:"]
UPDATE, AFTER_UPDATE = "Current Candidate For Further Review:", "Instruction:"
REVISED = ["Proposed Correction:", "Suggested Revision:"]
REVISED_JSON = r'"revised_answer"\s*:\s*"([^"]*)"'
EVALUATION = ["Evaluation result:", "Evaluation signal:", "Verifier:"]
HINT, ADVICE = "Evaluation hint:", ["Hint:", "Advice:"]
INSTRUCTIONS = ["Fix Instruction:", "Diagnosis:"]
ANSWERS = ["Candidate Answer:", "Final Answer:"]
NO_CANDIDATE = ["[none]", "none", "null", "n/a"]
APPROVING, OBJECTING = ["approve", "accept"], ["reject", "revise", "revision", "objection", "correction", "propose"]
SELF_AGREEING, SELF_OBJECTING = ["agree", "approve", "accept"], ["revise", "reject", "correction"]
UPTAKE = ["evaluator", "verifier", "feedback", "fail", "diagnosis", "system"]


def _any(x: Column, words: list[str]) -> Column:
    out = x.contains(words[0])
    for w in words[1:]:
        out = out | x.contains(w)
    return out


def _or(words: list[str]) -> str:
    return "|".join(words)


def _found(x: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(x, pattern, group)


def candidate(fragment: Column) -> Column:
    """The answer in a fragment: its last box, else its last line; '' for nothing."""
    plain = F.replace(F.regexp_replace(X.strip(F.coalesce(fragment, F.lit(""))), r"^`+|`+$", ""), F.lit("\\\\"), F.lit("\\"))
    return X.strip(X.final_answer(plain))


def key(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", ""))


def is_real(x: Column) -> Column:
    t = F.lower(X.strip(F.coalesce(x, F.lit(""))))
    return (t != "") & ~t.isin(NO_CANDIDATE)


def marks_evaluation(content: Column, agent_id: Column) -> Column:
    """A turn that is an evaluator's by its id or its words, whoever is named."""
    return (F.lower(agent_id) == "evaluator") | _any(content, EVALUATION)


def verdict(content: Column) -> Column:
    """True, False or null; a hint has no verdict. A score goes before a signal, a signal before a verifier's word."""
    said = lambda name, yes, no: F.lower(_found(content, rf"(?i)\b{name}:\s*({yes}|{no})\b"))
    parts = [said("Score", "true", "false"), said("Evaluation signal", "pass", "fail"), said("Verifier", "pass", "fail")]
    first = F.coalesce(*(F.nullif(p, F.lit("")) for p in parts))
    return F.when(~F.lower(content).contains(HINT.lower()), first.isin("true", "pass"))


def per_action(content: Column) -> Column:
    """agree, revise, or null where a reviewer's turn is no decision."""
    low = F.lower(content)
    return F.when(low.contains("[agree]"), "agree").when(low.rlike(r"\[route:[^\]]+\]") | _any(content, INSTRUCTIONS), "revise")


def _position(content: Column) -> Column:
    return F.lower(_found(content, r"(?i)\bReview Position:\s*([A-Za-z0-9_-]+)\b"))


def single_action(content: Column) -> Column:
    """The decision of an agent that reviews itself; null unless a candidate is under review."""
    low, position = F.lower(content), _position(content)
    own = (
        F.when(low.contains("[agree]"), "agree").when(low.rlike(r"\[(self-)?revise\]"), "revise").when(_any(position, SELF_AGREEING), "agree")
        .when(_any(position, SELF_OBJECTING) | _any(content, INSTRUCTIONS), "revise")
    )
    return F.when(content.contains(UNDER_REVIEW), own)


def approval(content: Column) -> Column:
    """Whether a peer approves; null without a word of it."""
    flag, position = F.lower(_found(content, r"(?i)\bApprove:\s*(True|False)\b")), _position(content)
    return F.when(flag != "", flag == "true").when(_any(position, APPROVING), True).when(_any(position, OBJECTING), False)


def protocol(task: Column, names: Column) -> Column:
    """From the task's label and the agents' names; the first rule that holds."""
    t, n = F.lower(F.coalesce(task, F.lit(""))), F.lower(F.concat_ws(" ", names))
    has = lambda *words: _any(t, list(words))
    return (
        F.when(has("broadcast", "deliberation"), "broadcast").when(has("single_llm", "single-llm") | (has("baseline") & has("llm")), "baseline_llm")
        .when(has("single_agent", "single-agent") | (has("single") & has("reflect")), "single_agent")
        .when((n.contains("planner") & n.contains("executor") & n.contains("reviewer")) | has("per"), "per").otherwise("unknown")
    )


def uses_feedback(feedback: Column, response: Column, stop: list[str]) -> Column:
    """Whether a response takes feedback up, by its words: it speaks of the feedback or repeats a word of it. Null if either is blank."""
    path = F.lower(response)
    again = F.exists(X.keywords(feedback, stop), lambda w: path.contains(w))
    blank = (X.strip(F.coalesce(feedback, F.lit(""))) == "") | (X.strip(F.coalesce(response, F.lit(""))) == "")
    return F.when(~blank, _any(path, UPTAKE) | again)


def classify(turns: DataFrame) -> DataFrame:
    """Adds to turns (agent_id, agent_name, content) all that is parsed from text, once, before any window.

    is_evaluator, marked (an evaluator's by id or words alone), is_reviewer, follows_up (a hint after a verdict), verdict, action (PER),
    own_action (single agent), approve, and the candidates, '' for none: revised, under_review, grouped, updated, named (the first of
    these, else the last box, else what stands behind the words for an answer).
    """
    c, name = F.coalesce("content", F.lit("")), F.lower(F.coalesce("agent_name", F.lit("")))
    evaluator = name.contains("evaluator") | (F.lower("agent_id") == "evaluator")
    x = turns.withColumns(
        {
            "is_evaluator": evaluator | _any(c, EVALUATION), "marked": marks_evaluation(c, F.col("agent_id")), "is_reviewer": name.contains("reviewer") | name.contains("critic"),
            "verdict": verdict(c), "action": per_action(c), "own_action": single_action(c), "approve": approval(c),
            "follows_up": F.lower(c).contains(HINT.lower()) | (verdict(c).isNull() & evaluator & _any(c, ADVICE)),
            "revised": candidate(F.coalesce(F.nullif(_found(c, rf"(?i)(?:{_or(REVISED)})\s*(.*)$"), F.lit("")), _found(c, "(?i)" + REVISED_JSON))),
            "under_review": candidate(_found(c, rf"(?i){UNDER_REVIEW}\s*(.*?)(?:\s+(?:{_or(AFTER_IT)}).*)?$")),
            "grouped": candidate(_found(c, rf"(?i){GROUP[0]}\s*{GROUP[1]}.*?{GROUP[2]}\s*(.*)$")),
            "updated": candidate(_found(c, rf"(?i){UPDATE}\s*(.*?)(?:\s+{AFTER_UPDATE}.*)?$")),
            "_boxed": candidate(F.coalesce(X.boxed_last(c), F.lit(""))), "_said": F.when(_any(c, ANSWERS), X.strip(X.final_answer(c))),
        }
    )
    parts = (F.nullif(F.col(n), F.lit("")) for n in ("revised", "under_review", "grouped", "updated", "_boxed", "_said"))
    return x.withColumn("named", F.coalesce(*parts, F.lit(""))).drop("_boxed", "_said")
