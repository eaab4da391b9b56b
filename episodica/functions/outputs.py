"""What models and evaluators write, read with native expressions: fields, JSON objects, scores, critiques, reports, and the decisions made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _let, boxed_last, strip

# Names and marks of the formats read here.
AGREE, DISAGREE = "[Agree]", "[Disagree]"
ADVICE = r"Advice:\s*(.+)"
REPORT_ANSWER, REPORT_END, REPORT_REASON = "## Student Final Answer", "=== report over ===", "Justification"
PRESENTATION = ["boxed answer", "boxed", "format", "latex", "markup", "unit", "token", "raw numeric", "presentation", "output", "missing"]
PEER = ["revise", "approve", "reject", "propose_final", "select_for_review"]


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _lines(x: Column) -> Column:
    """The text without blank edges and without empty lines."""
    return F.regexp_replace(strip(_text(x)), r"\n+", "\n")


def _after(x: Column, name: str, value: str) -> Column:
    """What follows `name:` or `name=`, quoted or not, in any case; null if nothing does."""
    return F.nullif(F.regexp_extract(_text(x), rf'(?i)"?\Q{name}\E"?\s*[:=]\s*({value})', 1), F.lit(""))


def int_field(x: Column, name: str, default: int = 1) -> Column:
    return F.coalesce(_after(x, name, r"\d{1,3}").cast("int"), F.lit(default))


def bool_field(x: Column, name: str, default: bool = False) -> Column:
    return F.coalesce(F.lower(_after(x, name, "true|false")) == "true", F.lit(default))


def boxed_field(x: Column, names: list[str]) -> Column:
    """The last box behind the first of the names that has one, boxed; else empty."""
    found = lambda n: _let(boxed_last(F.regexp_extract(_text(x), rf"(?is)\Q{n}\E\s*[:=]\s*(.*)", 1)), lambda b: F.when(b != "", F.concat(F.lit("\\boxed{"), b, F.lit("}"))))
    return F.coalesce(*map(found, names), F.lit(""))


def balanced(x: Column, quotes: str = "\"'") -> Column:
    """All braced parts of a text that close, at any depth, in order of their beginning: one fold over brace, quote and text tokens with a
    stack of open braces. Braces inside quotes don't count; outside all braces quotes don't."""
    marks = f"[{{}}{quotes}]"
    tokens = F.regexp_extract_all(_text(x), F.lit(rf"(?s)(\\.|{marks}|[^{{}}{quotes}\\]+|\\)"), F.lit(1))
    kind = "struct<at: int, quote: string, open: array<int>, found: array<struct<first: int, size: int>>>"
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("quote"), F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<first: int, size: int>>").alias("found")).cast(kind)

    def step(s: Column, t: Column) -> Column:
        inside, depth = s["quote"] != "", F.size(s["open"])
        quoted = F.when(inside, F.when(t == s["quote"], "").otherwise(s["quote"])).when((depth > 0) & t.isin(*quotes), t).otherwise("")
        opens, closes = ~inside & (t == "{"), ~inside & (t == "}") & (depth > 0)
        opened = F.when(opens, F.concat(s["open"], F.array(s["at"]))).when(closes, F.slice(s["open"], F.lit(1), F.greatest(depth - 1, F.lit(0)))).otherwise(s["open"])
        part = F.struct(F.try_element_at(s["open"], F.lit(-1)).alias("first"), (s["at"] - F.try_element_at(s["open"], F.lit(-1)) + 1).alias("size"))
        found = F.when(closes, F.concat(s["found"], F.array(part))).otherwise(s["found"])
        return F.struct((s["at"] + F.char_length(t)).alias("at"), quoted.alias("quote"), opened.alias("open"), found.alias("found")).cast(kind)

    parts = F.array_sort(F.aggregate(tokens, start, step, lambda s: s["found"]))
    return _let(_text(x), lambda t: F.transform(parts, lambda p: F.substr(t, p["first"], p["size"])))


def repair_json(x: Column) -> Column:
    """Drops comments, joins strings that a plus parts, quotes names and single-quoted strings, spells constants as JSON does, drops commas before a closing mark and closes what is open.

    The closing marks are those of objects within each other and of arrays at the end; text that can't be mended stays as it is."""
    # Strings, comments and what is between, so that neither sign is found inside a string.
    pieces = F.regexp_extract_all(strip(_text(x)), F.lit(r"""(?s)("(?:[^"\\]|\\.)*"|/\*.*?\*/|//[^\n]*|[^"/]+|.)"""), F.lit(1))
    kept = F.array_join(F.filter(pieces, lambda p: ~p.startswith("/*") & ~p.startswith("//")), "\x01")
    t = strip(F.replace(F.regexp_replace(kept, r"\"\x01\s*\+\s*\x01\"", ""), F.lit("\x01"), F.lit("")))
    for pattern, by in (
        (r"[\u201c\u201d]", '"'), (r"'([^'\"\\\n]*)'(?=\s*(?:[:,}\]]|\z))", '"$1"'), (r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", '$1"$2"$3'),
        (r"([:,\[]\s*)True(?=\s*(?:[,}\]]|\z))", "$1true"), (r"([:,\[]\s*)False(?=\s*(?:[,}\]]|\z))", "$1false"), (r"([:,\[]\s*)None(?=\s*(?:[,}\]]|\z))", "$1null"), (r",\s*([}\]])", "$1"), (r",\s*\z", ""),
    ):
        t = F.regexp_replace(t, pattern, by)
    bare = lambda s: F.regexp_replace(s, r'"(?:[^"\\]|\\.)*"', "")
    left = lambda s, a, b: F.greatest(F.lit(0), F.regexp_count(bare(s), F.lit(a)) - F.regexp_count(bare(s), F.lit(b)))
    return _let(t, lambda s: F.concat(s, F.repeat(F.lit("]"), left(s, r"\[", r"\]")), F.repeat(F.lit("}"), left(s, r"\{", r"\}"))))


def json_object(x: Column, schema: str, keys: list[str] | None = None) -> Column:
    """The first object in a text that isn't empty and, if keys are given, has one of them, as a struct; null if there is none.

    Looked at, in this order, each as it is, then repaired: the whole text, fenced blocks, braced parts at any depth (apostrophes first as
    quotes, then not, then no quotes at all), from the first brace to the last, and to the end. Each is made only if none before it will do."""
    found = lambda t, pattern: F.array(strip(F.regexp_extract(t, pattern, 1)))
    fenced = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?s)```(?:json|JSON)?\s*(.*?)```"), F.lit(1)), strip)

    def good(p: Column) -> Column:
        said = F.schema_of_variant(F.try_parse_json(p))
        fits = said.startswith("OBJECT<") & (said != "OBJECT<>")
        return fits & F.coalesce(F.arrays_overlap(F.json_object_keys(p), F.array(*map(F.lit, keys))), F.lit(False)) if keys else fits

    def first(parts: Column) -> Column:
        mended = lambda p: F.when(p.contains("{"), F.when(good(p), p).otherwise(_let(repair_json(p), lambda r: F.when(good(r), r))))
        return F.try_element_at(F.filter(F.transform(F.array_distinct(parts), mended), lambda p: p.isNotNull()), F.lit(1))

    ways = (F.array, fenced, balanced, lambda t: balanced(t, '"'), lambda t: balanced(t, ""), lambda t: found(t, r"(?s)(\{.*\})"), lambda t: found(t, r"(?s)(\{.*)"))
    one = _let(strip(_text(x)), lambda t: F.when(t.contains("{"), F.coalesce(*(first(way(t)) for way in ways))))
    return F.from_json(one, schema)


def scored(x: Column, dimensions: list[str]) -> Column:
    """An evaluator's answer: struct of scores (one line for each dimension, in order) and advice; null if a part is missing."""
    lines = F.split(_lines(x), "\n")
    score = [F.regexp_extract(_text(F.try_element_at(lines, F.lit(i))), rf"\Q{d}\E:\s*(\d)", 1).try_cast("int") for i, d in enumerate(dimensions, 1)]
    advice = F.regexp_extract(F.array_join(F.slice(lines, len(dimensions) + 1, F.greatest(F.size(lines), F.lit(1))), ""), ADVICE, 1)
    whole = advice != ""
    for s in score:
        whole = whole & s.isNotNull()
    return F.when(whole, F.struct(F.array(*score).alias("scores"), advice.alias("advice")))


def critique(x: Column) -> Column:
    """A critic's answer: struct of agrees and, unless it does, the criticism."""
    t = _lines(x)
    agrees = t.contains(AGREE)
    return F.struct(agrees.alias("agrees"), F.when(agrees, "").otherwise(strip(F.replace(t, F.lit(DISAGREE), F.lit("")))).alias("criticism"))


def judge_report(x: Column) -> Column:
    """A judge's report, tokenizer marks and spaced-out headers included: struct of answer, verdict (TRUE or FALSE) and justification, null where missing.

    The answer runs to the verdict; without one to the end, less a header on the last line."""
    t = F.replace(_text(x), F.lit("\u0120"), F.lit(" "))
    for pattern, by in ((r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n+", "\n")):
        t = F.regexp_replace(t, pattern, by)
    t = strip(t)
    # Blanks may stand between the header's letters, and some of those in its middle may be missing.
    spaced = r"\s*".join([*(c if c in "Jus" else c + "?" for c in REPORT_REASON[:8]), *REPORT_REASON[8:]])
    some = lambda s: F.nullif(s, F.lit(""))
    answer = F.regexp_extract(t, rf"(?is)\Q{REPORT_ANSWER}\E\s*(.*?)(?:true|false|\z)", 1)
    reason = F.regexp_extract(t, rf"(?is){spaced}\s*(.*?)(?:\Q{REPORT_END}\E|\z)", 1)
    return F.struct(
        some(strip(F.regexp_replace(strip(answer), r"\s*#\s*#[^\n]*\z", ""))).alias("answer"), some(F.upper(F.regexp_extract(t, "(?i)(true|false)", 1))).alias("verdict"),
        some(F.regexp_replace(reason, r"\A[ :#\n-]+|[ :#\n-]+\z", "")).alias("justification"),
    )


def intervention(repair: Column, harm: Column, credibility: Column | None = None, thresholds: tuple[float, float, float] = (0.5, 0.5, 0.5), log_only: bool = False) -> Column:
    """What a critique leads to: struct of action and would_action, accept, challenge or ignore. thresholds: repair, harm, credibility.

    With credibility, harm alone is ignored and only credible repair accepted; without, harm goes first. log_only accepts all and keeps what it would do."""
    helps, hurts = repair >= thresholds[0], harm >= thresholds[1]
    if credibility is None:
        would = F.when(hurts, "ignore").when(helps, "accept").otherwise("challenge")
    else:
        sure = credibility >= thresholds[2]
        would = F.when(sure & helps, "accept").when(hurts & ~sure & ~helps, "ignore").otherwise("challenge")
    return F.struct((F.lit("accept") if log_only else would).alias("action"), would.alias("would_action"))


def authority(action: Column, source: Column, stage: Column) -> Column:
    """Whose word a memory record is."""
    a, s, st = (F.lower(F.trim(_text(c))) for c in (action, source, stage))
    return (
        F.when((a == "evaluate") | s.contains("evaluator") | st.contains("evaluation"), "external_evaluator_signal")
        .when(s == "system", F.when(a == "select_revision", "protocol_candidate_selection_not_correctness").otherwise("system_protocol_event_not_correctness"))
        .when(s.contains("reviewer") | a.isin("review_submit", "repair_instruction"), "internal_reviewer_suggestion")
        .when(a.isin(*PEER), "peer_or_agent_suggestion").when(a == "propose", "internal_candidate_proposal").otherwise("internal_observation")
    )


def fail_route(advice: Column, review: Column) -> Column:
    """Who repairs a failed answer: the executor if it is about presentation, else the planner."""
    said = F.lower(F.concat(_text(advice), F.lit("\n"), _text(review)))
    return F.when(said.rlike("|".join(PRESENTATION)), "executor").otherwise("planner")
