"""Text functions over columns: boxed answers, comparison keys, verdicts, actions, labels. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed sets of texts that stand for no answer.
NO_ANSWER = ["", ".", "..", "...", "…", "none", "[none]", "null", "n/a", "[no candidate answer]", "[no extracted final answer]", "no solution yet", "no advice yet"]
# Texts of a turn that say nothing.
NOTHING_SAID = ["", "[empty]", "[none]", "none", "n/a", "na", "no comment", "no comments", "no feedback", "no substantive feedback", "nothing to add", "skip", "pass", "[]", "{}", '""', "''"]
# The wording by which the log names an answer, and how long it may be.
EXPLICIT = r"(?i)(?:final\s+answer|answer)\s*(?:is|:)\s*([^\n]{1,160})"
BOX = "\\boxed{"
PLAIN_BOX = r"\A[^{}\\]*\\boxed\{([^{}\\]*)\}[^{}\\]*\z"
_EDGES = r"^\s+|\s+$"


def _let(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, _EDGES, "")


def sanitize_boxed(x: Column) -> Column:
    """A literal backspace before "oxed{" is a lost backslash-b."""
    return F.replace(F.coalesce(x, F.lit("")), F.lit("\x08oxed{"), F.lit(BOX))


def boxed_all(x: Column) -> Column:
    """Payloads of balanced boxes from left to right; the search goes on after a closing brace and ends at an open box.

    Tokens are braces, markers and what lies between; one pass over them keeps the depth. Most texts have no box, or one and no other brace
    or backslash; these are told by one pattern.
    """
    plain = lambda t: strip(F.regexp_extract(t, PLAIN_BOX, 1))
    none = F.array().cast("array<string>")
    return _let(sanitize_boxed(x), lambda t: F.when(~t.contains(BOX), none).otherwise(_let(plain(t), lambda one: F.when(one != "", F.array(one)).otherwise(_boxes(t)))))


def _boxes(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(r"(\\boxed\{|[{}]|[^{}\\]+|\\)"), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        to = lambda d, b, o: F.struct(d.alias("depth"), b.alias("buf"), o.alias("out"))
        more, payload = F.concat(s["buf"], t), strip(s["buf"])
        return (
            F.when((s["depth"] == 0) & (t == BOX), to(F.lit(1), F.lit(""), s["out"]))
            .when(s["depth"] == 0, s)
            .when((t == "}") & (s["depth"] == 1), to(F.lit(0), F.lit(""), F.when(payload != "", F.concat(s["out"], F.array(payload))).otherwise(s["out"])))
            .when(t == "}", to(s["depth"] - 1, more, s["out"]))
            .when(t.endswith("{"), to(s["depth"] + 1, more, s["out"]))
            .otherwise(to(s["depth"], more, s["out"]))
        )

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def boxed_last(x: Column) -> Column:
    """The last balanced box, nested ones included; open ones are skipped, the last may be empty."""
    parts = F.split(sanitize_boxed(x), r"\\boxed\{")

    def payload(rest: Column) -> Column:
        tokens = F.regexp_extract_all(rest, F.lit(r"([{}]|[^{}]+)"), F.lit(1))
        start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("buf"))
        step = lambda s, t: F.when(s["depth"] == 0, s).otherwise(F.struct((s["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)).alias("depth"), F.when((t == "}") & (s["depth"] == 1), s["buf"]).otherwise(F.concat(s["buf"], t)).alias("buf")))
        return F.aggregate(tokens, start, step, lambda s: F.when(s["depth"] == 0, strip(s["buf"])))

    def found(p: Column) -> Column:
        rests = F.transform(F.sequence(F.lit(2), F.size(p)), lambda i: payload(F.array_join(F.slice(p, i, F.size(p)), BOX)))
        return F.when(F.size(p) > 1, F.try_element_at(F.filter(rests, lambda r: r.isNotNull()), F.lit(-1)))

    return _let(parts, found)


def is_placeholder(x: Column) -> Column:
    return F.lower(strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))).isin(NO_ANSWER)


def meaningful(x: Column) -> Column:
    """Whether a turn says something: a box, or four characters and more that aren't a filler."""
    said = F.lower(strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))
    return ~said.isin(NOTHING_SAID) & (F.coalesce(x, F.lit("")).contains(BOX) | (F.char_length(said) >= 4))


def explicit_answer(x: Column) -> Column:
    """The last box, unwrapped as long as it holds boxes; else the last "final answer is"; '' for placeholders, long prose and nothing."""
    raw = strip(sanitize_boxed(x))
    inner = lambda a: _let(boxed_all(a), lambda b: F.when(F.size(b) > 0, F.element_at(b, -1)).otherwise(a))
    # A box has at most one box inside for each marker that is left in it.
    unwrap = lambda a: F.aggregate(F.sequence(F.lit(1), F.size(F.split(a, r"\\boxed\{"))), a, lambda t, _: inner(t))
    said = F.rtrim(strip(F.try_element_at(F.regexp_extract_all(raw, F.lit(EXPLICIT), F.lit(1)), F.lit(-1))), F.lit("."))
    short = F.when((F.char_length(said) <= 120) & (F.size(F.split(said, r"\s+")) <= 12), said).otherwise("")
    answer = _let(boxed_all(raw), lambda b: F.when(F.size(b) > 0, _let(F.element_at(b, -1), unwrap)).otherwise(F.coalesce(short, F.lit(""))))
    return _let(answer, lambda a: F.when(is_placeholder(a), "").otherwise(a))


def field_answer(x: Column) -> Column:
    """The answer in a field of its own: an explicit one, else the field itself if it is short and has no sign of an explicit one."""
    raw = strip(sanitize_boxed(x))
    short = (F.char_length(raw) <= 120) & (F.size(F.split(raw, r"\s+")) <= 12) & ~raw.contains(BOX) & ~raw.rlike(EXPLICIT)
    return F.when(is_placeholder(raw), "").otherwise(_let(explicit_answer(x), lambda a: F.when(a != "", a).when(short, raw).otherwise("")))


def normalize_answer(x: Column) -> Column:
    """A comparison key: last box, no \\text wrapper, no white space, lower case; up to eight letters are sorted."""
    text = _let(boxed_all(strip(sanitize_boxed(x))), lambda b: F.when(F.size(b) > 0, F.element_at(b, -1)).otherwise(strip(sanitize_boxed(x))))
    text = F.regexp_replace(text, r"\\(?:mathrm|text)\{([^{}]*)\}", "$1")
    text = F.replace(F.replace(text, F.lit("\\,"), F.lit("")), F.lit("\\ "), F.lit(""))
    text = F.lower(F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r"^[$.]+|[$.]+$", ""))
    return _let(text, lambda t: F.when(t.rlike("^[a-z]{1,8}$"), F.array_join(F.array_sort(F.split(t, "")), "")).otherwise(t))


def candidate_key(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"\s+", ""))


def excerpt(x: Column, limit: int = 240) -> Column:
    return F.left(strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")), F.lit(limit))


def final_answer(x: Column) -> Column:
    """The last box, else the last line that isn't blank, without a dot at its end."""
    lines = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), lambda s: strip(s)), lambda s: s != "")
    return F.coalesce(boxed_last(x), F.rtrim(F.try_element_at(lines, F.lit(-1)), F.lit(".")), F.lit(""))


def last_number(x: Column) -> Column:
    return F.replace(F.try_element_at(F.regexp_extract_all(F.coalesce(boxed_last(x), x), F.lit(r"(-?\d[\d,]*(?:\.\d+)?)"), F.lit(1)), F.lit(-1)), F.lit(","), F.lit(""))


# Fixed values in the patterns below: the log's names of its fields (evaluation signal, review position, source, candidate under review).


def pass_fail(x: Column) -> Column:
    """True, False or null from an evaluator's text."""
    t = strip(F.coalesce(x, F.lit("")))
    signal = F.upper(F.regexp_extract(t, r"(?im)^\s*Evaluation\s+signal\s*:\s*(PASS|FAIL)\b", 1))
    return F.when(signal == "PASS", True).when(signal == "FAIL", False).when(F.upper(t) == "PASS", True).when(F.upper(t) == "FAIL", False)


def tri_bool(x: Column) -> Column:
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def two_bool(x: Column) -> Column:
    return F.coalesce(F.lower(x.cast("string")) == "true", F.lit(False))


def per_action(x: Column) -> Column:
    t = F.lower(F.coalesce(x, F.lit("")))
    agree = t.contains("[agree]") | t.contains("[submit]")
    revise = t.rlike(r"\[route|fix instruction:|diagnosis:|needs_revision|propose_correction")
    return F.when(agree, "agree").when(revise, "revise").otherwise("unknown")


def review_positions(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?i)\bReview\s+Position\s*:\s*([A-Za-z_]+)"), F.lit(1)), lambda s: F.lower(s))


def broadcast_action(positions: Column) -> Column:
    return F.when(F.size(positions) == 0, "unknown").when(F.forall(positions, lambda p: p == "approve"), "agree").otherwise("revise")


def anchor_source(x: Column) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(x, F.lit("")), r"(?i)\bSource\s*:\s*([^\n]+)", 1))


def reviewed_answer(x: Column) -> Column:
    after = F.regexp_extract(sanitize_boxed(x), r"(?is)Candidate\s+(?:Answer|under\s+(?:group\s+)?review)\s*:\s*(.*)$", 1)
    return F.coalesce(F.try_element_at(boxed_all(after), F.lit(1)), F.lit(""))


def updated_answer(x: Column) -> Column:
    """What a system's update of the candidate chose: the last of several boxes after "candidate updated from", else the answer after the header of the new candidate, else the last box; '' for none."""
    text = sanitize_boxed(x)
    # The texts of an update.
    from_to, header = "candidate updated from", r"(?is)Current\s+Candidate\s+For\s+Further\s+Review\s*:\s*(.*)$"
    headed = explicit_answer(F.regexp_extract(text, header, 1))

    def pick(b: Column) -> Column:
        last = F.when(F.size(b) > 0, field_answer(F.element_at(b, -1))).otherwise("")
        return F.when(F.lower(text).contains(from_to) & (F.size(b) >= 2), last).when(headed != "", headed).otherwise(last)

    return _let(boxed_all(text), pick)


def json_field(x: Column, name: str) -> Column:
    return F.get_json_object(F.coalesce(x, F.lit("")), f"$.{name}")


def keywords(x: Column, stop: list[str]) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"([a-z][a-z0-9_-]{3,})"), F.lit(1))), F.array(*map(F.lit, stop)))


def first_real(*cols: Column) -> Column:
    """The first that isn't null, blank, "none" or "null"."""
    real = lambda c: F.when(F.lower(F.trim(c)).isin("", "none", "null"), None).otherwise(F.trim(c))
    return F.coalesce(*map(real, cols))


def metric_safe(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def number_text(x: Column) -> Column:
    """Whole numbers without a point, others to ten places without trailing zeros."""
    text = F.rtrim(F.rtrim(F.format_string("%.10f", x), F.lit("0")), F.lit("."))
    return F.when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(text)


def route(x: Column) -> Column:
    """The route that a failing review names; the executor by default."""
    t = F.coalesce(x, F.lit(""))
    said = F.lower(F.regexp_extract(t, r"(?i)route\s*(?:to)?\s*:?\s*(planner|executor)", 1))
    return F.when(t.contains("[ROUTE_PLANNER]"), "planner").when(t.contains("[ROUTE_EXECUTOR]"), "executor").when(said != "", said).otherwise("executor")


def signature(*cols: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def redact(x: Column, secrets: Column) -> Column:
    """Replaces each of an array of strings, the longest first."""
    order = F.reverse(F.array_sort(F.transform(F.filter(secrets, lambda s: s != ""), lambda s: F.struct(F.char_length(s).alias("n"), s.alias("s")))))
    return F.aggregate(order, x, lambda t, s: F.replace(t, s["s"], F.lit("[redacted]")))


def compact(x: Column, limit: int) -> Column:
    t = strip(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"\s+", " "))
    return _let(t, lambda s: F.when(F.char_length(s) <= limit, s).otherwise(F.concat(strip(F.left(s, F.lit(limit - 3))), F.lit("..."))))


def tokens_approx(x: Column) -> Column:
    """An approximate token count: white-space words."""
    t = F.trim(F.coalesce(x, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+"))).cast("long")
