"""Scenarios of transitions and labels, text functions, file formats and streams on small inputs."""


import pytest
from pyspark.sql import functions as F

from episodica.functions import outputs, rules, text
from episodica.operators import cells, events, problems, reports, runs, sampling, sequences, transitions
from episodica.sources import files
from episodica.streaming import live

BASE = "uid bigint, seq bigint, protocol string, event_type string, stage string, sender string, role string, content string"


def log(spark, protocol, *steps):
    """steps: (stage, sender, role, content)."""
    return spark.createDataFrame([(1, i, protocol, "message", *s) for i, s in enumerate(steps)], BASE)


def executor(a):
    return ("executor_0", "Executor", "agent", f"so \\boxed{{{a}}}")


def reviewer(t):
    return ("reviewer_0", "Reviewer", "agent", t)


def submit(a):
    return ("solver_submission", "system", "system", f"\\boxed{{{a}}}")


def verdict(t):
    return ("evaluation", "Evaluator", "evaluator", f"Evaluation signal: {t}")


def labeled(spark, protocol, *steps):
    e = events.classify(log(spark, protocol, *steps))
    return transitions.label(transitions.transitions(e), transitions.frozen_labels(e))


def test_repaired(spark):
    r = labeled(spark, "per", submit("A"), verdict("FAIL"), executor("A"), reviewer("Diagnosis: no"), executor("B"), submit("B"), verdict("PASS")).first()
    assert (r.before_correct, r.after_correct, r.transition_outcome, r.bucket, r.action) == (False, True, "repaired", "strict_pre_gate", "revise")


@pytest.mark.parametrize(("said", "bucket"), [("Candidate Answer: \\boxed{C}", "other_non_strict"), ("Candidate Answer: \\boxed{A}", "strict_pre_gate"), ("no candidate named", "strict_pre_gate")])
def test_review_of_another_candidate_is_not_strict(spark, said, bucket):
    r = labeled(spark, "per", executor("A"), reviewer(f"Diagnosis: no\n{said}"), executor("B")).first()
    assert (r.bucket, r.strict) == (bucket, bucket == "strict_pre_gate")


def test_conflicting_verdicts(spark):
    e = events.classify(log(spark, "per", submit("A"), verdict("PASS"), submit("A"), verdict("FAIL")))
    r = transitions.frozen_labels(e).first()
    assert r.value is None and r.conflict


def test_submission_first(spark):
    r = labeled(spark, "per", executor("A"), reviewer("Diagnosis: no"), submit("A"), executor("B")).first()
    assert r.status == "no_actor_response_before_submission" and r.after_key is None


def test_unparsed_response(spark):
    r = labeled(spark, "per", executor("A"), reviewer("fine"), ("executor_0", "Executor", "agent", "I think so")).first()
    assert r.actor_turn_observed and r.after_key is None and r.bucket == "parser_incomplete" and r.action == "unknown"


def test_broadcast_update_then_answer(spark):
    say = lambda a: ("discussion_0", "M", "agent", f"\\boxed{{{a}}}")
    anchor = lambda a: ("candidate_review_0", "system", "system", f"Source: M\nCandidate under review: \\boxed{{{a}}}")
    vote = ("approval_0", "R", "agent", "Review Position: needs_revision")
    update = ("approval_0_candidate_update", "system", "system", "to \\boxed{B}")
    assert labeled(spark, "broadcast", say("A"), anchor("A"), vote, say("C"), anchor("C")).first().strict
    r = labeled(spark, "broadcast", say("A"), anchor("A"), vote, update, say("C"), anchor("C")).first()
    assert not r.strict and r.status == "actor_response_after_protocol_selection" and r.after_key == "c"


def test_other_protocol_fails(spark):
    with pytest.raises(Exception, match="unsupported protocol"):
        events.classify(log(spark, "ring", executor("A"))).collect()


def test_require(spark):
    with pytest.raises(Exception, match="odd"):
        cells.require(spark.range(3), F.col("id") < 2, "odd").collect()


@pytest.mark.parametrize(("said", "every", "last"), [("\\boxed{\\frac{1}{2}}", ["\\frac{1}{2}"], "\\frac{1}{2}"), ("\x08oxed{A}", ["A"], "A"), ("\\boxed{\\boxed{x}}", ["\\boxed{x}"], "x"), ("\\boxed{a", [], None), ("", [], None)])
def test_boxes(spark, said, every, last):
    r = spark.createDataFrame([(said,)], "t string").select(text.boxed_all(F.col("t")).alias("a"), text.boxed_last(F.col("t")).alias("b")).first()
    assert (r.a, r.b) == (every, last)


def test_equality(spark):
    pairs = [("1,000", "1000", True), ("1.50", "1.5", True), ("x", "x", True), ("", "", False), ("a", "b", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", rules.exact_match(F.col("a"), F.col("b")).alias("got")).collect())
    assert rules.math_same("\\frac12", "0.5") and rules.math_same("(1, 2)", "(1,2.0)") and not rules.math_same("3", "4")


def test_sequences(spark):
    df = spark.createDataFrame([(1, i, v, 4) for i, v in enumerate(["a", "a", None, "b", "a"])], "g int, i int, v string, n int")
    assert [r.v for r in sequences.dedupe_consecutive(df, ["g"], ["i"], F.col("v")).orderBy("i").collect()] == ["a", "b", "a"]
    assert [r.i for r in sequences.recent_tail(df, ["g"], ["i"], F.col("n"), 9).orderBy("i").collect()] == [3, 4]
    assert [r.i for r in sequences.recent_tail(df, ["g"], ["i"], F.col("n"), 1).collect()] == [4]


def test_bootstrap_ignores_partitioning(spark):
    df = spark.range(40).select(F.lit("g").alias("g"), F.col("id").alias("u"), (F.col("id") % 3).alias("a"), F.lit(3).alias("b"))
    one, two = (sorted(map(tuple, sampling.bootstrap(x, "g", "u", "a", "b", 5).collect())) for x in (df.coalesce(1), df.repartition(7)))
    assert one == two and len(one) == 5


def test_trace_round_trip(spark, tmp_path):
    rows = [(1, "in", "7", i, "A0", t) for i, t in enumerate(["first\nline", "second"])]
    body = files.render_traces(spark.createDataFrame(rows, "example_idx long, input_text string, label string, turn_idx long, agent_id string, content string")).first().value
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.trace.txt").write_text('A0: name=Solver llm_type=t model=m\n"task": "math"\n' + body + "\n")
    got = files.traces(spark, str(tmp_path)).orderBy("turn_idx").collect()
    assert [(r.task, r.example_idx, r.input_text, r.label, r.agent_name, r.content) for r in got] == [("math", 1, "in", "7", "Solver", "first line"), ("math", 1, "in", "7", "Solver", "second")]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 'two\n"lines"', 1.5), ("b", None, None)], "k string, t string, v double")
    for sep in (",", "\t"):
        files.write_table(df, str(tmp_path / "t"), ["k", "t", "v"], sep)
        assert sorted(map(tuple, files.table(spark, str(tmp_path / "t"), "k string, t string, v double", sep).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    (tmp_path / "l.jsonl").write_text('{"k": "a"}\n\n{bad\n{"k": "b\x00"}\n')
    assert sorted(r.k for r in files.json_lines(spark, str(tmp_path / "l.jsonl"), "k string").collect()) == ["a", "b"]
    assert "| k |" in reports.markdown(df.select("k"))


def test_manifest_has_every_file(spark, tmp_path):
    import hashlib
    import json

    spark.range(40).selectExpr("id", "id % 4 AS k").coalesce(1).write.partitionBy("k").parquet(str(tmp_path / "out"))
    for name in "ab":
        files.write_manifest(spark, {"rows": 40}, str(tmp_path / "out"), str(tmp_path / name))
    said = [json.loads(spark.read.text(str(tmp_path / name)).first().value) for name in "ab"]
    want = {(str(p.relative_to(tmp_path / "out")), p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in (tmp_path / "out").rglob("part-*")}
    assert len(want) == 4 and set(map(tuple, spark.read.parquet(str(tmp_path / "a-files")).collect())) == want
    assert said[0] == said[1] and said[0]["counts"] == {"rows": 40} and said[0]["files"]["count"] == 4 and len(said[0]["files"]["sha256"]) == 64


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(90)
    finally:
        query.stop()


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    stream = live.read(spark, str(tmp_path / "in"), e.schema)
    drain(live.counters(stream, ["user_id"], "event_type", ["view", "click"]).writeStream.outputMode("complete").format("memory").queryName("counted"))
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, live.counters(e, ["user_id"], "event_type", ["view", "click"]).collect()))


def test_first_wins_sink(spark, tmp_path):
    put, a = live.first_wins_sink(str(tmp_path / "t"), ["k"]), spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    put(a, 0)
    put(a, 0)
    put(spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string"), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, "x"), (2, "y"), (3, "w")]


def test_review_pairs_stream(spark, tmp_path):
    rows = [(1, 0, "actor", "a"), (1, 1, "review", None), (1, 2, "actor", "b"), (1, 3, "review", None), (1, 4, "submission", None)]
    spark.createDataFrame(rows, "uid long, seq long, kind string, answer_key string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.read(spark, str(tmp_path / "in"), "uid long, seq long, kind string, answer_key string")
    drain(live.review_pairs(stream, None).writeStream.outputMode("append").format("memory").queryName("pairs"))
    assert sorted(map(tuple, spark.table("pairs").collect())) == [(1, 1, "a", "b", "actor"), (1, 3, "b", None, "submission")]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_boxes_are_unwrapped_to_any_depth(spark):
    deep = "\\boxed{" * 5 + "7" + "}" * 5
    assert one(spark, text.explicit_answer(F.lit(f"so {deep}")))[0] == "7"
    assert one(spark, text.explicit_answer(F.lit("\\boxed{\\text{x} \\frac{1}{2}}")))[0] == "\\text{x} \\frac{1}{2}"


def test_a_poll_says_its_last_candidate(spark):
    rows = [(1, i, "broadcast", "summary", "poll_1", "M", "agent", t, x) for i, (t, x) in enumerate([("candidate = 3\nno, better:\ncandidate = 4", None), ("candidate = none", None), ("candidate = 3", '{"candidate_answer": "5"}'), ("candidate = \\boxed{9}", "")])]
    got = events.classify(spark.createDataFrame(rows, BASE + ", extra_json string")).orderBy("seq").select("answer").collect()
    assert [r.answer for r in got] == ["4", "", "5", "9"]


@pytest.mark.parametrize(("change", "status"), [
    ({}, "linked"), ({"extra": "{broken"}, "malformed_extra_json|stage_mismatch|source_mismatch|authority_mismatch|missing_action"), ({"extra": "[1]"}, "extra_json_not_object|stage_mismatch|source_mismatch|authority_mismatch|missing_action"),
    ({"prev": "e7"}, "previous_event_uid_mismatch"), ({"source": "Executor"}, "source_mismatch"), ({"authority": "actor"}, "authority_mismatch"), ({"stage": "reviewer_1_candidate_memory"}, "stage_mismatch"), ({"seq": 5}, "not_immediate_sequence"),
])
def test_memory_records(spark, change, status):
    said = f'{{"candidate_memory_event": {{"action": "review_route", "source": "{change.get("source", "reviewer")}", "authority": "{change.get("authority", "internal_reviewer_suggestion")}", "stage": "reviewer_0"}}}}'
    rows = [
        (1, 0, "per", "message", "executor_0", "Executor", "agent", "\\boxed{A}", "e0", None, None), (1, 1, "per", "message", "reviewer_0", "Reviewer", "agent", "It looks odd.", "e1", None, None),
        (1, change.get("seq", 2), "per", "summary", change.get("stage", "reviewer_0_candidate_memory"), "system", "system", "", "e2", change.get("prev", "e1"), change.get("extra", said)),
    ]
    r = transitions.memory_link(events.classify(spark.createDataFrame(rows, BASE + ", event_uid string, previous_event_uid string, extra_json string"))).first()
    assert (r.link_status, r.memory_valid, r.route_observed) == (status, status == "linked", status == "linked")


def test_final_answers_label_and_conflict(spark):
    e = events.classify(log(spark, "per", submit("A"), verdict("PASS")))
    finals = spark.createDataFrame([(1, "a", False), (1, "b", True), (2, "", True), (3, "c", None)], "uid bigint, answer_key string, value boolean")
    got = {(r.uid, r.answer_key): (r.value, r.conflict) for r in transitions.frozen_labels(e, finals).collect()}
    assert got == {(1, "a"): (None, True), (1, "b"): (True, False)}


def test_number_equality_against_decimals(spark):
    from decimal import Decimal, InvalidOperation

    def value(t):
        try:
            v = Decimal(t.replace(",", "").strip().rstrip("."))
        except InvalidOperation:
            return None
        return v if v.is_finite() else None

    texts = ["1", "01.0", "1.", "-0", "0.00", "1,000", "1000.0", "1e3", "1E+3", ".5", "-.50", "x", "", "inf", "nan", "1" * 60, "1" * 60 + ".0", "1" * 59 + "2", "0." + "3" * 50, "0." + "3" * 49 + "4", "+7", "7"]
    rows = [(a, b) for a in texts for b in texts]
    d = spark.createDataFrame(rows, "a string, b string")
    for r in d.select("a", "b", rules.numeric_equal(F.col("a"), F.col("b")).alias("same")).collect():
        assert r.same == (value(r.a) is not None and value(r.a) == value(r.b)), r
    assert one(spark, rules.numeric_equal(F.lit("0.3"), F.lit("0.2"), 0.1), rules.numeric_equal(F.lit("0.31"), F.lit("0.2"), 0.1)) == (True, False)


def test_small_text_functions(spark):
    f, lit = text, F.lit
    got = one(
        spark, f.metric_safe(lit("Solver #1 (a)")), f.number_text(lit(3.0)), f.number_text(lit(0.25)), f.route(lit("[ROUTE_PLANNER] x")), f.route(lit("route to: executor")), f.compact(lit("<b>a</b>  b"), 20), f.compact(lit("abcdefgh"), 6),
        f.redact(lit("key ab and abc"), F.array(lit("ab"), lit("abc"))), f.first_real(lit(" "), lit("none"), lit("x")), f.two_bool(lit("True")), f.two_bool(lit("1")), f.final_answer(lit("a\n b. \n")), f.last_number(lit("3 then 1,250.5 end")),
        f.tokens_approx(lit(" a b  c ")), f.candidate_key(lit("A b")), F.length(f.signature(lit("p"), lit("g"))),
    )
    assert tuple(got) == ("solver_1_a", "3", "0.25", "planner", "executor", "a b", "abc...", "key [redacted] and [redacted]", "x", True, False, "b", "1250.5", 3, "ab", 64)


def test_streamed_windows_sessions_and_once_equal_batch(spark, tmp_path):
    rows = [(i, f"u{i % 3}", f"2024-01-01 00:{i:02d}:00") for i in range(0, 50, 3)] + [(99, "u1", "2024-01-02 00:00:00")]
    d = spark.createDataFrame(rows + rows[:4], "id long, user string, at string").withColumn("ts", F.to_timestamp("at")).drop("at")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: live.read(spark, str(tmp_path / "in"), "id long, user string, ts timestamp")
    cases = {"t": lambda x: live.tumbling(x, "ts", "10 minutes", ["user"]), "s": lambda x: live.sessions(x, "ts", "5 minutes", ["user"]), "o": lambda x: live.once(x, ["id"], "ts")}
    for name, make in cases.items():
        q = make(stream()).writeStream.format("memory").queryName(f"live_{name}").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        want = make(d)
        if name != "o":
            want = want.where("start < '2024-01-02'")  # the last window stays open
        assert sorted(map(tuple, spark.table(f"live_{name}").collect())) == sorted(map(tuple, want.collect()))


def test_json_objects_in_odd_texts(spark):
    texts = {
        '{"a": 1, "b": {"c": "x } y"}}': (1, "x } y"), 'pre {not json} then {"a": 2}': (2, None), "{'a': 3, 'b': {'c': 'it'}": (3, "it"), '```json\n{"a": 4,}\n```': (4, None),
        '{a: 5, "b": {"c": null': (5, None), "“a”": None, "[1, 2]": None, "": None, '{"b": {"c": "say \\"{\\""}, "a": 6}': (6, 'say "{"'), "none": None, "x" * 20000 + ' {"a": 7}': (7, None),
        '{"z": {"y": {"x": {"w": {"v": 1}}}}, "a": 8}': (8, None),
    }
    d = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", outputs.json_object(F.col("t"), "a int, b struct<c: string>").alias("o"))
    for r in d.collect():
        want = texts.get(r.t)
        assert (None if r.o is None else (r.o.a, r.o.b and r.o.b.c)) == want, r.t


def test_fields_scores_and_decisions_of_missing_texts(spark):
    d = spark.createDataFrame([(None,), ("",)], "t string")
    t = F.col("t")
    for r in d.select(outputs.int_field(t, "score"), outputs.bool_field(t, "ok", True), outputs.boxed_field(t, ["x"]), outputs.scored(t, ["A"]), outputs.critique(t), outputs.judge_report(t), outputs.fail_route(t, t), outputs.authority(t, t, t)).collect():
        assert (r[0], r[1], r[2], r[3], tuple(r[4]), tuple(r[5]), r[6], r[7]) == (1, True, "", None, (False, ""), (None, None, None), "planner", "internal_observation")


def test_run_without_examples_and_without_scores(spark):
    schema = "uid long, seq long, round long, event_type string, stage string, sender string, content string"
    none = runs.collect(spark.createDataFrame([], schema))
    extra = {"first_success": F.lit(None).cast("long"), "attempts": F.lit(None).cast("long"), "tokens": F.lit(3).cast("long")}
    assert none.count() == 0 and set(runs.summary(none.withColumns(extra)).first()) == {0}
    one = runs.collect(spark.createDataFrame([(1, 0, 0, "message", "poll_1", "A", "score = 900"), (1, 1, 0, None, "poll_1", None, None), (1, 2, 0, "message", "executor", "A", "so \\boxed{7}")], schema))
    r = one.first()
    assert (r.messages, r.polls, r.confidence_sum, r.correct, r.predicted, r.first_passed) == (2, 2, 101, -1, "7", None)
    s = runs.summary(one.withColumns(extra)).first()
    assert (s.examples, s.scored, s.accuracy, s.avg_tokens, s.avg_confidence) == (1, 0, 0, 3, 50.5)
    assert runs.pass_at_attempt(one.withColumns(extra)).count() == 0


def test_label_cache_takes_the_last_row_and_null_parts(spark):
    cache = spark.createDataFrame([("p", None, "a", True, 1), ("p", "", "a", False, 2), ("q", None, "a", True, 1)], "problem string, gold string, answer string, value boolean, position long")
    asked = spark.createDataFrame([(1, "p", None, "a", None), (2, "p", "", "a", True), (3, "r", None, "a", None)], "id long, problem string, gold string, answer string, runtime boolean")
    got = {r.id: (r.value, r.source) for r in runs.look_up(asked, cache, ["problem", "gold", "answer"]).collect()}
    assert got == {1: (False, "cache"), 2: (True, "runtime_evaluator"), 3: (None, None)}


def test_problem_record_takes_tries_then_trace_then_metrics(spark):
    examples = spark.createDataFrame([(u, 5, 4) for u in range(1, 6)], "uid bigint, model_turns bigint, reasoning_turns bigint")
    attempts = spark.createDataFrame([(1, 3, 3, False, 2), (2, 2, None, False, 2)], "uid bigint, attempts bigint, first_success bigint, first_passed boolean, hints_used bigint")
    metrics = spark.createDataFrame(
        [(1, [True], [False], 9, None, 1, 2, 3, 0.5), (2, [], [True], None, {"a": 2, "b": None}, None, None, None, None), (3, None, [None, False, True], 2, {"a": 99}, 1, 1, None, 1.0), (4, [None, None], None, None, None, None, None, None, None)],
        f"uid bigint, {problems.METRICS}",
    )
    results = spark.createDataFrame([(3, 2, "x", "y")], "uid bigint, tier int, domain string, source string")
    x = problems.records(examples, attempts, metrics, results)
    got = {r.uid: (r.final_passed, r.first_passed, r.first_success, r.correction_loops, r.evaluator_submissions, r.hints_used, r.model_calls, r.total_tokens, r.tier) for r in x.collect()}
    assert got == {
        1: (True, True, 1, 1, 3, 2, 9, 3, None), 2: (False, False, None, 2, 2, 2, 5, 0, None), 3: (True, False, 2, 2, 2, 0, 5, 0, 2),
        4: (False, False, None, 2, 0, 0, 5, 0, None), 5: (False, False, None, 0, 0, 0, 5, 0, None),
    }
    said = {r.metric: (r.value, r.numerator, r.denominator) for r in problems.basic_metrics(x).collect()}
    assert said["Pass@1"] == (0.2, 1, 5) and said["AvgCorrectionAttemptsToSuccess"] == (1.5, 3, 2) and said["TotalModelCalls"] == (29.0, None, None)
    none = {r.metric: r.value for r in problems.basic_metrics(x.where("uid > 9")).collect()}
    assert none["FinalPassRate"] is None and none["TotalModelCalls"] == 0


def test_reflective_rounds_count_changes_within_closed_attempts(spark):
    said = ["a", "a", None, "b", "a", "V", "c", "V", "d", "e"]
    e = spark.createDataFrame([(1, i, True if s == "V" else None, None if s == "V" else s) for i, s in enumerate(said)], "uid bigint, seq bigint, verdict boolean, answer_key string")
    assert [tuple(r) for r in problems.reflective_rounds(e).collect()] == [(1, 2)]


def test_fixed_order_and_transition_names(spark):
    x = spark.createDataFrame([("z", 1), ("b", 2), (None, 3), ("a", 4), ("y", 5)], "name string, n int")
    assert [r.n for r in problems.in_order(x, {"name": ["b", "a"]}, "n").collect()] == [2, 4, 5, 1, 3]
    y = spark.createDataFrame([(False, True), (None, True), (True, True)], "a boolean, b boolean").select(problems.transition_name(F.col("a"), F.col("b")).alias("n"))
    assert [r.n for r in y.collect()] == ["wrong_to_correct", "unknown", "correct_to_correct"]


def test_best_sidecar(spark, tmp_path):
    for name, lines in (("a", "1\n\n \n2\n3\n"), ("b", "1\n\n\n\n\n"), ("c", "")):
        (tmp_path / f"{name}.metrics.jsonl").write_text(lines)
    pick = lambda *stems: [(r.path.rsplit("/", 1)[1][0], r.lines) for r in files.best_sidecar(spark, str(tmp_path), list(stems)).collect()]
    assert (pick(), pick("b"), pick("c"), pick("b", "c"), pick("x")) == ([("a", 3)], [("b", 1)], [("c", 0)], [("b", 1)], [("a", 3)])
    (tmp_path / "none").mkdir()
    assert files.best_sidecar(spark, str(tmp_path / "none"), ["a"]).isEmpty()


def test_an_empty_report_leaves_none(spark, tmp_path):
    path, x = str(tmp_path / "r"), spark.createDataFrame([(1, "a")], "n int, t string")
    assert files.write_or_remove(x, path, ["n", "t"]) and (tmp_path / "r").exists()
    assert not files.write_or_remove(x.where("n > 1"), path, ["n", "t"]) and not (tmp_path / "r").exists()


def test_labels_of_each_mode(spark):
    rows = [("1/2", "0.5", "1/2", None), ("3.05", "3", "7", True), ("7", "3", " 7 ", True), (None, "3", None, True), ("4", "", None, None)]
    x = spark.createDataFrame(rows, "answer string, gold string, final string, runtime boolean")
    said = lambda *a: [(r.value, r.source) for r in runs.judge(x, *a).collect()]
    tail = [(True, "runtime_evaluator"), (None, "missing"), (None, "missing")]
    assert said("exact")[1:] == [(False, "exact"), *tail] and said("numeric-verifier", 0.1)[1:] == [(True, "numeric-verifier"), *tail]
    assert said("omni-rule")[:2] == [(True, "omni-rule"), (False, "omni-rule")] and said("llm")[0] == (None, "unsupported:llm")


def test_saved_evaluations_count_if_all_have_one_of_one_mode(spark):
    log = [(1, 1, "meta", "evaluation_0", "exact", 0), (1, 2, "meta", "evaluation_1", "rule", 1), (1, 3, "meta", "evaluation_1", "rule", None), (2, 1, "meta", "evaluation", "rule", 0), (2, 2, "message", "evaluation", "rule", 1), (2, 3, "meta", "evaluation", "", 1)]
    saved = runs.saved_evaluations(spark.createDataFrame(log, "uid bigint, seq bigint, event_type string, stage string, mode string, correctness int"))
    assert sorted(map(tuple, saved.collect())) == [(1, "rule", True), (2, "rule", False)]
    records = spark.createDataFrame([(1, "4", "5"), (2, "5", "5")], "uid bigint, answer string, gold string")
    said = lambda *a: [tuple(r)[3:] for r in runs.post_evaluation(*a).orderBy("uid").collect()]
    assert said(records, saved) == [(1, "rule", "per_evaluator"), (0, "rule", "per_evaluator")]
    assert said(records, saved.where("uid = 1")) == [(0, "exact", "fallback_exact"), (1, "exact", "fallback_exact")]
    assert said(records, saved, "uid", "omni-rule") == [(0, "omni-rule", "extra_post_eval"), (1, "omni-rule", "extra_post_eval")]
