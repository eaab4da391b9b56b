"""Keys that re-appear, placement by path suffix, counters that are carried over, and ledgers kept by a stream."""

import pytest
from pyspark.sql import functions as F

from episodica.operators import admission, attempts, cells, problems, runs, sequences
from episodica.sources import files
from episodica.streaming import live


def test_keys_that_come_back_are_refused(spark, tmp_path):
    rows = [(k, i) for i, k in enumerate([1, 1, 2, 2, 2, None, None, 3])]
    whole, back, apart = (str(tmp_path / n) for n in ("whole", "back", "apart"))
    spark.createDataFrame(rows, "uid long, seq long").coalesce(1).write.parquet(whole)
    assert files.broken_runs(spark, whole, "uid").count() == 0
    files.require_runs(spark, whole, "uid")
    spark.createDataFrame([*rows, (2, 8)], "uid long, seq long").coalesce(1).write.parquet(back)
    assert [tuple(r) for r in files.broken_runs(spark, back, "uid").collect()] == [(2, 1, 4, 7)]
    with pytest.raises(ValueError, match="uid 2 re-appears"):
        files.require_runs(spark, back, "uid")
    for part in (rows, [(3, 9)]):
        spark.createDataFrame(part, "uid long, seq long").coalesce(1).write.mode("append").parquet(apart)
    assert [tuple(r) for r in files.broken_runs(spark, apart, "uid").collect()] == [(3, 2, 2, 2)]
    with pytest.raises(ValueError, match="uid 1 has 2 rows"):
        files.require_unique(spark.read.parquet(whole).where("uid < 2 OR uid > 2"), "uid")
    files.require_unique(spark.createDataFrame([(1,), (None,)], "uid long"), "uid")
    assert files.broken_runs(spark, whole, "uid").where("false").count() == 0


def test_longest_suffix_wins(spark):
    records = [(1, "/a/b/t/x", 0), (2, "/a/c/t/x", 0), (3, "t/x", 0), (4, "/q/x", 0), (5, "/q/z", 0), (6, "/a/b/t/x", 1), (7, None, 0), (8, "", 0), (9, "/q/xx", 0), (1, "/a/b/t/x", 0)]
    targets = [("b/t/x", 0, "deep"), ("t/x", 0, "near"), ("x", 0, "late"), ("x", 0, "early"), (None, 0, "none")]
    r = spark.createDataFrame(records, "id int, path string, example int")
    t = spark.createDataFrame(targets, "suffix string, example int, problem string")
    found = sorted((x.id, x.problem, x.suffix_names) for x in problems.by_path_suffix(r, "path", t, "suffix", ["example"]).collect())
    key = [(1, "deep", 3), (1, "deep", 3), (2, "near", 2), (3, "near", 2), (4, "early", 1)]
    assert found[:5] == key and [f[1:] for f in found[5:]] == [(None, None)] * 5
    assert problems.by_path_suffix(r.where("false"), "path", t, "suffix", ["example"]).count() == 0
    assert problems.by_path_suffix(r, "path", t.where("false"), "suffix").where("problem IS NOT NULL").count() == 0


def test_counters_carried_over_and_reset(spark):
    rows = [("w", 1, {"solver": 10, "critic": 4}), ("w", 2, {"solver": 25}), ("w", 3, {"solver": 5, "critic": 9}), ("w", 4, None), ("w", 5, {}), ("w", 6, {"solver": None, "critic": 9}), ("v", 1, {"solver": 7})]
    d = spark.createDataFrame(rows, "run string, example int, counters map<string,long>")
    got = sorted(map(tuple, problems.agent_increases(d, ["run"], "example", "counters").collect()))
    assert got == [("v", 1, "solver", 7, False), ("w", 1, "critic", 4, False), ("w", 1, "solver", 10, False), ("w", 2, "solver", 15, False), ("w", 3, "critic", 5, False), ("w", 3, "solver", 5, True), ("w", 6, "critic", 0, False)]


def test_every_dataset_has_its_route_row(spark):
    d = spark.createDataFrame([("a", "broadcast", True, False, "revise", False, True, True, "repaired")], "dataset string, protocol string, strict boolean, before_correct boolean, action string, route_observed boolean, after_correct boolean, answer_changed boolean, transition_outcome string")
    (row,) = cells.route_counts(d, ["dataset"]).collect()
    assert row.dataset == "a" and set(row[1:]) == {0}


def test_ledgers_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [(f"q{i % 3}", i, f"t{i}") for i in range(23)]
        folder, seen = str(tmp_path / "in"), {}
        for k in range(3):
            spark.createDataFrame(rows[8 * k : 8 * k + 8] + ([(None, 99, "lost")] if not k else []), "key string, at long, text string").coalesce(1).write.mode("append").parquet(folder)

        def put(batch, _):
            found = {}
            for r in batch.collect():
                found.setdefault(r.key, []).append((r.entry, r.parent, r.at, r.text))
            seen.update(found)
            assert all(len(v) <= 4 for v in found.values())

        stream = live.ledgers(live.read(spark, folder, "key string, at bigint, text string", 1), 4)
        q = stream.writeStream.outputMode("update").foreachBatch(put).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        assert q.awaitTermination(120)
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    want = {}
    for r in sequences.bounded_ledger(spark.read.parquet(folder).where("key IS NOT NULL"), ["key"], ["at"], 4).collect():
        want.setdefault(r.key, []).append((r.entry, r.parent, r.at, r.text))
    # Files of one folder may arrive in any order; a ledger holds what came last.
    assert {k: len(v) for k, v in seen.items()} == {k: len(v) for k, v in want.items()}
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}


def test_requests_wait_for_window_and_cooldown(spark):
    s = 1_000_000
    rows = [("a", 10 + i, i, None) for i in range(5)] + [("a", 3 * s, 9, 5 * s), ("a", 3 * s, 10, None), ("b", 0, 1, None), (None, 7, 1, None), ("b", None, 2, None), ("b", 0, 3, None)]
    d = spark.createDataFrame(rows, "worker string, at long, id long, wait long")
    got = {(r.worker, r.id): (r.admitted, r.waited) for r in admission.admit(d, "worker", "at", "id", "wait", limit=2).collect()}
    assert [got["a", i][0] for i in range(5)] == [10, 11, 10 + s + 1, 11 + s + 1, 10 + 2 * s + 2]
    assert got["a", 9] == (3 * s, 0) and got["a", 10] == (8 * s, 5 * s)
    assert got["b", 1] == (0, 0) and got["b", 3] == (0, 0) and got["b", 2] == (None, None) and got[None, 1] == (7, 0)
    assert admission.admit(d.where("false"), "worker", "at", "id", "wait").count() == 0


def test_signals_of_loops_and_convergence(spark):
    e, r, v = "Executor", "Reviewer", "Evaluator"
    rows = [
        (1, 0, e, None, None, None, "a"), (1, 1, r, "agree", None, None, None), (1, 2, v, None, None, False, None), (1, 3, e, None, None, None, "a"), (1, 4, r, "agree", None, None, None), (1, 5, v, None, None, True, None), (1, 6, r, "agree", None, None, None),
        (2, 0, e, None, None, None, "b"), (2, 1, v, None, None, True, None),
        (3, 0, "system", None, None, None, None), (4, 0, r, "revise", "planner", None, None), (4, 1, r, "revise", "planner", None, None), (4, 2, r, "revise", "planner", None, None),
    ]
    d = spark.createDataFrame(rows, "uid long, seq long, sender string, action string, route string, verdict boolean, answer_key string")
    got = {x.uid: x for x in attempts.signals(d).collect()}
    one = got[1]
    assert (one.reviews, one.agreements, one.agreed_then_fail, one.agreed_then_pass, one.pairs, one.repeated, one.fails, one.unchanged, one.loops) == (3, 3, 1, 1, 1, 1, 1, 1, True)
    assert one.imbalance == 0.2 and got[2].imbalance == 0 and got[3].imbalance is None and got[4].loops and not got[2].loops and not got[3].loops
    total = attempts.signal_rates(attempts.signals(d)).first()
    assert (total.trajectories, total.premature_convergence_rate, total.looping_rate, total.wrong_convergence_rate, total.no_change_after_fail_rate) == (4, 0.25, 0.5, 0.5, 1.0)
    assert attempts.signal_rates(attempts.signals(d.where("false"))).first().trajectories == 0


def test_submitted_labels_are_reused_unless_they_differ(spark):
    told = spark.createDataFrame([("p", "a", False), ("p", " a ", False), ("p", "b", True), ("p", "b", False), ("q", "b", True), ("q", None, True), ("q", "c", None), (None, "z", True)], "problem string, answer string, passed boolean")
    labels = runs.submitted_labels(told, ["problem"])
    d = spark.createDataFrame([("p", "a", "a"), ("p", "b", "b"), ("q", "b", "x"), ("q", "c", "x"), ("q", "", "x"), (None, "z", "x"), ("r", "a", "a")], "problem string, answer string, gold string")
    got = {(x.problem, x.answer): (x.value, x.source, x.conflict) for x in runs.judge(runs.with_submitted(d, labels, ["problem"])).collect()}
    assert got == {
        ("p", "a"): (False, "runtime_evaluator", False), ("p", "b"): (True, "exact", True), ("q", "b"): (True, "runtime_evaluator", False), ("q", "c"): (False, "exact", False),
        ("q", ""): (None, "missing", False), (None, "z"): (True, "runtime_evaluator", False), ("r", "a"): (True, "exact", False),
    }
