"""Steps that few bytes lead to much work: they are dealt to all tasks, and short paths give what the long ones give."""

import hashlib
import random

import public_tokenizers
from pyspark.sql import functions as F

from episodica.functions import text, tokens
from episodica.operators import sampling
from episodica.plans import adapter, catalog

SF = "/root/testdata/sf0.001"


def test_draws_are_dealt_and_not_sorted(spark):
    units = [("g", u, u % 5, 5) for u in range(90)] + [("h", u, u % 3, u % 2) for u in range(7)] + [("z", 1, 0, 0)]
    made = sampling.bootstrap(spark.createDataFrame(units, "g string, u long, a long, b long"), "g", "u", "a", "b", 50)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin" not in plan
    want = {}
    for g in ("g", "h", "z"):
        rows = [r for r in units if r[0] == g]
        for rep in range(1, 51):
            took = [rows[int(hashlib.md5(f"b|{rep}|{i}".encode()).hexdigest()[:8], 16) % len(rows)] for i in range(len(rows))]
            below = sum(r[3] for r in took)
            want[g, rep] = sum(r[2] for r in took) / below if below else None
    assert {(r.g, r.rep): r.rate for r in made.collect()} == want


def test_the_log_is_dealt_to_all_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert adapter.steps(spark, SF).rdd.getNumPartitions() == n == adapter.messages(spark, SF).rdd.getNumPartitions()


def test_detail_rows_read_the_log_parsed_once(spark):
    plan = catalog.QUERIES["detail_rows"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Position" not in plan and "Evaluation" not in plan  # of the patterns that read the texts


def test_plain_boxes_equal_the_fold(spark):
    texts = ["\\boxed{A}", "so \\boxed{ a b } ends.\nmore", "\\boxed{}", "\\boxed{ }", "\\boxed{A", "\\boxed{A}}", "{\\boxed{A}", "\\boxed{\\frac{1}{2}}", "\\boxed{A} \\boxed{B}", "x \\ \\boxed{A}", "\\boxed{A} \\", "\x08oxed{A}", "no box", "", None, "boxed{A}", "\\boxed{a\\b}"]
    x = spark.createDataFrame([(t,) for t in texts], "t string").select(text.boxed_all(F.col("t")).alias("a"), text._boxes(text.sanitize_boxed(F.col("t"))).alias("b")).collect()
    assert [r.a for r in x] == [r.b for r in x]
    assert [r.a for r in x[:4]] == [["A"], ["a b"], [], []]


def test_cuts_encode_only_what_may_stay(monkeypatch):
    path, real = public_tokenizers.path("byte_bpe_50k.json"), tokens.tokenizer
    seen = []

    class Counting:
        def __init__(self, t):
            self.t = t

        def encode(self, s, **k):
            seen.append(len(s))
            return self.t.encode(s, **k)

        def encode_batch(self, many, **k):
            seen.extend(map(len, many))
            return self.t.encode_batch(many, **k)

        def to_str(self):
            return self.t.to_str()

    t = Counting(real(path))
    monkeypatch.setattr(tokens, "tokenizer", lambda _: t)
    tokens.pieces.cache_clear()
    try:
        r = random.Random(3)
        long = " ".join(r.choice(["one", "two's", "three,", "\n\nfour", "5 6", "<|endoftext|>", "caf\u00e9 ", "\x1f.", "\u180e x"]) for _ in range(20_000))
        for keep in tokens.KEEP:
            for budget in (5, 40):
                seen.clear()
                got = tokens.fitted(long, path, budget, keep)
                assert sum(seen) < 10_000
                whole, fits = long.strip(), lambda s: len(t.t.encode(s, add_special_tokens=False).ids) <= budget
                fit = [n for n in range(32, 400) if fits(tokens.shortened(whole, n, keep))]
                assert got == (tokens.shortened(whole, fit[-1], keep) if fit else whole[-32:] if keep == "tail" else whole[:32])
    finally:
        tokens.pieces.cache_clear()
