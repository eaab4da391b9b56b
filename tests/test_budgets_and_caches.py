"""Token budgets by a real tokenizer, tails of histories, and a cache that a stream fills."""

import random

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from episodica.functions import tokens
from episodica.operators import sequences
from episodica.streaming import live

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    r = random.Random(7)
    words = ["the", "answer", "\\frac{1}{2}", "  ", "\n\n", "0123456789", "caf\u00e9", "\u4e2d\u6587", "antidisestablishmentarianism", ",", "\U0001f600", "x" * 30, "\u0e44\u0e17\u0e22"]
    made = [" ".join(r.choice(words) for _ in range(r.randrange(15, 40))) for _ in range(190)]
    return made + ["a" * 400, " " * 200 + "b" * 100 + " " * 200 + "c", "\n" * 300 + "end", "\u4e2d" * 200, "\U0001f600" * 120, "0" * 500, "ab" * 300, "- " * 250, ("word " * 20 + "\n") * 6, "." * 400]


def test_cuts_equal_trying_every_length(spark):
    t, every = Tokenizer.from_file(PATH), texts()
    assert len(every) == 200
    count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    d = spark.createDataFrame(list(enumerate(every)), "id long, text string").repartition(4)
    for keep, budget in (("head", 30), ("tail", 31), ("head_tail", 45)):
        got = {r.id: (r.cut, r.n) for r in d.select("id", tokens.fit_tokens(F.col("text"), PATH, budget, keep).alias("cut"), tokens.token_count(F.col("text"), PATH).alias("n")).collect()}
        for i, raw in enumerate(every):
            text = raw.strip()
            assert got[i][1] == count(raw)
            want = text
            if count(text) > budget:
                fit = [n for n in range(32, len(text) + 1) if count(tokens.shortened(text, n, keep)) <= budget]
                want = tokens.shortened(text, fit[-1], keep) if fit else text[-32:] if keep == "tail" else text[:32]
            assert got[i][0] == want, (keep, i)


def test_cuts_of_odd_inputs(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "   "), (4, " short "), (5, "long " * 30_000)], "id long, text string")
    cut = lambda budget, keep: {r.id: r.c for r in d.select("id", tokens.fit_tokens(F.col("text"), PATH, budget, keep).alias("c")).collect()}
    got = cut(50, "head_tail")
    assert [got[i] for i in (1, 2, 3, 4)] == [None, "", "", "short"] and tokens.MARK.strip() in got[5] and len(got[5]) < 400
    assert cut(1, "tail")[5] == ("long " * 30_000).strip()[-32:] and cut(0, "head")[5] == ("long " * 30_000).strip()
    assert [r.n for r in d.orderBy("id").select(tokens.token_count(F.col("text"), PATH).alias("n")).collect()][:2] == [0, 0]
    assert d.where("false").select(tokens.fit_tokens(F.col("text"), PATH, 5).alias("c")).count() == 0
    with pytest.raises(ValueError, match="keep"):
        tokens.fit_tokens(F.col("text"), PATH, 5, "middle")


def test_history_tail(spark):
    rows = [("a", i, n, i == 2) for i, n in enumerate([5, 5, 5, 5, 5, None])] + [("b", 0, 100, False), ("b", 1, 100, False), (None, 0, 1, False)]
    d = spark.createDataFrame(rows, "k string, i long, n long, final boolean")
    kept = lambda **a: sorted(((r.k or "", r.i) for r in sequences.history_tail(d, ["k"], ["i"], F.col("n"), **a).collect()))
    assert kept(budget=11, last_n=0) == [("", 0), ("a", 3), ("a", 4), ("a", 5), ("b", 1)]
    assert kept(budget=11, last_n=0, pinned=F.col("final")) == [("", 0), ("a", 2), ("a", 3), ("a", 4), ("a", 5), ("b", 1)]
    assert kept(budget=0, last_n=2) == [("", 0), ("a", 4), ("a", 5), ("b", 0), ("b", 1)]
    assert sequences.history_tail(d.where("false"), ["k"], ["i"], F.col("n"), 5, 1).count() == 0


CACHE = "k string, at long, v string, note string"


def held(spark, path, d, key=("k",)):
    return sorted((r.k, r.v) for r in live.cached_rows(spark, path, d.schema, list(key)).collect())


def test_cache_sink_survives_a_killed_batch(spark, tmp_path, monkeypatch):
    path, put = str(tmp_path / "t"), live.cache_sink(str(tmp_path / "t"), ["k"], ["at", "v"], ("v",), buckets=8)
    one = spark.createDataFrame([("a", 2, "late", "x"), ("a", 1, "first", "x"), ("b", 1, "b", None), (None, 1, "no key", "x"), ("c", 1, None, "x")], CACHE)
    assert held(spark, path, one) == []
    end = live._end
    monkeypatch.setattr(live, "_end", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        put(one, 0)
    assert held(spark, path, one) == []  # what a batch wrote that didn't end doesn't count
    monkeypatch.setattr(live, "_end", end)
    for _ in range(3):
        put(one, 0)
    assert held(spark, path, one) == [("a", "first"), ("b", "b")]
    put(spark.createDataFrame([("a", 0, "again", "x"), ("d", 0, "d", "x")], CACHE), 1)
    put(one.where("false"), 2)
    assert held(spark, path, one) == [("a", "first"), ("b", "b"), ("d", "d")]
    assert live.cached_rows(spark, path, one.schema).count() == 3
    refused = spark.read.schema(one.schema).parquet(f"{path}/refused")
    assert sorted((r.k or "", r.v or "") for r in refused.collect()) == [("", "no key"), ("c", "")]


def test_cache_of_two_writers_takes_the_last(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    d = spark.createDataFrame([("a", 1, "one", "x")], CACHE)
    live.cache_sink(path, ["k"], ["at"], writer="one")(d, 0)
    # A second writer that began before the first one's batch had ended sees nothing of it.
    with monkeypatch.context() as m:
        m.setattr(live, "cached_rows", lambda spark, path, schema: spark.createDataFrame([], "k string, cache_bucket int"))
        live.cache_sink(path, ["k"], ["at"], writer="two")(d.withColumn("v", F.lit("two")), 0)
    assert live.cached_rows(spark, path, d.schema).count() == 2 and held(spark, path, d) == [("a", "two")]


def test_cache_sink_reads_its_own_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    put, d = live.cache_sink(path, ["k"], ["at"], buckets=16), spark.createDataFrame([(f"k{i}", i, "v", None) for i in range(200)], CACHE)
    put(d, 0)
    rows = live.cached_rows(spark, path, d.schema)
    assert rows.select("cache_bucket").distinct().count() == 16
    plan = rows.where(F.col("cache_bucket").isin([3])).select("k")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cache_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_cache_sink_in_a_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    for k in range(3):
        spark.createDataFrame([(f"k{i % 5}", 10 * k + i, f"v{k}", None) for i in range(5 + k)], CACHE).coalesce(1).write.mode("append").parquet(source)
    stream = live.read(spark, source, CACHE, 1)
    q = stream.writeStream.foreachBatch(live.cache_sink(path, ["k"], ["at"], buckets=4)).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(120)
    d = spark.createDataFrame([], CACHE)
    assert [k for k, _ in held(spark, path, d)] == [f"k{i}" for i in range(5)] and live.cached_rows(spark, path, d.schema).count() == 5
