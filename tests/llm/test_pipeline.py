"""The pipeline on a small table, each stage against its own input."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F


def test_stages(spark):
    rng = random.Random(4)
    langs = {"en": "the of and is was with that from".split(), "fr": "le la de et les est pour dans".split()}
    word = lambda x: rng.choice(langs[x]) if rng.random() < 0.3 else f"{x}{rng.randrange(5000)}"
    rows = []
    for i in range(200):
        x = rng.choice(list(langs))
        rows.append((i, " ".join(word(x) for _ in range(60 + i)), x, f"s{i % 4}", 0))
    passage = " ".join(word("en") for _ in range(50))
    rows += [(200, rows[0][1], rows[0][2], "s0", 0), (201, "123 456", "en", "s1", 0), (202, None, "en", "s1", 0)]
    rows += [(203 + i, " ".join(word("en") for _ in range(40)) + " " + passage, "en", "s2", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], "").cache())
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert all(d.columns == docs.columns for d in seen[:-1])
    assert ids[0] - ids[1] == {201, 202}
    assert ids[1] - ids[2] == {200}
    assert ids[3] == ids[2] and not seen[3].where(F.col("text").contains(passage)).count()
    assert seen[5].count() == seen[4].count() and ids[5] == ids[4]
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_stage_keeps_learned_languages_only(spark):
    rng = random.Random(5)
    syllables = {"en": "the and ing ter ough ness wh ly ed con st er".split(), "fr": "le eau tion que oir é ment aux en ch ille ou".split()}
    word = lambda x: "".join(rng.choice(syllables[x]) for _ in range(rng.randrange(1, 4)))
    noise = lambda abc, n: " ".join("".join(rng.choice(abc) for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows = [(i, " ".join(word(x) for _ in range(40)), x) for i, x in enumerate(["en", "fr"] * 150)]
    rows += [(300, "это как не что был совсем другой текст", None), (301, "这是一个中文文本 没有别的", None), (302, noise("abcdefghijklmnopqrstuvwxyz", 80), None)]
    rows += [(303, rows[0][1] + " это", None), (304, noise("абвгдежзиклмно", 60) + " the and", None), (305, "“" + rows[2][1] + "” — …", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert set(range(306)) - kept == {300, 301, 302, 304}


def test_near_dedup_keeps_texts_without_ids(spark):
    rng = random.Random(6)
    text = [" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(5)]
    rows = [(None, text[0], "b"), (None, text[0], "a"), (1, text[1], "a"), (1, text[2], "a"), (2, text[3], "b"), (None, text[3] + " end", "a"), (4, text[4], "a"), (3, text[4] + " end", "b"), (5, None, "a"), (None, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for d in (docs.coalesce(1), docs.repartition(5)):
        got = {tuple(r) for r in corpus_pipeline.near_dedup(spark, d, "").collect()}
        assert got == {rows[1], rows[2], rows[3], rows[4], rows[7], rows[8], rows[9]}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names of results, of inner columns and of the struct that rows travel in.
CLASH = ("row", "key", "copy", "size", "copies", "kept", "score", "n_words", "n_removed", "kept_text", "component_id", "target", "held_out", "lang_pred", "ids", "n_tokens", "id", "k1", "t", "_size", "_copy", "_key", "a b", "x.y")


def odd_rows():
    rng = random.Random(7)
    said = lambda n: " ".join(rng.choice("the of and is was with that from".split()) if rng.random() < 0.4 else f"en{rng.randrange(4000)}" for _ in range(n))
    rows = [(i, said(50 + i), "en", f"s{i % 3}", 1) for i in range(60)]
    passage = said(40)
    rows += [(60, None, "en", "s0", None), (61, "", None, None, 0), (62, " \n", "en", "s1", 2), (63, "one", "en", None, 3), (None, said(60), "en", "s1", 9), (64, said(80), None, None, 7)]
    rows += [(65, said(70) + " " + passage, "en", "s2", 5), (66, passage + " " + said(70), "en", "s0", 5), (67, said(90_000), "en", "s0", 1)]
    return [*rows, rows[3], rows[3], (68, rows[4][1], "en", "s1", 1), (69, rows[4][1], "en", "s1", 1)]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    plain = sorted(map(repr, stage(spark, docs, "").collect()))
    assert plain and stage(spark, docs.limit(0), "").count() == 0
    more = docs.withColumns({c: F.lit("x") for c in CLASH})
    out = stage(spark, more, "")
    if name == "bpe":
        assert sorted(map(repr, out.collect())) == plain
    else:
        assert out.columns == more.columns
        assert sorted(map(repr, out.select(docs.columns).collect())) == plain
        assert out.select(*(f"`{c}`" for c in CLASH)).distinct().count() == 1


def test_kept_rows_of_odd_input(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {name: [tuple(r) for r in stage(spark, docs, "").collect()] for name, stage in corpus_pipeline.STAGES[:3]}
    ids = {name: [r[0] for r in found] for name, found in kept.items()}
    assert {60, 61, 62} & set(ids["language_id"]) == set() and {64, 67, None} <= set(ids["language_id"])
    near = ids["near_dedup"]
    assert near.count(3) == 1 and 4 in near and not {68, 69} & set(near) and {60, 61, 62, 63, 64, 67, None} <= set(near)
    texts = {r[0]: r[1] for r in kept["substring_dedup"]}
    assert len(kept["substring_dedup"]) == len(rows)
    assert texts[60] is None and texts[61] == "" and texts[63] == "one" and texts[3] == "" and texts[4] == "" and texts[67] == rows[68][1]
    assert len(texts[65].split()) == len(texts[66].split()) == 70
