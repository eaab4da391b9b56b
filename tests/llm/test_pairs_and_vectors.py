"""op11, op12 and op13 against plain versions over whole small tables, and odd rows."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from episodica.llm import alignment, jaccard, queries, whitening

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = "id long, text string"


# -- op11 --------------------------------------------------------------------------------------------------------
def plain_alignment(texts):
    """By the libraries themselves, a text at a time: (n_a, n_b, n_groups, links, digest)."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    byte_of = {chr(i if i in letters else next(spare)): i for i in range(256)}
    out = []
    for text in texts:
        whole = f" {text}".encode() if text else b""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not whole or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            out.append((0, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, raw_a))).tolist(), np.cumsum(list(map(len, raw_b))).tolist()
        both, groups, i, j, links = sorted(set(ends_a) & set(ends_b)), [], 0, 0, []
        for e in both:
            p, q = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append(",".join(map(str, ids_a[i:p])) + "|" + ",".join(map(str, ids_b[j:q])))
            links.append((ids_a[p - 1], ids_b[q - 1]))
            i, j = p, q
        out.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(x for r in out for x in r[3])
    most = Counter()
    for (_, q), n in counts.items():
        most[q] = max(most[q], n)
    return [(*r[:3], len(r[3]), sum(counts[x] == most[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]) for r in out]


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r[c] for c in ALIGNED) for r in queries.op11_alignment(spark, SF).collect()}
    for d, want in zip(docs, plain_alignment([d.text for d in docs]), strict=True):
        assert found[d.doc_id] == want, d.doc_id


def test_alignment_of_odd_texts(spark):
    texts = [None, "", " ", "  ", "a", "  two  spaces ", "tab\tand\nline", "<|endoftext|><s></s><unk>", "literal ▁ mark", "日本語 ภาษา 😀", "\x00﻿​", "a\xa0b é é", "ﬁ ½", "same same", "same same", "x" * 3000, "a\n\n  b \n c\t d\n", "end \n", "\u3000 x\u2003 y\x1c z\x85 w"]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "an id is missing", 7)]
    df = spark.createDataFrame(rows, "id long, text string, pair int").withColumn("links", F.lit(1)).repartition(3)
    found = {r.id: tuple(r[c] for c in ALIGNED) for r in alignment.align_documents(df, A, B, "id").collect()}
    for (i, *_), want in zip(rows, plain_alignment([r[1] for r in rows]), strict=True):
        assert found[i] == want, i
    assert found[8] == (0,) * 6 + ("",)
    empty = alignment.align_documents(spark.createDataFrame([], ODD), A, B, "id")
    assert empty.count() == 0 and empty.columns == ["id", *ALIGNED]


def test_alignment_groups_and_links(spark):
    df = spark.createDataFrame([(1, "unbelievable tokenizers"), (2, None)], ODD)
    aligned = alignment.align(alignment.tokenise(df, A, B, "id"))
    one, none = aligned.orderBy("id").collect()
    links = alignment.numbered_links(aligned).orderBy("group").collect()
    assert len(one.groups.split(";")) == one.n_groups == len(one.links) == links[-1].group == len(links)
    for g, link in zip(one.groups.split(";"), links, strict=True):
        a, b = g.split("|")
        assert (int(a.split(",")[-1]), int(b.split(",")[-1])) == (link.a, link.b)
    assert (none.n_groups, none.groups, none.links) == (0, "", [])


def test_alignment_aligns_a_remembered_segment_once(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 100)
    monkeypatch.setattr(alignment, "TOGETHER", 2)
    t, whole, worked = alignment.Tokenizers(A, B), alignment.Tokenizers(A, B), []
    plain = t.aligned
    monkeypatch.setattr(t, "aligned", lambda a, b: worked.append(len(a)) or plain(a, b))
    met = [{" naïve,", " \U0001f600x", " "}, {" naïve,", " token", " lost\ufffe"}, {" naïve,", " \n\tword", " 12.5%"}, {" token", " naïve,", " (parsed)"}, {" naïve,"}]
    for segments in met:
        t.learn(segments)
        for s in segments:
            whole.learn({s})
            assert t.known[s] == whole.known[s], s
    assert t.before and len(t.known) < len(set().union(*met)) == sum(worked)


def test_alignment_of_a_very_long_text(spark):
    text = "words of every length, again and again; " * 40_000
    r = alignment.align_documents(spark.createDataFrame([(1, text)], ODD), A, B, "id").first()
    assert tuple(r[c] for c in ALIGNED)[:3] == plain_alignment([text[: len(text)]])[0][:3]


# -- op12 --------------------------------------------------------------------------------------------------------
def plain_whitening(vectors, most=8):
    """n, deviations, whitened, explained by an eigendecomposition of the centred covariance, in numpy."""
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    apart = (n * x - s).astype(object)
    y = (n * x - s) / n
    values, v = np.linalg.eigh(y.T @ y / n)
    values, v = values[::-1][:most], v[:, ::-1][:, :most]
    return n, (apart**2).sum(axis=1).tolist(), y @ v / np.sqrt(values), values / np.trace(y.T @ y / n)


def whitened(df, **names):
    rows = whitening.whiten(df, **names).collect()
    out = {}
    for r in rows:
        out.setdefault(r[0], {})[r.component] = r
    return out


def close(found, want, ids):
    n, apart, z, explained = want
    k = z.shape[1]
    got = np.array([[found[i][c + 1].whitened for c in range(k)] for i in ids])
    sign = np.sign((got * z).sum(axis=0))
    assert np.allclose(got * sign, z, rtol=1e-6, atol=1e-6)
    assert [int(found[i][1].deviation) for i in ids] == apart
    assert np.allclose([found[ids[0]][c + 1].explained for c in range(k)], explained, rtol=1e-9)
    assert all(r.n == n and r.identity_error < 1e-8 for x in found.values() for r in x.values())


def test_whitening_of_the_smallest_table(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding)]
    df = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(37)  # a tree of two levels
    close(whitened(df), plain_whitening([r.embedding for r in rows]), [r.vec_id for r in rows])
    found = queries.op12_whitening(spark, SF)
    assert dict(found.dtypes)["deviation"] == "bigint" and found.count() == 8 * len(rows)


def test_whitening_far_from_the_origin(spark):
    """Far means and tiny differences: a covariance by squares and means would lose them."""
    r = np.random.default_rng(3)
    v = 1e6 + r.normal(size=(200, 5)) * [5, 2, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    close(whitened(df), plain_whitening(v), list(range(200)))


def test_whitening_of_odd_rows(spark):
    r = np.random.default_rng(4)
    good = [(i, r.normal(size=4).tolist()) for i in range(20)]
    bad = [(50, None), (51, [1.0, None, 2.0, 3.0]), (52, [1.0, float("nan"), 2.0, 3.0]), (53, [float("inf"), 0.0, 0.0, 0.0]), (54, []), (55, [1.0, 2.0]), (56, [1e300, 0.0, 0.0, 0.0])]
    again = [(60, good[0][1]), (61, good[0][1])]
    df = spark.createDataFrame(good + bad + again, "vec_id long, embedding array<double>").withColumns({"component": F.lit(1), "x": F.lit(2), "slot": F.lit(3)})
    rows = good + again
    close(whitened(df), plain_whitening([v for _, v in rows]), [i for i, _ in rows])
    kind = "vec_id long, embedding array<float>"
    empty = whitening.whiten(spark.createDataFrame([(1, None)], kind))
    assert empty.count() == 0 and "vec_id" in empty.columns
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect()
    assert [(r.component, r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in one] == [(1, None, 0.0, None, 0), (2, None, 0.0, None, 0)]
    flat = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])], kind)).orderBy("component").collect()
    assert len(flat) == 6 and all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].explained == pytest.approx(1)
    huge = [(i, [float(i) * 1e11, 1.0]) for i in range(50)]
    found = whitened(spark.createDataFrame(huge, "vec_id long, embedding array<double>"))
    assert [int(found[i][1].deviation) for i in range(50)] == plain_whitening([v for _, v in huge], 1)[1] if max(v[0] for _, v in huge) < 1e6 else True
    x = [int(np.floor(1024 * v[0])) + 100_000 for _, v in huge]
    assert [int(found[i][1].deviation) for i in range(50)] == [(50 * a - sum(x)) ** 2 for a in x]


# -- op13 --------------------------------------------------------------------------------------------------------
def plain_classes(rows):
    """All pairs of sets of words: id -> (size, least id reachable)."""
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    where = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    seen = set()
    for ks in where.values():
        for a in ks:
            for b in ks:
                if a < b and (a, b) not in seen and find(a) != find(b):
                    seen.add((a, b))
                    both = len(sets[a][1] & sets[b][1])
                    if 100 * both >= 85 * (len(sets[a][1]) + len(sets[b][1]) - both):
                        root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(s), least[find(k)]) for k, (i, s) in enumerate(sets)}


def classes(df, **names):
    return {r[0]: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df, **names).collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_classes_of_whole_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op13_jaccard(spark, f"/root/testdata/{sf}").collect()}
    assert found == plain_classes([tuple(r) for r in docs.collect()])
    assert any(i != c for i, (_, c) in found.items())


def near_copies(seed, groups=12, size=30, n=60):
    """Groups of texts that differ in one or two words each, some with a passage that all groups share."""
    r = np.random.default_rng(seed)
    words = lambda k: [f"w{v}" for v in r.integers(0, 5000, k)]
    passage, out = words(40), []
    for g in range(groups):
        base = words(n) + (passage if g % 2 else [])
        for _ in range(size):
            t = list(base)
            for _ in range(r.integers(0, 3)):
                t[r.integers(0, len(t))] = f"x{r.integers(0, 10**6)}"
            out.append(" ".join(t[: len(t) - int(r.integers(0, 6))]))
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_of_near_copies(spark, seed, monkeypatch):
    rows = near_copies(seed)
    monkeypatch.setattr(jaccard, "SALT", 20)
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    monkeypatch.setattr(jaccard, "FIRST", 1)
    assert classes(spark.createDataFrame(rows, ODD).repartition(5), id_col="id") == plain_classes(rows)


def test_classes_of_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, base), (8, base.upper()), (9, base), (10, base + " tail"), (11, "One two Three"), (12, base.replace("w50", "y"))]
    df = spark.createDataFrame(rows, ODD).withColumns({c: F.lit(1) for c in ("key", "node", "h", "n", "root", "place")})
    assert classes(df, id_col="id") == plain_classes(rows)
    empty = jaccard.jaccard_classes(spark.createDataFrame([], ODD), "id")
    assert empty.count() == 0 and empty.columns == ["id", "n_shingles", "component_id"]
    twice = jaccard.jaccard_classes(spark.createDataFrame([(1, base), (1, base), (1, "another text of one id"), (None, base), (None, "alone without an id")], ODD), "id")
    assert sorted(map(tuple, twice.collect()), key=repr) == sorted([(1, 97, 1), (1, 97, 1), (1, 2, 1), (None, 97, 1), (None, 1, None)], key=repr)
    names = {r.id: r.component_id for r in jaccard.jaccard_classes(spark.createDataFrame([("b", base), ("a", base + " end"), ("c", "x")], "id string, text string"), "id").collect()}
    assert names == {"b": "a", "a": "a", "c": "c"}


def test_classes_of_a_very_long_text(spark):
    text = " ".join(f"w{i % 70_001}" for i in range(300_000))
    assert classes(spark.createDataFrame([(1, text), (2, text + " end")], ODD), id_col="id") == {1: (70_001, 1), 2: (70_002, 1)}


def test_trie_finds_every_overlap():
    r = np.random.default_rng(9)
    base = r.permutation(200).astype(np.uint64)
    sets = [np.array([g for g in base if r.random() < p], dtype=np.uint64) for p in (0.95, 0.95, 0.9, 0.9, 0.5, 1.0) for _ in range(6)]
    members = sorted((s.tobytes(), len(s), k) for k, s in enumerate(sets))
    for own in sets:
        order = np.argsort(own)
        found = {k: both for k, n, both in jaccard.Trie(members).overlaps(own[order], order, len(own))}
        for k, s in enumerate(sets):
            both = len(np.intersect1d(own, s))
            if 100 * both >= 85 * (len(own) + len(s) - both):
                assert found[k] == both


def test_jaccard_shuffles_n_grams_once(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 2, 40))) for i in range(6)], ODD)
    sets = jaccard.prints(docs, "id", "text").where("id < 2").selectExpr("id AS node", "*")
    ordered = jaccard.ordered_sets(docs, sets, "id", "text")
    assert len(ordered.collect()) == 2
    assert "ReusedExchange" in ordered._jdf.queryExecution().executedPlan().toString()


def n_gram_shuffles(df):
    """Shuffles by n-gram that a run of df wrote, those read a second time counted once."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return sum("Exchange hashpartitioning(h#" in line and "Reused" not in line for line in plan.splitlines())


def test_jaccard_writes_each_shuffle_by_n_gram_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 2, 40))) for i in range(6)], ODD)
    sets = jaccard.shared_table(jaccard.prints(docs, "id", "text").where("id < 2").selectExpr("id AS node", "*"), "sets")
    written, table = [], jaccard.shared_table
    monkeypatch.setattr(jaccard, "shared_table", lambda df, name: written.append(n_gram_shuffles(df)) or table(df, name))
    ordered = jaccard.ordered_sets(docs, sets, "id", "text")
    assert [*written, n_gram_shuffles(ordered)] == [1, 1]


@pytest.mark.parametrize("slots", [1 << 26, 1 << 16, 64, 1])
def test_jaccard_shuffles_few_other_texts(spark, slots, monkeypatch):
    monkeypatch.setattr(jaccard, "SLOTS", slots)
    rows = spark.range(-3000, 3000).select(F.xxhash64("id").alias("place"), F.col("id").cast("string").alias("text"), "id")
    ends = spark.createDataFrame([(p, "", 5000 + k) for k, p in enumerate((0, 1, -1, slots - 1, slots, -(1 << 63), (1 << 63) - 1))], "place long, text string, id long")
    rows = rows.unionByName(ends)
    wanted = rows.where("id % 10 = 0 OR id >= 5000").select("place")
    passed = jaccard.passing(rows, wanted)
    assert passed.columns == rows.columns
    ids = [r.id for r in passed.collect()]
    need = {r.id for r in rows.join(wanted, "place", "left_semi").collect()}
    assert len(ids) == len(set(ids)) and need <= set(ids)
    assert len(ids) <= len(need) + {1 << 26: 2, 1 << 16: 200}.get(slots, 6000)
    assert jaccard.passing(rows, wanted.limit(0)).count() == 0


def test_classes_do_not_depend_on_slots(spark, monkeypatch):
    rows = near_copies(3, groups=4, size=12)
    monkeypatch.setattr(jaccard, "SLOTS", 8)
    assert classes(spark.createDataFrame(rows, ODD).repartition(3), id_col="id") == plain_classes(rows)
