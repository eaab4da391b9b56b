"""Small fixtures for each operator: nulls, empties, repeated rows, empty tables, clashing columns, and brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from episodica.llm import audio, bpe, chat, classifier, language, licences, minhash, mixing, rules, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, words=None):
    words = words or [f"w{i}" for i in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base, passage = prose(rng, 120), prose(rng, 60)
    texts = [base, base, base.replace(base.split()[60], "changed", 1), None, "", " \n\t", "one", "ONE", "one two three four", passage + " " + prose(rng, 80), prose(rng, 90) + " " + passage, "the the the " * 40, prose(rng, 3000), "éè \U0001f600 <|endoftext|> x", "42 !!", "line\nline\nline\nother"]
    texts += [prose(rng, 30 + i) for i in range(40)]
    out = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return out + [out[9], (None, "a row without an id " + passage, "en", "a", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clash(docs):
    """The same rows with columns named like results."""
    return docs.withColumns({c: F.lit("x") for c in ("size", "kept", "score", "n_words", "component_id", "target", "held_out", "ids", "id", "k1", "t")})


def collect(df, by="doc_id"):
    return sorted(map(tuple, df.collect()), key=repr)


OPERATORS = {
    "near": minhash.near_duplicates,
    "bpe": lambda d: bpe.encode_documents(d, public_tokenizers.path("byte_bpe_50k.json")),
    "licences": licences.scan,
    "mixing": mixing.mix_sources,
    "substrings": substrings.remove_repeats,
    "language": lambda d: language.identify(d, language.learn(d)),
    "rules": rules.quality,
    "audio": audio.media_columns,
    "quality": lambda d: classifier.score(d, None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_clashes_and_row_counts(name, docs, clash, rows):
    op = OPERATORS[name]
    assert op(docs.limit(0)).count() == 0
    plain = op(docs)
    assert plain.count() == len(rows)
    assert collect(plain) == collect(op(clash))


def shingle_set(text):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates_against_all_pairs(docs, rows):
    sets = {r[0]: shingle_set(r[1]) for r in rows if r[0] is not None}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = minhash.near_duplicates(docs).where("doc_id IS NOT NULL").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def classes(sets):
    """The least id that each can reach over links, by all pairs."""
    root = {i: i for i in sets}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for a in sorted(sets):
        met = Counter(b for x in sets[a] for b in holders[x] if b > a)
        for b, n in met.items():
            if root[a] != root[b] and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def close_copies(n=150, length=200, edits=9, seed=8):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(length)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(1, edits)):
            words[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("stars", "salt"), [(32, 500), (1, 7)])
def test_near_duplicates_many_close_copies(spark, stars, salt, monkeypatch):
    monkeypatch.setattr(minhash, "STARS", stars)
    monkeypatch.setattr(minhash, "SALT", salt)
    rows = close_copies()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == classes({i: shingle_set(t) for i, t in rows})


def test_near_duplicates_with_ids_of_other_types(spark):
    rows = [*close_copies(40, 120, 14), (None, "no id " * 9), (90, None)]
    whole = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    named = minhash.near_duplicates(spark.createDataFrame([(None if i is None else f"d{i:03}", t) for i, t in rows], "doc_id string, text string")).collect()
    name = lambda i: None if i is None else f"d{i:03}"
    assert Counter((name(r.doc_id), r.n_shingles, name(r.component_id), r.kept) for r in whole) == Counter(map(tuple, named))


def test_near_duplicates_of_the_given_documents(spark):
    """Recall over whole tables: every class of the 1,000 documents at scale 0.01 by all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == classes({r.doc_id: shingle_set(r.text) for r in docs.collect()})


def test_densified_bins_agree_as_the_sets_do():
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(60):
        x = rng.integers(0, 2**63, size=40).astype(np.uint64)
        a, b = np.sort(x[:35]), np.sort(x[5:])  # 30 of 40 in common
        agree.append((minhash.signature(a) == minhash.signature(b)).mean())
    assert abs(np.mean(agree) - 0.75) < 0.04


@pytest.mark.parametrize(("split", "bucket", "at_once"), [(1000, 500_000, 100_000), (0, 500_000, 50), (0, 2, 100_000), (3, 0, 50)])
def test_substrings_against_all_windows(docs, rows, split, bucket, at_once, monkeypatch):
    for name, value in (("SPLIT", split), ("BUCKET", bucket), ("AT_ONCE", at_once)):
        monkeypatch.setattr(substrings, name, value)
    words = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(rows, words, strict=True):
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[(r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert Counter(map(tuple, substrings.remove_repeats(docs).collect())) == want


def test_bpe_equals_the_library(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).where("doc_id IS NOT NULL").collect():
        ids = t.encode(rows[r["doc_id"]][1] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_and_long_texts(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, c, rng = Tokenizer.from_file(path), bpe.Codec(path), random.Random(5)
    pool = [chr(i) for i in range(0x3000)] + [" ", "\n", "<|endoftext|>", "'s", "\x85", "֋'", "a", "the", " the", "\U0001f600", "1"] * 50
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(500)] + ["ab" * 4000, " " * 900 + "x", ""]
    monkeypatch.setattr(bpe, "CHUNK_TOKENS", 7)
    for text, (ids, said) in zip(texts, c.encode_many(texts), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype=np.int32).tolist() == want and said == ",".join(map(str, want))
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 20)
    for text in texts:
        assert np.frombuffer(c.encode_long(text)[0], dtype=np.int32).tolist() == t.encode(text, add_special_tokens=False).ids


def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "<|", "", "a\nb", "tail<", None]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "we\\ird\nrole<|", None) for t in odd)]
    rows += [(2, None, "assistant", "b"), (2, None, "assistant", "b"), (2, 0, "user", "a"), (None, 0, "user", "n")]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))).collect()}
    for conv in (1, 2, None):
        mine = sorted(((r[1] is None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()) for r in rows if r[0] == conv))
        turns = [(r.decode(), t.decode()) for _, _, r, t in mine]
        said = "".join(t for r, t in turns if r == "assistant")
        assert out[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (out[conv]["n_turns"], out[conv]["loss_chars"]) == (len(turns), len(said))
        assert out[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        whole = "".join(chat.render(r, t) for r, t in turns)
        assert [x[:2] for x in chat.parse(whole)] == turns and out[conv]["formatted_chars"] == len(whole)
    assert chat.parse("<|im_start|>user\nx") is None


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 60)), rng.choice(["a"] * 6 + ["b", "c", "d", None])) for i in range(3000)]
    rows += [(5000, "tiny", "z"), (5000, "tiny", "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = collect(mixing.mix_sources(d)), collect(mixing.mix_sources(d.repartition(7)))
    assert first == again
    by = {}
    for _, source, size, source_size, target, copies in first:
        x = by.setdefault(source, [source_size, target, 0])
        x[2] += size * copies
        assert 0 <= copies <= 3
    total = sum(x[0] for x in by.values())
    assert abs(sum(x[1] for x in by.values()) - total) < 1e-6
    weights, order = {}, sorted((s for s in by if s), key=str.encode)
    for i, s in enumerate([*order, None]):
        weights[s] = (5, 2, 1)[i % 3]
    free, left, want = set(by), total, {}
    while free:  # the contract's own loop
        level = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if level[s] > 3 * by[s][0]}
        want |= {s: 3 * by[s][0] for s in over} if over else level
        left -= sum(3 * by[s][0] for s in over)
        free = free - over if over else set()
    for s, (_, target, taken) in by.items():
        assert abs(target - want[s]) < 1e-6 and abs(taken - target) <= 60


def test_mixing_takes_copies(docs):
    decisions = mixing.mix_sources(docs).cache()
    taken = mixing.take(docs, decisions)
    assert taken.columns == docs.columns and taken.count() == decisions.agg(F.sum("copies")).first()[0]


def test_language_spans(spark):
    rng, langs = random.Random(1), {"en": "the of and is was with that".split(), "de": "der die und ist für nicht über".split(), "ru": "это как не что был".split()}
    rows = [(i, prose(rng, 40, langs[x]), x) for i, x in enumerate(rng.choice(list(langs)) for _ in range(300))]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = prose(rng, 30, langs["en"]) + " " + prose(rng, 50, langs["de"])
    test = spark.createDataFrame([(1, mixed), (2, "12 ... !"), (3, None), (4, "это что"), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identify(test, model).collect()}
    assert got[1]["lang_pred"] == "de" and [(s["lang"], s["start"], s["stop"]) for s in got[1]["spans"]] == [("en", 0, 30), ("de", 30, 80)]
    assert [got[i]["lang_pred"] for i in (2, 3, 4, 5)] == ["und", "und", "ru", "und"] and 0.5 < got[1]["score"] < 1


def test_language_of_unlike_texts(spark):
    rng, langs = random.Random(4), {"en": "the of and is was with that".split(), "zh": ["我们的语言", "这是一个", "不是他们"]}
    rows = [(i, prose(rng, 40, langs[x]), x) for i, x in enumerate(rng.choice(list(langs)) for _ in range(300))]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = [(1, "это что как не был"), (2, "zxqj qqkz vvxw " * 20), (3, "这是我们的the language of that这是一个"), (4, "ª"), (5, "、。！")]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(test, "doc_id long, text string"), model).collect()}
    assert got[1]["lang_pred"] in langs and got[2]["lang_pred"] in langs and got[4]["lang_pred"] in langs and got[5]["lang_pred"] == "und"
    assert (got[1]["score"], got[2]["score"], got[1]["spans"], got[2]["spans"]) == (0, 0, [], [])
    assert [(s["lang"], s["start"], s["stop"]) for s in got[3]["spans"]] == [("zh", 0, 5), ("en", 5, 9), ("zh", 9, 13)]


def test_viterbi_against_all_paths():
    import itertools

    model = language.Model(["a", "b"], np.zeros((2, 2), np.float32), np.ones((1, 2), bool))
    s = language.Scorer(model)
    s.scores = np.random.default_rng(4).normal(0, 9, size=(40, 2)).astype(np.float32)
    rows = [np.arange(7), np.arange(7, 9), np.arange(20, 28), np.array([30])]
    for r, path in zip(rows, s.paths(rows), strict=True):
        value = lambda p, r=r: s.scores[r, list(p)].sum() - language.SWITCH * sum(x != y for x, y in zip(p, p[1:], strict=False))
        assert abs(value(path) - max(map(value, itertools.product((0, 1), repeat=len(r))))) < 1e-3


def test_field_learns_and_holds_out(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join("".join(rng.choice("#$%&") for _ in range(30)) if i % 3 == 0 else prose(rng, 12) for _ in range(4)), int(i % 3 != 0)) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    field = classifier.train(d.drop("quality"), d.select("doc_id", "quality"), sample=150)
    got = classifier.score(d.drop("quality"), field).join(d, "doc_id").where("held_out").collect()
    assert len(got) > 30 and all(r["predicted"] == r["quality"] for r in got)
    empty = classifier.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), field).collect()
    assert all(0 <= r["score"] <= 1 for r in empty)
    assert classifier.train(d, d.select("doc_id", "quality").limit(0)) is None


def test_chain_against_all_labelings():
    import itertools

    rng = np.random.default_rng(3)
    e, move = rng.normal(size=6), rng.normal(size=(2, 2))
    n = np.array([2, 4])
    f, b = classifier.chain(e, classifier._steps(n)[2], move)
    for a, m in ((0, 2), (2, 4)):
        weights = {y: np.exp(sum(e[a + i] * v for i, v in enumerate(y)) + sum(move[x, z] for x, z in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=m)}
        for i in range(m):
            want = sum(w for y, w in weights.items() if y[i]) / sum(weights.values())
            assert abs(1 / (1 + np.exp(-(f + b)[a + i])) - want) < 1e-9


def test_rules_against_python(docs, rows):
    for r in rules.quality(docs).where("doc_id IS NOT NULL").collect():
        text = rows[r["doc_id"]][1] or ""
        w = WORD.findall(text)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_licences(spark):
    apache = "Licensed under the Apache License, Version 2.0. Released under the MIT License.\nAll rights reserved."
    d = spark.createDataFrame([(1, apache), (2, "no licence here"), (3, None), (4, "x\n  RELEASED under the   MIT license!")], "doc_id long, text string")
    got = {r["doc_id"]: (r["licence"], r["licences"], r["n_known"]) for r in licences.scan(d).collect()}
    assert got == {1: ("Apache-2.0", "Apache-2.0,MIT", 3), 2: (None, "", 0), 3: (None, "", 0), 4: ("MIT", "MIT", 1)}


def test_licences_wrapped_over_lines(spark):
    import textwrap

    full = lambda *names: " ".join(licences.SENTENCES[n][-1] + "." for n in names)
    wrap = lambda t, mark: "\n".join(mark + x for x in textwrap.wrap(t, 50))
    want = {"MIT": ["mit_grant", "mit_notice"], "GPL-3.0-or-later": ["gpl_free", "gpl_hope"], "BSD-2-Clause": ["bsd_grant", "bsd_warranty"], "BSD-3-Clause": ["bsd_grant", "bsd_endorse", "bsd_warranty"], "MPL-2.0": ["mpl2_name"], "Apache-2.0": ["apache2_name", "apache2_copy", "apache2_as_is"]}
    licence = {k: " ".join(licences.SENTENCES[n][0 if n == "mpl2_name" else -1] + "." for n in v) for k, v in want.items()}
    cases = [(k, ",".join(v), f"int x;\n\n{wrap(licence[k], mark)}\n{mark}\n{mark}more text") for k, v in want.items() for mark in ("", "# ", " * ", "// ", "; ", "-- ")]
    cases += [(None, "", t) for t in ("2.0", "Version: 2.0", "see\n2.0\nthere", "Apache License, v. 2.0", "you can redistribute it", full("gpl_hope").split("; ")[1], "the MIT License is short")]
    tag = "SPDX-License-Identifier: "
    cases += [("Apache-2.0", "tag_Apache-2.0", f"/* {tag}Apache-2.0 */\nint x;"), ("GPL-2.0-or-later", "tag_GPL-2.0-or-later", f"# {tag}GPL-2.0-or-later\n"), ("MIT", "tag_MIT,tag_ISC", f"{tag}MIT OR ISC"), (None, "", "MIT"), (None, "", "ISC\nApache-2.0")]
    more = {"GPL-2.0-or-later": ["gpl2_free"], "LGPL-2.1-or-later": ["lgpl21_free"], "LGPL-3.0-or-later": ["lgpl3_free"], "AGPL-3.0-or-later": ["agpl3_free"], "ISC": ["isc_grant"], "BSL-1.0": ["bsl_grant"], "Zlib": ["zlib_as_is", "zlib_grant"], "Unlicense": ["unlicense"]}
    cases += [(k, ",".join(v), f"x\n\n{wrap(full(*v), mark)}\n\ny") for k, v in more.items() for mark in ("", " * ", "// ")]
    cases += [("MIT", "mit_name", "a line\nMIT License\nanother line"), ("Apache-2.0", "apache2_name", "Licensed under the Apache License,\r\nVersion 2.0\r\n")]
    d = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: (r["licence"], r["sentence_ids"]) for r in licences.scan(d).collect()}
    assert got == {i: (name, ids) for i, (name, ids, _) in enumerate(cases)}


def test_licences_of_other_holders_titles_and_tags(spark):
    """Written out, not from the operator's tables."""
    grant = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce it.\n"
    third = "3. Neither the name of Foo Bar University nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    end = '\nTHIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS "AS IS" AND\nANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE\nARE DISCLAIMED. IN NO EVENT SHALL ANYBODY BE LIABLE.\n'
    owner = "Copyright (c) 2020, Foo Bar University. All rights reserved.\n"
    tag = "// SPDX-License-Identifier: "
    cases = [
        ("LicenseRef-BSD", "Copyright 2010 The Authors. All rights reserved.\nUse of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
        ("LicenseRef-BSD", owner + "Use of this source code is governed by a BSD-style license"),
        ("BSD-3-Clause", owner + grant + third + end),
        ("BSD-3-Clause", grant + "3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission." + end),
        ("BSD-2-Clause", owner + grant + end),
        ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS"),
        ("GPL-3.0-only", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone may copy it."),
        ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n"),
        ("LGPL-3.0-only", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n"),
        ("LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n"),
        ("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n"),
        ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions"),
        ("EPL-2.0", "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM"),
        ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n"),
        ("CC0-1.0", "Creative Commons Legal Code\n\nCC0 1.0 Universal\n"),
        ("MIT", tag + "MIT OR Apache-2.0\nint x;"), ("GPL-2.0-only", tag + "GPL-2.0\n"), ("GPL-2.0-or-later", tag + "GPL-2.0+\n"), ("MIT", tag + "(MIT AND GPL-3.0-or-later)\n"),
        (None, tag + "Apache-2.0 WITH LLVM-exception\n"),
        ("MIT", "released under the MIT license, see LICENSE"), ("MIT", "This project is licensed under the terms of the MIT license."), ("Apache-2.0", "The code is distributed under the Apache License 2.0; see NOTICE."),
        (None, "It is not released under the MIT License for now."), (None, "All rights reserved. See the license agreement."), ("proprietary", owner), ("proprietary", "Any text. All rights reserved."),
    ]
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licences.scan(d).collect()}
    assert [(found[i]["licence"], t) for i, (_, t) in enumerate(cases)] == cases
    both = [found[i]["licences"] for i, (_, t) in enumerate(cases) if " OR " in t and t.startswith(tag) or " AND " in t and t.startswith(tag)]
    assert both == ["MIT,Apache-2.0", "MIT,GPL-3.0-or-later"]


def test_audio(docs, rows):
    import zlib

    for r in audio.media_columns(docs, with_media=True).where("doc_id IS NOT NULL").collect():
        raw = (rows[r["doc_id"]][1] or "").encode()
        padded = raw + bytes(-len(raw) % 64) or bytes(64)
        assert audio.samples(bytes(r["media"])) == padded and len(r["tensor"]) == audio.BINS * audio.MELS
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        assert r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()


def test_audio_pieces_make_no_difference(monkeypatch):
    raw = random.Random(9).randbytes(64 * 700)
    whole = audio.log_mel(raw)
    monkeypatch.setattr(audio, "PIECE", 1 << 12)
    assert np.allclose(audio.log_mel(raw), whole, atol=1e-4) and len(whole) == (len(raw) // 2 - audio.FRAME) // audio.HOP + 1


def test_audio_ends_stand_in_a_frame():
    hop = audio.HOP * audio.DOWN
    for n in (64 * 9, 64 * 10, 64 * 11, 64 * 12, 64 * 13):
        quiet = bytes([128]) * (n - 64)
        assert len(audio.log_mel(quiet + bytes(64))) == max(1, -(-(n - audio.FRAME * audio.DOWN) // hop) + 1)
        assert not np.allclose(audio.log_mel(quiet + bytes(64))[-1], audio.log_mel(quiet + bytes([128]) * 64)[-1])


def test_audio_tensors_are_stored_with_their_shape(spark, docs, tmp_path):
    import pyarrow as pa

    media, path = audio.media_columns(docs), str(tmp_path / "tensors")
    audio.tensor_blocks(media).write.parquet(path)
    blocks = spark.read.parquet(path)
    assert collect(audio.read_tensors(blocks)) == collect(media.select("doc_id", "tensor", "spans"))
    found = blocks.collect()
    assert sum(b.n_rows for b in found) == docs.count()
    for b in found:
        part = pa.ipc.open_stream(bytes(b.block)).read_all()
        assert part.column("tensor").chunk(0).to_numpy_ndarray().shape == (b.n_rows, audio.BINS, audio.MELS)
    assert audio.tensor_blocks(media.where("false")).count() == 0


def test_mixing_of_documents_without_ids(spark):
    """Texts that differ are units of their own though no row has an id: the source's copies hold its target up to half a document."""
    rows = [(None, f"text {i} of ten words that is all there is", "a") for i in range(300)] + [(i, "a longer text of another source " * 20, "b") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.decide(d, share=0.5).cache()
    taken = {r.source: (r.taken, r.target) for r in out.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()}
    assert abs(taken["a"][0] - taken["a"][1]) <= 10 and out.where("source = 'a'").select("copies").distinct().count() > 1
    assert mixing.take(d, out).where("source = 'a'").count() == out.where("source = 'a'").agg(F.sum("copies")).first()[0]
