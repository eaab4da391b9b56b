"""Whole queries that SQL can't express, against plain versions of their methods, over all documents of the smallest tables."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.llm import audio, classifier, language, mixing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def plain_mel(payload):
    """One convolution over the whole file, every second value, windows one by one, a table of cosines and sines."""
    n = np.arange(32) - 15.5
    low = np.sinc(n / 2) / 2 * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(32) / 31))
    x = np.concatenate([np.zeros(30), (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128])
    y = np.convolve(x, low[::-1] / low.sum(), "valid")[::2]
    frames = max(1, math.ceil((len(y) - 256) / 128) + 1)
    y = np.concatenate([y, np.zeros((frames - 1) * 128 + 256 - len(y))])
    angle = 2 * np.pi * np.outer(np.arange(256), np.arange(129)) / 256
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 255)
    top = 2595 * math.log10(1 + 2000 / 700)
    edge = [700 * (10 ** (top * i / 25 / 2595) - 1) for i in range(26)]
    f = np.arange(129) * 4000 / 256
    bank = np.array([[max(0, min((v - edge[m]) / (edge[m + 1] - edge[m]), (edge[m + 2] - v) / (edge[m + 2] - edge[m + 1]))) for m in range(24)] for v in f])
    out = []
    for k in range(frames):
        cut = y[k * 128 : k * 128 + 256] * window
        out.append(np.log(((cut @ np.cos(angle)) ** 2 + (cut @ np.sin(angle)) ** 2) @ bank + 1e-6))
    return np.array(out)


def plain_segments(level, on=1.0, off=-1.0):
    spans, begun = [], None
    for i, v in enumerate([*level, -math.inf]):
        if begun is None and v > on:
            begun = i
        elif begun is not None and v < off:
            spans.append((begun, i))
            begun = None
    return spans


def test_op10_against_a_plain_version(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = {r.doc_id: r for r in audio.media_columns(docs).collect()}
    found = queries.op10_audio(spark, SF).collect()
    assert len(found) == len(texts)
    unsure = 0
    for r in found:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64) or bytes(64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = audio.wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and media[44:] == payload
        mel, m = plain_mel(payload), made[r.doc_id]
        bins = [mel[i * len(mel) // 16 : max((i + 1) * len(mel) // 16, i * len(mel) // 16 + 1)].mean(axis=0) for i in range(16)]
        assert m.n_frames == len(mel) and np.allclose(np.reshape(m.tensor, (16, 24)), bins, atol=2e-3)
        level = 10 * np.log10(np.exp(mel).sum(axis=1))
        level -= level.mean()
        if min(np.abs(np.abs(level) - 1)) < 1e-3:
            unsure += 1  # a frame stands at a threshold, where single precision may decide otherwise
        else:
            assert [(s.start, s.stop) for s in m.spans] == [(round(a * 0.032, 3), round(b * 0.032, 3)) for a, b in plain_segments(level)]
        code = zlib.crc32(np.round(np.array(m.tensor, np.float32) * 8).astype("<i2").tobytes())
        assert r.feature == f"frames={m.n_frames};segments={len(m.spans)};voiced={sum(s.stop - s.start for s in m.spans):.3f};mel={code:08x}"
    assert unsure < len(found) / 4


def plain_features(text):
    """Line by line, sign by sign."""
    lines = text.encode().split(b"\n")
    own = []
    for i, line in enumerate(lines):
        words, n = line.split(), max(1, len(line))
        share = lambda signs: sum(b in signs for b in line) / n  # noqa: B023, E731
        own.append([
            math.log1p(len(words)), math.log1p(len(line)), math.log1p(len(line) / len(words)) if words else 0, share(b"#*$%&|<>@~^=+_\\{}[]/"), share(b"0123456789"), share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b".,;:!?"),
            sum(b >= 128 for b in line) / n, len(set(words)) / len(words) if words else 1, sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words) if words else 0,
            float(bool(words) and line in lines[:i]), float(not words), math.log(len(lines)),
        ])
    none = [0.0] * len(own[0])
    return np.array([own[i] + (own[i - 1] if i else none) + (own[i + 1] if i + 1 < len(own) else none) for i in range(len(own))]), [len(x) + 1 for x in lines]


def plain_score(text, field):
    """Forward and backward by sums of probabilities, scaled at each line."""
    x, size = plain_features(text)
    e = np.clip((x - field.mean) / field.scale, -8, 8) @ field.weights[:-1] + field.weights[-1]
    step = np.exp(field.move)
    here = [np.array([1.0, math.exp(v)]) / (1 + math.exp(v)) for v in e]
    ahead, behind = [here[0]], [np.ones(2)]
    for h in here[1:]:
        a = (ahead[-1] @ step) * h
        ahead.append(a / a.sum())
    for h in here[:0:-1]:
        b = step @ (h * behind[-1])
        behind.append(b / b.sum())
    good = [(a * b)[1] / (a * b).sum() for a, b in zip(ahead, behind[::-1], strict=True)]
    return sum(g * s for g, s in zip(good, size, strict=True)) / sum(size)


def test_op5_against_a_plain_version(spark, texts):
    field = classifier.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    found = queries.op5_quality(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        want = plain_score(texts[r.doc_id], field)
        assert abs(r.score - want) < 1e-4 and r.held_out == is_held_out(r.doc_id) and r.predicted == int(r.score >= 0.3)


def test_op8_against_a_plain_version(spark, texts):
    """Best paths word by word, then the share of letters of spans that read like their language."""
    model = language.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    scorer, found = language.Scorer(model), queries.op8_language(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r.doc_id]
        words = language.words_of(text)
        assert r.held_out == is_held_out(r.doc_id)
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        at = scorer.rows([words])[0]
        score, used, letters = scorer.scores[at].tolist(), scorer.used[at].tolist(), scorer.letters[at].tolist()
        n = len(model.langs)
        value, back = list(score[0]), []
        for s in score[1:]:
            best = max(range(n), key=lambda j: (value[j], -j))  # noqa: B023
            back.append([best if value[best] - language.SWITCH > value[j] else j for j in range(n)])
            value = [max(value[j], value[best] - language.SWITCH) + s[j] for j in range(n)]
        path = [max(range(n), key=lambda j: (value[j], -j))]
        for b in back[::-1]:
            path.append(b[path[-1]])
        path.reverse()
        sums, cut = [0] * n, [0, *(i for i in range(1, len(path)) if path[i] != path[i - 1]), len(path)]
        for a, b in zip(cut, cut[1:], strict=False):
            lang, size = path[a], sum(used[a:b])
            likely = sum(score[i][lang] for i in range(a, b) if used[i])
            if likely + language.BENEFIT * model.usual[lang] >= model.least[lang] * (size + language.BENEFIT):
                sums[lang] += size
        best = max(range(n), key=lambda j: (sums[j], -j))
        assert abs(r.score - sums[best] / sum(letters)) < 1e-6 and (not sums[best] or r.lang_pred == model.langs[best]) and r.lang_pred in model.langs


def test_pivotal_steps_keep_mass_and_odds(spark):
    """20,000 pairs of the same two units under different ids: one is settled, mass stays, and each keeps its chance."""
    n, a, b = 20_000, (30.0, 0.3), (50.0, 0.45)
    unit = lambda i, x: F.struct(F.expr(i).alias("id"), F.lit(7).cast("long").alias("size"), F.lit(x[0]).alias("mass"), F.lit(x[1]).alias("p"))
    none = "struct<rest: struct<id: bigint, size: bigint, mass: double, p: double>, done: array<struct<id: bigint, size: bigint, up: int>>>"
    x = spark.range(n).select("id", F.aggregate(F.array(unit("id * 2", a), unit("id * 2 + 1", b)), F.from_json(F.lit('{"done": []}'), none), mixing._pair(5)).alias("x"))
    rows = x.select("id", "x.rest", "x.done").collect()
    chance = {0: 0.0, 1: 0.0}
    for r in rows:
        (d,) = r.done
        assert {d.id, r.rest.id} == {r.id * 2, r.id * 2 + 1} and d.up in (0, 1) and -1e-12 <= r.rest.p <= 1 + 1e-12
        mass = (a[0] if d.id % 2 == 0 else b[0]) * d.up + r.rest.mass * r.rest.p
        assert abs(mass - a[0] * a[1] - b[0] * b[1]) < 1e-9
        chance[d.id % 2] += d.up
        chance[r.rest.id % 2] += r.rest.p
    assert abs(chance[0] / n - a[1]) < 0.015 and abs(chance[1] / n - b[1]) < 0.015
