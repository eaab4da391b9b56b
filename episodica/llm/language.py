"""Language of mixed texts: scripts narrow the candidates, Viterbi over word scores labels spans."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .util import held_out

# First code points of ranges and the script of each.
SCRIPTS = [(0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other")]
NAMES = sorted({s for _, s in SCRIPTS})
_FIRST, _OF = [a for a, _ in SCRIPTS], [NAMES.index(s) for _, s in SCRIPTS]
BITS, ORDERS = 15, (1, 2, 3, 4)
#: Bytes that part words here: ASCII that is no letter.
_APART = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Log-odds that a change of language costs; learned documents of each language, on average.
SWITCH, SAMPLE = 8.0, 1500
#: A script is used in a language if so many of its words are written in it.
LEAST_SHARE = 0.01
REMEMBERED = 300_000
#: Letters of usual text that a span is filled up with before it is judged, so that a rare word or two alone don't condemn it.
BENEFIT = 12


#: Scripts written without blanks: Thai to Tibetan, Burmese, Khmer, kana, Han. Each of their signs is a word.
_UNSPACED = re.compile("([\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff])")


def words_of(text: str) -> list[bytes]:
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \1 ", text)
    return text.lower().encode("utf-8", "replace").translate(_APART).split()


def script_of(word: bytes) -> int:
    """The script of the first letter; of a word without one, of its first sign."""
    said = word.decode("utf-8", "replace")
    first = said[0] if said[0].isalpha() else next(filter(str.isalpha, said), said[0])
    return 0 + _OF[bisect_right(_FIRST, ord(first)) - 1]


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of words, blanks around each; and the word each stands in."""
    joined = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    start = np.cumsum(size - 1) - (size - 1)
    buckets, owners = [], []
    h = np.zeros(len(joined), dtype=np.uint64)
    for k in range(1, max(ORDERS) + 1):
        h = h[: len(joined) - k + 1] * np.uint64(257) + joined[k - 1 :] + np.uint64(1)
        n = np.maximum(size - k + 1, 0) if k > 1 else size - 2
        at = np.repeat(start + (k == 1), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        g = h[at] * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((g >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(np.repeat(np.arange(len(words)), n))
    return np.concatenate(buckets), np.concatenate(owners)


def mixed_up(words: list[bytes]) -> list[bytes]:
    """Words of the same lengths in letters from the same words, in a fixed random order."""
    said = [w.decode("utf-8", "replace") for w in words]
    letters = np.array(list("".join(said)))
    mixed = "".join(letters[np.random.default_rng(0).permutation(len(letters))])
    stop = np.cumsum([len(w) for w in said]).tolist()
    return [mixed[a:b].encode("utf-8", "replace") for a, b in zip([0, *stop], stop, strict=False)]


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # buckets x languages
    uses: np.ndarray  # scripts x languages
    usual: np.ndarray | None = None  # mean log-likelihood of a letter in a language's own text
    least: np.ndarray | None = None  # half-way between that and the same text with its letters mixed up


def learn(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts n-grams and scripts over about `sample` documents of each language that aren't held out, drawn by hash.

    Tasks hand on counts for each language and bucket, and the same for their texts with letters mixed up at random, which show
    how unlike the language a text without sense is; the driver gets at most 2^16 and a few rows for each language.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    rows = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rows:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sorted(rows.items()) for x in (k, min(1.0, sample / n)))), F.col("lang"))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(text)
                if words:
                    n = sums.setdefault(lang, np.zeros((2 << BITS) + len(NAMES), dtype=np.int64))
                    n[: 1 << BITS] += np.bincount(features(words)[0], minlength=1 << BITS)
                    n[1 << BITS : 2 << BITS] += np.bincount(features(mixed_up(words))[0], minlength=1 << BITS)
                    n[2 << BITS :] += np.bincount(list(map(script_of, words)), minlength=len(NAMES))
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "at", "n"])

    table = drawn.mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows)
    counts = np.zeros(((2 << BITS) + len(NAMES), len(langs)))
    counts[table["at"].to_numpy(dtype=np.int64), np.searchsorted(langs, table["lang"].to_numpy(dtype=str)) if len(table) else []] = table["n"].to_numpy(dtype=float)
    seen, mixed, scripts = counts[: 1 << BITS], counts[1 << BITS : 2 << BITS], counts[2 << BITS :]
    grams, total = seen + 0.1, np.maximum(seen.sum(axis=0), 1)
    logp = np.log(grams / grams.sum(axis=0))
    # Each n-gram is judged by the others, as in a text that wasn't learned.
    usual = (seen * np.log(np.maximum(grams - 1, 0.1) / grams.sum(axis=0))).sum(axis=0) / total
    least = (usual + (mixed * logp).sum(axis=0) / total) / 2
    return Model(langs, logp.astype(np.float32), scripts / np.maximum(scripts.sum(axis=0), 1) >= LEAST_SHARE, usual, np.where(least < usual, least, -np.inf))


class Scorer:
    """Word scores, remembered; Viterbi for many documents in step."""

    def __init__(self, model: Model):
        self.m, self.at = model, {}
        self.scores = np.zeros((1024, len(model.langs)), dtype=np.float32)
        self.letters, self.used = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)  # bytes of each word; if its script is used

    def rows(self, lists: list[list[bytes]]) -> list[np.ndarray]:
        new = set().union(*lists) - self.at.keys()
        if len(self.at) + len(new) > REMEMBERED:
            self.at.clear()
            new = set().union(*lists)
        new, first = list(new), len(self.at)
        if new:
            need = first + len(new)
            if need > len(self.scores):
                self.scores = np.concatenate([self.scores[:first], np.zeros((2 * need - first, self.scores.shape[1]), np.float32)])
                self.letters, self.used = (np.concatenate([x[:first], np.zeros(2 * need - first, np.int64)]) for x in (self.letters, self.used))
            for k in range(0, len(new), 20_000):
                part = new[k : k + 20_000]
                bucket, owner = features(part)
                s = np.stack([np.bincount(owner, self.m.logp[bucket, j], minlength=len(part)) for j in range(len(self.m.langs))], axis=1) / len(ORDERS)
                uses = self.m.uses[list(map(script_of, part))]
                some = uses.any(axis=1)
                # Words of a script that no language is known to use speak for none.
                s = np.where(some[:, None], np.where(uses, s, s.min(axis=1, keepdims=True) - 3 * SWITCH), 0)
                self.scores[first + k : first + k + len(part)] = s
                size = np.fromiter((len(w) if w.isalpha() or any(map(str.isalpha, w.decode("utf-8", "replace"))) else 0 for w in part), dtype=np.int64, count=len(part))
                self.letters[first + k : first + k + len(part)], self.used[first + k : first + k + len(part)] = size, size * some
            self.at.update(zip(new, range(first, need), strict=True))
        get = self.at.__getitem__
        return [np.fromiter(map(get, w), dtype=np.int32, count=len(w)) for w in lists]

    def paths(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The best language of each word; documents take their steps together, the longest ones to the end."""
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        n = np.array([len(rows[i]) for i in order])
        start = np.cumsum(n) - n
        s = self.scores[np.concatenate([rows[i] for i in order])]
        width = s.shape[1]
        back = np.zeros(s.shape, dtype=np.int16)
        value, keep = s[start].copy(), np.arange(width, dtype=np.int16)
        live = np.searchsorted(-n, -np.arange(n[0] + 1), side="left")  # documents with more words than t
        for t in range(1, n[0]):
            a = live[t]
            v, at = value[:a], start[:a] + t
            best = v.argmax(axis=1)
            top = v[np.arange(a), best] - SWITCH
            change = top[:, None] > v
            back[at] = np.where(change, best[:, None], keep)
            value[:a] = np.where(change, top[:, None], v) + s[at]
        path = np.zeros(len(s), dtype=np.int16)
        state = value.argmax(axis=1)
        for t in range(n[0] - 1, -1, -1):
            a = live[t]
            at = start[:a] + t
            path[at] = state[:a]
            if t:
                state[:a] = back[at, state[:a]]
        out: list[np.ndarray] = [path] * len(rows)
        for k, i in enumerate(order):
            out[i] = path[start[k] : start[k] + n[k]]
        return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Returns id_col, the columns of `keep`, held_out, lang_pred, score (share of the letters that lang_pred's spans hold) and
    spans array<struct<lang, start, stop>> (in words, stop excluded).

    Letters of scripts that no learned language uses, and of spans that read far less like their language than learned text does,
    are no language's but count in the whole, so that the score says how sure lang_pred is; such spans aren't returned. A text of such
    letters only still gets the likeliest language, with score 0 and no spans. Signs of scripts written without blanks are words.
    Rows are independent; nothing is shuffled. Null texts, texts without a letter, or a model without languages, give `und` with
    score 0 and no spans. Ties go to the language that comes first by name. A null id counts as held out. Repeated rows
    pass through, an empty table gives an empty result, long texts are read whole, other columns are ignored.
    """
    kept = list(dict.fromkeys(c for c in (id_col, *keep)))
    names = [f"k{i}" for i in range(len(kept))]
    source = docs.select(*(F.col(c).alias(n) for c, n in zip(kept, names, strict=True)), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    schema = StructType([*source.schema.fields[:-1], *StructType.fromDDL("lang_pred string, score double, spans array<struct<lang: string, start: long, stop: long>>").fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^15 floats for each language
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer, langs = Scorer(model), model.langs
        most = max(1, 4_000_000 // max(1, len(langs)))

        def judge(lists: list[list[bytes]]) -> list[tuple[str, float, list[dict]]]:
            full = [i for i, w in enumerate(lists) if w]
            out: list[tuple[str, float, list[dict]]] = [("und", 0.0, [])] * len(lists)
            if full and langs:
                rows = scorer.rows([lists[i] for i in full])
                for i, at, path in zip(full, rows, scorer.paths(rows), strict=True):
                    cuts = np.flatnonzero(np.diff(path, prepend=-1, append=-1))
                    first, used = cuts[:-1], scorer.used[at]
                    lang, size = path[first], np.add.reduceat(used, first)
                    if model.least is not None:
                        likely = np.add.reduceat(np.where(used > 0, scorer.scores[at, path], 0), first)
                        size = np.where(likely + BENEFIT * model.usual[lang] >= model.least[lang] * (size + BENEFIT), size, 0)
                    letters = np.bincount(lang, size, minlength=len(langs))
                    best = int(letters.argmax())
                    if not letters[best]:
                        out[i] = (langs[int(np.bincount(lang, np.add.reduceat(used, first), minlength=len(langs)).argmax())], 0.0, [])
                    else:
                        spans = [{"lang": langs[x], "start": a, "stop": b} for x, n, a, b in zip(lang.tolist(), size.tolist(), cuts.tolist(), cuts[1:].tolist(), strict=False) if n]
                        out[i] = (langs[best], float(letters[best] / scorer.letters[at].sum()), spans)
            return out

        for b in batches:
            results, group, n = [], [], 0
            for t in b.column("t"):
                text = t.as_py()
                words = words_of(text)
                if words and not any(map(str.isalpha, text)):
                    words = []
                group.append(words)
                n += len(words)
                if n >= most:
                    results += judge(group)
                    group, n = [], 0
            results += judge(group)
            c = [list(x) for x in zip(*results, strict=True)] or [[], [], []]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(c[0], pa.string()), pa.array(c[1], pa.float64()), pa.array(c[2], span)], [*names, "lang_pred", "score", "spans"])

    out = source.mapInArrow(work, schema).withColumn("held_out", held_out("k0"))
    return out.select(*(F.col(n).alias(c) for c, n in zip(kept, names, strict=True)), "held_out", "lang_pred", "score", "spans")
