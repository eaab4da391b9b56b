"""Removes passages of 35 words that occur twice: super-k-mers are dealt by minimiser and counted by sorting.

A window is 35 consecutive words; its minimiser is the least hash of the 6-word grams in it. Consecutive windows with one minimiser
form a super-k-mer. Equal windows have equal minimisers, so a minimiser that the corpus has once needs no look at its words.
The others' super-k-mers are packed as one string each. Equal strings are first counted together, in the tasks that made them and
then across tasks; what travels to the bucket of a minimiser is each distinct string once. There the windows of all strings are
sorted and counted, and each string gets the runs of its repeated windows, which go back to its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import WordHashes, drop_shared, grams, mix, shared_table, tasks

WINDOW, GRAM = 35, 6
#: A minimiser that occurs more often than SPLIT times has its bucket divided by a second one, over grams of SECOND words: equal windows
#: have both in common, and a window that was edited seldom has.
SPLIT, SECOND = 1000, 18
#: Distinct strings that one task holds of a bucket, eight bytes a window. A larger bucket is divided to the end: each of its windows is
#: a bucket of its own, counted by partial aggregation.
BUCKET = 500_000
#: Words that a task takes apart at once.
AT_ONCE = 100_000
#: Parts of a string's occurrences, by text; its marks travel to those parts that it occurs in.
PARTS = 32


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    low, have = x, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: len(low) - (width - have)], low[width - have :]) if width > have else low


def runs(*x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of values that are equal in every array."""
    if not len(x[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(x[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([y[1:] != y[:-1] for y in x])
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(new)))


class Chunk:
    """The words of some texts on end: text `of` each window, and its `place` in all the words."""

    def __init__(self, first: int, lists: list[list[bytes]], hashes: WordHashes):
        self.words = list(chain.from_iterable(lists))
        self.h = hashes.of(self.words)
        size = np.array([len(x) for x in lists])
        self.start = np.cumsum(size) - size
        n = np.maximum(size - WINDOW + 1, 0)
        self.of = np.repeat(np.arange(len(lists)), n)
        self.place = np.arange(n.sum()) + np.repeat(self.start - (np.cumsum(n) - n), n)
        self.first = first

    def least_grams(self, words: int) -> np.ndarray:
        """Each window's least hash of a run of so many words."""
        return least(grams(self.h, words), WINDOW - words + 1)[self.place]


def chunks(column: pa.Array, hashes: WordHashes) -> Iterator[Chunk]:
    lists, first, n = [], 0, 0
    for k, raw in enumerate(column):
        lists.append(raw.as_py().split())
        n += len(lists[-1])
        if n >= AT_ONCE or k == len(column) - 1:
            if n >= WINDOW:
                yield Chunk(first, lists, hashes)
            lists, first, n = [], k + 1, 0


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, k1, k2, n: the minimisers of each text, and how often each is a gram of it (twice or more: it may repeat inside)."""
    hashes = WordHashes()
    for b in batches:
        for c in chunks(b.column("raw"), hashes):
            if not len(c.of):
                continue
            low = c.least_grams(GRAM)
            at, _ = runs(c.of, low)
            of, v = c.of[at], low[at]
            order = np.lexsort((v, of))
            at, _ = runs(of[order], v[order])
            of, v = of[order][at], v[order][at]
            # Grams that run over the end of a text are of no window; as grams they only raise a count, and the count only lets more in.
            g = grams(c.h, GRAM)
            value, times = np.unique(mix(g + mix(np.searchsorted(c.start, np.arange(len(g)), "right").astype(np.uint64))), return_counts=True)
            n = times[np.searchsorted(value, mix(v + mix((of + 1).astype(np.uint64))))]
            row = pa.array(of + c.first)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), b.column("k1").take(row), b.column("k2").take(row), pa.array(n.astype(np.int64))], ["v", "k1", "k2", "n"])


_PACKED = "k1 long, k2 long, copies long, key long, first long, s1 long, s2 long, packed binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Super-k-mers of the wanted minimisers: bucket, first window, two halves of the digest, packed words."""
    hashes = WordHashes()
    tag = lambda v, of: mix(v + mix(of.astype(np.uint64)))
    for b in batches:
        found = b.column("found")
        entry, text = found.flatten(), np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
        known = tag(entry.field("v").to_numpy().view(np.uint64), text)
        order = np.argsort(known)
        known, burns = known[order], entry.field("hot").to_numpy(zero_copy_only=False)[order]
        for c in chunks(b.column("raw"), hashes):
            if not len(c.of):
                continue
            low = c.least_grams(GRAM)
            mine = tag(low, c.of + c.first)
            slot = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            hit = np.flatnonzero(known[slot] == mine)
            if not len(hit):
                continue
            of, place, key = c.of[hit], c.place[hit], low[hit]
            hot = burns[slot[hit]]
            if hot.any():
                key = np.where(hot, mix(key + mix(c.least_grams(SECOND)[hit])), key)
            at, n = runs(of, key, place - np.arange(len(place)))
            packed = [b" ".join(c.words[p : p + m + WINDOW - 1]) for p, m in zip(place[at].tolist(), n.tolist(), strict=True)]
            digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, packed)), dtype=np.int64).reshape(-1, 2)
            row = pa.array(of[at] + c.first)
            columns = [key[at].view(np.int64), place[at] - c.start[of[at]], digest[:, 0], digest[:, 1]]
            yield pa.RecordBatch.from_arrays([*(b.column(x).take(row) for x in ("k1", "k2", "copies")), *map(pa.array, columns), pa.array(packed, pa.binary())], ["k1", "k2", "copies", "key", "first", "s1", "s2", "packed"])


def _windows(column: pa.Array, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """For packed strings: a hash of each window, one string after the other, and the number of windows of each string."""
    flat, size = [np.zeros(0, np.uint64)], np.zeros(len(column), np.int64)
    for c in chunks(column, hashes):
        flat.append(grams(c.h, WINDOW)[c.place])
        size += np.bincount(c.of + c.first, minlength=len(column))
    return np.concatenate(flat), size


_MARKED = "s1 long, s2 long, parts long, firsts array<int>, ns array<int>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings that have repeated windows, with the runs of these. The input is sorted by bucket, and a task has whole buckets."""
    hashes, names = WordHashes(), ("key", "s1", "s2", "parts", "times")
    held: list[dict] = []

    def close(parts: list[dict]) -> Iterator[pa.RecordBatch]:
        x = {c: np.concatenate([p[c] for p in parts]) for c in (*names, "size", "w")}
        # Equal windows have one bucket, so that all windows can be sorted together.
        order = np.argsort(x["w"], kind="stable")
        at, n = runs(x["w"][order])
        if not len(at):
            return
        twice = np.zeros(len(order), dtype=bool)
        twice[order] = np.repeat(np.add.reduceat(np.repeat(x["times"], x["size"])[order], at) > 1, n)
        start = np.cumsum(x["size"]) - x["size"]
        of = np.repeat(np.arange(len(start)), x["size"])
        hit = np.flatnonzero(twice)
        if not len(hit):
            return
        at, n = runs(of[hit], hit - np.arange(len(hit)))
        of, firsts = of[hit[at]], hit[at] - start[of[hit[at]]]
        row, many = runs(of)
        offsets = pa.array(np.append(row, len(of)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(y, pa.int32())) for y in (firsts, n)]
        yield pa.RecordBatch.from_arrays([*(pa.array(x[c][of[row]]) for c in ("s1", "s2", "parts")), *lists], ["s1", "s2", "parts", "firsts", "ns"])

    for b in batches:
        if not b.num_rows:
            continue
        x = {c: b.column(c).to_numpy() for c in names}
        x["w"], x["size"] = _windows(b.column("packed"), hashes)
        cut = int(np.searchsorted(x["key"], x["key"][-1]))  # where the last bucket begins, which may go on
        if held and (cut or held[0]["key"][0] != x["key"][0]):
            ends = 0 if cut == 0 else cut
            w = int(x["size"][:ends].sum())
            yield from close([*held, {c: y[: w if c == "w" else ends] for c, y in x.items()}])
            held = [{c: y[w if c == "w" else ends :] for c, y in x.items()}]
        else:
            if cut:
                w = int(x["size"][:cut].sum())
                yield from close([{c: y[: w if c == "w" else cut] for c, y in x.items()}])
                x = {c: y[w if c == "w" else cut :] for c, y in x.items()}
            held.append(x)
    if held:
        yield from close(held)


def _each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """s1, s2, parts, place, w, times: each window of each string."""
    hashes = WordHashes()
    for b in batches:
        w, size = _windows(b.column("packed"), hashes)
        row = pa.array(np.repeat(np.arange(len(size)), size))
        place = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in ("s1", "s2", "parts")), pa.array(place, pa.int32()), pa.array(w.view(np.int64)), b.column("times").take(row)], ["s1", "s2", "parts", "place", "w", "times"])


_RESULT = "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _remove(with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw, copies, marks in zip(b.column("raw"), b.column("copies").to_pylist(), b.column("marks"), strict=True):
                words = raw.as_py().split()
                total, gone = len(words), 0
                if copies > 1 and total >= WINDOW:
                    words, gone = [], total
                elif marks.is_valid:
                    m = marks.values
                    edge = np.zeros(total + 1, dtype=np.int64)
                    many = m.field("firsts").value_lengths().to_numpy()
                    starts = np.repeat(m.field("first").to_numpy(), many) + m.field("firsts").flatten().to_numpy()
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + m.field("ns").flatten().to_numpy() + WINDOW - 1, -1)
                    left = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    gone, words = total - len(left), [words[i] for i in left.tolist()]
                kept = b" ".join(words)
                rows.append((total, gone, hashlib.sha256(kept).hexdigest(), (kept if gone else raw.as_py()).decode("utf-8", "replace") if with_text else None))
            c = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string())], ["k1", "k2", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return work


def repeats(packed: DataFrame) -> DataFrame:
    """Strings with repeated windows, as _MARKED says, from super-k-mers as _PACKED says.

    `parts` has a bit for each part of the texts that a string occurs in; texts that are gone as a whole need no marks.
    """
    n = tasks(packed.sparkSession)
    part = F.when(F.col("copies") == 1, F.expr(f"shiftleft(1L, cast(k1 & {PARTS - 1} AS int))")).otherwise(F.lit(0).cast("long"))
    strings = shared_table(packed.groupBy("key", "s1", "s2", "packed").agg(F.sum("copies").alias("times"), F.bit_or(part).alias("parts")), "repeat-strings")
    per = strings.groupBy("key").agg(F.count("*").alias("strings"))
    large = per.where(F.col("strings") > BUCKET).select("key")
    beyond = not large.isEmpty()
    small = strings.join(large, "key", "left_anti") if beyond else strings
    marks = small.select("key", "s1", "s2", "packed", "times", "parts").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_count, _MARKED)
    if beyond:
        each = strings.join(large, "key", "left_semi").select("s1", "s2", "packed", "times", "parts").mapInArrow(_each_window, "s1 long, s2 long, parts long, place int, w long, times long")
        often = each.groupBy("w").agg(F.sum("times").alias("all")).where("all > 1").select("w")
        placed = each.join(often, "w").groupBy("s1", "s2", "parts").agg(F.collect_list("place").alias("firsts"))
        marks = marks.unionByName(placed.withColumn("ns", F.transform("firsts", lambda i: F.lit(1))))
    return marks


def remove_repeats(docs: DataFrame, text_col: str = "text", with_text: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each input row: the columns of `keep`, n_words, n_removed, kept_sha256; and kept_text (the text as it was if nothing was removed) if with_text.

    Each distinct text is looked at once, however many copies it has. A null text has no words. Texts under 35 words have no window and
    stay whole. All occurrences of a repeated window go, the first included, judged on the input. Null ids and repeated rows are like
    other rows (repeated rows are copies of each other); an empty table gives an empty result; texts are read whole; columns not
    named in `keep` are ignored. `keep` may not have names of results; a caller who can't exclude that keeps one struct of its columns.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("row"), F.xxhash64(text).alias("r1"), F.xxhash64(F.lit(7), text).alias("r2"), F.col(text_col).isNotNull().alias("said"))
    raw = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), text.alias("text"))
    light = shared_table(raw.select("k1", "k2", F.col("text").cast("binary").alias("raw")).mapInArrow(_light, "v long, k1 long, k2 long, n long"), "repeat-minimisers")
    again = light.groupBy("v").agg(F.sum("n").alias("times")).where("times > 1").select("v", (F.col("times") > SPLIT).alias("hot"))
    found = light.join(again, "v").groupBy("k1", "k2").agg(F.collect_set(F.struct("v", "hot")).alias("found"))
    texts = raw.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies")).select("k1", "k2", F.col("text").cast("binary").alias("raw"), "copies")
    packed = shared_table(texts.join(found, ["k1", "k2"]).select("k1", "k2", "copies", "raw", "found").mapInArrow(_pack, _PACKED), "repeat-packed")
    drop_shared(light)
    marked = repeats(packed).select("s1", "s2", "firsts", "ns", F.explode(F.expr(f"filter(sequence(0, {PARTS - 1}), i -> getbit(parts, i) = 1)")).alias("part"))
    occurs = packed.where("copies = 1").select("k1", "k2", "first", "s1", "s2", F.expr(f"cast(k1 & {PARTS - 1} AS int)").alias("part"))
    marks = occurs.join(marked, ["s1", "s2", "part"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "firsts", "ns")).alias("marks"))
    done = texts.join(marks, ["k1", "k2"], "left").select("k1", "k2", "raw", "copies", "marks").mapInArrow(_remove(with_text), _RESULT)
    joined = rows.join(done, (F.col("r1") == F.col("k1")) & (F.col("r2") == F.col("k2")))
    return joined.select(*(F.col("row")[c].alias(c) for c in keep), "n_words", "n_removed", "kept_sha256", *([F.when(F.col("said"), F.col("kept_text")).alias("kept_text")] if with_text else []))
