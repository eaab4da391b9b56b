"""Near-duplicates: one-permutation MinHash with optimal densification, banded buckets, stars of candidates, exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import WordHashes, drop_shared, fold_ascii, grams, mix, shared_table, tasks

WORDS = 5
#: Bands of ROWS bins each. A pair at the threshold 0.75 misses all 32 bands with odds of (1 - 0.75^4)^32, 5 in a million.
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Stars that a rare shingle gets at first; members that one task compares with a star's centre in a row.
STARS, CHUNK = 32, 64
#: Documents of one shingle that meet in one task.
SALT = 500

_EDGES = (np.arange(BINS, dtype=np.uint64) * np.uint64((1 << 64) // BINS)).astype(np.uint64)
#: Where an empty bin looks: for each bin a sequence of random bins.
_PROBES = np.random.default_rng(5).integers(0, BINS, size=(BINS, 4 * BINS))


def shingles(text: str, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words; with fewer words, of the whole sequence; empty without words."""
    words = fold_ascii(text.encode("utf-8", "replace")).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = hashes.of(words)
    if len(h) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=np.uint64)
    return np.unique(grams(h, WORDS))


def signature(s: np.ndarray) -> np.ndarray:
    """The least hash of each bin; an empty bin takes that of the first filled one on its own random path."""
    at = np.searchsorted(s, _EDGES)
    full = np.append(at[1:], len(s)) > at
    out = np.zeros(BINS, dtype=np.uint64)
    out[full] = s[at[full]]
    empty = np.flatnonzero(~full)
    for probe in _PROBES.T:
        if not len(empty):
            break
        hit = full[probe[empty]]
        out[empty[hit]] = out[probe[empty[hit]]]
        empty = empty[~hit]
    else:
        out[empty] = s[0]
    return out


def bands(s: np.ndarray) -> np.ndarray:
    rows = signature(s).reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, key binary (of the set; null if empty), bands array<long>."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = (shingles(t.as_py(), hashes) for t in b.column("text"))
            rows = [(len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, bands(s) if len(s) else None) for s in sets]
            sizes = np.array([0, *(0 if r[2] is None else BANDS for r in rows)])
            flat = np.concatenate([np.zeros(0, np.int64), *(r[2] for r in rows if r[2] is not None)])
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), listed], ["id", "n_shingles", "key", "bands"])

    return source.mapInArrow(work, "id long, n_shingles long, key binary, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node, root (the least node), for every node that has an edge.

    Large stars and small stars in turn, until nothing changes; each step's edges are a table in the shared folder.
    """
    now = shared_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before, after = None, mark(now)
    while before != after:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        step = shared_table(small, "cc")
        drop_shared(now)
        now, before, after = step, after, mark(step)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact intersection and union of the full sets of pairs (a, b), a being the star's centre: a, b, inter, whole.

    A star's members are dealt by hash to chunks of about CHUNK, each with a copy of the centre; a task streams the sorted chunks
    and holds one centre's set.
    """
    n = tasks(pairs.sparkSession)
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    member = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), F.col("b").alias("id"), F.lit(1).alias("member"))
    centre = chunks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("chunk"), F.col("a").alias("id"), F.lit(0).alias("member"))
    dealt = member.unionByName(centre).join(texts, "id").repartition(n, "a", "chunk").sortWithinPartitions("a", "chunk", "member").select("a", "chunk", "id", "member", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own, of = WordHashes(), np.zeros(0, dtype=np.uint64), None
        for b in batches:
            out = []
            for a, chunk, i, member, text in zip(*(b.column(c) for c in ("a", "chunk", "id", "member", "text")), strict=True):
                s, key = shingles(text.as_py(), hashes), (a.as_py(), chunk.as_py())
                if not member.as_py():
                    own, of = s, key
                elif key == of:
                    at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                    inter = int((own[at] == s).sum())
                    out.append((key[0], i.as_py(), inter, len(own) + len(s) - inter))
            c = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], ["a", "b", "inter", "whole"])

    return dealt.mapInArrow(work, "a long, b long, inter long, whole long")


def rare_shingles(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """An exact filter for links between components: h, id, n, largest, place, able, parts, part.

    Order all shingles: first those of one component alone, then by number of documents. A link has 75 % of either set in common, so the
    first n - ceil(0.75 n) + 1 shingles of both sets share one, and it is not one of a single component: these are the rows. At
    the first shingle that two sets share, each has only its rest to share; so a set that has less than the threshold needs from two sets
    of its own size can only link with smaller ones, up to `largest`. One of each linked pair has largest >= n: `able` counts those
    of a shingle and `place`, which is null for the rest, spreads them over 0 to able, as stars' centres. A shingle of many documents
    is dealt in `parts` parts.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets, size, first = [], 0, 0
            for k, t in enumerate(b.column("text")):
                sets.append(shingles(t.as_py(), hashes).view(np.int64))
                size += len(sets[-1])
                if size >= 200_000 or k == b.num_rows - 1:
                    of = pa.array(np.repeat(np.arange(first, k + 1), [len(s) for s in sets]))
                    yield pa.RecordBatch.from_arrays([b.column("id").take(of), pa.array(np.concatenate(sets))], ["id", "h"])
                    sets, size, first = [], 0, k + 1

    every = texts.join(open_.select("id"), "id").select("id", "text").mapInArrow(spread, "id long, h long").join(open_, "id")
    across = every.groupBy("h").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h", "df")
    own = Window.partitionBy("id")
    first = (
        every.join(across, "h").withColumn("shared", F.count("*").over(own)).withColumn("at", F.row_number().over(own.orderBy("df", "h")))
        .where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - (F.col("n") - F.col("shared")))
    )
    largest = F.floor((F.col("shared") - F.col("at") + 1) * (100 + PERCENT) / PERCENT + 1e-9).cast("long") - F.col("n")
    parts = F.ceil(F.col("df") / SALT).cast("long")
    left = shared_table(first.withColumns({"largest": largest, "parts": parts, "part": F.pmod(F.xxhash64("id"), parts)}), "dedup-first")
    able = left.groupBy("h", "parts").agg(F.count_if(F.col("largest") >= F.col("n")).alias("able"))
    place = F.when(F.col("largest") >= F.col("n"), F.pmod(F.xxhash64("id", "h"), F.lit(1 << 52)) / float(1 << 52) * F.col("able"))
    return left.join(in_parts(able), ["h", "part"]).select("h", "id", "n", "largest", place.alias("place"), "able", "parts", "part")


def in_parts(x: DataFrame) -> DataFrame:
    """A row for each part of its shingle, without the number of parts."""
    return x.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id_col, n_shingles, component_id, kept.

    1. Equal sets are one node, named by its least id. 2. Buckets of equal bands: the member that meets most documents is the centre of a
    star of candidates, as many as members. 3. Full sets confirm or refuse each. 4. Components of the links. 5. Where a bucket's
    members stand in two components still, an exact filter (rare_shingles) leaves the documents that can link across at all, by
    shared rare shingle; those get further stars, sixteen times as many each round, until every pair left is checked or in one
    component. So no link of a pair that shares a bucket is lost.

    Two documents that no shared shingle rules out, in two components, are compared at last, however many share it: at most each such
    pair once. A shingle's rows are dealt in parts of about SALT documents, with a copy of the stars' centres for each.

    A null or empty text, or one without words, has an empty set: it links with nothing and is kept. Ids may be of any type that has
    an order; those that aren't whole numbers are hashed on the way. Rows of one id are one document. A null id takes its set's component_id (null, and not kept, if no row of the set has an id). Repeated rows are in one
    component; an empty table gives an empty result; other columns are ignored.
    """
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        keyed = docs.select(F.col(id_col).alias("id"), F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)).alias("key"), F.col(text_col).alias("text"))
        found = near_duplicates(keyed, "key", "text").join(keyed.select("id", "key").distinct(), "key", "left")
        least = found.groupBy("component_id").agg(F.min("id").alias("least"))
        return found.join(least, "component_id", "left").select(F.col("id").alias(id_col), "n_shingles", F.col("least").alias("component_id"), F.coalesce(F.col("id") == F.col("least"), F.lit(False)).alias("kept"))
    prints = shared_table(fingerprints(docs, id_col, text_col), "dedup-prints")
    sets = prints.where("key IS NOT NULL AND id IS NOT NULL")
    nodes = sets.groupBy("key").agg(F.min("id").alias("id"))
    # Ids of equal sets, and of rows that share an id, are linked before any bucket is looked at.
    alias = shared_table(sets.select("id", "key").join(nodes.withColumnRenamed("id", "node"), "key").where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b")).distinct(), "dedup-equal")
    entries = sets.join(nodes, ["key", "id"], "left_semi").select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    counts = entries.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    shared = shared_table(entries.join(counts, "bucket"), "dedup-entries")
    # The document that meets most others is the likeliest to be near all of a bucket.
    met = shared.groupBy("id").agg(F.sum("k").alias("met"))
    entries = shared.drop("k").join(met, "id")
    stars = entries.groupBy("bucket").agg(F.min(F.struct((-F.col("met")).alias("met"), F.col("id"), F.col("n"))).alias("c")).select("bucket", F.col("c.id").alias("a"), F.col("c.n").alias("an"))
    members = shared_table(entries.join(stars, "bucket").select("bucket", "id", "n", "met", "a", "an"), "dedup-members")
    wanted = shared_table(members.select("id").distinct(), "dedup-wanted")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    texts = shared_table(source.join(wanted, "id", "left_semi"), "dedup-texts")
    alike = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT  # noqa: E731  sizes alone can rule a link out
    fits = F.col("inter") * 100 >= F.col("whole") * PERCENT
    pairs = members.where((F.col("a") != F.col("id")) & alike(F.col("n"), F.col("an"))).select("a", F.col("id").alias("b")).distinct()
    checked = shared_table(verify(pairs, texts), "dedup-checked")
    links = alias.unionByName(checked.where(fits).select("a", "b"))
    roots = shared_table(components(links), "dedup-roots")
    placed = members.select("bucket", "id", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    open_ = shared_table(placed.join(split, "bucket", "left_semi").select("id", "n", "root").distinct(), "dedup-open")
    rare = shared_table(rare_shingles(open_, texts), "dedup-rare")
    low, high = 0, STARS
    while True:
        now = rare.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        split = now.groupBy("h", "parts").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max("able").alias("able")).where((F.col("least") != F.col("most")) & (F.col("able") > low))
        now = shared_table(now.join(in_parts(split.select("h", "parts")), ["h", "part"], "left_semi"), "dedup-rest")
        if now.isEmpty():
            break
        centre = in_parts(now.where((F.col("place") >= low) & (F.col("place") < high)).select("h", "parts", F.col("id").alias("a"), F.col("n").alias("an"), F.col("largest").alias("alargest"), F.col("root").alias("ar"), F.struct("place", "id").alias("aplace")))
        after = F.col("place").isNull() | (F.struct("place", "id") > F.col("aplace"))
        unseen = now.join(centre, ["h", "part"]).where(after & (F.col("root") != F.col("ar")) & alike(F.col("n"), F.col("an")) & (F.col("n") <= F.col("alargest")) & (F.col("an") <= F.col("largest"))).select("a", F.col("id").alias("b")).distinct()
        known = checked.select("a", "b").unionByName(checked.select(F.col("b").alias("a"), F.col("a").alias("b")))
        more = shared_table(verify(unseen.join(known, ["a", "b"], "left_anti"), texts), "dedup-checked")
        checked = checked.unionByName(more)
        links = links.unionByName(more.where(fits).select("a", "b"))
        roots = shared_table(components(links), "dedup-roots")
        low, high = high, 16 * high
    named = nodes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", F.coalesce("root", "id").alias("root"))
    out = prints.join(named, "key", "left").withColumn("component_id", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("root")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
