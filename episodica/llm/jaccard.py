"""N-gram Jaccard join: links all documents whose sets of word n-grams are alike, through prefixes of globally ordered sets and tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .minhash import components, in_parts
from .util import WordHashes, drop_shared, fold_ascii, grams, shared_table, tasks

WORDS = 4
#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 85
#: Members that a star's centre meets in one trie; documents of one n-gram that one task joins with its centres.
CHUNK, SALT = 64, 500
#: Centres that an n-gram of many documents gets in the first round after its star; each round has GROWTH times as many.
FIRST, GROWTH = 32, 16
#: Bits of the filter that texts pass before they are shuffled: at most 4 MB, however many rows there are.
SLOTS = 1 << 25


def shingles(text: str, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of four words; with fewer words, of the whole sequence; empty without words."""
    words = fold_ascii(text.encode("utf-8", "replace")).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = hashes.of(words)
    if len(h) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=np.uint64)
    return np.unique(grams(h, WORDS))


def least_overlap(n):
    """What a set of n has in common with any that it links with, at least: the partner has all of it then."""
    return -(-n * PERCENT // 100)


def heads(n: int) -> tuple[int, int]:
    """(n-grams looked at, of which must be shared) for a set of n: two linked sets have `shared` among either's first ones in any global order."""
    first = n - least_overlap(n) + 1
    shared = -(-first // 2)
    return min(n, first + shared - 1), shared


class Trie:
    """Sets as paths of n-grams in one global order, of which the common beginnings are stored once.

    A node has the n-grams of its edge, the sets that end there, its children, and over all sets below it the least size and the most n-grams
    that may still come: bounds for pruning.
    """

    __slots__ = ("edge", "ends", "children", "least", "rest")

    def __init__(self, sets: list[tuple[bytes, int, int]], at: int = 0):
        """sets: (n-grams as 8 bytes each, whole size, name), sorted; they share what comes before byte `at`."""
        low, high = sets[0][0], sets[-1][0]
        end = at
        while end < min(len(low), len(high)) and low[end : end + 8] == high[end : end + 8]:
            end += 8
        self.edge = np.frombuffer(low[at:end], dtype=np.uint64)
        self.least, self.rest = min(s[1] for s in sets), max(len(s[0]) for s in sets) // 8 - end // 8
        self.ends = [s for s in sets if len(s[0]) == end]
        self.children, k = [], len(self.ends)
        while k < len(sets):
            j = k
            while j < len(sets) and sets[j][0][end : end + 8] == sets[k][0][end : end + 8]:
                j += 1
            self.children.append(Trie(sets[k:j], end))
            k = j

    def overlaps(self, own: np.ndarray, place: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
        """(name, whole size, intersection) of each set that may link with one of `size` n-grams: `own` sorted, with each one's place in the
        global order. A path's overlap is carried to all sets below; a subtree that can't reach the threshold any more is left."""
        todo = [(self, 0, -1)]
        while todo:
            node, found, last = todo.pop()
            if len(node.edge):
                at = np.minimum(np.searchsorted(own, node.edge), len(own) - 1)
                hit = place[at[own[at] == node.edge]]
                if len(hit):
                    found, last = found + len(hit), int(hit[-1])
            needed = -(-PERCENT * (size + node.least) // (100 + PERCENT))
            if found + min(node.rest, len(own) - 1 - last) < needed:
                continue
            yield from ((name, n, found) for _, n, name in node.ends)
            todo += [(c, found, last) for c in node.children]


def prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each row id, n, key binary (of the set, 128 bits; null if empty), place (of the row: id and text), need, low array<int> and high
    array<tinyint>: the last 40 bits of its least hashes. So few will do to ask whether another set has one; one that seems to costs time, no link."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(id_col, text_col).alias("place"))
    schema = StructType([source.schema["id"], *StructType.fromDDL("place long, n long, key binary, need long, low array<int>, high array<tinyint>").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sizes, keys, needs, flat = [], [], [], []
            for t in b.column("text"):
                s = shingles(t.as_py(), hashes)
                looked, shared = heads(len(s)) if len(s) else (0, 0)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                needs.append(shared)
                flat.append(s[:looked].view(np.int64).copy())
            at = pa.array(np.cumsum([0, *map(len, flat)]), pa.int32())
            head = np.concatenate(flat) if flat else np.zeros(0, np.int64)
            low, high = (pa.ListArray.from_arrays(at, pa.array(x)) for x in (head.astype(np.int32), (head >> 32).astype(np.int8)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("place"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(needs, pa.int64()), low, high], schema.names)

    return source.mapInArrow(work, schema)


def spread(texts: DataFrame) -> DataFrame:
    """node, h: all n-grams of the sets whose key is theirs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets, size, first = [], 0, 0
            for k, (t, key) in enumerate(zip(b.column("text"), b.column("key"), strict=True)):
                s = shingles(t.as_py(), hashes)
                sets.append(s.view(np.int64) if xxhash.xxh3_128_digest(s.tobytes()) == key.as_py() else s[:0].view(np.int64))
                size += len(s)
                if size >= 200_000 or k == b.num_rows - 1:
                    of = pa.array(np.repeat(np.arange(first, k + 1), [len(s) for s in sets]))
                    yield pa.RecordBatch.from_arrays([b.column("node").take(of), pa.array(np.concatenate(sets))], ["node", "h"])
                    sets, size, first = [], 0, k + 1

    return texts.mapInArrow(work, "node long, h long")


def passing(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose place has its bit set by a place of `wanted`: all that join with it by place, and few others. The bits are at most
    SLOTS, so that the broadcast is bounded; where most are set, more rows pass, and a join still decides."""
    slot = F.pmod("place", F.lit(SLOTS))
    bits = wanted.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "bucket").where(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1).select(rows.columns)


def ordered_sets(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, n, grams array<long>: of the sets that may link at all, the n-grams that another such set has too, in the global order: rarest
    first, then by hash.

    A set's least hashes decide first: as many of them as any partner shares must stand in another set (heads()). For what is left, all
    n-grams are counted. An n-gram stands in several sets if the least and the greatest of their nodes differ: both sides of each join
    read the same columns, and nulls are left out before the shuffle, as Spark would do on one side only, so that one shuffle serves both.
    """
    several, named = F.min("node") != F.max("node"), F.col("node").isNotNull() & F.col("h").isNotNull()
    n_tasks = tasks(docs.sparkSession)
    forty = lambda low, high: F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit((1 << 32) - 1)))
    first = sets.select("node", F.explode(F.zip_with("low", "high", forty)).alias("h")).where(named).repartition(n_tasks, "h")
    met = first.join(first.groupBy("h").agg(several.alias("several")).where("several").select("h"), "h").groupBy("node").agg(F.count("*").alias("met"))
    open_ = shared_table(sets.join(met, "node").where("met >= need").select("node", "n", "key", "place"), "jaccard-open")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("place"))
    # By place and node, as one place has one node: the join's shuffle serves the grouping.
    texts = passing(rows, open_).join(open_.select("place", "node", "key"), "place").groupBy("place", "node").agg(F.min(F.struct("key", "text")).alias("one")).select("node", "one.*")
    every = spread(texts).where(named).repartition(n_tasks, "h")
    across = every.groupBy("h").agg(F.count("*").alias("df"), several.alias("several")).where("several").select("h", "df")
    rare = F.array_sort(F.collect_list(F.struct("df", "h")))
    grouped = every.join(across, "h").select("node", "df", "h").repartition(n_tasks, "node").groupBy("node").agg(F.transform(rare, lambda x: x["h"]).alias("grams")).join(open_.select("node", "n"), "node")
    return grouped.where(F.size("grams") >= F.ceil(F.col("n") * PERCENT / 100))


def verify(pairs: DataFrame, ordered: DataFrame) -> DataFrame:
    """Links among pairs (a, b), a being a centre: its members are dealt by hash to chunks of about CHUNK, each a trie that the centre's set runs through."""
    n_tasks = tasks(pairs.sparkSession)
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks"))
    member = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), F.col("b").alias("node"), F.lit(1).alias("member"))
    centre = chunks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("node"), F.lit(0).alias("member"))
    dealt = member.unionByName(centre).join(ordered, "node").repartition(n_tasks, "a", "chunk").sortWithinPartitions("a", "chunk", "member").select("a", "chunk", "node", "member", "n", "grams")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own, size, members = None, np.zeros(0, np.uint64), 0, []

        def found() -> list[tuple[int, int]]:
            if not members:
                return []
            # The trie takes the commonest n-grams first, which near copies have in common.
            line = own[::-1]
            order = np.argsort(line)
            return [(of[0], name) for name, n, both in Trie(sorted(members)).overlaps(line[order], order, size) if 100 * both >= PERCENT * (n + size - both)]

        for b in batches:
            out = []
            for a, chunk, node, member, n, g in zip(*(b.column(c) for c in ("a", "chunk", "node", "member", "n", "grams")), strict=True):
                s = g.values.to_numpy().view(np.uint64)
                if not member.as_py():
                    out += found()
                    of, own, size, members = (a.as_py(), chunk.as_py()), s, n.as_py(), []
                elif of == (a.as_py(), chunk.as_py()):
                    members.append((s[::-1].tobytes(), n.as_py(), node.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        out = found()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(work, "a long, b long")


def may_link() -> Column:
    """Whether sizes, and what either set has from a shared n-gram on, leave room for a link. At the first n-gram that two sets share they
    have no more in common than that, so that every link passes there, if not at each shared n-gram."""
    sizes = F.least("n", "an") * 100 >= F.greatest("n", "an") * PERCENT
    return sizes & (F.least("rest", "arest") * (100 + PERCENT) >= (F.col("n") + F.col("an")) * PERCENT)


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after more links: only the components that these touch are looked at."""
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    between = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    moved = shared_table(components(between.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))), "jaccard-moved")
    first_met = moved.select("node").join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return roots.unionByName(first_met).join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def link_sets(ordered: DataFrame) -> DataFrame:
    """node, root: components of all links between the sets.

    Two linked sets share one of the first n-grams of both, rarest first, and from there on enough (may_link). Each such n-gram's documents first make one star around the one that
    meets most; what links is one component. Then, where an n-gram's documents stand in several components still, more of them become
    centres, GROWTH times as many each round, until all pairs left of it have met: no link between components is lost.
    """
    reach = F.size("grams") - F.ceil(F.col("n") * PERCENT / 100).cast("int") + 1
    rows = ordered.select("node", "n", F.size("grams").alias("m"), F.posexplode(F.slice("grams", F.lit(1), reach)).alias("at", "h")).select("node", "n", "h", (F.col("m") - F.col("at")).alias("rest"))
    index = shared_table(rows.join(rows.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "h"), "jaccard-index")
    met = index.groupBy("node").agg(F.sum("k").alias("met"))
    # Centres are the same documents for all n-grams, as far as may be: few different pairs.
    star = index.join(met, "node").groupBy("h").agg(F.max(F.struct("met", "node", "n", "rest")).alias("c")).select("h", F.col("c.node").alias("a"), F.col("c.n").alias("an"), F.col("c.rest").alias("arest"))
    pairs = index.join(star, "h").where((F.col("a") != F.col("node")) & may_link()).select("a", F.col("node").alias("b")).distinct()
    checked = shared_table(pairs, "jaccard-pairs")
    links = shared_table(verify(checked, ordered), "jaccard-links")
    roots = shared_table(components(links), "jaccard-roots")
    parts = F.ceil(F.col("k") / SALT).cast("long")
    turn = F.pmod(F.xxhash64("node"), F.lit(1 << 52)) / float(1 << 52) * F.col("k")
    low, high, open_ = 0, FIRST, index
    while True:
        now = open_.join(roots, "node", "left").withColumns({"root": F.coalesce("root", "node"), "turn": turn})
        split = now.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("k").alias("most")).where((F.col("low") != F.col("high")) & (F.col("most") > low)).select("h")
        now = shared_table(now.join(split, "h", "left_semi").withColumns({"parts": parts, "part": F.pmod(F.xxhash64("node"), parts)}), "jaccard-rest")
        drop_shared(open_)
        if now.isEmpty():
            return roots
        centre = in_parts(now.where((F.col("turn") >= low) & (F.col("turn") < high)).select("h", "parts", F.col("node").alias("a"), F.col("n").alias("an"), F.col("rest").alias("arest"), F.col("root").alias("ar"), F.struct("turn", "node").alias("aturn")))
        apart = now.join(centre, ["h", "part"]).where((F.struct("turn", "node") > F.col("aturn")) & (F.col("root") != F.col("ar")) & may_link())
        fresh = apart.select("a", F.col("node").alias("b")).distinct()
        known = checked.select("a", "b").unionByName(checked.select(F.col("b").alias("a"), F.col("a").alias("b")))
        more = shared_table(fresh.join(known, ["a", "b"], "left_anti"), "jaccard-pairs")
        checked = checked.unionByName(more)
        new = shared_table(verify(more, ordered), "jaccard-links")
        if not new.isEmpty():
            roots, old = shared_table(joined(roots, new), "jaccard-roots"), roots
            drop_shared(old)
        # What stands in one component stays there: the next round reads what this one had left.
        low, high = high, GROWTH * high
        shut = now._shared_path
        open_ = now.select("node", "n", "h", "rest", "k")
        open_._shared_path = shut


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id_col, n_shingles, component_id.

    1. Rows of equal sets are one node. 2. Sets whose least hashes stand in no other set go (ordered_sets). 3. The n-grams of the rest get one
    global order, rarest first. 4. Sets that share one of their first n-grams are candidates; members' tries tell their overlap with a
    centre (link_sets, verify). 5. component_id is the least id of a component.

    Sets are of 64-bit hashes: two sets of 20,000 n-grams hold a false common one with odds of about 1 in 50 thousand million. A null or empty
    text, or one without words, has n_shingles 0, links with nothing and has its own id as component_id. Rows of one id and different texts
    are different documents; a null id takes its component's least id, null if none has one; repeated rows are one set; an empty
    table gives an empty result; other columns are ignored, so that their names can't clash; texts are read whole. Ids may be of any
    type that has an order.
    """
    whole = shared_table(prints(docs, id_col, text_col), "jaccard-prints")
    one = whole.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("place", "n", "need", "low", "high")).alias("one"))
    sets = shared_table(one.select(F.monotonically_increasing_id().alias("node"), "key", "one.*"), "jaccard-sets")
    found = shared_table(whole.select("id", "n", "key"), "jaccard-found")
    drop_shared(whole)
    ordered = shared_table(ordered_sets(docs, sets, id_col, text_col), "jaccard-ordered")
    nodes = shared_table(sets.select("key", "node"), "jaccard-nodes")
    drop_shared(sets)
    roots = link_sets(ordered)
    named = nodes.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    least = found.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least")).join(named, "key")
    ids = least.groupBy("root").agg(F.min("least").alias("component")).join(least.select("root", "key"), "root").select("key", "component")
    out = found.select("id", "n", "key").join(ids, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))
