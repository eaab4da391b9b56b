"""Aligns two tokenizers over whole texts: a byte-level BPE (A) and a sentencepiece model with byte fallback (B).

A segment ends where a space follows a character that is no white space: neither tokenizer's tokens cross that place. Each distinct segment is
tokenised and cut into groups once, many of them together as arrays (Tokenizers.aligned), and remembered; a document's groups and links are its
segments' ones behind each other. Counts of links over the corpus, and what becomes of them by document, are Spark's (pair_counts).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec
from .util import shared_table

#: Bits for B's id beside A's in a link.
BITS = 17
ID = (1 << BITS) - 1
#: What sentencepiece writes for a space. A text that holds it can't come back.
SPACE = "\u2581"
#: Documents of about so many characters make a block; a longer one is a block of its own.
BLOCK_CHARS = 1_500_000
#: Characters of segments remembered by a worker, each segment counted with 8 more; segments that are learned together.
REMEMBERED, TOGETHER = 3_000_000, 10_000
SEGMENT = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+")


class Tokenizers:
    """Encodes segments with both tokenizers, whose special tokens' strings are plain text here."""

    def __init__(self, a: str, b: str):
        self.a = Codec(a)
        self.a.cut, self.a.special, self.a.ids, self.a.said = None, {}, {}, {}
        # A merge's text is that of its parts, so that a text's tokens have its bytes if its pre-tokens have them.
        assert all(self.a.decode_bytes(np.array([i])) == bytes([b]) for b, i in enumerate(self.a.first))
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        assert not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces), "a piece goes on after a space"
        self.raw = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.b_lengths = np.array([len(r) for r in self.raw], dtype=np.int64)
        self.space = [self.b.piece_to_id(SPACE)]
        # Ids in decimal with what follows: inside a group of A, at its end; inside a group of B, at its end, at the segment's end.
        self.ids = max(len(self.a.lengths), len(pieces))
        assert len(pieces) <= ID
        self.said = np.array([f"{i}{mark}" for mark in ",|,;\n" for i in range(self.ids)], dtype=object)
        #: Of each segment n_a, n_b, its groups as text and its links as int64, or None where a tokenizer's bytes aren't the segment's.
        self.known: dict[str, tuple[int, int, str, bytes] | None] = {}
        self.before, self.held = {}, 0

    def learn(self, segments: set[str]) -> None:
        """Has all of them in `known`. When what it holds is half of REMEMBERED, it begins anew, and takes from the one before what is met again."""
        if self.held > REMEMBERED // 2:
            self.before, self.known, self.held = self.known, {}, 0
            self.a.ids, self.a.said = {}, {}
        missing = [s for s in segments if s not in self.known]
        self.known |= {s: self.before[s] for s in missing if s in self.before}
        self.held += sum(map(len, missing)) + 8 * len(missing)
        new = [s for s in missing if s not in self.known]
        for k in range(0, len(new), TOGETHER):
            part = new[k : k + TOGETHER]
            lists = [[t for some in self.a.pre_tokens(s) for t in some] for s in part]
            self.a.known(lists)
            ids = self.a.ids
            # The model adds the first space itself; of a lone space it is given nothing.
            b = [x or self.space for x in self.b.encode([s[1:] for s in part], num_threads=1)]
            same = ["".join(x) == s and b"".join([self.raw[i] for i in y]) == s.encode() for s, x, y in zip(part, lists, b, strict=True)]
            self.known |= dict.fromkeys(part)
            if any(same):
                good = [s for s, ok in zip(part, same, strict=True) if ok]
                a = [b"".join([ids[t] for t in x]) for x, ok in zip(lists, same, strict=True) if ok]
                self.known |= zip(good, self.aligned(a, [y for y, ok in zip(b, same, strict=True) if ok]), strict=True)

    def aligned(self, a: list[bytes], b: list[list[int]]) -> Iterator[tuple[int, int, str, bytes]]:
        """n_a, n_b, groups and links of segments, given A's ids as int32 and B's. They are laid one behind the other as one text: a segment's
        bytes are the same for both, so that its end is one of the places where both end."""
        n_a, n_b = np.array([len(x) // 4 for x in a]), np.array([len(y) for y in b])
        a_ids = np.frombuffer(b"".join(a), dtype=np.int32).astype(np.int64)
        b_ids = np.fromiter(chain.from_iterable(b), dtype=np.int64, count=n_b.sum())
        a_ends, b_ends = np.cumsum(self.a.lengths[a_ids]), np.cumsum(self.b_lengths[b_ids])
        ends = np.zeros((2, a_ends[-1] + 1), dtype=bool)
        ends[0, a_ends], ends[1, b_ends] = True, True
        a_shut, b_shut = ends[1, a_ends], ends[0, b_ends]
        last = np.cumsum(n_b) - 1
        b_mark = 2 + b_shut
        b_mark[last] = 4
        group = np.concatenate([2 * (np.cumsum(a_shut) - a_shut), 2 * (np.cumsum(b_shut) - b_shut) + 1])
        named = np.concatenate([a_shut * self.ids + a_ids, b_mark * self.ids + b_ids])[np.argsort(group, kind="stable")]
        texts = "".join(self.said[named].tolist()).split("\n")
        links = (a_ids[a_shut] << BITS | b_ids[b_shut]).tobytes()
        stops = (8 * np.cumsum(b_shut)[last]).tolist()
        return zip(n_a.tolist(), n_b.tolist(), texts[:-1], (links[x:y] for x, y in zip([0, *stops[:-1]], stops, strict=True)), strict=True)


@lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


def tokenise(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of space + text, a row for each document: id, n_a, n_b, groups (text: a1,a2|b1;a3|b2,b3) and links array<long>. Null or empty texts and
    those whose tokens' bytes are not the text's have no tokens. a and b are paths that exist on every executor."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, n_a int, n_b int, groups string, links array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a, b)

        def block(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            cut = [SEGMENT.findall(" " + x) if x and SPACE not in x else [] for x in texts]
            t.learn(set().union(*cut))
            known, rows = t.known, []
            for segments in cut:
                found = [known[s] for s in segments]
                n_a, n_b, groups, links = zip(*found, strict=True) if found and None not in found else [()] * 4
                rows.append((sum(n_a), sum(n_b), ";".join(groups), b"".join(links)))
            n_a, n_b, groups, links = zip(*rows, strict=True)
            flat = pa.array(np.frombuffer(b"".join(links), dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 8 for x in links)]), pa.int32()), flat)
            return pa.RecordBatch.from_arrays([ids, pa.array(n_a, pa.int32()), pa.array(n_b, pa.int32()), pa.array(groups, pa.string()), lists], ["id", "n_a", "n_b", "groups", "links"])

        for batch in batches:
            sizes, k = pc.utf8_length(batch.column("t")).to_pylist(), 0
            while k < len(sizes):
                first, chars = k, 0
                while k < len(sizes) and (k == first or chars + sizes[k] <= BLOCK_CHARS):
                    chars, k = chars + sizes[k], k + 1
                yield block(batch.column("id").slice(first, k - first), batch.column("t").slice(first, k - first).to_pylist())

    return source.mapInArrow(work, schema)


def align(tokenised: DataFrame) -> DataFrame:
    """Of tokenise(), a row for each document: id, n_a, n_b, n_groups, groups and links, one for each byte offset where both end (packed: A's
    id, then B's in 17 bits)."""
    return tokenised.select("id", "n_a", "n_b", F.size("links").alias("n_groups"), "groups", "links")


def numbered_links(aligned: DataFrame) -> DataFrame:
    """Of align(), a row for each link: id, group (from 1), a, b."""
    link = F.zip_with(F.sequence(F.lit(1), F.col("n_groups")), "links", lambda g, x: F.struct(g.alias("group"), F.shiftright(x, BITS).cast("int").alias("a"), x.bitwiseAND(F.lit(ID)).cast("int").alias("b")))
    return aligned.where("n_groups > 0").select("id", F.explode(link).alias("link")).select("id", "link.*")


def pair_counts(links: DataFrame) -> DataFrame:
    """Of rows with an array `links` of packed pairs: pair, n (how many links hold it), best (whether no pair of its B id has more).

    Of two tokens that end together one is the end of the other, so that the two vocabularies bound the number of pairs, whatever the
    corpus: the sum of their tokens' byte lengths, under 600,000 for those of 50,257 and 32,000 tokens.
    """
    counts = links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit(ID))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256.

    Groups and links are built where the texts are read, nothing is shuffled for them, and stored once in the shared folder, a link as one number; the
    pair table, bounded by the vocabularies (pair_counts), is broadcast to the links. Null or empty texts and those that a tokenizer can't
    give back have zeros and an empty groups_sha256; a null id and repeated rows pass through, each with its own links in the counts; an
    empty table gives an empty result; other columns are ignored, so that their names can't clash; texts are read whole, those over 1.5
    million characters in blocks of their own.
    """
    hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows = shared_table(align(tokenise(docs, a, b, id_col, text_col)).select(F.monotonically_increasing_id().alias("row"), "id", "n_a", "n_b", "n_groups", hashed.alias("groups_sha256"), "links"), "align-links")
    each = rows.select("row", F.explode("links").alias("pair")).join(F.broadcast(pair_counts(rows)), "pair")
    sums = each.groupBy("row").agg(F.count("*").alias("n_links"), F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.drop("links").join(sums, "row", "left").select(F.col("id").alias(id_col), *map(n, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), "groups_sha256")
