"""Byte-level BPE: encodes and decodes whole texts with a public vocabulary file.

Each distinct pre-token is merged with a segment tree over the ranks of its adjacent pairs. A leaf holds
(rank, position) of one pair as one number, so that the root is the leftmost pair of the lowest rank. A merge
changes at most three leaves, each of which is carried to the root. The trees of many pre-tokens stand in one array and
take their steps together.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed value: the published pre-token pattern of this vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: letters and numbers younger than Unicode 16, which the vocabulary's library takes for symbols.
LATER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    r"\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    r"\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    r"\U0003d000-\U0003fc3f"
)
NONE, MASK = np.iinfo(np.int64).max, (1 << 62) - 1
#: Characters or pre-tokens that are worked on at once; bounds memory, not what is encoded.
CHUNK_CHARS, CHUNK_TOKENS = 1_000_000, 200_000
#: Pre-tokens remembered by a worker.
REMEMBERED = 300_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if visible, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class Codec:
    """Reads a tokenizer file; encodes and decodes as the file says, special tokens in a text included."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        bits = max(10, (4 * len(keys)).bit_length())
        self.spread, self.drop = 0x9E3779B97F4A7C15 - (1 << 64), 62 - bits
        self.table, self.rank_at = np.full(1 << bits, -2, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
        slots = ((keys * self.spread & MASK) >> self.drop).tolist()
        for rank, (key, slot) in enumerate(zip(keys.tolist(), slots, strict=True)):
            while self.table[slot] >= 0:
                slot = (slot + 1) & ((1 << bits) - 1)
            self.table[slot], self.rank_at[slot] = key, rank
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        texts = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        pieces = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        narrow = [(chr(i), regex.match(r"\p{L}|(\p{N})", chr(i))) for i in range(256)]
        letters_1, numbers_1 = ("".join(c for c, m in narrow if m and bool(m[1]) is n) for n in (False, True))
        self.pattern = re.compile(PRE_TOKEN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters_1}{numbers_1}]").replace(r"\p{L}", f"[{letters_1}]").replace(r"\p{N}", f"[{numbers_1}]").replace(r"\s", r"[\t-\r \x85\xa0]").replace(r"[^[\t-\r \x85\xa0]", r"[^\t-\r \x85\xa0").replace(r"\S", r"[^\t-\r \x85\xa0]"))
        letter, number = rf"[\p{{L}}--[{LATER}]]", rf"[\p{{N}}--[{LATER}]]"
        self.rare = regex.compile("(?V1)" + PRE_TOKEN.replace(r"[^\s\p{L}\p{N}]", rf"(?:(?!{letter}|{number})\S)").replace(r"\p{L}", letter).replace(r"\p{N}", number))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ids: dict[str, bytes] = {s: np.array([i], dtype=np.int32).tobytes() for s, i in self.special.items()}
        self.said: dict[str, str] = {s: str(i) for s, i in self.special.items()}

    # -- merging -------------------------------------------------------------------------------------------------
    def _leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(rank, position) of the pairs a b, or NONE where they don't merge."""
        key = a << 32 | b
        slot = (key * self.spread & MASK) >> self.drop
        hit = self.table[slot] == key
        rank = np.where(hit, self.rank_at[slot], -1)
        left = np.flatnonzero(~hit & (self.table[slot] >= 0))
        while len(left):  # another key has the slot: look at the next
            slot[left] = (slot[left] + 1) & (len(self.table) - 1)
            there = self.table[slot[left]]
            good = there == key[left]
            rank[left[good]] = self.rank_at[slot[left[good]]]
            left = left[~good & (there >= 0)]
        return np.where(rank >= 0, rank << 32 | at, NONE)

    def _merge(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words of at most `width` bytes, a power of two from 2: all ids, and how many each word has."""
        n, m = np.array([len(w) for w in words], dtype=np.int64), len(words)
        inside = np.arange(width) < n[:, None]
        sym = np.full((m, width + 1), -1, dtype=np.int64)
        sym[:, :width][inside] = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after = np.minimum(np.arange(1, width + 2), n[:, None])  # the symbol to the right; n: none
        before = np.broadcast_to(np.arange(-1, width), (m, width + 1)).copy()  # -1: none
        tree = np.full((m, 2 * width), NONE, dtype=np.int64)
        r, i = np.nonzero(np.arange(width) < n[:, None] - 1)
        tree[r, width + i] = self._leaf(sym[r, i], sym[r, i + 1], i)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        flat, after, before, t = sym.ravel(), after.ravel(), before.ravel(), tree.ravel()
        row, root = np.arange(m), tree[:, 1].copy()
        while True:
            live = root != NONE
            row, root = row[live], root[live]
            if not len(row):
                break
            base, top = row * (width + 1), row * (2 * width)
            i = root & 0xFFFFFFFF
            at = base + i
            new, gone = self.merged[root >> 32], after[at]
            far, left = after[base + gone], before[at]
            flat[at], flat[base + gone], after[at] = new, -1, far
            before[base + far] = i  # the place after the last symbol stands for none
            right = flat[base + far]  # -1 there
            t[top + width + gone] = NONE
            t[top + width + i] = self._leaf(new, right, i)
            has = np.flatnonzero(left >= 0)
            t[(top + width + left)[has]] = self._leaf(flat[(base + left)[has]], new[has], left[has])
            a, b, c = (width + i) >> 1, (width + gone) >> 1, (width + np.maximum(left, 0)) >> 1
            while a[0]:  # all leaves are equally deep
                for x in (a, b, c):
                    two = top + 2 * x
                    t[top + x] = np.minimum(t[two], t[two + 1])
                a, b, c = a >> 1, b >> 1, c >> 1
            root = t[top + 1]
        left = sym >= 0
        return sym[left], left.sum(axis=1)

    def learn(self, words: list[str]) -> None:
        """Encodes pre-tokens that aren't remembered yet."""
        by: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode()
            by.setdefault(max(1, (len(raw) - 1).bit_length()), []).append((w, raw))
        for bits, group in by.items():
            step = max(1, (1 << 17) >> bits)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                ids, counts = self._merge([raw for _, raw in part], 1 << bits)
                packed, said, at = ids.astype(np.int32).tobytes(), list(map(str, ids.tolist())), 0
                for (w, _), n in zip(part, counts.tolist(), strict=True):
                    self.ids[w], self.said[w] = packed[4 * at : 4 * (at + n)], ",".join(said[at : at + n])
                    at += n

    # -- texts ---------------------------------------------------------------------------------------------------
    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """Lists of the text's pre-tokens, in order; a special token stands for itself."""
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield [part]
                continue
            try:
                part.encode("latin-1")
                pattern = self.pattern
            except UnicodeEncodeError:
                pattern = self.rare
            if len(part) <= CHUNK_CHARS:
                yield pattern.findall(part)
            else:
                found = pattern.finditer(part)
                while some := [m[0] for m in islice(found, CHUNK_TOKENS)]:
                    yield some

    def known(self, lists: list[list[str]]) -> None:
        distinct = set().union(*lists)
        if len(self.ids) + len(distinct) > REMEMBERED:
            keep = distinct | self.special.keys()
            self.ids = {w: v for w, v in self.ids.items() if w in keep}
            self.said = {w: v for w, v in self.said.items() if w in keep}
        self.learn([w for w in distinct if w not in self.ids])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        shift = self.starts[ids] - (np.cumsum(n) - n)
        return self.bytes[np.repeat(shift, n) + np.arange(n.sum())].tobytes()

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian int32 and in decimal, joined by commas."""
        lists = [[t for part in self.pre_tokens(text) for t in part] for text in texts]
        self.known(lists)
        ids, said = self.ids, self.said
        return [(b"".join([ids[t] for t in x]), ",".join([said[t] for t in x])) for x in lists]

    def encode_long(self, text: str) -> tuple[bytes, list[str]]:
        ids, said = [], []
        for part in self.pre_tokens(text):
            if part:
                self.known([part])
                ids.append(b"".join([self.ids[t] for t in part]))
                said.append(",".join([self.said[t] for t in part]))
        return b"".join(ids), said

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD."""
        parts = [self.decode_bytes(ids[k : k + CHUNK_CHARS]) for k in range(0, len(ids), CHUNK_CHARS)]
        return b"".join(parts).decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encodes every text and decodes the ids again.

    Returns id_col, the columns named in `keep`, ids array<int>, n_tokens long, ids_sha256 and decoded_sha256. Rows
    are independent: nothing is shuffled. A null or empty text has no ids; a null id and repeated rows pass through;
    an empty table gives an empty result; other columns are ignored, so that their names can't clash. A text over a
    million characters is worked on in pieces that end between pre-tokens. `tokenizer` is a path that exists on every
    executor.
    """
    kept = list(dict.fromkeys(c for c in (id_col, *keep) if c != text_col))
    names = [f"k{i}" for i in range(len(kept))]
    source = docs.select(*(F.col(c).alias(n) for c, n in zip(kept, names, strict=True)), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    schema = StructType([*source.schema.fields[:-1], *StructType.fromDDL("ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        sha = lambda *parts: (h := hashlib.sha256(), [h.update(p) for p in parts])[0].hexdigest()

        def result(rows: list[tuple[int, bytes, str, str]], batch: pa.RecordBatch) -> pa.RecordBatch:
            flat = np.frombuffer(b"".join([r[1] for r in rows]), dtype=np.int32)
            sizes = [len(r[1]) // 4 for r in rows]
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat))
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [batch.column(n).take(at) for n in names]
            return pa.RecordBatch.from_arrays([*columns, ids, pa.array(sizes, pa.int64()), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])], [*names, "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

        for batch in batches:
            texts, k = batch.column("t"), 0
            while k < len(texts):
                group, chars = [], 0
                while k < len(texts) and (chars < CHUNK_CHARS or not group):
                    group.append((k, t := texts[k].as_py()))
                    chars, k = chars + len(t), k + 1
                rows = []
                short = [(i, t) for i, t in group if len(t) <= CHUNK_CHARS]
                for (i, _), (ids, said) in zip(short, c.encode_many([t for _, t in short]), strict=True):
                    rows.append((i, ids, sha(said.encode()), sha(c.decode(np.frombuffer(ids, dtype=np.int32)))))
                for i, t in group:
                    if len(t) > CHUNK_CHARS:
                        ids, said = c.encode_long(t)
                        rows.append((i, ids, sha(*(("," * bool(n) + s).encode() for n, s in enumerate(said))), sha(c.decode(np.frombuffer(ids, dtype=np.int32)))))
                yield result(rows, batch)

    out = source.mapInArrow(work, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(kept, names, strict=True)), "ids", "n_tokens", "ids_sha256", "decoded_sha256")
