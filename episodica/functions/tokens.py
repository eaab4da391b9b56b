"""Token counts and cuts to a token budget, by a real tokenizer: a file of the tokenizers library, at a path that every executor has.

Python only counts; rows are independent, texts go through one at a time.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# What stands where a text was cut, the fewest characters that stay, and the front's part of them.
MARK, LEAST, FRONT = "\n...[truncated for prompt budget]...\n", 32, 0.45
KEEP = ("head", "tail", "head_tail")
#: Where a blank follows what is no white space: no token of a byte-level tokenizer's pattern crosses that place. U+180E is white space to some libraries only.
PLACE = re.compile(r"(?<=[^\s\u180e])(?=[ \t\n\r])")
#: A longer piece between two such places sends its text to the general way; so many pieces' counts are remembered.
LONGEST, REMEMBERED = 200, 200_000


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def token_count(x: Column, path: str) -> Column:
    """Tokens of a text without special ones (long); 0 for null and empty."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        t = tokenizer(path)
        return pd.Series([len(t.encode(s, add_special_tokens=False).ids) if s else 0 for s in texts], dtype="int64")

    return count(x)


def shortened(text: str, chars: int, keep: str, mark: str = MARK) -> str:
    """What is given out of a text of which so many characters stay."""
    if keep == "head_tail":
        front = max(LEAST // 2, int(chars * FRONT))
        back = max(LEAST // 2, chars - front)
        return text[:front].rstrip() + mark + text[-back:].lstrip()
    return text[:chars] + mark.rstrip("\n") if keep == "head" else mark.lstrip("\n") + text[-chars:]


class Pieces:
    """Token counts by piece: those of a text's pieces add up to the text's."""

    def __init__(self, path: str):
        self.t, self.known = tokenizer(path), {}
        said = json.loads(self.t.to_str())
        pattern = said["pre_tokenizer"] or {}
        plain = all(not a["lstrip"] and not a["rstrip"] and not re.search(r"\s", a["content"]) for a in said["added_tokens"])
        #: Whether the tokenizer is of the kind that can be counted so.
        self.fits = pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not pattern.get("add_prefix_space", True) and not said["normalizer"] and plain

    def one(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = len(self.t.encode(piece, add_special_tokens=False).ids)
            if len(piece) <= LONGEST:
                self.known[piece] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.one, PLACE.split(text)))


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _fitted_by_pieces(text: str, p: Pieces, budget: int, keep: str, mark: str) -> str | None:
    """fitted() of a stripped text, of which only as many pieces are counted at either end as reach the budget; None if one of them is long.

    Pieces that a cut leaves whole, and the mark's, bound its count from below, and the bound grows with the cut: from the longest cut within
    it downwards the first that fits is the longest of all.
    """
    at, sums = [0], [0]
    for m in PLACE.finditer(text):
        if m.start() - at[-1] > LONGEST:
            return None
        sums.append(sums[-1] + p.one(text[at[-1] : m.start()]))
        at.append(m.start())
        if sums[-1] > budget:
            break
    else:
        if len(text) - at[-1] > LONGEST:
            return None
        if sums[-1] + p.one(text[at[-1] :]) <= budget:
            return text
    size, width = len(text), 8 * budget
    while True:  # from the end; what the slice begins with is left to a wider one
        first = max(0, size - width)
        back_at, back_sums, end = [size], [0], size
        for k in reversed(([0] if first == 0 else []) + [first + m.start() for m in PLACE.finditer(text[first:])]):
            if end - k > LONGEST:
                return None
            back_sums.append(back_sums[-1] + p.one(text[k:end]))
            back_at.append(k)
            end = k
            if back_sums[-1] > budget:
                break
        if back_sums[-1] > budget or first == 0:
            break
        width *= 2
    back_at.reverse()
    back_sums.reverse()
    of_mark = PLACE.split(mark)
    fixed = sum(map(p.one, of_mark[1:-1])) + (p.one(of_mark[0]) if keep == "head_tail" and len(of_mark) > 1 and mark[0] in " \t\n\r" else 0)

    def parts(n: int) -> tuple[int, int, int]:
        """Tokens of the pieces left whole, and where the first that isn't begins and the last ends."""
        front, back = {"head": (n, 0), "tail": (0, n), "head_tail": (max(LEAST // 2, int(n * FRONT)), 0)}[keep]
        if keep == "head_tail":
            back = max(LEAST // 2, n - front)
            while front and text[front - 1].isspace():
                front -= 1
        start = size - back
        while keep == "head_tail" and start < size and text[start].isspace():
            start += 1
        i = bisect_right(at, max(front - 1, 0)) - 1
        j = min(bisect_left(back_at, start + 1), len(back_at) - 1)
        return sums[i] + back_sums[j], at[i], back_at[j]

    low, high = LEAST - 1, max(LEAST, size)
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if parts(half)[0] + fixed <= budget else (low, half - 1)
    for n in range(low, LEAST - 1, -1):
        whole, a, b = parts(n)
        cut = shortened(text, n, keep, mark)
        if whole + p.count(cut[a : len(cut) - (size - b)]) <= budget:
            return cut
    return text[-LEAST:] if keep == "tail" else text[:LEAST]


def fitted(text: str, path: str, budget: int, keep: str, mark: str = MARK) -> str:
    """The stripped text if it has at most `budget` tokens, else its longest cut that has.

    Byte-level tokenizers count by pieces (_fitted_by_pieces), unless a piece is long. Else the token that reaches the budget bounds what is tried, so that no try is much longer than the budget. Counts of longer and longer cuts
    grow but for a token's length: a binary search finds the place, and all lengths within the text's longest token from there are tried.
    Where not even LEAST characters with the mark fit, they are given out without it. A budget of 0 or less leaves the text whole.
    """
    text = text.strip()
    if not text or budget <= 0:
        return text
    p = pieces(path)
    if p.fits and (cut := _fitted_by_pieces(text, p, budget, keep, mark)) is not None:
        return cut
    t = p.t
    whole = t.encode(text, add_special_tokens=False)
    if len(whole.ids) <= budget:
        return text
    reach = max(b - a for a, b in whole.offsets) + 2
    front, back = whole.offsets[budget - 1][1], len(text) - whole.offsets[len(whole.ids) - budget][0]
    most = min(len(text), {"head": front, "tail": back, "head_tail": front + back}[keep] + reach)
    fits = lambda lengths: [len(e.ids) <= budget for e in t.encode_batch([shortened(text, n, keep, mark) for n in lengths], add_special_tokens=False)]
    low, high = LEAST - 1, max(LEAST, most)
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if fits([half])[0] else (low, half - 1)
    while True:
        ahead = range(low + 1, min(low + reach, len(text)) + 1)
        longer = [n for n, ok in zip(ahead, fits(ahead), strict=True) if ok and n >= LEAST]
        if not longer:
            break
        low = longer[-1]
    if low < LEAST:
        return text[-LEAST:] if keep == "tail" else text[:LEAST]
    return shortened(text, low, keep, mark)


def fit_tokens(x: Column, path: str, budget: int, keep: str = "head_tail", mark: str = MARK) -> Column:
    """fitted() of a text column; null stays null."""
    if keep not in KEEP:
        raise ValueError(f"keep must be one of {KEEP}, not {keep!r}")

    @F.pandas_udf("string")
    def fit(texts: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else fitted(s, path, budget, keep, mark) for s in texts], dtype="object")

    return fit(x)
