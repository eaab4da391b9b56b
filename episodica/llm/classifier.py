"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import held_out

#: Labelled documents that are fitted on, at most.
SAMPLE = 4000
ROUNDS, RIDGE = 160, 1e-3
FEATURES = ["words", "bytes", "word length", "symbols", "digits", "capitals", "stops", "other bytes", "different words", "repeats of the word before", "equal to an earlier line", "blank", "lines of the document"]


def _marks() -> np.ndarray:
    kind = np.zeros(256, dtype=np.int64)
    for i, chars in enumerate((b"#*$%&|<>@~^=+_\\{}[]/", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?"), 1):
        kind[list(chars)] = i
    kind[128:] = 5
    return kind


_KIND = _marks()


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines x 3 FEATURES: each line's own, the line's before and after; and the lines' lengths in bytes, plus 1."""
    lines = text.encode("utf-8", "replace").split(b"\n")
    own, seen = np.zeros((len(lines), len(FEATURES)), dtype=np.float32), set()
    size = np.array([len(x) for x in lines], dtype=np.int64)
    counts = np.zeros((len(lines), 6))
    if size.sum():
        kind = _KIND[np.frombuffer(b"".join(lines), dtype=np.uint8)]
        counts = np.bincount(np.repeat(np.arange(len(lines)), size) * 6 + kind, minlength=6 * len(lines)).reshape(-1, 6)
    for k, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if n:
            own[k, 0], own[k, 2] = n, size[k] / n
            own[k, 8], own[k, 9], own[k, 10] = len(set(words)) / n, sum(map(eq, words, words[1:])) / n, line in seen
            seen.add(line)
        else:
            own[k, 8], own[k, 11] = 1, 1
    own[:, 0], own[:, 1], own[:, 2] = np.log1p(own[:, 0]), np.log1p(size), np.log1p(own[:, 2])
    own[:, 3:8] = counts[:, 1:] / np.maximum(size, 1)[:, None]
    own[:, 12] = np.log(len(lines))
    none = np.zeros((1, len(FEATURES)), dtype=np.float32)
    return np.hstack([own, np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])]), size + 1


@dataclass
class Field:
    """weights: of the standardised features, the constant last; move: log potentials from state to state (0 bad, 1 good)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    move: np.ndarray

    def emission(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]


def _steps(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For documents of n lines each, the longest first: starts, order, and at each step the lines that stand there."""
    order = np.argsort(-n, kind="stable")
    start = (np.cumsum(n) - n)[order]
    live = np.searchsorted(-n[order], -np.arange(n.max()), side="left")
    return start, order, [start[:a] + t for t, a in enumerate(live)]


def chain(e: np.ndarray, steps: list[np.ndarray], move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of good against bad at each line; their sum is the marginal's."""
    f, b = e.copy(), np.zeros_like(e)
    for last, at in zip(steps, steps[1:], strict=False):
        x = f[last[: len(at)]]
        f[at] += np.logaddexp(x + move[1, 1], move[0, 1]) - np.logaddexp(x + move[1, 0], move[0, 0])
    for at, after in zip(steps[-2::-1], steps[:0:-1], strict=True):
        x = e[after] + b[after]
        b[at[: len(after)]] = np.logaddexp(x + move[1, 1], move[1, 0]) - np.logaddexp(x + move[0, 1], move[0, 0])
    return f, b


def fit(xs: list[np.ndarray], labels: list[int]) -> Field:
    """Maximum likelihood by gradient steps with momentum (Adam); each line bears its document's label."""
    n = np.array([len(x) for x in xs])
    x, y = np.concatenate(xs).astype(np.float64), np.repeat(np.array(labels, dtype=np.float64), n)
    field = Field(x.mean(axis=0), x.std(axis=0) + 1e-3, np.zeros(x.shape[1] + 1), np.zeros((2, 2)))
    z = np.hstack([np.clip((x - field.mean) / field.scale, -8, 8), np.ones((len(x), 1))])
    _, _, steps = _steps(n)
    # Each document counts alike, and both labels weigh as their documents do.
    weight = np.repeat(1 / n, n)
    links = [(last[: len(at)], at) for last, at in zip(steps, steps[1:], strict=False)]
    tail, head = (np.concatenate([p[i] for p in links]) if links else np.zeros(0, dtype=np.int64) for i in (0, 1))
    theta, m, v = np.zeros(z.shape[1] + 4), 0.0, 0.0
    for k in range(1, ROUNDS + 1):
        move = theta[-4:].reshape(2, 2)
        e = z @ theta[:-4]
        f, b = chain(e, steps, move)
        grad = np.zeros_like(theta)
        grad[:-4] = z.T @ (weight * (y - 1 / (1 + np.exp(-np.clip(f + b, -500, 500))))) / len(n)
        if len(tail):
            left, right = f[tail], e[head] + b[head]
            joint = np.stack([i * left + j * right + move[i, j] for i in (0, 1) for j in (0, 1)], axis=1)
            joint = np.exp(joint - joint.max(axis=1, keepdims=True))
            joint /= joint.sum(axis=1, keepdims=True)
            real = np.stack([(y[tail] == i) & (y[head] == j) for i in (0, 1) for j in (0, 1)], axis=1)
            grad[-4:] = (weight[tail, None] * (real - joint)).sum(axis=0) / len(n)
        grad -= RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    field.weights, field.move = theta[:-4], theta[-4:].reshape(2, 2)
    return field


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """Fits on at most `sample` labelled rows that aren't held out, the first by a hash of their ids.

    Ids with unequal labels take the lower one. None if there are no such rows.
    """
    rows = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality"))
    drawn = F.broadcast(rows.orderBy(F.xxhash64("id"), "id").limit(sample))  # `sample` rows at most
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(drawn, "id").select("id", "text", "quality")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [line_features(t.as_py())[0].astype(np.float32) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(a) for a in x], pa.int64()), pa.array([a.tobytes() for a in x], pa.binary()), b.column("quality").cast(pa.int64())], ["id", "n", "x", "quality"])

    table = found.mapInArrow(measure, f"id {found.schema['id'].dataType.simpleString()}, n long, x binary, quality long").toPandas()
    if not len(table):
        return None
    table = table.sort_values(["id", "n", "x"])
    return fit([np.frombuffer(x, dtype=np.float32).reshape(n, -1) for x, n in zip(table["x"], table["n"], strict=True)], table["quality"].tolist())


def score(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Returns id_col, held_out, score, predicted int, n_lines and n_bad_lines long.

    The score is the mean of the lines' marginals of being good, weighed by length. Null texts are empty: one blank line. Without a
    field (no labels) every score is 0.5. Rows are independent; a null id counts as held out; repeated rows pass through; an empty
    table gives an empty result; long texts are read whole; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few dozen numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for whole in batches:
            for k in range(0, len(whole), 500):
                b = whole.slice(k, 500)
                both = [line_features(t.as_py()) for t in b.column("text")]
                n = np.array([len(size) for _, size in both], dtype=np.int64)
                size = np.concatenate([size for _, size in both])
                if field:
                    f, back = chain(np.concatenate([field.emission(x) for x, _ in both]), _steps(n)[2], field.move)
                    good = 1 / (1 + np.exp(-np.clip(f + back, -500, 500)))
                else:
                    good = np.full(len(size), 0.5)
                at = np.cumsum(n) - n
                marks = np.add.reduceat(good * size, at) / np.add.reduceat(size, at)
                bad = np.add.reduceat((good < 0.5).astype(np.int64), at)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.clip(marks, 0, 1)), pa.array(n), pa.array(bad)], ["id", "score", "n_lines", "n_bad_lines"])

    out = source.mapInArrow(work, f"id {source.schema['id'].dataType.simpleString()}, score double, n_lines long, n_bad_lines long")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines", "n_bad_lines")
