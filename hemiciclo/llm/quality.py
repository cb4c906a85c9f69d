"""Quality rules: exact text statistics, and a logistic regression over hashed n-grams learned from quality labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemiciclo.llm.common import hash_sample

#: Hash bits of a feature; half of the table is for bytes' n-grams, half for words'.
BITS = 13
HALF = 1 << (BITS - 1)
#: Odd factors of the hashes, modulo 2**64.
MIX, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Labelled documents that the regression is fitted on, at most.
TRAIN_DOCS = 4000
#: Documents whose probability of good quality is below it are not kept.
THRESHOLD = 0.35
SYMBOLS = b"#*$%&|<>"
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    kinds = len(number)
    if kinds == n:
        return 0
    pairs = ids[:-1] * kinds + ids[1:]
    if kinds >= 1 << 20:
        pairs, kinds = np.unique(pairs, return_inverse=True)[1], kinds
    windows = pairs[:-1] * kinds + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\v\f")]
    return len(lines) - len(set(lines))


def text_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    octets = np.frombuffer(raw, np.uint8)
    words = raw.split()
    in_words = int((~_SPACE[octets] & ((octets & 0xC0) != 0x80)).sum())
    return len(words), in_words, int(_SYMBOL[octets].sum()), duplicate_lines(text), repeated_words(words)


def _word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of whole words: differences of prefix sums, shifted back to the word's start."""
    n = len(points)
    up, down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    up[1:], down[1:] = BASE, BASE_INVERSE
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * up[:n], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the whole text: of three characters (code points), and of one and two whole words."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    shift = np.uint64(65 - BITS)
    grams = ((c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42)) * MIX) >> shift if len(c) > 2 else np.zeros(0, np.uint64)
    space = _SPACE[np.minimum(c, np.uint64(255))]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return grams.astype(np.uint32), np.zeros(0, np.uint32)
    one = _word_hashes(c, starts, ends)
    one = (one ^ one >> np.uint64(32)) * MIX
    two = (one[:-1] * MIX) ^ one[1:]
    mixed = np.concatenate([one, (two ^ two >> np.uint64(32)) * MIX])
    return grams.astype(np.uint32), (mixed >> shift).astype(np.uint32) + np.uint32(HALF)


def feature_row(text: str) -> np.ndarray:
    """Shares of the two kinds of n-grams, each summing to 1."""
    row = np.zeros(2 * HALF, np.float32)
    for part in features(text):
        if len(part):
            row += np.bincount(part, minlength=2 * HALF).astype(np.float32) / len(part)
    return row


@dataclass
class QualityModel:
    """weights per n-gram share, then Platt's slope and intercept on the decision value."""

    weights: np.ndarray
    bias: float
    slope: float
    intercept: float

    def probability(self, text: str) -> float:
        z = self.bias + sum(float(self.weights[part].mean()) for part in features(text) if len(part))
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.intercept, -500, 500))))


def _descend(x: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression by Nesterov's accelerated gradient."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    pace = 4.0 / (float((x**2).sum(axis=1).max(initial=1e-9)) + 1)
    v, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        error = (1 / (1 + np.exp(-np.clip(x @ v + vb, -60, 60))) - y).astype(np.float32) / len(y)
        w1, b1 = v - pace * (x.T @ error + penalty * v), vb - pace * float(error.sum())
        t1 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return w, b


def fit_platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and intercept of a logistic curve through decision values, with Platt's smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -60, 60)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        m = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        da, dc = np.linalg.solve(m, [(g * z).sum(), g.sum()])
        step = min(1.0, 5 / (abs(da) + abs(dc) + 1e-12))
        a, c = a - step * da, c - step * dc
    return (a, c) if a > 0 else (1.0, 0.0)


def fit_quality(x: np.ndarray, y: np.ndarray, *, penalty: float = 2e-4, steps: int = 300, folds: int = 3) -> QualityModel:
    """Weights from all rows; Platt's curve from decision values of folds that were held out."""
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-4)
    scaled = x * scale
    z = np.zeros(len(y))
    for k in range(folds):
        out = np.arange(len(y)) % folds == k
        w, b = _descend(scaled[~out], y[~out], penalty, steps)
        z[out] = scaled[out] @ w + b
    slope, intercept = fit_platt(z, y)
    w, b = _descend(scaled, y, penalty, steps)
    return QualityModel((w * scale).astype(np.float32), float(b), float(slope), float(intercept))


def train_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> QualityModel | None:
    """From at most `train_docs` labelled documents (those of the least hashes, so the broadcast side is bounded); None unless both labels occur.

    Features are made on the executors; a row of fixed size for each comes to the driver.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    chosen = hash_sample(usable.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_y")), "_id", train_docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [feature_row(t or "").astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], names=["i", "y", "x"])

    texts = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select(F.col(id_col).cast("long"), F.col(text_col), "_y")
    got = sorted((r["i"], bytes(r["x"]), r["y"]) for r in texts.mapInArrow(rows, "i long, y int, x binary").toLocalIterator())
    y = np.array([r[2] for r in got], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    x = np.stack([np.frombuffer(r[1], np.float16) for r in got]).astype(np.float32)
    return fit_quality(x, y)


def judge_quality(docs: DataFrame, model: QualityModel | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, min_words: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability for every row.

    base_failed: fewer than `min_words` words, or more than half of the words in repeated 3-word windows. Of the
    others, those whose probability of good quality is at least `threshold` are kept; without a model (no labels of
    both kinds) all are; a probability that equals the threshold is kept. NULL and empty texts have no words and fail.
    Repeated rows are judged each; other columns, whatever their names, are not read; an empty table gives no rows. One
    narrow pass over whole texts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]
    types = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64()]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = sent.value
        for batch in batches:
            out = []
            texts = (t for at in range(0, batch.num_rows, 512) for t in batch.column(1).slice(at, 512).to_pylist())
            for text in texts:
                n, chars, symbols, lines, repeats = text_statistics(text or "")
                failed = n < min_words or 100 * repeats > 50 * n
                p = 1.0 if learned is None else learned.probability(text or "")
                out.append((n, chars, symbols, lines, repeats, failed, not failed and p >= threshold, p))
            columns = zip(*out, strict=True) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judged, kinds)
