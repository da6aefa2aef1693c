"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, integer_id, numbered, without_columns

#: Labelled documents that a model is fitted on, at most; they are drawn by a hash of their id.
SAMPLE_DOCS = 4000
#: Chains of lines in training; longer documents are cut into several chains (scoring never cuts).
CHAIN = 64

#: Upper edges of the bins of each line feature.
EDGES: dict[str, tuple[float, ...]] = {
    "letters": (0.3, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9),
    "upper": (0.001, 0.02, 0.05, 0.1, 0.2, 0.5, 0.9),
    "digits": (0.001, 0.02, 0.05, 0.1, 0.3),
    "exclaim": (0.001, 0.05, 0.2, 0.5, 0.9),
    "bars": (0.001, 0.05, 0.2, 0.4, 0.8),
    "symbols": (0.001, 0.01, 0.03, 0.1, 0.2),
    "stops": (0.001, 0.05, 0.1, 0.2, 0.3, 0.5),
    "distinct": (0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 0.99),
    "commonest": (0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "echoes": (0.001, 0.02, 0.05, 0.1, 0.3, 0.6),
    "word_length": (2, 3, 4, 5, 6, 8, 12, 20),
    "words": (0, 1, 2, 4, 8, 16, 32, 64, 128),
    "start": (0.5, 1.5),
    "end": (0.5, 1.5),
}
BINS = max(map(len, EDGES.values())) + 1
#: Neighbouring lines whose features a line sees; a place outside the text is a bin of its own.
NEIGHBOURS = (-1, 0, 1)
OUTSIDE = BINS
WIDTH = len(EDGES)
WEIGHTS = len(NEIGHBOURS) * WIDTH * (BINS + 1)

UPPER, LOWER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
LETTERS = UPPER + LOWER + bytes(range(128, 256))
SYMBOLS = b"#$%&*+/<=>@\\^_`{}~[]"
_EDGES = [np.array(e) for e in EDGES.values()]


def line_values(line: bytes) -> tuple[float, ...]:
    """The features of one line, in the order of EDGES."""
    words = line.split()
    n, w = len(line), len(words)
    if not w:
        return (0.0,) * WIDTH
    solid = sum(map(len, words))
    letters = n - len(line.translate(None, LETTERS))
    counts = Counter(words)
    first, last = words[0][:1], line.rstrip()[-1:]
    return (
        letters / solid,
        (n - len(line.translate(None, UPPER))) / max(1, letters),
        (n - len(line.translate(None, DIGITS))) / solid,
        line.count(b"!") / w,
        line.count(b"|") / w,
        (n - len(line.translate(None, SYMBOLS))) / solid,
        (line.count(b".") + line.count(b",")) / w,
        len(counts) / w,
        max(counts.values()) / w if w > 3 else 0.0,
        sum(map(eq, words, words[1:])) / w,
        solid / w,
        w,
        0.0 if first.islower() else 1.0 if first in UPPER else 2.0,
        0.0 if last.isalnum() else 1.0 if last in b".?!" else 2.0,
    )


def line_bins(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bins (lines x features, uint8) and byte lengths of the lines; an empty text is one empty line."""
    lines = (text or "").encode().split(b"\n")
    values = np.array([line_values(x) for x in lines])
    bins = np.stack([np.searchsorted(e, values[:, k]) for k, e in enumerate(_EDGES)], axis=1).astype(np.uint8)
    return bins, np.array([len(x) for x in lines], float)


def slots(bins: np.ndarray) -> np.ndarray:
    """Weight numbers (lines x NEIGHBOURS x features) of each line's own and neighbouring features."""
    n = len(bins)
    padded = np.full((n + 2, WIDTH), OUTSIDE, np.int32)
    padded[1:-1] = bins
    base = np.arange(WIDTH, dtype=np.int32) * (BINS + 1)
    return np.concatenate([padded[1 + d : 1 + d + n] + base + k * WIDTH * (BINS + 1) for k, d in enumerate(NEIGHBOURS)], axis=1)


@dataclass
class Model:
    """weights: score of 'good' less 'bad' by feature; steps[i, j]: score of going from label i to j (0 bad, 1 good);
    slope, offset: calibration of the weighted mean marginal to the probability of a good document."""

    weights: np.ndarray
    steps: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def marginals(self, bins: np.ndarray) -> np.ndarray:
        """Probability that each line is good, by the forward-backward recursions in probability space."""
        good = np.exp(np.clip(self.weights[slots(bins)].sum(axis=1), -30, 30)).tolist()
        (s00, s01), (s10, s11) = np.exp(self.steps).tolist()
        n = len(good)
        forward, a0, a1 = [], 0.5, 0.5
        for k, g in enumerate(good):
            if k:
                a0, a1 = a0 * s00 + a1 * s10, (a0 * s01 + a1 * s11) * g
            else:
                a1 *= g
            z = a0 + a1
            a0, a1 = a0 / z, a1 / z
            forward.append((a0, a1))
        out, b0, b1 = [0.0] * n, 1.0, 1.0
        for k in range(n - 1, -1, -1):
            p0, p1 = forward[k][0] * b0, forward[k][1] * b1
            out[k] = p1 / (p0 + p1)
            g = good[k]
            b0, b1 = s00 * b0 + s01 * g * b1, s10 * b0 + s11 * g * b1
            z = b0 + b1
            b0, b1 = b0 / z, b1 / z
        return np.array(out)

    def mean(self, bins: np.ndarray, lengths: np.ndarray) -> float:
        """The marginals' mean, weighted by line length."""
        weight = lengths + 1
        return float((self.marginals(bins) * weight).sum() / weight.sum())

    def score(self, text: str | None) -> float:
        bins, lengths = line_bins(text)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * self.mean(bins, lengths) + self.offset))))


class Chains:
    """Chains of up to CHAIN lines, all of a chain with its document's label; longer documents are several chains."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        chains = [(slots(bins)[at : at + CHAIN], y) for bins, _, y in docs for at in range(0, len(bins), CHAIN)]
        chains.sort(key=lambda c: -len(c[0]))
        self.n = n = np.array([len(s) for s, _ in chains])
        self.top = int(n[0])
        self.y = y = np.array([y for _, y in chains])
        self.seen_by = np.concatenate([s for s, _ in chains])  # lines x features
        self.live = [int((n > t).sum()) for t in range(self.top)]  # chains are sorted, so those with a line t come first
        # Each label counts the same in total, however rare.
        self.weight = np.where(y == 1, 0.5 / max(1, n[y == 1].sum()), 0.5 / max(1, n[y == 0].sum()))
        self.mask = np.arange(self.top) < n[:, None]

    def likelihood(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """The weighted sum of the chains' log conditional likelihoods, and its gradient, by forward and backward recursions."""
        n, y, top, live, weight = self.n, self.y, self.top, self.live, self.weight
        w, trans = theta[:WEIGHTS], theta[WEIGHTS:].reshape(2, 2)
        e = np.zeros((len(n), top))
        e[self.mask] = w[self.seen_by].sum(axis=1)
        f = np.zeros((len(n), top, 2))
        f[:, 0, 1] = e[:, 0]
        for t in range(1, top):
            m = live[t]
            f[:m, t, 0] = np.logaddexp(f[:m, t - 1, 0] + trans[0, 0], f[:m, t - 1, 1] + trans[1, 0])
            f[:m, t, 1] = np.logaddexp(f[:m, t - 1, 0] + trans[0, 1], f[:m, t - 1, 1] + trans[1, 1]) + e[:m, t]
        b = np.zeros_like(f)
        pair = np.zeros((2, 2))
        z = np.logaddexp(f[np.arange(len(n)), n - 1, 0], f[np.arange(len(n)), n - 1, 1])
        for t in range(top - 1, 0, -1):
            m = live[t]
            good = e[:m, t] + b[:m, t, 1]
            for i in (0, 1):
                b[:m, t - 1, i] = np.logaddexp(trans[i, 0] + b[:m, t, 0], trans[i, 1] + good)
                pair[i, 0] += (weight[:m] * np.exp(f[:m, t - 1, i] + trans[i, 0] + b[:m, t, 0] - z[:m])).sum()
                pair[i, 1] += (weight[:m] * np.exp(f[:m, t - 1, i] + trans[i, 1] + good - z[:m])).sum()
        p = np.exp(np.minimum(0, f[:, :, 1] + b[:, :, 1] - z[:, None]))
        miss = ((y[:, None] - p) * weight[:, None])[self.mask]
        grad = np.zeros_like(theta)
        grad[:WEIGHTS] = np.bincount(self.seen_by.reshape(-1), np.repeat(miss, self.seen_by.shape[1]), WEIGHTS)
        seen = np.zeros((2, 2))
        seen[0, 0], seen[1, 1] = (weight * (n - 1) * (y == 0)).sum(), (weight * (n - 1) * (y == 1)).sum()
        grad[WEIGHTS:] = (seen - pair).reshape(-1)
        own = np.where(y == 1, e.sum(axis=1) + trans[1, 1] * (n - 1), trans[0, 0] * (n - 1))
        return float((weight * (own - z)).sum()), grad


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 150, rate: float = 0.2, decay: float = 1e-3) -> Model:
    """Maximum conditional likelihood of the lines' labels (each its document's), by Adam over all chains at once.

    docs: (bins, lengths, label), of any number of lines; a document of no text is
    one empty line. Without documents of both labels the model is
    neutral and scores the share of label 1, or 0.5 without any.
    """
    labels = np.array([y for *_, y in docs], float)
    model = Model(np.zeros(WEIGHTS), np.zeros((2, 2)))
    if not len(docs) or labels.min() == labels.max():
        share = min(0.99, max(0.01, labels.mean())) if len(docs) else 0.5
        model.slope, model.offset = 0.0, math.log(share / (1 - share))
        return model
    chains = Chains(docs)
    theta = np.zeros(WEIGHTS + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        grad = chains.likelihood(theta)[1] - decay * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8) / math.sqrt(step)
    model.weights, model.steps = theta[:WEIGHTS].copy(), np.clip(theta[WEIGHTS:].reshape(2, 2), -8, 8)
    model.slope, model.offset = _calibrated(np.array([model.mean(b, l) for b, l, _ in docs]), labels)
    return model


def _calibrated(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic regression of y on x, lightly penalised, by Newton's method."""
    theta, design = np.zeros(2), np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (y - p) - 1e-2 * theta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        theta += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def held_out(id_col: str = "doc_id"):
    """True for the fifth of ids that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on at most sample_docs labelled documents outside the held-out fifth.

    The sample is the labels with the smallest hash of (id, label); only their
    lines' bins and lengths reach the driver, about 20 bytes a line. Labels other
    than 0 and 1, null labels and ids without a document are left out. Ids must
    be integers; other columns, whatever their names, are ignored.
    """
    some = labels.select(integer_id(labels, id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(~held_out("id"))
    some = some.distinct().orderBy(F.xxhash64("id", "y"), "id", "y").limit(sample_docs)
    texts = docs.select(integer_id(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [line_bins(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b.tobytes() for b, _ in rows], pa.binary()), pa.array([l.tolist() for _, l in rows], pa.list_(pa.float64()))],
                ["id", "y", "bins", "lengths"],
            )

    rows = texts.join(F.broadcast(some), "id").select("id", "y", "text").mapInArrow(kernel, "id long, y int, bins binary, lengths array<double>").collect()
    rows.sort(key=lambda r: (r["id"], r["y"], r["bins"]))
    return fit([(np.frombuffer(r["bins"], np.uint8).reshape(-1, WIDTH), np.array(r["lengths"]), r["y"]) for r in rows])


def scored(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score (double, 0 to 1, higher is better) and predicted (int); columns of these names, in capitals or not, are replaced.

    A null or empty text is scored as one empty line. Whole texts of any number
    of lines are read; rows are scored alone, so repeated rows get equal scores.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = without_columns(docs, ["score", "predicted"])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "score double"])
    names = base.columns
    at_text = names.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            new = pa.array([held.value.score(t) for t in table.column(at_text).to_pylist()], pa.float64())
            yield from pa.table([*table.columns, new], names=[*names, "score"]).to_batches()

    return base.mapInArrow(kernel, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the model predicts to be good, with docs' own columns and their values, whatever their names."""
    found = scored(numbered(docs), model, f"c{docs.columns.index(text_col)}", threshold)
    return found.where("predicted = 1").select(*numbered(docs).columns).toDF(*docs.columns)
