"""Document quality by Bradley-Terry ranking.

Preference pairs (a document of label 1 is preferred to one of label 0) teach a linear score of text features: the logistic loss is taken
on the difference of the two documents' features, so only the order of documents is learned. Every pair of labelled documents counts. A
quantile of all their scores then becomes the threshold, and scores are mapped to 0..1 so that the threshold lies at a fixed value.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialize, scratch, table

FEATURES = ("letters", "upper", "digits", "space", "marks", "pipes", "log_words", "word_length", "length_spread", "distinct", "adjacent", "distinct_lines", "ends_plain", "marked_words", "upper_words", "distinct_letters", "top_word", "sentence")
_ASCII = np.zeros(256, np.int64)
_ASCII[ord("A") : ord("Z") + 1] = 1
_ASCII[ord("a") : ord("z") + 1] = 2
_ASCII[ord("0") : ord("9") + 1] = 3
for _c in b" \t\r\n\x0b\x0c":
    _ASCII[_c] = 4
for _c in b".,;:?'\"()-":
    _ASCII[_c] = 5
_ASCII[ord("|")] = 6
_ASCII[128:] = 7
_NON_ASCII_UPPER = re.compile("[À-ÖØ-ÞΑ-ΩА-Я]")


def features(text: str) -> np.ndarray:
    """len(FEATURES) numbers for one whole text, all within 0..1 or nearly; zeros for an empty one."""
    out = np.zeros(len(FEATURES), np.float32)
    words = text.split()
    if not words:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_ASCII[np.frombuffer(raw, np.uint8)], minlength=8)
    foreign_upper = len(_NON_ASCII_UPPER.findall(text)) if kinds[7] else 0
    upper, letters = kinds[1] + foreign_upper, kinds[1] + kinds[2] + kinds[7] / 2
    n, size = len(words), max(1, len(text))
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    tails = [w[-1] for w in words]
    marked = sum(t not in ".,;:?'\"()-" and not t.isalnum() for t in tails)
    out[:] = (
        letters / size,
        upper / max(1, letters),
        kinds[3] / size,
        kinds[4] / size,
        kinds[0] / size,
        kinds[6] / size,
        min(1.0, np.log1p(n) / 8),
        min(2.0, lengths.mean() / 10),
        min(2.0, lengths.std() / 10),
        len(counts) / n ** 0.75 / 4,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(set(lines)) / len(lines) if lines else 0,
        sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / len(lines) if lines else 0,
        marked / n,
        sum(map(str.isupper, words)) / n,
        min(1.0, len(set(text)) / 60),
        max(counts.values()) / n,
        min(2.0, n / (1 + sum(t in ".?!" for t in tails)) / 20),
    )
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """Features, their squares, and three steps of each: a line's slope alone can't tell a few marks from many."""
    soft = [1 / (1 + np.exp(-(x - c) * 24)) for c in (0.05, 0.2, 0.5)]
    return np.concatenate([x, x * x, *soft], axis=1)


@dataclass(frozen=True)
class Params:
    #: All pairs together weigh as much as so many, against the penalty.
    pairs: int = 150_000
    penalty: float = 2.0
    rounds: int = 25
    #: Where the threshold lies after the mapping.
    cut: float = 0.3
    #: Cells of scores: an opponent counts with the mean score of its cell.
    cells: int = 512


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = (expand(x.astype(np.float64)) - self.mean) / self.scale @ self.weights
        z = np.clip((raw - self.threshold) / self.spread + np.log(self.cut / (1 - self.cut)), -40, 40)
        return 1 / (1 + np.exp(-z))


def summed(known: DataFrame, part) -> tuple[list, list]:
    """part(features, good) gives two lists of arrays for a batch of rows: the first are added over all rows, of the second the least is kept."""

    def merge(one, two):
        return [a + b for a, b in zip(one[0], two[0], strict=True)], [np.minimum(a, b) for a, b in zip(one[1], two[1], strict=True)]

    def run(batches):
        found = None
        for batch in batches:
            if batch.num_rows:
                good = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
                got = part(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(np.float64), good)
                found = got if found is None else merge(found, got)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["part"])

    found = None
    for row in known.select("good", "features").mapInArrow(run, "part binary").collect():
        got = pickle.loads(row[0])
        found = got if found is None else merge(found, got)
    return found or ([], [])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_pairs(known: DataFrame, p: Params) -> Model | None:
    """Bradley-Terry over all pairs of a good and a bad row of known (good, features), by Newton's method. None unless both labels occur.

    The work grows with the rows, not the pairs: a row meets the other label's rows as counts by cells of their scores. Each round reads
    known twice; the driver gets sums of a fixed size from each task.
    """
    sums, _ = summed(known, lambda x, good: ([np.bincount(good, minlength=2), expand(x).sum(0)], []))
    if not sums or not sums[0].all():
        return None
    n, mean = sums[0], sums[1] / sums[0].sum()

    def moments(x, good):
        c = expand(x) - mean
        return [c.T @ c], []

    spread = summed(known, moments)[0][0] / n.sum()
    scale = np.sqrt(np.diag(spread))
    scale[scale < 1e-9] = 1
    spread = spread / scale / scale[:, None]
    weight = p.pairs / (float(n[0]) * float(n[1]))
    w = np.zeros(len(mean))
    for _ in range(p.rounds):
        step = newton_step(known, mean, scale, w, max(1e-6, float(np.sqrt(w @ spread @ w))), weight, p)
        w -= step * min(1, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    # the score quantile that leaves below it as large a share as the labels have of 0
    below = in_order(known, mean, scale, w, int(n[0]))
    return Model(mean, scale, w, sum(below) / 2, max(1e-6, float(np.sqrt(w @ spread @ w)) / 3), p.cut)


def newton_step(known: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, deviation: float, weight: float, p: Params) -> np.ndarray:
    """Gradient and Hessian of the loss over all pairs, each of this weight, at w; deviation is that of the scores, whose mean is 0."""
    k = p.cells

    def placed(x, good):
        z = (expand(x) - mean) / scale
        s = z @ w
        return z, s, np.clip((s / deviation + 6) * (k / 12), 0, k - 1).astype(np.int64) + k * good  # cells of bad ones, then of good ones

    def count(x, good):
        _, s, cell = placed(x, good)
        return [np.bincount(cell, minlength=2 * k), np.bincount(cell, s, minlength=2 * k)], [s.min(), -s.max()]

    (rows, total), (low, high) = summed(known, count)
    full = [np.flatnonzero(rows[:k]), np.flatnonzero(rows[k:]) + k]
    at = total / np.maximum(rows, 1)
    # what a row of a score adds to the gradient: over all opponents, the chance that the wrong one of the two wins
    grid = np.linspace(low, -high, 4097)
    wrong = [sum(rows[v] * sigmoid(sign * (grid - at[v])) for v in full[1 - label]) for label, sign in ((0, 1), (1, -1))]
    # what it adds to the Hessian, by cells on both sides, so that the whole stays positive
    chance = sigmoid(at[full[1]][:, None] - at[full[0]])
    curve = chance * (1 - chance)
    bend = np.zeros(2 * k)
    bend[full[1]], bend[full[0]] = curve @ rows[full[0]], rows[full[1]] @ curve

    def add(x, good):
        z, s, cell = placed(x, good)
        slope = np.where(good, -np.interp(s, grid, wrong[1]), np.interp(s, grid, wrong[0]))
        order = np.argsort(cell, kind="stable")
        found, begin = np.unique(cell[order], return_index=True)
        by_cell = np.zeros((2 * k, len(w)))
        by_cell[found] = np.add.reduceat(z[order], begin)
        return [slope @ z, (z * bend[cell][:, None]).T @ z, by_cell], []

    (gradient, own, by_cell), _ = summed(known, add)
    across = by_cell[full[1]].T @ curve @ by_cell[full[0]]
    return np.linalg.solve(weight * (own - across - across.T) + p.penalty * np.eye(len(w)), weight * gradient + p.penalty * w)


def in_order(known: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, n: int, cells: int = 1024) -> tuple[float, float]:
    """The n-th smallest score (from 1) and the one after it (n + 1 rows at least), exactly: each pass counts within the cell that holds it."""

    def scores(x):
        return np.round((expand(x) - mean) / scale @ w, 9)  # the same in every pass

    def ends(x, good):
        s = scores(x)
        return [], [s.min(), -s.max()]

    low, high = summed(known, ends)[1]
    high, below = -high, 0
    while low < high:

        def count(x, good, low=low, high=high):
            s = scores(x)
            s = s[(s >= low) & (s <= high)]
            cell = np.minimum((s - low) / (high - low) * cells, cells - 1).astype(np.int64)
            least, most = np.full(cells, np.inf), np.full(cells, np.inf)
            np.minimum.at(least, cell, s)
            np.minimum.at(most, cell, -s)
            return [np.bincount(cell, minlength=cells)], [least, most]

        (rows,), (least, most) = summed(known, count)
        upto = below + np.cumsum(rows)
        c = int(np.searchsorted(upto, n))
        low, high, below = float(least[c]), -float(most[c]), int(upto[c] - rows[c])

    def after(x, good):
        s = scores(x)
        return [np.sum(s <= low)], [np.min(s, where=s > low, initial=np.inf)]

    (upto,), (following,) = summed(known, after)
    return float(low), float(low if upto > n else following)


def with_features(docs: DataFrame, keep: tuple[str, ...], *carry: Column) -> DataFrame:
    """Columns keep and carry, and features array<float> of column text; null text counts as empty."""
    fields = docs.select(*[F.col(f"`{k}`") for k in keep], *carry).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "features array<float>"])

    def run(batches):
        for batch in batches:
            rows = [features(t.as_py() or "") for t in batch.column(batch.num_columns - 1)]
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.float32), pa.float32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [f.name for f in fields] + ["features"])

    return docs.select(*[F.col(f"`{k}`") for k in keep], *carry, F.col("text").alias("__text")).mapInArrow(run, schema)


def fit(described: DataFrame, labels: DataFrame, p: Params = Params()) -> Model | None:
    """described: doc_id and features; labels: doc_id and quality (0 or 1; null and other values are left out).

    A document with several labels takes the majority, and with a draw none. All labelled rows of described are learned from.
    """
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("m")).where("m <> 0.5").select("doc_id", (F.col("m") > 0.5).alias("good"))
    known = described.select("doc_id", "features").join(marks, "doc_id").select("good", "features")
    with scratch():
        return fit_pairs(materialize(known, "labelled"), p)


def score(described: DataFrame, model: Model | None, keep: tuple[str, ...]) -> DataFrame:
    """Columns keep of described, score (0..1) and predicted (1 where score >= cut). Without a model every score is 0.5."""
    fields = described.select(*keep).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double, predicted int"])

    def run(batches):
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= (model.cut if model else 0.3)).astype(np.int32))], [f.name for f in fields] + ["score", "predicted"])

    return described.select(*keep, "features").mapInArrow(run, schema)


def op1_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text; learned from labelled documents whose crc32 modulo 5 is not 0.

    Null and empty texts have a score too; repeated rows stay; a document without a label is scored like any other.
    """
    docs = table(spark, sf_dir, "documents")
    described = materialize(with_features(docs, ("doc_id",), (fold("doc_id", 5) == 0).alias("held_out")), "features")
    model = fit(described.where("not held_out"), table(spark, sf_dir, "labels"))
    return score(described, model, ("doc_id", "held_out"))
