"""Language identification by nearest centroids of TF-IDF letter n-grams.

A text becomes the counts of its letter trigrams (lower case, runs of other characters as one space), hashed into a fixed number of
bins, weighted by inverse document frequency and scaled to length 1. Each language has several centroids, found by spherical k-means;
a text takes the language of the centroid of highest cosine and is rejected where even that one is too far.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, kept_by_worker, share, table

UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    bins: int = 4096
    centroids: int = 3
    #: Labelled documents that centroids are fitted on, all languages together (about; chosen by a hash of the id).
    sample: int = 3000
    rounds: int = 8
    #: A text is rejected when its cosine falls short of a floor; it lies this far up from the cosines of foreign texts to own ones.
    between: float = 0.2
    seed: int = 7


class Grams:
    """Counts of hashed trigrams for blocks of texts."""

    def __init__(self, bins: int):
        self.bins = bins
        points = np.array([chr(c).isalpha() for c in range(0x10000)])
        lower = np.arange(0x10000, dtype=np.uint32)
        for c in np.flatnonzero(points):
            low = chr(c).lower()
            lower[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
        self.code = np.where(points, lower, 0).astype(np.uint32)

    def letters(self, text: str) -> np.ndarray:
        """Lower-case letters as code points, each run of anything else as one 0, with a 0 at both ends."""
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if raw.size and raw.max() >= 0x10000:
            code = np.where(raw < 0x10000, self.code[np.minimum(raw, 0xFFFF)], 0)
            for k in np.flatnonzero(raw >= 0x10000):
                code[k] = raw[k] if chr(raw[k]).isalpha() else 0
        else:
            code = self.code[raw]
        code = np.concatenate(([0], code, [0])).astype(np.uint32)
        return code[np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))]

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x bins) counts and, by text, whether it has a letter."""
        out, has = np.zeros((len(texts), self.bins), np.float32), np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            code = self.letters(text)
            has[k] = code.size > 2
            if has[k]:
                h = code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77) + code[2:] * np.uint32(0xC2B2AE3D)
                h ^= h >> np.uint32(15)
                out[k] = np.bincount((h * np.uint32(0x2C1B3C6D) >> np.uint32(16)) % np.uint32(self.bins), minlength=self.bins)
        return out, has


def grams_of_worker(bins: int) -> Grams:
    """One table of letters for each Python worker."""
    return kept_by_worker(f"grams {bins}", lambda: Grams(bins))


def blocks(batch: pa.RecordBatch, column: str | int, most: int = 256):
    """The texts of a batch, some hundred at a time; null as empty."""
    values = batch.column(column)
    for k in range(0, len(values), most):
        yield k, [t or "" for t in values.slice(k, most).to_pylist()]


def document_frequencies(docs: DataFrame, bins: int) -> tuple[np.ndarray, int]:
    """In how many documents each bin occurs, over all of docs; a row for each bin and task is shuffled, a row for each bin collected."""

    def run(batches):
        grams, df, n = grams_of_worker(bins), np.zeros(bins, np.int64), 0
        for batch in batches:
            for _, texts in blocks(batch, "text"):
                counts, has = grams.count(texts)
                df += (counts > 0).sum(0)
                n += int(has.sum())
        if n:
            used = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(df[used], n), pa.int64())], ["bin", "n"])

    rows = docs.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(bins, np.int64), 0
    for b, n in rows:
        if b < 0:
            total = n
        else:
            df[b] = n
    return df, total


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """languages by centroid, centroids already weighted by idf, and the lowest cosine that is not rejected, by centroid."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray
    params: Params

    def score(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = unit(counts * self.idf)
        cos = x @ self.centroids.T
        best = cos.argmax(1)
        return best, np.clip(cos[np.arange(len(best)), best], 0, 1)


def fit(docs: DataFrame, p: Params = Params()) -> Model | None:
    """Learn from text and lang of docs (rows whose lang is null are left out). Frequencies cover every row; the centroids a sample.

    The sample takes about p.sample rows, as many of each language, and at least 20 of each. None when there is nothing to learn from.
    """
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    df, total = document_frequencies(known, p.bins)
    idf = (np.log((1 + total) / (1 + df)) + 0.1).astype(np.float32)
    want = max(20, p.sample // len(sizes))
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & share("doc_id", want / n))
    rows = known.where(chosen)

    def run(batches):
        grams = grams_of_worker(p.bins)
        for batch in batches:
            for k, texts in blocks(batch, "text"):
                counts, has = grams.count(texts)
                keep = np.flatnonzero(has)
                bins = [np.flatnonzero(counts[i]) for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(k, len(texts)).take(pa.array(keep)), batch.column("lang").slice(k, len(texts)).take(pa.array(keep)), pa.array([b.astype("<u2").tobytes() for b in bins], pa.binary()), pa.array([counts[i][b].astype("<u2").tobytes() for i, b in zip(keep, bins, strict=True)], pa.binary())],
                    ["doc_id", "lang", "bins", "counts"],
                )

    found = sorted(rows.mapInArrow(run, "doc_id long, lang string, bins binary, counts binary").collect(), key=lambda r: (r[1], r[0] if r[0] is not None else -1, r[2], r[3]))
    rng, languages, centroids, floor = np.random.default_rng(p.seed), [], [], []
    for lang in sorted(sizes):
        own = [r for r in found if r[1] == lang]
        if not own:
            continue
        x = np.zeros((len(own), p.bins), np.float32)
        for k, r in enumerate(own):
            x[k, np.frombuffer(r[2], "<u2")] = np.frombuffer(r[3], "<u2")
        counts, x = x, unit(x * idf)
        c = unit(x[rng.choice(len(x), min(p.centroids, len(x)), replace=False)])
        for _ in range(p.rounds):
            near = (x @ c.T).argmax(1)
            c = unit(np.stack([x[near == k].sum(0) if (near == k).any() else c[k] for k in range(len(c))]))
        cos = (x @ c.T).max(1)
        # foreign: the same counts on other trigrams, drawn anew for each document
        foreign = np.concatenate([(unit(rng.permuted(counts, axis=1) * idf) @ c.T).max(1) for _ in range(max(1, 200 // len(x)))])
        own_low, foreign_high = float(np.quantile(cos, 0.01)), float(np.quantile(foreign, 0.99))
        languages += [lang] * len(c)
        centroids.append(c)
        floor += [min(own_low, foreign_high + p.between * max(0.0, own_low - foreign_high))] * len(c)
    return Model(languages, np.concatenate(centroids), idf, np.array(floor), p) if languages else None


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), *carry: Column) -> DataFrame:
    """Columns keep and carry of every row, with lang_pred, score (cosine, 0 to 1), rejected and nearest.

    lang_pred is a learned language, or `und` where the text is null or has no letter, or when nothing was learned; such rows have score
    0 and are rejected. rejected is also true where the cosine falls short of the language's floor; lang_pred stays the nearest language
    then. Ties go to the language first in the alphabet. Repeated rows stay; nothing is shuffled.
    """
    fields = docs.select(*[F.col(f"`{k}`") for k in keep], *carry).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double, rejected boolean"])
    context = docs.sparkSession.sparkContext
    # arrays and plain values only: what is broadcast is pickled by reference, and workers need no copy of this package
    shared = context.broadcast((model.languages, model.centroids, model.idf, model.floor) if model else None)
    params = model.params if model else None

    def run(batches):
        m = Model(*shared.value, params) if shared.value else None
        grams = grams_of_worker(m.params.bins if m else 8)
        for batch in batches:
            lang, score, out = [], [], []
            for _, texts in blocks(batch, place):
                counts, has = grams.count(texts)
                if m is None:
                    lang, score, out = lang + [UNKNOWN] * len(texts), score + [0.0] * len(texts), out + [True] * len(texts)
                    continue
                best, cos = m.score(counts)
                lang += [m.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                score += np.where(has, cos, 0.0).astype(float).tolist()
                out += (~has | (cos < m.floor[best])).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], [f.name for f in fields] + ["lang_pred", "score", "rejected"])

    place = [f.name for f in fields].index("text") if "text" in keep else len(fields)
    sent = [F.col(f"`{k}`") for k in keep] + list(carry)
    return docs.select(*sent, *([] if "text" in keep else [F.col("text").alias("__text")])).mapInArrow(run, schema)


def op5_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from the documents whose crc32 modulo 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold("doc_id", 3) != 1))
    return predict(docs, model, ("doc_id",), (fold("doc_id", 3) == 1).alias("held_out"))
