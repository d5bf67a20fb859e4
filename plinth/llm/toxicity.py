"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, pairs of neighbours, and pairs with one word between, hashed to 2**BITS coordinates; a feature
counts once in a text. FTRL-proximal keeps per coordinate the sum of squared gradients (its learning rate) and a
linear term; L1 leaves most weights at exactly zero. The non-zero ones are broadcast and every whole text is scored.

Fitting reads a bounded sample: the SAMPLE labelled rows, outside the held-out fold, with the smallest hash of doc_id;
executors hash their texts, and the driver sees feature numbers only, all of each text. Where these go beyond TOTAL,
fewer rows are learned from, in the same order, each still whole.

* Very long texts are hashed in steps of STEP words, without losing pairs between steps.
* Null and empty texts, and those without words, have no features: their score is that of the intercept.
* Rows without doc_id or label, and labels without a text, aren't learned from; of labels that repeat a doc_id, the
  larger counts. With no labelled rows the score is 0.5. Repeated rows repeat; an empty table gives an empty result;
  further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.shared import materialize, ship, small_side

BITS = 22
SAMPLE = 10_000
#: Feature numbers the driver takes; the row that reaches it is the last.
TOTAL = 25_000_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 12.0, 0.0
#: Words whose hash a worker remembers.
WORDS = 500_000
#: Words of a text that are hashed at once; neighbours across two steps are kept.
STEP = 200_000
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 7)
        if len(self) >= WORDS:
            self.clear()
        if len(word) <= 40:
            self[word] = h
        return h


_HASHES = _Hashes()


def hashed(text: str | None) -> Iterator[np.ndarray]:
    """Coordinates of a text's features, a step of words at a time; they repeat as the features do."""
    words = _WORD.findall(text.lower()) if text else []
    shift = np.uint64(64 - BITS)
    for k in range(0, len(words), STEP):
        part = words[max(0, k - 2) : k + STEP]
        h = np.fromiter(map(_HASHES.__getitem__, part), np.uint64, len(part))
        one = h * np.uint64(0x9E3779B97F4A7C15)
        two = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ one[1:]
        skip = (h[:-2] * np.uint64(0x165667B19E3779F9)) ^ one[2:]
        yield np.concatenate([one, two * np.uint64(0xFF51AFD7ED558CCD), skip * np.uint64(0xC4CEB9FE1A85EC53)]) >> shift


@dataclass
class Weights:
    """Sparse weights: coordinates in order, their weights, and the intercept."""

    at: np.ndarray
    weight: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.weight
        return out


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Weights:
    """FTRL-proximal over rows of distinct coordinates, in the order given."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = w0 = 0.0
    for _ in range(epochs):
        for x, y in zip(rows, labels, strict=True):
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(nx)) / ALPHA + L2))
            g = _sigmoid(w.sum() + w0) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * w
            n[x] = nx + g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / ALPHA * w0
            n0 += g * g
            w0 = -z0 / ((BETA + np.sqrt(n0)) / ALPHA)
    at = np.flatnonzero(np.abs(z) > L1)
    weight = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
    return Weights(at.astype(np.int64), weight.astype(np.float32), float(w0))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Weights:
    spark = docs.sparkSession
    ship(spark)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("order", F.xxhash64("doc_id"))
    picked = materialize(known.orderBy("order", "doc_id").limit(sample), "toxic-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = []
            for t in b.column(2):
                x = [np.unique(p) for p in hashed(t.as_py())]
                x = np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64)
                at.append(x.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.binary())], ["order", "toxic", "at"])

    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(small_side(picked), "doc_id")
    found = materialize(texts.select("order", "toxic", "text").mapInArrow(run, "order long, toxic int, at binary"), "toxic-features")
    sizes = found.groupBy("order").agg(F.sum(F.length("at") / 4).alias("size")).toPandas().sort_values("order")
    taken = sizes["order"][sizes["size"].cumsum() - sizes["size"] < TOTAL]
    found = found.filter(F.col("order") <= int(taken.max()) if len(taken) else F.lit(False)).toPandas()
    found = found.sort_values(["order", "at"], kind="stable")
    rows = [np.frombuffer(x, "<i4") for x in found["at"]]
    return ftrl(rows, found["toxic"].to_numpy(np.float64))


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, score) for every row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.dense()
        for b in batches:
            out = []
            for t in b.column(1):
                hits = [x[w[x] != 0] for x in hashed(t.as_py())]
                distinct = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
                out.append(_sigmoid(float(w[distinct].sum(dtype=np.float64)) + shared.value.intercept))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    docs = docs.select("doc_id", "text")
    out = score(docs, fit(docs, labels, sample))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
