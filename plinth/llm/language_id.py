"""Language ID by prediction by partial matching (PPM): exact code lengths under frozen byte statistics.

Fitting reads a bounded sample of labelled rows: per language, the DOCS_PER_LANGUAGE rows with the smallest hash of
doc_id (all whole texts). Executors count contexts of up to ORDER bytes; per language these are a context tree of
variable order with escapes by method C: a context seen n times with d distinct successors gives a successor seen c
times c / (n + d) and escapes to the next shorter context with d / (n + d), down to a uniform byte. The statistics are
then frozen, so the cost of every (context, byte) is a constant. All runs of the sample, of every language, stand in
sparse tables of (run, language) by order, and a text's exact code length is a sum of their rows.

Bytes are coded after ASCII letters are lower-cased; all 256 have codes of their own.

* Null texts, and those without a letter (Unicode category L), are `und` with score 0. Very long texts are scored in
  steps. Ties go to the language first in order.
* Rows with a null lang or doc_id aren't learned from but are predicted. Repeated rows repeat. Without any row to learn
  from, all are `und`. An empty table gives an empty result. Further columns are ignored.
* The tables broadcast are bounded by the sample: (runs + contexts) * languages * 4 bytes. Beyond TABLE_BYTES fitting
  fails with an error; no language, byte or context is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plinth.llm.shared import materialize, ship, small_side, text_hash, without_rows

ORDER = 3
DOCS_PER_LANGUAGE = 300
#: Cost tables that are larger are refused, never cut.
TABLE_BYTES = 256 << 20
UNKNOWN = "und"
#: Bytes of text that are scored at once.
STEP = 1 << 17


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


@dataclass
class Model:
    """Costs in bits by order k = 0..ORDER: cost[k][i, language] of the run runs[k][i] (a context of k bytes and its
    successor), and escape[k][j, language] of leaving contexts[k][j]. All keys are sorted, high byte first.

    Runs that no language has seen cost their escape and what the next shorter context says.
    """

    languages: list[str]
    runs: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def _bits(self, grams: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, bits by language) whose sums are the costs of the grams of ORDER + 1 bytes."""
        at = np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            row, hit = _find(self.runs[k], grams & _mask(k + 1))
            yield at[hit], self.costs[k][row[hit]]
            at, grams = at[~hit], grams[~hit]
            row, hit = _find(self.contexts[k], (grams & _mask(k + 1)) >> 8)
            yield at[hit], self.escapes[k][row[hit]]
        yield at, np.full((len(at), len(self.languages)), 8, np.float32)

    @property
    def cost(self) -> np.ndarray:
        """cost[context, byte, language] of every context of ORDER bytes that was seen."""
        grams = ((self.contexts[ORDER][:, None] << 8) | np.arange(256)).ravel()
        out = np.zeros((len(grams), len(self.languages)))
        for at, bits in self._bits(grams):
            out[at] += bits
        return out.reshape(-1, 256, len(self.languages))

    def code_lengths(self, text: str) -> np.ndarray:
        """Bits for the text in each language."""
        raw = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
        total = np.zeros(len(self.languages))
        for k in range(0, len(raw), STEP):
            c = np.concatenate([np.full(max(0, ORDER - k), 32, np.uint8), raw[max(0, k - ORDER) : k + STEP]]).astype(np.int64)
            for _, bits in self._bits((c[:-3] << 24) | (c[1:-2] << 16) | (c[2:-1] << 8) | c[3:]):
                total += bits.sum(axis=0, dtype=np.float64)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        bits = self.code_lengths(text)
        best = int(bits.argmin())
        return self.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def _sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text) of the rows to learn from: ids are ranked without texts, then texts are read for them.

    Only ids under a hash threshold are ranked, set by the language's count to pass twice the number wanted; where ids
    repeat so often that too few pass, the threshold is raised.
    """
    slim = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang")
    slim = slim.withColumn("order", F.xxhash64("doc_id"))
    counts = materialize(slim.groupBy("lang").agg(F.count("*").alias("n")), "lang-counts")
    sized = slim.join(small_side(counts), "lang")
    wanted, order = 2 * per_language, W.partitionBy("lang").orderBy("order", "doc_id")
    while True:
        share = F.lit(float(wanted)) / F.col("n")
        under = sized.filter(F.col("order") / 2.0**64 + 0.5 <= share).select("doc_id", "lang", "order").distinct()
        ranked = under.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language)
        picked = materialize(ranked.select("doc_id", "lang"), "lang-sample")
        enough = picked.groupBy("lang").agg(F.count("*").alias("got"))
        if counts.join(enough, "lang", "left").filter((F.coalesce("got", F.lit(0)) < per_language) & (F.col("n") > wanted)).isEmpty():
            break
        wanted *= 8
    return docs.select("doc_id", "lang", "text").join(small_side(picked), ["doc_id", "lang"], "left_semi").select("lang", "text")


def _counts(sample: DataFrame) -> DataFrame:
    """(lang, gram long, n): of all runs of ORDER + 1 lower-cased bytes, with spaces before the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(b" " * ORDER + (text or "").encode("utf-8", "replace").lower(), np.uint8).astype(np.int64)
                if len(raw) > ORDER:
                    gram, n = np.unique(((raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    return sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """A frozen model. What reaches the driver is bounded by the sample: distinct 4-byte runs per language."""
    ship(docs.sparkSession)
    grams = _counts(_sample(docs, per_language)).toPandas()
    return freeze(grams)


def freeze(grams) -> Model:
    """The cost tables of counted runs (pandas: lang, gram, n): every language, byte and context of them."""
    languages = sorted(grams["lang"].unique())
    g, n, lang = grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.float64), grams["lang"].to_numpy()
    runs = [np.unique(g & _mask(k + 1)) for k in range(ORDER + 1)]
    contexts = [np.unique(r >> 8) for r in runs]
    size = 4 * len(languages) * sum(map(len, runs + contexts))
    if size > TABLE_BYTES:
        raise ValueError(f"cost tables of {len(languages)} languages take {size} bytes, beyond TABLE_BYTES; sample fewer rows a language")
    costs = [np.zeros((len(r), len(languages)), np.float32) for r in runs]
    escapes = [np.zeros((len(c), len(languages)), np.float32) for c in contexts]
    context_of = [np.searchsorted(c, r >> 8) for c, r in zip(contexts, runs, strict=True)]
    suffix_of = [None, *[np.searchsorted(runs[k - 1], runs[k] & _mask(k)) for k in range(1, ORDER + 1)]]
    for i, name in enumerate(languages):
        mine = lang == name
        shorter = None
        for k in range(ORDER + 1):
            at = context_of[k]
            w = np.bincount(np.searchsorted(runs[k], g[mine] & _mask(k + 1)), weights=n[mine], minlength=len(runs[k]))
            below = np.full(len(runs[k]), 1 / 256) if shorter is None else shorter[suffix_of[k]]
            total, distinct = np.bincount(at, weights=w), np.bincount(at, weights=w > 0)
            left = 1 - np.bincount(at, weights=np.where(w > 0, below, 0))
            # with all bytes seen there is none to escape to
            spare = np.where(distinct < 256, distinct, 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                leave = np.where((total > 0) & (spare > 0), spare / (total + spare) / left, 1)
                shorter = np.where(w > 0, w / (total + spare)[at], leave[at] * below)
            costs[k][:, i], escapes[k][:, i] = -np.log2(shorter), -np.log2(leave)
    return Model(list(languages), runs, costs, contexts, escapes)


def _mask(size: int) -> int:
    return (1 << (8 * size)) - 1


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of sorted keys, and which of the wanted are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    row = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return row, keys[row] == wanted


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score to (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for b in batches:
            out = [made.predict(t.as_py()) for t in b.column(1)]
            cols = [b.column(0), b.column(2), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", text_hash(docs).alias("h"))
    return rows.mapInArrow(run, "doc_id long, h long, lang_pred string, score double")


def identify_documents(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    out = predict(docs, fit(docs, per_language))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """Documents whose language is told; null and letterless texts, and those of an unsure language, go."""
    found = predict(docs, fit(docs, per_language))
    bad = found.filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < min_score)).select("doc_id", "h")
    return without_rows(docs, materialize(bad, "lang-rejected"))
