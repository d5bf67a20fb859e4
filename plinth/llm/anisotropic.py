"""Approximate nearest neighbours: score-aware (anisotropic) quantisation, four-bit table scans, exact reranking.

Least Euclidean distance is largest inner product: |q - x|^2 = |q|^2 - 2 (q.x - |x|^2 / 2). The norm is kept exactly, so
only the product is approximated. A vector is its cell's centroid plus a residual, quantised in subspaces of two
dimensions with 16 codewords (four bits each). Codes and codewords minimise a loss that weighs the residual's part
parallel to the vector ETA times as much as the rest, as that part is what changes large products.

1. Rows of equal vectors become one class with its K + 1 smallest ids; the index holds every class.
2. There is a cell for CELL classes. Centroids and codebooks are fitted on PER_CELL classes a cell (at least SAMPLE),
   those with the smallest hash. The driver takes SAMPLE_BYTES of them at most; beyond that, cells hold more classes.
3. Each class is put in its nearest cell; a cell of more than BLOCK classes is cut into blocks. Queries (classes
   again) go to every block of their nearest cells, in parts of QUERIES; how many cells is measured, so that COVER of
   the neighbours that TRIALS sampled vectors have in the sample lie there.
4. A task scans the codes of one block (no vectors are moved) by tables of 16 entries a subspace. For each query it
   takes RERANK of them, and all that come as close to the K-th as the block's quantisation error. To these it adds what
   the codes leave, kept in one byte a dimension, and gives KEPT of them, and all that come as close to the K-th as a
   byte's error (so groups of near copies are kept whole). What all blocks give is cut by the same rule once more.
5. Vectors are joined to those only, and ranked by exact double-precision distance; ids are filled in.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another dimension than
the commonest (the larger on a tie), nor rows without id. Rows that repeat an id and vector count once; a query's own
id is never its neighbour. Fewer candidates than K give all of them; an empty table gives none. Further columns are
ignored. No text is read, and ties in distance go to the smaller id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plinth.llm.shared import materialize, ship

K = 10
SAMPLE, PER_CELL, SAMPLE_BYTES = 10_000, 64, 96 << 20
CELL, COVER, TRIALS = 2_500, 0.97, 200
BLOCK, QUERIES, RERANK, KEPT = 8192, 1024, 120, 22
WORDS = 16
#: Share of a vector's length below which a query's product doesn't matter (T); gives the weight of parallel error.
THRESHOLD = 0.2


@dataclass
class Quantiser:
    """cells (c, d); books (subspaces, 16, 2); d is even (odd dimensions get a zero)."""

    cells: np.ndarray
    books: np.ndarray
    probes: int = 1

    def nearest_cells(self, x: np.ndarray, n: int) -> np.ndarray:
        far = (self.cells**2).sum(1) - 2 * x @ self.cells.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return _codes(x - self.cells[cell], _unit(x), self.books, _eta(x.shape[1]), 2)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(subspaces, 16): products of a query's parts with the codewords."""
        return np.einsum("md,mkd->mk", q.reshape(-1, 2), self.books)


def _eta(d: int) -> float:
    return max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _even(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, x.shape[1] % 2)))


def _codes(r: np.ndarray, u: np.ndarray, books: np.ndarray, eta: float, rounds: int) -> np.ndarray:
    """Codes by coordinate descent on |e|^2 + (eta - 1) (e.u)^2, e being the residual's error."""
    n, m = len(r), len(books)
    parts, along = r.reshape(n, m, 2), u.reshape(n, m, 2)
    errors = parts[:, :, None, :] - books[None]
    square = (errors**2).sum(-1)
    dot = np.einsum("nmkd,nmd->nmk", errors, along)
    codes = square.argmin(-1)
    total = np.take_along_axis(dot, codes[:, :, None], 2)[:, :, 0].sum(1)
    rows = np.arange(n)
    for _ in range(rounds):
        for s in range(m):
            rest = total - dot[rows, s, codes[:, s]]
            codes[:, s] = (square[:, s] + (eta - 1) * (rest[:, None] + dot[:, s]) ** 2).argmin(1)
            total = rest + dot[rows, s, codes[:, s]]
    return codes.astype(np.uint8)


def sizes(count: int, dimension: int, cell: int = CELL) -> tuple[int, int]:
    """(cells, sampled classes) of an index of so many classes."""
    most = max(PER_CELL, SAMPLE_BYTES // (4 * dimension))
    cells = max(1, min(math.ceil(count / cell), most // PER_CELL))
    return cells, min(most, max(SAMPLE, PER_CELL * cells))


def fit(x: np.ndarray, cells: int, seed: int = 7) -> Quantiser:
    """Cells by Lloyd's algorithm, codebooks by alternating codes and weighted least squares."""
    rng = np.random.default_rng(seed)
    c = min(cells, len(x))
    cells = x[rng.choice(len(x), c, replace=False)].copy()
    for _ in range(8):
        cell = ((cells**2).sum(1) - 2 * x @ cells.T).argmin(1)
        sums = np.zeros_like(cells)
        np.add.at(sums, cell, x)
        sizes = np.bincount(cell, minlength=c)
        cells[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    cell = ((cells**2).sum(1) - 2 * x @ cells.T).argmin(1)
    r, u, eta = x - cells[cell], _unit(x), _eta(x.shape[1])
    m = x.shape[1] // 2
    parts, along = r.reshape(-1, m, 2), u.reshape(-1, m, 2)
    books = parts[rng.choice(len(r), WORDS, replace=len(r) < WORDS)].transpose(1, 0, 2).copy()
    for step in range(8):
        codes = _codes(r, u, books, eta, 1 if step else 0)
        error = parts - books[np.arange(m), codes]
        total = (error * along).sum((1, 2))
        for s in range(m):
            rest = total - (error[:, s] * along[:, s]).sum(1)
            a = along[:, s]
            aim = parts[:, s] + (eta - 1) * (rest + (parts[:, s] * a).sum(1))[:, None] * a
            for k in range(WORDS):
                mine = codes[:, s] == k
                if mine.any():
                    left = np.eye(2) * mine.sum() + (eta - 1) * a[mine].T @ a[mine]
                    books[s, k] = np.linalg.solve(left, aim[mine].sum(0))
            error[:, s] = parts[:, s] - books[s, codes[:, s]]
            total = rest + (error[:, s] * a).sum(1)
    made = Quantiser(cells, books)
    trial = x[rng.choice(len(x), min(TRIALS, len(x)), replace=False)]
    far = (x**2).sum(1) - 2 * trial @ x.T
    near = np.argsort(far, axis=1, kind="stable")[:, 1 : K + 1]
    place = np.argsort(made.nearest_cells(trial, c), axis=1)
    ranks = np.sort(np.take_along_axis(place, cell[near], 1), axis=None)
    made.probes = int(ranks[min(len(ranks) - 1, int(COVER * len(ranks)))]) + 1 if len(ranks) else c
    return made


def vector_classes(table: DataFrame, k: int = K) -> DataFrame:
    """(cid, vec, ids): distinct vectors that take part, their smallest id and the k + 1 smallest ids."""
    e = F.col("embedding")
    good = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = table.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)).filter(good)
    # 0.0 and -0.0 are one value
    rows = rows.select("vec_id", F.transform(e, lambda v: F.when(v == 0, F.lit(0)).otherwise(v).cast("float")).alias("vec"))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.filter(F.size("vec") == (sizes["d"] if sizes else 0)).withColumn("h", F.xxhash64("vec"))
    first = F.row_number().over(W.partitionBy("h", "vec").orderBy("vec_id"))
    few = rows.distinct().withColumn("n", first).filter(F.col("n") <= k + 1)
    ids = F.array_sort(F.collect_list("vec_id"))
    return few.groupBy("h", "vec").agg(ids.alias("ids")).select(F.element_at("ids", 1).alias("cid"), "vec", "ids", "h")


def neighbours(table: DataFrame, queries: DataFrame, k: int = K, cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of table's rows found for each of the queries (vec_id, embedding)."""
    spark = table.sparkSession
    ship(spark)
    classes = materialize(vector_classes(table, k), "ann-classes")
    asked = materialize(
        vector_classes(queries, 0).select(F.col("cid").alias("qid"), "vec", "h"), "ann-queries"
    )
    schema = "query_id long, rank int, vec_id long, score double"
    n, n_asked = classes.count(), asked.count()
    if not n or not n_asked:
        return spark.createDataFrame([], schema)
    wanted, many = sizes(n, len(classes.first()["vec"]), cell)
    sample = classes.orderBy("h", "cid").limit(many).select("vec").toPandas()["vec"]
    made = fit(_even(np.stack(sample.to_numpy()).astype(np.float64)), wanted)
    shared = spark.sparkContext.broadcast(made)
    cells = len(made.cells)
    probes = min(made.probes, cells)

    def index(batches):
        q = shared.value
        for b in batches:
            x = _even(np.stack(b["vec"].to_numpy()).astype(np.float64))
            cell = q.nearest_cells(x, 1)[:, 0]
            codes = q.encode(x, cell)
            packed = codes[:, 0::2] | np.pad(codes[:, 1::2], ((0, 0), (0, codes.shape[1] % 2))) << 4
            error = x - q.cells[cell] - q.books[np.arange(codes.shape[1]), codes].reshape(len(x), -1)
            step = np.maximum(np.abs(error).max(1), 1e-30) / 127
            rest = np.rint(error / step[:, None]).astype(np.int8)
            each = {"half": (x**2).sum(1) / 2, "error": (error**2).mean(1), "step": step}
            each |= {"codes": [c.tobytes() for c in packed], "rest": [c.tobytes() for c in rest]}
            yield pd.DataFrame({"cid": b["cid"], "cell": cell, **each})

    def route(batches):
        for b in batches:
            near = shared.value.nearest_cells(_even(np.stack(b["vec"].to_numpy()).astype(np.float64)), probes)
            for j in range(probes):
                yield pd.DataFrame({"qid": b["qid"], "vec": b["vec"], "cell": near[:, j]})

    built = materialize(classes.select("cid", "vec").mapInPandas(index, "cid long, cell int, half double, error double, step double, codes binary, rest binary"), "ann-index")
    routed = materialize(asked.mapInPandas(route, "qid long, vec array<float>, cell int"), "ann-routed")
    load = built.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    load = load.join(routed.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), "cell")
    load = F.broadcast(materialize(load, "ann-load"))  # a row for each cell, which SAMPLE_BYTES bounds
    left = built.join(load, "cell").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("blocks", "parts")
    right = routed.join(load, "cell").withColumn("part", F.pmod(F.xxhash64("qid"), "parts").cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "parts")

    def search(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": [], "cid": [], "rough": [], "slack": [], "first": []})
        if x.empty or q.empty:
            return empty
        model = shared.value
        m = len(model.books)
        packed = np.frombuffer(b"".join(x["codes"]), np.uint8).reshape(len(x), -1)
        codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(x), -1)[:, :m]
        flat = codes.astype(np.int64) + np.arange(m) * WORDS
        half, centre, step = x["half"].to_numpy(), model.cells[int(x["cell"].iloc[0])], x["step"].to_numpy()
        rest = np.frombuffer(b"".join(x["rest"]), np.int8).reshape(len(x), -1)
        spread, fine = 2 * np.sqrt(x["error"].mean()), step.max()
        cids = x["cid"].to_numpy(np.int64)
        out = []
        for qid, vec in zip(q["qid"], q["vec"], strict=True):
            w = _even(np.asarray(vec, np.float64)[None])[0]
            rough = half - model.tables(w).reshape(-1)[flat].sum(1) - w @ centre
            best = np.arange(len(rough))
            if len(rough) > RERANK:
                order = np.partition(rough, (k, RERANK - 1))
                best = np.flatnonzero(rough <= max(order[RERANK - 1], order[k] + spread * np.linalg.norm(w)))
            # a byte is off by half a step at most, so two steps are about seven deviations of a product
            rough, slack = rough[best] - step[best] * (rest[best] @ w), 2 * fine * np.linalg.norm(w)
            first = np.ones(len(rough), bool)
            if len(rough) > KEPT:
                order = np.partition(rough, (k, KEPT - 1))
                kept = rough <= max(order[KEPT - 1], order[k] + slack)
                best, rough, first = best[kept], rough[kept], rough[kept] <= order[KEPT - 1]
            out.append(pd.DataFrame({"qid": qid, "cid": cids[best], "rough": rough, "slack": slack, "first": first}))
        return pd.concat(out) if out else empty

    group = ["cell", "block", "part"]
    scanned = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(search, "qid long, cid long, rough double, slack double, first boolean")
    scanned = materialize(scanned, "ann-scanned")
    # what all blocks of a query keep is cut as in a block; only the first KEPT of each block are ranked for it
    place = F.row_number().over(W.partitionBy("qid").orderBy("rough", "cid"))
    firsts = scanned.filter("first").select("qid", "cid", "rough").withColumn("n", place).filter(F.col("n") <= KEPT)
    bounds = firsts.groupBy("qid").agg(F.max("rough").alias("most"), F.max(F.when(F.col("n") <= k + 1, F.col("rough"))).alias("kth"))
    kept = scanned.join(bounds, "qid").filter(F.col("rough") <= F.greatest("most", F.col("kth") + F.col("slack"))).select("qid", "cid")
    kept = kept.join(asked.select("qid", F.col("vec").alias("asked")), "qid").join(classes.select("cid", "vec", "ids"), "cid")

    def measure(batches):
        for b in batches:
            if len(b):
                x, v = (np.stack(b[c].to_numpy()).astype(np.float64) for c in ("vec", "asked"))
                yield pd.DataFrame({"qid": b["qid"], "cid": b["cid"], "score": np.sqrt(((x - v) ** 2).sum(1)), "ids": b["ids"]})

    found = kept.select("qid", "cid", "vec", "asked", "ids").mapInPandas(measure, "qid long, cid long, score double, ids array<long>")
    near = F.row_number().over(W.partitionBy("qid").orderBy("score", "cid"))
    best = found.withColumn("n", near).filter(F.col("n") <= k + 1).select("qid", "score", F.explode("ids").alias("vec_id"))
    pairs = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k + 1)
    best = materialize(best.groupBy("qid").agg(pairs.alias("pairs")), "ann-best")
    e = F.transform("embedding", lambda v: F.when(v == 0, F.lit(0)).otherwise(v).cast("float"))
    rows = queries.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("query_id"), F.xxhash64(e).alias("h"), e.alias("vec"))
    own = asked.join(best, "qid").select("h", F.col("vec").alias("v"), "pairs")
    rows = rows.distinct().join(own, "h").filter(F.col("vec") == F.col("v"))
    others = F.slice(F.filter("pairs", lambda p: p["vec_id"] != F.col("query_id")), 1, k)
    ranked = rows.select("query_id", F.posexplode(others).alias("pos", "p"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "p.vec_id", "p.score")


def search_embeddings(table: DataFrame, k: int = K, cell: int = CELL) -> DataFrame:
    table = table.select("vec_id", "embedding")
    return neighbours(table, table.filter(F.col("vec_id") % 100 == 0), k, cell)
