"""Pair counts of baskets and association measures. Masked pairs are absent rows, never zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plinth.operators.pairs import PART, counts
from plinth.sources.scratch import spread

MIN_BASKETS, MIN_PAIRS = 3, 3
PAIR = ["i", "j"]


def _held(baskets: DataFrame, tasks: int, once: bool) -> DataFrame:
    rows = spread(baskets.select("basket", "item"), tasks, "item")
    return rows if once else rows.distinct()


def item_index(baskets: DataFrame, least: int = MIN_BASKETS, tasks: int = 0, once: bool = False) -> DataFrame:
    """(item, n_baskets) of the items in at least `least` baskets. `baskets` may repeat an item of a basket,
    unless `once` says that they don't. `tasks`, here and below: how many tasks share the rows, if not Spark's own number."""
    found = _held(baskets, tasks, once).groupBy("item").agg(F.count("*").alias("n_baskets"))
    return found.filter(F.col("n_baskets") >= least)


def with_rows(index: DataFrame, key: str = "item", pieces: int = 64) -> DataFrame:
    """Adds `row`, the position by a numeric key from 0. Ranges are counted apart and then shifted, so no task sorts
    the whole table; where all keys are equal that is one range."""
    cuts = index.agg(F.percentile_approx(key, [k / pieces for k in range(1, pieces)], 10_000).alias("cuts"))
    cut = index.crossJoin(F.broadcast(cuts)).withColumn("piece", F.size(F.filter("cuts", lambda c: c < F.col(key)))).drop("cuts")
    before = cut.groupBy("piece").agg(F.count("*").alias("n"))
    before = before.withColumn("shift", F.sum("n").over(W.orderBy("piece").rowsBetween(W.unboundedPreceding, -1))).drop("n")
    own = F.row_number().over(W.partitionBy("piece").orderBy(key))
    rows = cut.withColumn("own", own).join(F.broadcast(before), "piece")
    return rows.withColumn("row", (F.col("own") - 1 + F.coalesce("shift", F.lit(0))).cast("long")).drop("piece", "own", "shift")


def entries(baskets: DataFrame, index: DataFrame, weights: DataFrame | None = None, item_weights: DataFrame | None = None, tasks: int = 0, once: bool = False) -> DataFrame:
    """(basket, item, w, u): indexed items only. weights: (basket, w); item_weights: (basket, item, u); 1 where none."""
    rows = _held(baskets, tasks, once).join(index.select("item"), "item", "left_semi")
    rows = spread(rows, tasks, "basket").join(weights, "basket", "left") if weights is not None else rows.withColumn("w", F.lit(1.0))
    rows = spread(rows, tasks, "basket", "item").join(item_weights, ["basket", "item"], "left") if item_weights is not None else rows.withColumn("u", F.lit(1.0))
    return rows.select("basket", "item", F.coalesce("w", F.lit(1.0)).alias("w"), F.coalesce("u", F.lit(1.0)).alias("u"))


def pair_counts(rows: DataFrame, least: int = MIN_PAIRS, by: tuple[str, ...] = (), part: int = PART, tasks: int = 0) -> DataFrame:
    """(by, i, j, raw, joint) with i < j: baskets that hold both, and the sum of their weights times both items'.

    `by` and w belong to the basket. A range of items makes and counts its pairs in one task, `part` of them, about; see
    `pairs`.
    """
    return counts(rows, least, by, part, tasks)


def marginals(rows: DataFrame, by: tuple[str, ...] = (), tasks: int = 0) -> DataFrame:
    return spread(rows, tasks, *by, "item").groupBy(*by, "item").agg(F.count("*").alias("n_baskets"), F.sum(F.col("w") * F.col("u")).alias("weight"))


def totals(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, total) of baskets with at least one indexed item."""
    return rows.select(*by, "basket", "w").distinct().groupBy(*by).agg(F.count("*").alias("n"), F.sum("w").alias("total"))


def pair_stats(rows: DataFrame, least: int = MIN_PAIRS, by: tuple[str, ...] = (), tasks: int = 0) -> DataFrame:
    """Pairs with their marginals (m_i, m_j; n_i, n_j unweighted) and totals."""
    m = marginals(rows, by, tasks)
    out = pair_counts(rows, least, by, tasks=tasks)
    for k in PAIR:
        out = out.join(m.select(*by, F.col("item").alias(k), F.col("weight").alias(f"m_{k}"), F.col("n_baskets").alias(f"n_{k}")), [*by, k])
    t = totals(rows, by)
    return out.join(F.broadcast(t), list(by)) if by else out.crossJoin(F.broadcast(t))


def pmi(k: float = 1.0) -> Column:
    """Smoothed PMI, discounted by the raw joint count and the smaller weighted marginal; null where undefined."""
    ratio = (F.col("joint") + k) * F.col("total") / ((F.col("m_i") + k) * (F.col("m_j") + k))
    low = F.least("m_i", "m_j")
    return F.when(ratio > 0, F.ln(ratio) * F.col("raw") / (F.col("raw") + 1) * low / (low + 1))


def lift() -> Column:
    return F.try_divide(F.col("joint") * F.col("total"), F.col("m_i") * F.col("m_j"))


def tscore() -> Column:
    return F.when(F.col("joint") > 0, (F.col("joint") - F.col("m_i") * F.col("m_j") / F.col("total")) / F.sqrt("joint"))


def raw_lift() -> Column:
    return F.try_divide(F.col("raw") * F.col("n").cast("double"), F.col("n_i") * F.col("n_j"))


def scored(stats: DataFrame) -> DataFrame:
    """All measures of each pair."""
    return stats.select(*[c for c in stats.columns if c not in ("m_i", "m_j", "n_i", "n_j", "n", "total")], pmi().alias("pmi"), lift().alias("lift"), tscore().alias("tscore"), raw_lift().alias("raw_lift"))


def mirrored(pairs: DataFrame, value: str) -> DataFrame:
    """(a, b, v): both directions of a symmetric matrix with an empty diagonal."""
    one = lambda x, y: pairs.select(F.col(x).alias("a"), F.col(y).alias("b"), F.col(value).alias("v"))
    return one("i", "j").unionByName(one("j", "i"))


def density(pairs: DataFrame, index: DataFrame) -> DataFrame:
    n = index.agg(F.count("*").alias("n_items"))
    out = pairs.agg(F.count("*").alias("n_pairs")).crossJoin(F.broadcast(n))
    return out.withColumn("density", F.try_divide(F.col("n_pairs"), F.col("n_items") * (F.col("n_items") - 1) / 2))


def top_partners(pairs: DataFrame, item: int, value: str, k: int, catalog: DataFrame | None = None) -> DataFrame:
    """The k best partners of an item, of its own category if a catalogue (item, staple) is given."""
    near = pairs.filter((F.col("i") == item) | (F.col("j") == item))
    near = near.select(F.when(F.col("i") == item, F.col("j")).otherwise(F.col("i")).alias("item"), F.col(value).alias("value")).filter("value != 0")
    if catalog is not None:
        same = catalog.filter(F.col("item") == item).select(F.col("staple").alias("own"))
        near = near.join(catalog.select("item", "staple"), "item").crossJoin(F.broadcast(same)).filter("staple = own").select("item", "value")
    return near.orderBy(F.desc("value"), "item").limit(k)


def best_partner(pairs: DataFrame, catalog: DataFrame, floor: float = 5.0) -> DataFrame:
    """(item, partner, lift): the highest lift if above `floor`, else the highest among items of the same kind."""
    m = mirrored(pairs, "lift")
    kind = catalog.select("item", "kind")
    m = m.join(kind.select(F.col("item").alias("a"), F.col("kind").alias("ka")), "a").join(kind.select(F.col("item").alias("b"), F.col("kind").alias("kb")), "b")
    rank = F.struct("v", (-F.col("b")).alias("back"))
    best = m.groupBy("a").agg(F.max(rank).alias("all"), F.max(F.when(F.col("ka") == F.col("kb"), rank)).alias("same"))
    pick = F.when(F.col("all.v") > floor, F.col("all")).otherwise(F.col("same"))
    return best.select(F.col("a").alias("item"), (-pick["back"]).alias("partner"), pick["v"].alias("lift")).filter("partner is not null")


def near_uniform(holders: DataFrame) -> DataFrame:
    """(stratum, n, weight): the median stratum size over a stratum's own (exact median)."""
    n = holders.groupBy("stratum").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.median("n").alias("mid")))).select("stratum", "n", (F.col("mid") / F.col("n")).alias("weight"))


def design_weights(holders: DataFrame, truth: DataFrame) -> DataFrame:
    """(stratum, weight): true share over sampled share. True totals are of all known strata, sampled totals of the
    sampled strata that are known; strata without a true count have none (1 is used for them)."""
    n = holders.groupBy("stratum").agg(F.count("*").alias("n")).join(truth, "stratum")
    sums = truth.agg(F.sum("true_n").alias("all_true")).crossJoin(n.agg(F.sum("n").alias("all_n")))
    return n.crossJoin(F.broadcast(sums)).select("stratum", ((F.col("true_n") / F.col("all_true")) / (F.col("n") / F.col("all_n"))).alias("weight"))


def submatrix(pairs: DataFrame, item: int, value: str, k: int) -> DataFrame:
    """Pairs among an item and its k best partners."""
    near = top_partners(pairs, item, value, k).select("item")
    both = near.unionByName(near.sparkSession.range(1).select(F.lit(item).cast("long").alias("item")))
    out = pairs.select("i", "j", value)
    for x in PAIR:
        out = out.join(F.broadcast(both.select(F.col("item").alias(x))), x, "left_semi")
    return out


def check_dense(n_rows: int, n_cols: int, limit: int = 2 << 30) -> None:
    """Raise MemoryError if a dense matrix of doubles would be larger than `limit` bytes."""
    if n_rows * n_cols * 8 > limit:
        raise MemoryError(f"{n_rows} x {n_cols} doubles need {n_rows * n_cols * 8} bytes, more than {limit}")
