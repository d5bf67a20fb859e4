"""Baskets against published templates: matching, overlap, retention evidence and item weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plinth.functions.ranks import at_positions

#: A difference of at most SAME is the template itself; FAR items from the basket's size it is no match.
SAME, FAR = 10, 20
CENTRE, SPREAD = 20, 10.0
LOW_CUT, HIGH_CUT = 0.05, 1.0


def leader_bridge(template_leaders: DataFrame) -> DataFrame:
    """(template, leader) from the declared leader, the partner and the alternatives."""
    keys = F.concat(F.array("declared", "partner"), F.coalesce("alternatives", F.array().cast("array<int>")))
    return template_leaders.select("template", F.explode(keys).alias("leader")).filter("leader is not null").distinct()


def matches(basket_leaders: DataFrame, bridge: DataFrame) -> DataFrame:
    return basket_leaders.join(bridge, "leader").select("basket", "template").distinct()


def compared(matched: DataFrame, baskets: DataFrame, templates: DataFrame) -> DataFrame:
    """(basket, template, total, n_items, overlap, shared, n_template) of each match."""
    sizes = baskets.groupBy("basket").agg(F.sum("qty").alias("total"), F.count("*").alias("n_items"))
    held = baskets.select("basket", "item", F.col("qty").alias("held"))
    lines = matched.join(templates, "template").join(held, ["basket", "item"], "left")
    # a null `held` must not count as the template's own quantity: least() skips nulls
    out = lines.groupBy("basket", "template").agg(
        F.sum(F.when(F.col("held").isNull(), F.lit(0)).otherwise(F.least("qty", "held"))).alias("overlap"),
        F.count("held").alias("shared"), F.count("*").alias("n_template"),
    )
    return out.join(sizes, "basket")


def trust(diff: Column, total: Column) -> Column:
    """1 up to SAME, 0 from total - FAR on, linear between; checked in that order."""
    return F.when(diff <= SAME, 1.0).when(diff >= total - FAR, 0.0).otherwise((total - FAR - diff) / (total - FAR - SAME).cast("double"))


def cut_confidence(diff: Column) -> Column:
    return 1 / (1 + F.exp((diff - CENTRE) / SPREAD))


def item_weight(cut_rate: Column) -> Column:
    return F.when(cut_rate <= LOW_CUT, 1.0).when(cut_rate >= HIGH_CUT, 0.0).otherwise((HIGH_CUT - cut_rate) / (HIGH_CUT - LOW_CUT))


def best_match(pairs: DataFrame) -> DataFrame:
    """(basket, template, total, diff, trust): least difference, then the smallest template."""
    diff = F.col("total") - F.col("overlap")
    rank = F.row_number().over(W.partitionBy("basket").orderBy("diff", "template"))
    rows = pairs.withColumn("diff", diff).withColumn("rank", rank).filter("rank = 1")
    return rows.select("basket", "template", "total", "diff", trust(F.col("diff"), F.col("total")).alias("trust"))


def similarity(holders: DataFrame, pairs: DataFrame) -> DataFrame:
    """(basket, similarity): the largest Jaccard similarity to a matching template, null without one."""
    jaccard = F.try_divide(F.col("shared"), F.col("n_items") + F.col("n_template") - F.col("shared"))
    best = pairs.groupBy("basket").agg(F.max(jaccard).alias("similarity"))
    return holders.select("basket").join(best, "basket", "left")


def retention(best: DataFrame, baskets: DataFrame, templates: DataFrame, similar: int = 20) -> DataFrame:
    """(template, item, similar_n, kept_n, weighted_cut, weighted_kept): every template line, also where nothing was kept."""
    held = baskets.select("basket", "item", F.lit(True).alias("has"))
    grid = best.join(templates.select("template", "item"), "template").join(held, ["basket", "item"], "left")
    near, has, sure = F.col("diff") <= similar, F.col("has").isNotNull(), cut_confidence(F.col("diff"))
    return grid.groupBy("template", "item").agg(
        F.count_if(near).alias("similar_n"), F.count_if(near & has).alias("kept_n"),
        F.sum(F.when(~has, F.col("trust") * sure).otherwise(0.0)).alias("weighted_cut"),
        F.sum(F.when(has, F.col("trust") * (1 - sure)).otherwise(0.0)).alias("weighted_kept"),
    )


def item_overrides(best: DataFrame, baskets: DataFrame, kept: DataFrame) -> DataFrame:
    """(basket, item, u): weights of items that belong to the basket's template and have evidence; others count 1."""
    total = F.col("weighted_cut") + F.col("weighted_kept")
    rates = kept.filter(total > 0).select("template", "item", (F.col("weighted_cut") / total).alias("cut_rate"))
    rows = baskets.select("basket", "item").join(best.select("basket", "template", "trust"), "basket").join(rates, ["template", "item"])
    return rows.select("basket", "item", (1 - F.col("trust") * (1 - item_weight(F.col("cut_rate")))).alias("u"))


def histogram(values: DataFrame, value: str, edges: int = 10) -> DataFrame:
    """(bucket, low, n): half-open buckets of [0, 1], the last closed; explicit comparisons with the edges, zero-filled."""
    bounds = values.sparkSession.range(edges).select(F.col("id").cast("int").alias("bucket"), (F.col("id") / edges).alias("low"))
    bucket = sum(((F.col(value) >= k / edges).cast("int") for k in range(1, edges)), F.lit(0))
    n = values.filter(F.col(value).between(0, 1)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return bounds.join(F.broadcast(n), "bucket", "left").select("bucket", "low", F.coalesce("n", F.lit(0)).alias("n"))


def nearest_rank(values: DataFrame, value: str, quantiles: tuple[float, ...]) -> DataFrame:
    """(q, value): the value at position min(n - 1, int(q n)) in ascending order; none of an empty table."""
    names = {f"at{k}": F.least(F.col("n") - 1, F.floor(F.lit(float(q)) * F.col("n"))) for k, q in enumerate(quantiles)}
    found = at_positions(values, value, names)
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(n).alias("value")) for q, n in zip(quantiles, names, strict=True)])
    return found.select(F.inline(pairs)).filter(F.col("value").isNotNull())
