"""Eligibility by identity masks of five bits: who could hold an item, and how often it is held."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.shared import small_side

LETTERS = "WUBRG"


def identity(mask):
    """Letters of a mask in their fixed order; empty for none."""
    return F.concat(*[F.when(mask.bitwiseAND(F.lit(1 << k)) != 0, c).otherwise("") for k, c in enumerate(LETTERS)])


def identity_counts(spark: SparkSession, holders: DataFrame, weights: DataFrame) -> DataFrame:
    """(mask, n, weighted) for all 32 identities, zero where no basket has it. weights: (stratum, weight)."""
    seen = holders.join(F.broadcast(weights.select("stratum", "weight")), "stratum", "left")
    seen = seen.groupBy("mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("weight", F.lit(1.0))).alias("weighted"))
    all_masks = spark.range(32).select(F.col("id").cast("int").alias("mask"))
    return all_masks.join(F.broadcast(seen), "mask", "left").select("mask", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("weighted", F.lit(0.0)).alias("weighted"))


def eligible(counts: DataFrame) -> DataFrame:
    """(mask, n, weighted): baskets whose identity holds the mask. 32 x 32 rows at most."""
    asked = counts.select(F.col("mask").alias("asked"))
    held = F.col("mask").bitwiseAND(F.col("asked")) == F.col("asked")
    return asked.join(F.broadcast(counts), held).groupBy(F.col("asked").alias("mask")).agg(F.sum("n").alias("n"), F.sum("weighted").alias("weighted"))


def play_rates(baskets: DataFrame, catalog: DataFrame, eligible_counts: DataFrame) -> DataFrame:
    """(item, deck_count, eligible_count, play_rate): null where nothing is eligible."""
    held = baskets.select("basket", "item").distinct().groupBy("item").agg(F.count("*").alias("deck_count"))
    e = eligible_counts.select("mask", F.col("n").alias("eligible_count"))
    out = catalog.select("item", "mask").join(held, "item", "left").join(F.broadcast(e), "mask", "left")
    count = F.coalesce("deck_count", F.lit(0))
    return out.select("item", count.alias("deck_count"), "eligible_count", F.try_divide(count, F.col("eligible_count")).alias("play_rate"))


def conditioned_tscore(stats: DataFrame, catalog: DataFrame, eligible_counts: DataFrame) -> DataFrame:
    """(i, j, raw, tscore): expectation among the baskets that could hold both."""
    masks, n = catalog.select("item", "mask"), catalog.count()
    out = stats
    for k in ("i", "j"):
        out = out.join(small_side(masks.select(F.col("item").alias(k), F.col("mask").alias(f"mask_{k}")), n), k)
        out = out.join(F.broadcast(eligible_counts.select(F.col("mask").alias(f"mask_{k}"), F.col("weighted").alias(f"e_{k}"))), f"mask_{k}")
    out = out.withColumn("either", F.col("mask_i").bitwiseOR(F.col("mask_j")))
    out = out.join(F.broadcast(eligible_counts.select(F.col("mask").alias("either"), F.col("weighted").alias("e_ij"))), "either")
    rate = lambda k: F.when(F.col(f"e_{k}") > 0, F.col(f"m_{k}") / F.col(f"e_{k}")).otherwise(0.0)
    value = (F.col("joint") - F.col("e_ij") * rate("i") * rate("j")) / F.sqrt("joint")
    return out.filter("joint > 0").select("i", "j", "raw", value.alias("tscore"))
