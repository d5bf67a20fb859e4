"""Item graphs: sparsifying, gates, cores, memberships and agreement of groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plinth.llm.shared import small_side
from plinth.operators.association import mirrored
from plinth.sources.scratch import materialize


def topk_union(pairs: DataFrame, value: str, k: int, excluded: DataFrame | None = None, above: float = 0.0) -> DataFrame:
    """(i, j): pairs among the k best of either end. Excluded items go before ranking; values must exceed `above`."""
    ends = mirrored(pairs, value).filter(F.col("v") > above)
    if excluded is not None:
        n = excluded.count()
        for c in ("a", "b"):
            ends = ends.join(small_side(excluded.select(F.col("item").alias(c)), n), c, "left_anti")
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("v"), "b"))
    kept = ends.withColumn("rank", rank).filter(F.col("rank") <= k)
    return kept.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("i").alias("a"), F.col("j").alias("b")).unionByName(edges.select(F.col("j").alias("a"), F.col("i").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("a").agg(F.count("*").alias("d"))


def jaccard_gate(edges: DataFrame, least: float) -> DataFrame:
    """(i, j, jaccard) of edges whose ends share neighbours: shared / (d_i + d_j - shared) >= least.

    Wedges are built from the edge's first end only and met with the second's neighbours, so the work is the sum of
    degrees over edges; after topk_union that is bounded by the hubs, which AQE splits.
    """
    ends, d = both_ways(edges), degrees(edges)
    via = edges.join(ends.select(F.col("a").alias("i"), F.col("b").alias("via")), "i")
    hit = via.join(ends.select(F.col("a").alias("j"), F.col("b").alias("via")), ["j", "via"]).groupBy("i", "j").agg(F.count("*").alias("shared"))
    out = edges.join(hit, ["i", "j"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    for k in ("i", "j"):
        out = out.join(d.select(F.col("a").alias(k), F.col("d").alias(f"d_{k}")), k)
    jaccard = F.col("shared") / (F.col("d_i") + F.col("d_j") - F.col("shared"))
    return out.select("i", "j", jaccard.alias("jaccard")).filter(F.col("jaccard") >= least)


def edge_weights(gated: DataFrame, scored: DataFrame) -> DataFrame:
    """Adds tscore, raw_lift and weight = tscore * ln(1 + raw_lift) to edges."""
    joined = gated.join(scored.select("i", "j", "tscore", "raw_lift"), ["i", "j"])
    return joined.withColumn("weight", F.col("tscore") * F.log1p("raw_lift"))


def generic_items(edges: DataFrame, rates: DataFrame, most: float, least_rate: float) -> DataFrame:
    """(item, max_lift, play_rate): items without any strong edge that are often held all the same."""
    best = mirrored(edges, "raw_lift").groupBy(F.col("a").alias("item")).agg(F.max("v").alias("max_lift"))
    return best.join(rates.select("item", "play_rate"), "item").filter((F.col("max_lift") < most) & (F.col("play_rate") >= least_rate))


def kcore(edges: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(item, topic): the largest subset of each topic in which every item has k edges within the topic.

    Rounds go on until nothing is dropped (each drops at least one row, so they end); each is written to the shared
    folder, which ends the lineage and survives lost executors.
    """
    ends = materialize(both_ways(edges), "core-ends")
    now = materialize(members.select("item", "topic"), "core")
    n = now.count()
    while n:
        near = now.join(ends, F.col("item") == F.col("a")).select("item", "topic", "b")
        inside = near.join(now.select(F.col("item").alias("b"), "topic"), ["b", "topic"], "left_semi")
        now = materialize(inside.groupBy("item", "topic").agg(F.count("*").alias("d")).filter(F.col("d") >= k).select("item", "topic"), "core")
        n, before = now.count(), n
        if n == before:
            break
    return now


def shares(factors: DataFrame) -> DataFrame:
    """Adds share, a weight over the sum of its item's; null if that is zero."""
    return factors.withColumn("share", F.try_divide(F.col("weight"), F.sum("weight").over(W.partitionBy("item"))))


def memberships(factors: DataFrame, least: float = 0.1, most: int = 5) -> DataFrame:
    """(item, topic, weight, share): the `most` largest shares of each item that reach `least`."""
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("share"), "topic"))
    return shares(factors).filter(F.col("share") >= least).withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def primary_topic(items: DataFrame, surviving: DataFrame) -> DataFrame:
    """(item, topic): the surviving topic with the largest share, -1 without one."""
    best = surviving.groupBy("item").agg(F.max(F.struct("share", (-F.col("topic")).alias("back"))).alias("best"))
    return items.select("item").join(best, "item", "left").select("item", F.coalesce(-F.col("best.back"), F.lit(-1)).alias("topic"))


def project_baskets(baskets: DataFrame, factors: DataFrame, least: float = 0.1) -> DataFrame:
    """(basket, topic, share): summed item weights of each topic, normalised, at least `least`."""
    rows = baskets.select("basket", "item").join(factors, "item").groupBy("basket", "topic").agg(F.sum("weight").alias("weight"))
    share = F.try_divide(F.col("weight"), F.sum("weight").over(W.partitionBy("basket")))
    return rows.withColumn("share", share).filter(F.col("share") >= least).select("basket", "topic", "share")


def rand_index(groups: DataFrame, a: str, b: str) -> DataFrame:
    """(n, ari): adjusted Rand index of two labels of the same rows, from their contingency table."""
    two = lambda c: F.sum(c * (c - 1) / 2)
    cells = groups.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(two(F.col("n")).alias("both_s"), F.sum("n").alias("n"))
    side = lambda c, s: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias(s))
    all_ = both.crossJoin(F.broadcast(side(a, "a_s"))).crossJoin(F.broadcast(side(b, "b_s")))
    expected = F.try_divide(F.col("a_s") * F.col("b_s"), F.col("n") * (F.col("n") - 1) / 2)
    return all_.select("n", F.coalesce(F.try_divide(F.col("both_s") - expected, (F.col("a_s") + F.col("b_s")) / 2 - expected), F.lit(1.0)).alias("ari"))


def communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(item, community): weighted label propagation from each item's own label; ties to the smallest label.

    Stands in for modularity search, which has no distributed exact form. An item keeps its label if none is better;
    about half of the items may move in a turn, another half each time, so labels don't swap for ever. It ends when
    none wants to move, or after `rounds`.
    """
    back = edges.select(F.col("j").alias("a"), F.col("i").alias("b"), "weight")
    w = materialize(edges.select(F.col("i").alias("a"), F.col("j").alias("b"), "weight").unionByName(back), "lp-edges")
    now = materialize(w.select(F.col("a").alias("item"), F.col("a").alias("community")).distinct(), "lp")
    for turn in range(rounds):
        votes = w.join(now.select(F.col("item").alias("b"), F.col("community").alias("label")), "b").groupBy(F.col("a").alias("item"), "label").agg(F.sum("weight").alias("v"))
        ranked = F.struct(F.round("v", 9).alias("v"), (F.col("label") == F.col("community")).alias("own"), (-F.col("label")).alias("back"))
        best = votes.join(now, "item").groupBy("item", "community").agg((-F.max(ranked)["back"]).alias("best"))
        moves = F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(2)) == 0
        after = materialize(best.select("item", F.when(moves, F.col("best")).otherwise(F.col("community")).alias("community"), (F.col("best") != F.col("community")).alias("wants")), "lp")
        done = after.filter("wants").isEmpty()
        now = after.drop("wants")
        if done:
            break
    return now
