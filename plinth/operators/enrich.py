"""Enrichment of groups by labels: hypergeometric tails, step-up adjustment, granularity, purity and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plinth.sources.scratch import materialize


def log_factorials(spark, most: int, block: int = 4096) -> DataFrame:
    """(n, lf) for 0..most. Sums run within blocks of numbers, and over the sums of the blocks."""
    n = spark.range(most + 1).select(F.col("id").alias("n"), F.floor(F.col("id") / block).alias("b"), F.ln(F.greatest("id", F.lit(1))).alias("l"))
    ahead = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    sums = n.groupBy("b").agg(F.sum("l").alias("s"))
    bases = sums.select("b", (F.sum("s").over(ahead(W.orderBy("b"))) - F.col("s")).alias("base"))
    inner = n.withColumn("inner", F.sum("l").over(ahead(W.partitionBy("b").orderBy("n"))))
    return inner.join(bases, "b").select("n", (F.col("base") + F.col("inner")).alias("lf"))


def enrichment(members: DataFrame, labels: DataFrame, least: int = 5) -> DataFrame:
    """(topic, tag, both_n, n, k, share, recall, resolution, lift, p) of topics and labels that share at least `least`
    items of the pool.

    p is the hypergeometric upper tail. Its terms follow each other by a ratio, so each pair sums its own tail in one
    expression from the first term, whose log-factorials are looked up by one join of all their arguments.
    """
    pool = members.select("item").distinct()
    mine = labels.select("item", "tag").distinct().join(pool, "item", "left_semi")
    sizes = members.groupBy("topic").agg(F.count("*").alias("n"))
    wide = mine.groupBy("tag").agg(F.count("*").alias("k"))
    both = members.select("item", "topic").join(mine, "item").groupBy("topic", "tag").agg(F.count("*").alias("both_n")).filter(F.col("both_n") >= least)
    rows = both.join(sizes, "topic").join(wide, "tag").crossJoin(F.broadcast(pool.agg(F.count("*").alias("big"))))  # one row
    lf = log_factorials(members.sparkSession, pool.count())
    signs = {"k": 1, "both_n": -1, "k - both_n": -1, "big - k": 1, "n - both_n": -1, "big - k - n + both_n": -1, "big": -1, "n": 1, "big - n": 1}
    each = F.explode(F.array(*[F.struct(F.expr(f"cast(greatest({at}, 0) as bigint)").alias("at"), F.lit(sign).alias("sign")) for at, sign in signs.items()]))
    looked = rows.withColumn("x", each).select("topic", "tag", "both_n", "n", "k", "big", F.col("x.at").alias("at"), F.col("x.sign").alias("sign"))
    looked = looked.join(lf.withColumnRenamed("n", "at"), "at").groupBy("topic", "tag", "both_n", "n", "k", "big")
    rows = looked.agg(F.sum(F.col("sign") * F.col("lf")).alias("log_first"))
    first = F.exp("log_first")
    step = lambda s, x: F.struct(
        (s["p"] + s["t"]).alias("p"),
        (s["t"] * ((F.col("k") - x) * (F.col("n") - x)) / ((x + 1) * (F.col("big") - F.col("k") - F.col("n") + x + 1))).alias("t"),
    )
    xs = F.sequence("both_n", F.least("n", "k"))
    tail = F.aggregate(xs, F.struct(F.lit(0.0).alias("p"), first.alias("t")), step, lambda s: s["p"])
    p = F.least(tail, F.lit(1.0))
    share, recall = F.col("both_n") / F.col("n"), F.col("both_n") / F.col("k")
    return rows.select("topic", "tag", "both_n", "n", "k", share.alias("share"), recall.alias("recall"), F.least(share, recall).alias("resolution"), (F.col("both_n") / (F.col("n") * F.col("k") / F.col("big"))).alias("lift"), p.alias("p"))


def step_up(tests: DataFrame, p: str, key: list[str]) -> DataFrame:
    """Adds q, the Benjamini-Hochberg adjusted p: min over later ranks of p n / rank, within [0, 1].

    Tests are pairs of topics and labels, a small product of two dimensions; ranks are taken over distinct p first, so
    the one-task windows hold distinct values only.
    """
    n = tests.groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("c"))
    run = n.withColumn("rank", F.sum("c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("c").over(W.partitionBy()))
    q = F.min(F.col("__p") * F.col("all") / F.col("rank")).over(W.orderBy("__p").rowsBetween(0, W.unboundedFollowing))
    adjusted = run.select("__p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)).alias("q"))
    return tests.join(adjusted, F.col(p) == F.col("__p")).drop("__p")


def enriched(tested: DataFrame, lift: float = 3.0, fdr: float = 0.01) -> DataFrame:
    """Tested pairs with their adjusted p as q, of which those stay that have at least the lift and at most the rate of
    false discoveries. q is taken over all pairs tested, before any goes."""
    return step_up(tested, "p", ["topic", "tag"]).filter((F.col("lift") >= lift) & (F.col("q") <= fdr))


def granularity(enriched: DataFrame, members: DataFrame, labels: DataFrame, cuts: tuple[float, ...] = (0.05, 0.10, 0.20, 0.30)) -> DataFrame:
    """(n_labels, covered, resolved_<cut>..., median_labels) of enriched pairs (see `enriched`): labels found anywhere,
    labels with a topic that resolves them, and the median of labels a topic over all topics."""
    best = enriched.groupBy("tag").agg(F.max("resolution").alias("r"))
    one = best.agg(F.count("*").alias("covered"), *[F.count_if(F.col("r") >= c).alias(f"resolved_{round(c * 100)}") for c in cuts])
    per = members.select("topic").distinct().join(enriched.groupBy("topic").agg(F.count("*").alias("c")), "topic", "left")
    mid = per.agg(F.median(F.coalesce("c", F.lit(0))).alias("median_labels"))
    n = labels.agg(F.count_distinct("tag").alias("n_labels"))
    return n.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(mid))


def purity(members: DataFrame, catalog: DataFrame, top: int = 30) -> DataFrame:
    """(topic, size, modal_mask, purity) over each topic's `top` items by weight; the smaller mask wins a tie."""
    rank = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("weight"), "item"))
    rows = members.select("topic", "item", "weight").join(catalog.select("item", "mask"), "item").withColumn("rank", rank).filter(F.col("rank") <= top)
    n = rows.groupBy("topic", "mask").agg(F.count("*").alias("c"))
    best = n.groupBy("topic").agg(F.max(F.struct("c", (-F.col("mask")).alias("back"))).alias("best"), F.sum("c").alias("all"))
    sizes = members.groupBy("topic").agg(F.count("*").alias("size"))
    return best.join(sizes, "topic").select("topic", "size", (-F.col("best.back")).alias("modal_mask"), (F.col("best.c") / F.col("all")).alias("purity"))


def purity_null(members: DataFrame, catalog: DataFrame, top: int = 30, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(draw, purity): the largest share of one mask among `top` items drawn without replacement from all members, items
    without a mask being one kind of their own.

    A draw takes the `top` items with the smallest seeded hashes; a threshold on the hash leaves a few times as many to
    rank, so the pool isn't sorted for each draw.
    """
    pool = materialize(members.select("item").distinct().join(catalog.select("item", "mask"), "item", "left"), "purity-pool")
    n = pool.count()
    if not n:
        return members.sparkSession.createDataFrame([], "draw long, purity double")
    take, share = min(top, n), min(1.0, (4 * top + 40) / n)
    numbered = members.sparkSession.range(draws).withColumnRenamed("id", "draw")
    hashed = pool.crossJoin(F.broadcast(numbered)).withColumn("at", F.xxhash64("item", "draw", F.lit(seed)))  # draws is a parameter
    few = hashed.filter(F.col("at") / 2.0**64 + 0.5 <= share)
    drawn = few.withColumn("rank", F.row_number().over(W.partitionBy("draw").orderBy("at", "item"))).filter(F.col("rank") <= take)
    counted = drawn.groupBy("draw", "mask").agg(F.count("*").alias("c")).groupBy("draw")
    return counted.agg((F.max("c") / F.sum("c")).alias("purity"))


def community_names(assigned: DataFrame, tags: DataFrame, n_items: int, least: int = 4, share: float = 0.10, lift: float = 8.0, broad_share: float = 0.20, broad_lift: float = 2.0) -> DataFrame:
    """(topic, name): the two tags with the largest share * ln(1 + lift) that clear the gates; where none of them
    covers `broad_share`, the widest tag of at least `broad_lift` leads instead."""
    sizes = assigned.groupBy("topic").agg(F.count("*").alias("n"))
    wide = tags.groupBy("tag").agg(F.count_distinct("item").alias("all"))
    k = assigned.join(tags, "item").groupBy("topic", "tag").agg(F.count_distinct("item").alias("k"))
    st = k.join(sizes, "topic").join(wide, "tag").withColumn("share", F.col("k") / F.col("n"))
    st = st.withColumn("lift", F.col("share") / (F.col("all") / n_items)).withColumn("score", F.col("share") * F.log1p("lift")).filter(F.col("k") >= least)
    ok = st.filter((F.col("share") >= share) & (F.col("lift") >= lift))
    order = lambda c: F.row_number().over(W.partitionBy("topic").orderBy(F.desc(F.round(c, 9)), "tag"))
    top = ok.withColumn("rank", order("score")).withColumn("most", F.max("share").over(W.partitionBy("topic")))
    top = top.filter("rank <= 2").groupBy("topic").agg(F.max(F.when(F.col("rank") == 1, F.col("tag"))).alias("one"), F.max(F.when(F.col("rank") == 2, F.col("tag"))).alias("two"), F.max("most").alias("most"))
    broad = st.filter(F.col("lift") >= broad_lift).withColumn("rank", order("share")).filter("rank = 1").select("topic", F.col("tag").alias("broad"))
    out = top.join(broad, "topic", "left")
    rescue = (F.col("most") < broad_share) & F.col("broad").isNotNull() & (F.col("broad") != F.col("one")) & ~F.coalesce(F.col("broad") == F.col("two"), F.lit(False))
    return out.select("topic", F.when(rescue, F.concat_ws("/", "broad", "one")).otherwise(F.concat_ws("/", "one", "two")).alias("name"))
