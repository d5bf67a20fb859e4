"""Profiles and small reports: nulls, summaries, pivots, ranks and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plinth.functions.ranks import quantiles


def null_profile(df: DataFrame) -> DataFrame:
    """(field, n_null, filled_pct) of every column, in one pass."""
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("n_null"), F.col("__n")) for c in df.columns])).alias("x")
    return one.select(pairs).select("x.field", "x.n_null", ((1 - F.try_divide(F.col("x.n_null"), F.col("x.__n"))) * 100).alias("filled_pct"))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, mean, sd, low, high, mid): mean, sample deviation, extremes and exact median."""
    each = [F.struct(F.lit(c).alias("field"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.median(c).alias("mid")) for c in columns]
    return df.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def extreme_per_group(df: DataFrame, by: list[str], value: str, key: str, largest: bool = True) -> DataFrame:
    """The row of each group with the largest (or smallest) value; ties to the smallest key."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc_nulls_last(value) if largest else F.asc_nulls_last(value), key))
    return df.withColumn("__r", rank).filter("__r = 1").drop("__r")


def top_names(df: DataFrame, by: list[str], name: str, order: list[Column], k: int = 3) -> DataFrame:
    """(by, n, names): each group's size and its first k names, joined."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    ranked = df.withColumn("__r", rank)
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__r") <= k, F.struct("__r", name)))), lambda x: x[name]), ", ")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), first.alias("names"))


def grid(df: DataFrame, x: str, y: str, low: int, high: int) -> DataFrame:
    """(x, y, n, heat): counts over the whole grid of clipped values, 0 where none, and ln(1 + n) over the largest."""
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high)).cast("int")
    n = df.groupBy(clip(x).alias("x"), clip(y).alias("y")).agg(F.count("*").alias("n"))
    side = lambda name: df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(name))
    full = side("x").crossJoin(side("y")).join(F.broadcast(n), ["x", "y"], "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n"))
    return full.crossJoin(F.broadcast(n.agg(F.max(F.log1p("n")).alias("most")))).select("x", "y", "n", (F.log1p("n") / F.col("most")).alias("heat"))


def cross_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().fillna(0)


def quintile_means(df: DataFrame, by: str, value: str) -> DataFrame:
    """(bin, n, mean): means of a value in five bins between exact quintiles of another, bins closed above."""
    edges = quantiles(df, by, [0.2, 0.4, 0.6, 0.8]).withColumnRenamed("q", "e")
    rows = df.crossJoin(F.broadcast(edges)).select(F.size(F.filter("e", lambda e: e < F.col(by))).alias("bin"), F.col(value).alias("v"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def positional_means(df: DataFrame, group: str, order: list[Column], value: str, width: int = 10) -> DataFrame:
    """(group, bin, mean): means of each group's runs of `width` rows."""
    at = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("bin", F.floor((at - 1) / width).cast("long")).groupBy(group, "bin").agg(F.avg(value).alias("mean"))


def overlap_top(a: DataFrame, b: DataFrame, key: str, order_a: list[Column], order_b: list[Column], k: int = 10) -> DataFrame:
    """(n): how many of a's first k are among b's first k."""
    return a.orderBy(*order_a).limit(k).select(key).join(b.orderBy(*order_b).limit(k).select(key), key).agg(F.count("*").alias("n"))


def extremes(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The k smallest and the k largest rows, marked."""
    low = df.orderBy(value, key).limit(k).withColumn("side", F.lit("low"))
    return low.unionByName(df.orderBy(F.desc(value), key).limit(k).withColumn("side", F.lit("high")))


def size_audit(baskets: DataFrame, holders: DataFrame, least: int) -> DataFrame:
    """(basket, n): baskets, also empty ones, that hold fewer than `least` items by quantity."""
    n = baskets.groupBy("basket").agg(F.sum("qty").alias("n"))
    return holders.select("basket").join(n, "basket", "left").select("basket", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") < least)


def progress(df: DataFrame, category: str, known: DataFrame, goal: int) -> DataFrame:
    """(category, n, pct): counts with known categories filled with 0; percent of the goal, 100 at most."""
    n = df.groupBy(category).agg(F.count("*").alias("n"))
    out = known.select(category).distinct().join(n, category, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(F.col(category).alias("category"), "n", F.least(F.lit(100.0), F.round(F.col("n") * 100.0 / goal, 1)).alias("pct"))


def find(df: DataFrame, contains: dict[str, str] = {}, equal: dict[str, object] = {}, at_least: dict[str, float] = {}, sort: str | None = None) -> DataFrame:  # noqa: B006
    """Rows that meet all given conditions; substrings ignore case; sort by a column, '-column' downwards, nulls last."""
    for c, v in contains.items():
        df = df.filter(F.contains(F.lower(c), F.lit(v.lower())))
    for c, v in equal.items():
        df = df.filter(F.col(c) == v)
    for c, v in at_least.items():
        df = df.filter(F.col(c) >= v)
    if sort:
        df = df.orderBy(F.desc_nulls_last(sort[1:]) if sort[0] == "-" else F.asc_nulls_last(sort))
    return df


def lookup(df: DataFrame, name: str, text: str, popularity: str) -> DataFrame:
    """The rows for a name, best first: exact, then the most popular that contains it, then the nearest by edits; three."""
    n, want = F.lower(name), text.lower()
    level = F.when(n == want, 0).when(F.contains(n, F.lit(want)), 1).otherwise(2)
    far = F.when(level == 2, F.levenshtein(n, F.lit(want))).otherwise(0)
    return df.withColumn("level", level).withColumn("far", far).orderBy("level", "far", F.desc_nulls_last(popularity), name).limit(3)


def complete(columns: list[str]) -> Column:
    """No value is null, empty or 'N/A'."""
    return F.forall(F.array(*[F.col(c).cast("string") for c in columns]), lambda x: x.isNotNull() & ~x.isin("", "N/A"))


def price_usd(value: Column) -> Column:
    """Rounded up to whole cents."""
    return F.ceil(F.round(value * 100, 6)) / 100


def star_rating(counts: Column) -> Column:
    """Mean of the ratings 1..n whose counts are given; null without any."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    weighted = F.aggregate(F.transform(counts, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(weighted, total)
