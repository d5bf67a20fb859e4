"""The basket model over the test tables: customers as baskets, parts as items, nations as strata and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plinth.sources.scratch import spread

#: Lines of a task; and tasks up to which Spark's shuffles are written without holding rows (bypassMergeThreshold).
LINES, BYPASS = 1_000_000, 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(spark: SparkSession, sf_dir: str, name: str = "lineitem", times: int = 1) -> int:
    """Tasks of a step over all lines, or over `times` rows for each of another table's, LINES a task (up to four times as many rather than more than BYPASS tasks); 0 if
    Spark's own number is enough. Adaptive plans merge partitions down to the number of cores, so that is what counts."""
    n = -(-table(spark, sf_dir, name).count() * times // LINES)  # from the files' footers
    own = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return min(n, max(BYPASS, n // 4)) if n > own else 0


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basket, item, qty): one row for each item of a basket."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("basket"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), "l_quantity")
    n = pieces(spark, sf_dir)
    joined = spread(lines, n, "l_orderkey").join(spread(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return spread(joined, n, "basket", "item").groupBy("basket", "item").agg(F.sum("l_quantity").cast("long").alias("qty"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, name, kind, brand, size, price, mask, staple); mask is an identity of five bits."""
    p = table(spark, sf_dir, "part")
    bit = F.expr("shiftleft(1, cast(p_partkey % 5 as int))")
    return p.select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
        F.when(F.col("p_partkey") % 6 == 5, 0).otherwise(bit).alias("mask"), (F.col("p_type") == "ECONOMY").alias("staple"),
    )


def holders(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """(basket, stratum, mask) of baskets that hold anything; `held`: the baskets, if they are at hand."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("basket"), F.col("c_nationkey").alias("stratum"), ((F.col("c_custkey") * 7) % 32).cast("int").alias("mask")
    )
    held = baskets(spark, sf_dir) if held is None else held
    return c.join(spread(held.select("basket"), pieces(spark, sf_dir), "basket").distinct(), "basket", "left_semi")


def true_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stratum, true_n): the population behind each stratum, where it is known."""
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("stratum")).agg(F.count("*").alias("true_n"))


def templates(spark: SparkSession, sf_dir: str, size: int = 40, held: DataFrame | None = None) -> DataFrame:
    """(template, item, qty): the `size` largest lines of each stratum's first basket."""
    held = baskets(spark, sf_dir) if held is None else held
    first = holders(spark, sf_dir, held).groupBy(F.col("stratum").alias("template")).agg(F.min("basket").alias("basket"))
    rank = F.row_number().over(W.partitionBy("template").orderBy(F.desc("qty"), "item"))
    rows = held.join(F.broadcast(first), "basket").withColumn("rank", rank)
    return rows.filter(F.col("rank") <= size).select("template", "item", "qty")


def template_leaders(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """(template, declared, partner, alternatives) of each stratum's template."""
    t = holders(spark, sf_dir, held).select(F.col("stratum").alias("template")).distinct()
    near = lambda k: ((F.col("template") + k) % 25).cast("int")
    return t.select(
        "template", F.col("template").alias("declared"), F.when(F.col("template") % 5 == 0, near(1)).alias("partner"),
        F.when(F.col("template") % 3 == 0, F.array(near(2))).otherwise(F.array().cast("array<int>")).alias("alternatives"),
    )


def basket_leaders(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """(basket, leader): one or two leaders a basket."""
    h = holders(spark, sf_dir, held)
    two = F.when(F.col("basket") % 4 == 0, F.array("stratum", (F.col("basket") % 25).cast("int"))).otherwise(F.array("stratum"))
    return h.select("basket", F.explode(F.array_distinct(two)).alias("leader"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, tag): the words of an item's name, its kind and its brand."""
    c = catalog(spark, sf_dir)
    words = F.concat(F.split(F.lower("name"), " "), F.array(F.lower("kind")), F.array(F.lower("brand")))
    return c.select("item", F.explode(F.array_distinct(words)).alias("tag"))
