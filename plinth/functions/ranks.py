"""Positions in a total order, of tables that no single task could sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plinth.sources.scratch import materialize


def ranked(rows: DataFrame, *order: Column, name: str = "rank", pieces: int = 64) -> DataFrame:
    """Adds the position from 1 in the order given. Rows are dealt out by ranges of the whole order (so the many rows of
    one first value are dealt out as well) and written once; each range is numbered apart and shifted by those before."""
    ranged = rows.repartitionByRange(pieces, *order).withColumn("__piece", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    sizes = ranged.groupBy("__piece").agg(F.count("*").alias("__n"))  # `pieces` rows at most
    before = sizes.withColumn("__before", F.sum("__n").over(W.orderBy("__piece").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).drop("__n")
    own = F.row_number().over(W.partitionBy("__piece").orderBy(*order))
    return ranged.withColumn("__own", own).join(F.broadcast(before), "__piece").withColumn(name, F.col("__own") + F.col("__before")).drop("__piece", "__own", "__before")


def at_positions(rows: DataFrame, value: str, positions: dict[str, Column]) -> DataFrame:
    """One row with, for each name, the non-null value at a position from 0 in ascending order; positions are expressions
    of `n`, the number of such values. Empty tables give nulls."""
    found = ranked(rows.select(F.col(value).alias("__v")).filter(F.col("__v").isNotNull()), F.col("__v"), name="__rank")
    asked = found.agg(F.count("*").alias("n")).select(*[p.cast("long").alias(name) for name, p in positions.items()])
    met = found.crossJoin(F.broadcast(asked))  # one row
    return met.agg(*[F.max(F.when(F.col("__rank") - 1 == F.col(name), F.col("__v"))).alias(name) for name in positions])


def quantiles(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row with the array `q` of exact quantiles, interpolated between the two nearest values."""
    at = {f"{side}{k}": f(F.lit(s) * (F.col("n") - 1)) for k, s in enumerate(shares) for side, f in (("low", F.floor), ("high", F.ceil))}
    n = rows.filter(F.col(value).isNotNull()).agg(F.count("*").alias("n"))
    found = at_positions(rows, value, at).crossJoin(F.broadcast(n))
    part = lambda k, s: F.lit(s) * (F.col("n") - 1) - F.floor(F.lit(s) * (F.col("n") - 1))
    mixed = [(1 - part(k, s)) * F.col(f"low{k}") + part(k, s) * F.col(f"high{k}") for k, s in enumerate(shares)]
    return found.select(F.array(*mixed).alias("q"))
