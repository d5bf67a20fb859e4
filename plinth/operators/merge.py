"""Rewrites of keyed tables: upserts, precedence, replacement by scope, backfills and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_per_key(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    return rows.withColumn("__rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__rank = 1").drop("__rank")


def upsert(old: DataFrame, new: DataFrame, key: list[str], protected: Column | None = None) -> DataFrame:
    """New rows replace old ones of the same key. Old rows for which `protected` holds always stay. Of new rows that
    repeat a key any one would do, so they must not: use last_write_wins first."""
    o = old.withColumn("__new", F.lit(0)) if protected is None else old.withColumn("__new", F.when(protected, 2).otherwise(0))
    return first_per_key(o.unionByName(new.withColumn("__new", F.lit(1))), key, [F.desc("__new")]).drop("__new")


def last_write_wins(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    return first_per_key(rows, key, [F.desc(v) for v in version])


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Old rows of every scope in `new` go, then all new rows come."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new)


def backfill(rows: DataFrame, values: DataFrame, key: list[str], column: str) -> DataFrame:
    """Sets a column from another table; rows without a match get null."""
    return rows.drop(column).join(values.select(*key, column), key, "left")


def stratified_cap(rows: DataFrame, stratum: str, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most `most` rows a stratum, by the MD5 of the key and a seed: the same rows every time and everywhere."""
    mixed = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(mixed, key))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= most).drop("__rank")


def alias_merge(own: DataFrame, alias: DataFrame, key: str) -> DataFrame:
    """Names to ids: an item's own name beats any alias; then the smallest id."""
    rows = own.select(key, "item", F.lit(0).alias("__p")).unionByName(alias.select(key, "item", F.lit(1).alias("__p")))
    return first_per_key(rows, [key], ["__p", "item"]).drop("__p")


def assert_unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows; running it raises if a key repeats."""
    n = F.count("*").over(W.partitionBy(*key))
    return rows.withColumn("__ok", F.assert_true(n == 1, F.lit(f"{key} repeats"))).filter(F.col("__ok").isNull()).drop("__ok")


def require(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows; running it raises if one of the columns is null."""
    ok = F.assert_true(F.forall(F.array(*[F.col(c).isNotNull() for c in columns]), lambda x: x), F.lit(f"{columns}: missing values"))
    return rows.withColumn("__ok", ok).filter(F.col("__ok").isNull()).drop("__ok")


def quota_left(targets: DataFrame, kept: DataFrame, key: str, skip: DataFrame | None = None) -> DataFrame:
    """(key, target, kept, wanted): what is still to be fetched, skipping given keys."""
    n = kept.groupBy(key).agg(F.count("*").alias("kept"))
    out = targets.join(n, key, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    out = out if skip is None else out.join(skip.select(key), key, "left_anti")
    return out.select(key, "target", "kept", F.greatest(F.lit(0), F.col("target") - F.col("kept")).alias("wanted"))


def share_target(n: Column, most: Column, low: int = 5, high: int = 25) -> Column:
    """Square-root share of `high`, within bounds, rounded half to even."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.bround(high * F.sqrt(n / most)).cast("int")))
