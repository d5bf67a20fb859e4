"""Small derived tables: ratios, matches in order, alternatives, group texts, diagnostics of a classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plinth.operators import enrich, factor
from plinth.sources.scratch import materialize

#: Fixed value: the share of names without a match from which on a basket is flagged.
UNRESOLVED = 0.15


def unresolved_ratio(lines: DataFrame, known: DataFrame, key: str = "name", least: float = UNRESOLVED) -> DataFrame:
    """(basket, ratio) of baskets whose lines go unmatched at a higher rate than `least`."""
    names = known.select(key).distinct().withColumn("__known", F.lit(True))
    n = lines.join(names, key, "left").groupBy("basket").agg((F.count_if(F.col("__known").isNull()) / F.count("*")).alias("ratio"))
    return n.filter(F.col("ratio") > least)


def playable(items: DataFrame, legal: str = "legal", games: str = "games", medium: str = "paper") -> DataFrame:
    """Rows that are legal and published in a medium; null lists of media count as none."""
    return items.filter(F.coalesce(F.col(legal), F.lit(False)) & F.coalesce(F.array_contains(games, medium), F.lit(False)))


def flattened(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """A struct's fields as columns of their own, named prefix_field, in place of the struct."""
    fields = df.schema[column].dataType.fieldNames()
    return df.select(*[c for c in df.columns if c != column], *[F.col(f"`{column}`.`{f}`").alias(f"{prefix}_{f}") for f in fields])


def with_samples(df: DataFrame, by: str, value: str, sample: str, k: int) -> DataFrame:
    """(by, n, total, samples): count, sum, and the first k distinct samples in order. Only k of a group are gathered."""
    one = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    rank = F.row_number().over(W.partitionBy(by).orderBy(sample))
    few = df.select(by, sample).distinct().withColumn("__rank", rank).filter(F.col("__rank") <= k)
    return one.join(few.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.col(sample).cast("string"))), ", ").alias("samples")), by)


def first_ratio(df: DataFrame, over: str, under: str, order: list[str]) -> DataFrame:
    """(ratio) of one row, the first in a stated order."""
    return df.orderBy(*order).limit(1).select(F.try_divide(F.col(over), F.col(under)).alias("ratio"))


def above_median(df: DataFrame, value: str, name: str = "above") -> DataFrame:
    """Adds a flag, 1 where the value is above the exact median of all rows."""
    from plinth.functions.ranks import quantiles

    mid = quantiles(df, value, [0.5]).select(F.col("q")[0].alias("__mid"))
    return df.crossJoin(F.broadcast(mid)).withColumn(name, (F.col(value) > F.col("__mid")).cast("int")).drop("__mid")  # one row


#: Columns of each named space.
SPACES = {"text": "text_", "types": "type_", "cost": "cost_", "all": ""}


def space_columns(df: DataFrame, space: str, spaces: dict[str, str] | None = None) -> list[str]:
    """Numeric columns of a named space, by prefix, in the table's order. An unknown space raises KeyError."""
    spaces = SPACES if spaces is None else spaces
    if space not in spaces:
        raise KeyError(f"{space}: one of {', '.join(sorted(spaces))}")
    return [c for c, kind in df.dtypes if c.startswith(spaces[space]) and kind in ("double", "float", "int", "bigint")]


def large_groups(members: DataFrame, group: str, least: int, order: list[Column]) -> DataFrame:
    """Members of groups of at least `least` rows, with their rank in the group."""
    sizes = members.groupBy(group).agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    return members.join(sizes, group).withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)))


def cleaned(df: DataFrame, kinds: dict[str, str], keep: Column) -> DataFrame:
    """Columns cast by name (null where a value doesn't fit), then rows filtered."""
    return df.withColumns({c: F.col(c).try_cast(kind) for c, kind in kinds.items()}).filter(keep)


def matched_in_order(names: DataFrame, tags: DataFrame, tries: list[tuple[str, Column]]) -> DataFrame:
    """Adds tag and match_source: the first try whose value is a known tag, or null and 'none'. Tries: (source, value)."""
    known = tags.select("tag").distinct()
    out = names
    for k, (_, value) in enumerate(tries):
        side = known.select(F.col("tag").alias(f"__{k}"))
        out = out.join(side, value == F.col(f"__{k}"), "left")
    found = [F.col(f"__{k}").isNotNull() for k in range(len(tries))]
    source = F.lit("none")
    for k in reversed(range(len(tries))):
        source = F.when(found[k], F.lit(tries[k][0])).otherwise(source)
    return out.select(*names.columns, F.coalesce(*[F.col(f"__{k}") for k in range(len(tries))]).alias("tag"), source.alias("match_source"))


def alternatives(declared: DataFrame, items: DataFrame) -> DataFrame:
    """(template, item): items that can lead and have exactly the identity of a template's declared leaders, but for
    those. declared: (template, item); items: (item, mask, leads). The identity of several is the union of theirs."""
    own = declared.join(items.select("item", "mask"), "item").groupBy("template").agg(F.bit_or("mask").alias("mask"))
    found = own.join(items.filter("leads").select("item", "mask"), "mask").select("template", "item")
    return found.join(declared.select("template", "item"), ["template", "item"], "left_anti")


def harvested(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(template, item, qty) of lines (template, name, qty) that names resolve, and in `n_lost` how many of a template's
    lines don't; templates that resolve nothing give one row without an item."""
    got = lines.join(names.select("name", "item"), "name", "left")
    lost = got.groupBy("template").agg(F.count_if(F.col("item").isNull()).alias("n_lost"))
    kept = got.filter("item is not null").groupBy("template", "item").agg(F.sum("qty").alias("qty"))
    return lost.join(kept, "template", "left").select("template", "item", "qty", "n_lost")


def text_contrast(groups: DataFrame, words: DataFrame) -> DataFrame:
    """(topic, n_pairs, median_cosine) over all pairs of each group's members. groups: (topic, item), each a report's few
    members; words: (item, word, weight). Members without words have the cosine 0 with all."""
    length = words.groupBy("item").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    unit = words.join(length, "item").select("item", "word", (F.col("weight") / F.col("length")).alias("u"))
    pairs = groups.select("topic", F.col("item").alias("i")).join(groups.select("topic", F.col("item").alias("j")), "topic").filter("i < j")
    pairs = materialize(pairs, "contrast-pairs")
    side = lambda x: unit.select(F.col("item").alias(x), "word", F.col("u").alias(f"u_{x}"))
    met = pairs.join(side("i"), "i").join(side("j"), ["j", "word"]).groupBy("topic", "i", "j").agg(F.sum(F.col("u_i") * F.col("u_j")).alias("cosine"))
    every = pairs.join(met, ["topic", "i", "j"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    return every.groupBy("topic").agg(F.count("*").alias("n_pairs"), F.median("cosine").alias("median_cosine"))


def explained(tag_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    """(item, role, layer, evidence, weight): every single piece of evidence of a classification. tag_hits: (item, role,
    tag, weight); text_hits: (item, role, pattern, weight)."""
    tags = tag_hits.select("item", "role", F.lit("tag").alias("layer"), F.col("tag").alias("evidence"), F.col("weight").cast("double").alias("weight"))
    return tags.unionByName(text_hits.select("item", "role", F.lit("text").alias("layer"), F.col("pattern").alias("evidence"), F.col("weight").cast("double").alias("weight")))


def thin_evidence(evidence: DataFrame, most: int = 1) -> DataFrame:
    """(item, role, n, score): roles that rest on at most so many pieces of evidence for them."""
    n = evidence.filter("weight > 0").groupBy("item", "role").agg(F.count("*").alias("n"), F.sum("weight").alias("score"))
    return n.filter(F.col("n") <= most)


def two_sided(evidence: DataFrame) -> DataFrame:
    """(evidence, role, n_with, n_without): of the items that show a piece of evidence, how many get the role from other
    evidence as well and how many have no other; a rule with none of the former stands alone."""
    for_ = evidence.filter("weight > 0").select("item", "role", "evidence").distinct()
    counted = for_.withColumn("n", F.count("*").over(W.partitionBy("item", "role")))
    return counted.groupBy("evidence", "role").agg(F.count_if(F.col("n") > 1).alias("n_with"), F.count_if(F.col("n") == 1).alias("n_without"))


def granularity_curve(nodes: list[factor.Node], labels: DataFrame, leaves: list[int], least: int = 5, lift: float = 3.0, fdr: float = 0.01) -> DataFrame:
    """The granularity report of each cut of a hierarchy into so many leaves: (leaves, n_topics, n_labels, covered, …)."""
    out = None
    for n in leaves:
        members = materialize(factor.cut(labels.sparkSession, nodes, n), "curve-cut")
        found = materialize(enrich.enriched(enrich.enrichment(members, labels, least), lift, fdr), "curve-enriched")
        topics = F.broadcast(members.agg(F.count_distinct("topic").alias("n_topics")))  # one row
        one = enrich.granularity(found, members, labels).crossJoin(topics).withColumn("leaves", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out
