"""Tag closure and two-layer, rule-based classification. Rules are tables, so any vocabulary will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plinth.sources.scratch import materialize

#: Least evidence for a role, and for a second one; the score of an override; a large body's own.
LEAST, SECOND_LEAST, OVERRIDE, BODY = 1.0, 1.0, 100.0, 2.5
BODY_FROM = 5


def closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, ancestor): each node with itself and all it reaches by (node, parent). Cycles end, dangling parents go.

    Each round joins only what was new, and doubles as a fixpoint test; rounds are written to the shared folder.
    """
    edges = materialize(edges.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "parent").distinct(), "closure-edges")
    found = fresh = materialize(nodes.select("node", F.col("node").alias("ancestor")).distinct(), "closure")
    while not fresh.isEmpty():
        up = fresh.join(edges.withColumnsRenamed({"node": "ancestor", "parent": "next"}), "ancestor").select("node", F.col("next").alias("ancestor")).distinct()
        fresh = materialize(up.join(found, ["node", "ancestor"], "left_anti"), "closure")
        found = found.unionByName(fresh)
    return found


def expand(item_nodes: DataFrame, closed: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(item, tag) distinct, over self and ancestors; items outside a given catalogue are left out."""
    rows = item_nodes if items is None else item_nodes.join(items.select("item"), "item", "left_semi")
    return rows.join(closed, rows["tag"] == closed["node"]).select("item", F.col("ancestor").alias("tag")).distinct()


def tag_scores(tags: DataFrame, rules: DataFrame, combos: list[tuple[str, list[str], float]] = ()) -> DataFrame:
    """(item, role, credit, penalty): positive and negative weights apart; a combo adds credit if all its tags are there."""
    t = tags.select("item", "tag").distinct()
    w = F.col("weight")
    parts = t.join(F.broadcast(rules), "tag").select("item", "role", F.greatest(w, F.lit(0.0)).alias("credit"), F.least(w, F.lit(0.0)).alias("penalty"))
    for role, needed, bonus in combos:
        has = t.filter(F.col("tag").isin(*needed)).groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") == len(set(needed)))
        parts = parts.unionByName(has.select("item", F.lit(role).alias("role"), F.lit(float(bonus)).alias("credit"), F.lit(0.0).alias("penalty")))
    return parts.groupBy("item", "role").agg(F.sum("credit").alias("credit"), F.sum("penalty").alias("penalty"))


def text_scores(items: DataFrame, rules: list[tuple[str, str, float]], text: str = "text", skip: Column | None = None, skippable: frozenset[str] = frozenset()) -> DataFrame:
    """(item, role, score): weights of the patterns found, each once. Rules of `skippable` roles don't count where `skip`.

    All patterns are tried in one projection of the text; only roles with evidence become rows.
    """
    by_role: dict[str, list[tuple[str, float]]] = {}
    for role, pattern, weight in rules:
        by_role.setdefault(role, []).append((pattern, weight))
    cols = []
    for role, own in by_role.items():
        total = sum((F.when(F.col(text).rlike(p), float(w)).otherwise(0.0) for p, w in own), F.lit(0.0))
        if skip is not None and role in skippable:
            total = F.when(skip, 0.0).otherwise(total)
        cols.append(F.struct(F.lit(role).alias("role"), total.alias("score")))
    return items.select("item", F.explode(F.array(*cols)).alias("x")).select("item", "x.role", "x.score").filter("score != 0")


def best_role(scores: DataFrame, priority: list[str], value: str, least: float = LEAST) -> DataFrame:
    """(item, role, value): the highest score of at least `least`; ties by the order of `priority`."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("role"))
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc(value), place))
    return scores.filter(F.col(value) >= least).withColumn("rank", rank).filter("rank = 1").select("item", "role", value)


def classify(items: DataFrame, by_tag: DataFrame, by_text: DataFrame, priority: list[str], default: str = "other", override: str = "land", body: str | None = None) -> DataFrame:
    """One row per item: primary and secondary role, scores, sources, and each layer's own verdict.

    A role's score is the larger of both layers' credit, plus penalties. `items` has (item, is_override, big_body).
    Items without a primary role are `default`, with null verdicts.
    """
    tag_total = by_tag.select("item", "role", (F.col("credit") + F.col("penalty")).alias("score"))
    joined = by_tag.join(by_text, ["item", "role"], "full").select(
        "item", "role", (F.greatest(F.coalesce("credit", F.lit(0.0)), F.coalesce("score", F.lit(0.0))) + F.coalesce("penalty", F.lit(0.0))).alias("score")
    )
    typed = items.filter("is_override").select("item", F.lit(override).alias("role"), F.lit(OVERRIDE).alias("score"))
    if body is not None:
        typed = typed.unionByName(items.filter("not is_override and big_body").select("item", F.lit(body).alias("role"), F.lit(BODY).alias("score")))
    both = joined.unionByName(typed).groupBy("item", "role").agg(F.max("score").alias("score"))
    first = best_role(both, priority, "score").withColumnsRenamed({"role": "primary", "score": "primary_score"})
    rest = both.join(first.select("item", "primary"), "item").filter((F.col("role") != F.col("primary")) & ~F.col("role").isin(override, default))
    second = best_role(rest, priority, "score", SECOND_LEAST).withColumnsRenamed({"role": "secondary", "score": "secondary_score"})
    t = best_role(tag_total, priority, "score").select("item", F.col("role").alias("tag_primary"))
    x = best_role(by_text, priority, "score").select("item", F.col("role").alias("text_primary"))
    out = items.select("item").join(first, "item", "left").join(second, "item", "left").join(t, "item", "left").join(x, "item", "left")
    seen = lambda frame, flag, role: frame.filter("score > 0").select("item", F.col("role").alias(role), F.lit(True).alias(flag))
    for role in ("primary", "secondary"):
        out = out.join(seen(tag_total, f"{role}_t", role), ["item", role], "left").join(seen(by_text, f"{role}_x", role), ["item", role], "left")
    source = lambda r: F.when(F.col(r).isNull(), None).when(F.col(f"{r}_t") & F.col(f"{r}_x"), "both").when(F.col(f"{r}_t"), "tags").when(F.col(f"{r}_x"), "text").otherwise("type")
    none = F.col("primary").isNull()
    return out.select(
        "item", F.coalesce("primary", F.lit(default)).alias("primary"), F.coalesce("primary_score", F.lit(0.0)).alias("primary_score"),
        F.coalesce(source("primary"), F.lit("default")).alias("primary_source"), "secondary", F.coalesce("secondary_score", F.lit(0.0)).alias("secondary_score"),
        source("secondary").alias("secondary_source"), F.when(~none, F.col("tag_primary")).alias("tag_primary"), F.when(~none, F.col("text_primary")).alias("text_primary"),
    )


def agreement(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Counts of two verdicts on the same rows, and the rate of agreement where both speak."""
    a, b = F.col(left).isNotNull(), F.col(right).isNotNull()
    n = rows.agg(
        F.count_if(a & b).alias("n_both"), F.count_if(a & b & (F.col(left) == F.col(right))).alias("n_agree"), F.count_if(a & ~b).alias("n_only_left"),
        F.count_if(~a & b).alias("n_only_right"), F.count_if(~a & ~b).alias("n_neither"),
    )
    return n.withColumn("rate", F.try_divide(F.col("n_agree"), F.col("n_both")))


def big_body(power: Column, toughness: Column) -> Column:
    """Whether either is a whole number of at least BODY_FROM; other strings don't count."""
    return (F.coalesce(power.try_cast("int"), F.lit(0)) >= BODY_FROM) | (F.coalesce(toughness.try_cast("int"), F.lit(0)) >= BODY_FROM)
