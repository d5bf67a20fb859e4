"""Queries of the report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import text as X
from plinth.operators import reports as R
from plinth.plans.registry import query
from plinth.plans.sql import select
from plinth.sources import model as M


@query(
    select(
        "SELECT basket, round(ratio, 9) AS ratio FROM (SELECT basket, count(*) FILTER (size <= 12) / CAST(count(*) AS DOUBLE) AS ratio FROM baskets JOIN catalog USING (item) GROUP BY 1) WHERE ratio > 0.15",
        "baskets", "catalog",
    )
)
def unresolved_ratio(spark, sf):
    """Lines by a name made of the item; the names of small parts aren't known."""
    name = F.concat(F.lit("part "), F.col("item").cast("string")).alias("name")
    lines = M.baskets(spark, sf).join(M.catalog(spark, sf).select("item"), "item").select("basket", name)
    return R.unresolved_ratio(lines, M.catalog(spark, sf).filter("size > 12").select(name)).withColumn("ratio", F.round("ratio", 9))


@query("SELECT p_partkey AS item FROM part WHERE p_size % 3 <> 0 AND (p_size % 2 = 0 OR p_brand = 'paper')")
def playable_items(spark, sf):
    p = M.table(spark, sf, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") % 3 != 0).alias("legal"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("paper"), F.lit("online"))).when(F.col("p_size") % 5 == 0, F.array(F.lit("online"))).alias("games"))
    return R.playable(p).select("item")


@query("SELECT p_partkey AS item, p_retailprice AS price_usd, p_retailprice / 2 AS price_eur, p_size > 10 AS legal_main FROM part")
def flattened_structs(spark, sf):
    price, legal = F.struct(F.col("p_retailprice").alias("usd"), (F.col("p_retailprice") / 2).alias("eur")), F.struct((F.col("p_size") > 10).alias("main"))
    p = M.table(spark, sf, "part").select(F.col("p_partkey").alias("item"), price.alias("prices"), legal.alias("legalities"))
    return R.flattened(R.flattened(p, "prices", "price"), "legalities", "legal")


@query("SELECT a.p_brand AS brand, n, total, samples FROM (SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1) a JOIN (SELECT p_brand, array_to_string(list_sort(list(p_name)), ', ') AS samples FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS rk FROM (SELECT DISTINCT p_brand, p_name FROM part)) WHERE rk <= 3 GROUP BY 1) b USING (p_brand)")
def counts_with_samples(spark, sf):
    return R.with_samples(M.table(spark, sf, "part"), "p_brand", "p_size", "p_name", 3).withColumnRenamed("p_brand", "brand")


@query("SELECT round(l_extendedprice / l_quantity, 9) AS ratio FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1")
def first_row_ratio(spark, sf):
    return R.first_ratio(M.table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_orderkey", "l_linenumber"]).withColumn("ratio", F.round("ratio", 9))


@query("SELECT p_partkey AS item, len(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS n_words, CAST(p_retailprice > (SELECT median(p_retailprice) FROM part) AS INTEGER) AS dear FROM part")
def words_and_dear_items(spark, sf):
    p = R.above_median(M.table(spark, sf, "part"), "p_retailprice", "dear")
    return p.select(F.col("p_partkey").alias("item"), F.size(F.filter(F.split("p_name", " "), lambda x: x != "")).cast("long").alias("n_words"), "dear")


@query("SELECT p_partkey AS item, CAST(p_size AS DOUBLE) AS cost_size, p_retailprice AS cost_price FROM part")
def columns_of_a_space(spark, sf):
    p = M.table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("cost_size"), F.col("p_retailprice").alias("cost_price"), F.col("p_name").alias("cost_name"), F.lit(1.0).alias("text_a"))
    return p.select("item", *R.space_columns(p, "cost"))


@query(
    select(
        "SELECT topic, item, size, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, item) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY topic) AS size FROM members) WHERE size >= (SELECT count(*) / 8.0 FROM members)",
        "members",
    )
)
def large_topics(spark, sf):
    from plinth.plans.baskets import _members

    m = _members(spark, sf)
    least = m.count() / 8
    return R.large_groups(m, "topic", least, [F.desc("weight"), F.col("item")]).select("topic", "item", "size", F.col("rank").cast("long").alias("rank"))


@query("SELECT CAST(p_partkey AS INTEGER) AS item, CAST(floor(p_retailprice) AS INTEGER) AS price FROM part WHERE p_partkey % 4 <> 0 AND p_size > 5")
def cleaned_frame(spark, sf):
    p = M.table(spark, sf, "part")
    raw = p.select(F.when(F.col("p_partkey") % 4 == 0, "none").otherwise(F.col("p_partkey").cast("string")).alias("item"), F.floor("p_retailprice").cast("string").alias("price"), "p_size")
    return R.cleaned(raw, {"item": "int", "price": "int"}, F.col("item").isNotNull() & (F.col("p_size") > 5)).select("item", "price")


_THEMES = "SELECT DISTINCT lower(p_type) AS theme FROM part UNION SELECT DISTINCT string_split(lower(p_name), ' ')[1] || 's' FROM part UNION SELECT 'the shiny one' UNION SELECT 'nothing-at-all'"


@query(
    select(
        f"SELECT theme, coalesce(a.tag, b.tag, c.tag) AS tag, CASE WHEN a.tag IS NOT NULL THEN 'exact' WHEN b.tag IS NOT NULL THEN 'singular' WHEN c.tag IS NOT NULL THEN 'alias' ELSE 'none' END AS match_source FROM ({_THEMES}) LEFT JOIN (SELECT DISTINCT tag FROM tags) a ON a.tag = theme LEFT JOIN (SELECT DISTINCT tag FROM tags) b ON b.tag || 's' = theme LEFT JOIN (SELECT DISTINCT tag FROM tags) c ON theme = 'the shiny one' AND c.tag = 'economy'",
        "tags",
    )
)
def matched_in_order(spark, sf):
    """Exact, then singular, then by a list of aliases."""
    p = M.table(spark, sf, "part")
    themes = p.select(F.lower("p_type").alias("theme")).union(p.select(F.concat(F.split(F.lower("p_name"), " ")[0], F.lit("s"))))
    themes = themes.union(spark.createDataFrame([("the shiny one",), ("nothing-at-all",)], "theme string")).distinct()
    alias = F.create_map(F.lit("the shiny one"), F.lit("economy"))[F.col("theme")]
    return R.matched_in_order(themes, M.tags(spark, sf), [("exact", F.col("theme")), ("singular", X.singular(F.col("theme"))), ("alias", alias)])


@query(
    select(
        "SELECT d.template, c.item FROM (SELECT template, min(item) AS item FROM templates GROUP BY 1) d JOIN catalog o USING (item) JOIN catalog c ON c.mask = o.mask AND c.size <= 10 AND c.item <> d.item",
        "templates", "catalog",
    )
)
def template_alternatives(spark, sf):
    """A template declares its first part; small parts can lead."""
    c = M.catalog(spark, sf).select("item", "mask", (F.col("size") <= 10).alias("leads"))
    return R.alternatives(M.templates(spark, sf).groupBy("template").agg(F.min("item").alias("item")), c)


@query(
    select(
        "SELECT template, item, qty, n_lost FROM (SELECT template, count(*) FILTER (p_size % 4 = 0) AS n_lost FROM templates JOIN part ON item = p_partkey GROUP BY 1) LEFT JOIN (SELECT template, item, CAST(sum(qty) AS BIGINT) AS qty FROM templates JOIN part ON item = p_partkey WHERE p_size % 4 <> 0 GROUP BY 1, 2) USING (template)",
        "templates",
    )
)
def template_harvest(spark, sf):
    """Lines by name; the names of some parts aren't known."""
    name = F.concat(F.lit("part "), F.col("item").cast("string")).alias("name")
    lines = M.templates(spark, sf).select("template", name, "qty")
    names = M.catalog(spark, sf).filter("size % 4 != 0").select(name, "item")
    return R.harvested(lines, names)


@query(
    select(
        "SELECT topic, count(*) AS n_pairs, round(median(cosine), 6) AS median_cosine FROM (SELECT p.topic, p.i, p.j, coalesce(sum(a.u * b.u), 0.0) AS cosine FROM (SELECT a.topic, a.item AS i, b.item AS j FROM top a JOIN top b ON a.topic = b.topic AND a.item < b.item) p LEFT JOIN unit a ON a.item = p.i LEFT JOIN unit b ON b.item = p.j AND b.tag = a.tag GROUP BY 1, 2, 3) GROUP BY 1".replace(
            "FROM top a JOIN top b", "FROM (SELECT topic, item FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, item) AS rk FROM members) WHERE rk <= 14) a JOIN (SELECT topic, item FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, item) AS rk FROM members) WHERE rk <= 14) b"
        ).replace("unit a", "(SELECT item, tag, 1 / sqrt(count(*) OVER (PARTITION BY item)) AS u FROM tags) a").replace("unit b", "(SELECT item, tag, 1 / sqrt(count(*) OVER (PARTITION BY item)) AS u FROM tags) b"),
        "members", "tags",
    )
)
def text_contrast(spark, sf):
    """Pairs of each group's 14 heaviest members (a feature of the report) and the median cosine of their tags."""
    from plinth.plans.baskets import _members

    top = R.large_groups(_members(spark, sf), "topic", 1, [F.desc("weight"), F.col("item")]).filter("rank <= 14").select("topic", "item")
    words = M.tags(spark, sf).select("item", F.col("tag").alias("word"), F.lit(1.0).alias("weight"))
    return R.text_contrast(top, words).withColumn("median_cosine", F.round("median_cosine", 6))


_EVIDENCE = "SELECT doc_id AS item, 'prose' AS role, 'tag' AS layer, 'lang:en' AS evidence, 0.5::DOUBLE AS weight FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'prose', 'text', 'the', 1.0::DOUBLE FROM documents WHERE contains(lower(text), 'the') UNION ALL SELECT doc_id, 'stub', 'text', '^.{0,400}$', 2.0::DOUBLE FROM documents WHERE length(text) <= 400 AND NOT contains(text, chr(10))"


def _evidence(spark, sf):
    d = M.table(spark, sf, "documents")
    tag = d.filter("lang = 'en'").select(F.col("doc_id").alias("item"), F.lit("prose").alias("role"), F.lit("lang:en").alias("tag"), F.lit(0.5).alias("weight"))
    rules = [("prose", "the", 1.0, F.contains(F.lower("text"), F.lit("the"))), ("stub", "^.{0,400}$", 2.0, (F.length("text") <= 400) & ~F.contains("text", F.lit("\n")))]
    text = None
    for role, pattern, weight, hit in rules:
        one = d.filter(hit).select(F.col("doc_id").alias("item"), F.lit(role).alias("role"), F.lit(pattern).alias("pattern"), F.lit(weight).alias("weight"))
        text = one if text is None else text.unionByName(one)
    return R.explained(tag, text)


@query(_EVIDENCE)
def role_evidence(spark, sf):
    return _evidence(spark, sf)


@query(f"SELECT item, role, count(*) AS n, sum(weight) AS score FROM ({_EVIDENCE}) GROUP BY 1, 2 HAVING count(*) <= 1")
def role_thin_evidence(spark, sf):
    return R.thin_evidence(_evidence(spark, sf))


@query(f"SELECT evidence, role, count(*) FILTER (n > 1) AS n_with, count(*) FILTER (n = 1) AS n_without FROM (SELECT *, count(*) OVER (PARTITION BY item, role) AS n FROM ({_EVIDENCE})) GROUP BY 1, 2")
def role_two_sided(spark, sf):
    return R.two_sided(_evidence(spark, sf))
