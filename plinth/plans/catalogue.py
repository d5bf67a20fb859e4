"""Catalogue queries: names, predicates, profiles, pivots, structured features and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import text as X
from plinth.functions.ranks import ranked
from plinth.operators import classify as C
from plinth.operators import merge, profile
from plinth.operators import vectors as V
from plinth.plans.registry import query
from plinth.plans.sql import select
from plinth.sources import model as M
from plinth.sources import readers


def _r(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(select("SELECT item, name, price FROM catalog WHERE price > 1000 AND size BETWEEN 10 AND 20", "catalog"))
def scan_filter(spark, sf):
    return M.catalog(spark, sf).filter("price > 1000 and size between 10 and 20").select("item", "name", "price")


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%' GROUP BY 1")
def sql_to_frame(spark, sf):
    return spark.sql(
        "SELECT n_regionkey AS region, count(*) AS n FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%' GROUP BY 1",
        nation=M.table(spark, sf, "nation"), region=M.table(spark, sf, "region"),
    )


@query(select("SELECT item, contains(kind, 'ECONOMY') AS is_staple, lower(kind) LIKE '%small%' AS is_small, contains(name, 'red') AND contains(name, 'widget') AS leads, size >= 5 AS big FROM catalog", "catalog"))
def predicates(spark, sf):
    n = F.col("name")
    return M.catalog(spark, sf).select("item", F.contains("kind", F.lit("ECONOMY")).alias("is_staple"), F.lower("kind").like("%small%").alias("is_small"), (F.contains(n, F.lit("red")) & F.contains(n, F.lit("widget"))).alias("leads"), (F.col("size") >= 5).alias("big"))


@query(select("SELECT item, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS normalized, replace(lower(name), ' ', '-') AS slug, trim(regexp_replace(lower(brand), '[^a-z0-9]+', '_', 'g'), '_') AS label, concat_ws('+', name, brand) AS slot, array_to_string(list_sort([replace(lower(name), ' ', '-'), replace(lower(kind), ' ', '-')]), '-') AS pair FROM catalog", "catalog"))
def name_normalize(spark, sf):
    n, b = F.col("name"), F.col("brand")
    return M.catalog(spark, sf).select("item", X.normalized(n).alias("normalized"), X.slug(n).alias("slug"), X.file_label(b).alias("label"), X.slot_key(n, b).alias("slot"), X.pair_slug(n, F.col("kind")).alias("pair"))


@query(
    "WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) || s AS word FROM part, (SELECT unnest(['', 's', 'es', 'ies', 'ches']) AS s)) SELECT word, CASE WHEN word LIKE '%ies' AND length(word) > 4 THEN regexp_replace(word, 'ies$', 'y') WHEN regexp_matches(word, '(ses|xes|ches|shes)$') THEN regexp_replace(word, 'es$', '') WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN regexp_replace(word, 's$', '') ELSE word END AS singular FROM w"
)
def singularize(spark, sf):
    words = M.table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    ends = F.explode(F.array(*map(F.lit, ["", "s", "es", "ies", "ches"])))
    return words.distinct().select("w", ends.alias("s")).select(F.concat("w", "s").alias("word")).distinct().select("word", X.singular(F.col("word")).alias("singular"))


@query(
    select(
        "SELECT item, brand || ' (' || upper(replace(name, ' ', '')) || ')' AS full_name, upper(replace(name, ' ', '')) AS code, string_split(name || ' // ' || kind, ' // ') AS faces, string_split(brand, '#')[-1] AS tail FROM catalog",
        "catalog",
    )
)
def name_parts(spark, sf):
    full = F.concat("brand", F.lit(" ("), F.upper(F.replace("name", F.lit(" "), F.lit(""))), F.lit(")"))
    return M.catalog(spark, sf).select("item", full.alias("full_name"), X.set_code(full).alias("code"), X.split_pair(F.concat_ws(" // ", "name", "kind")).alias("faces"), X.url_tail(F.replace("brand", F.lit("#"), F.lit("/"))).alias("tail"))


@query("SELECT p_partkey AS item, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS number, TRY_CAST(p_name AS DOUBLE) AS failed, p_type AS kind FROM part")
def numeric_coercion(spark, sf):
    p = M.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("item"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).try_cast("double").alias("number"), F.col("p_name").try_cast("double").alias("failed"), F.col("p_type").alias("kind"))


@query(
    "SELECT 'nullable' AS field, count(*) FILTER (p_size % 3 = 0) AS n_null, round((1 - count(*) FILTER (p_size % 3 = 0) / CAST(count(*) AS DOUBLE)) * 100, 6) AS filled_pct FROM part UNION ALL SELECT 'p_name', count(*) FILTER (p_name IS NULL), round((1 - count(*) FILTER (p_name IS NULL) / CAST(count(*) AS DOUBLE)) * 100, 6) FROM part"
)
def field_profile(spark, sf):
    p = M.table(spark, sf, "part").select("p_name", F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("nullable"))
    return _r(profile.null_profile(p), "filled_pct")


@query(
    "SELECT 'p_retailprice' AS field, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS sd, min(p_retailprice) AS low, max(p_retailprice) AS high, median(p_retailprice) AS mid FROM part UNION ALL SELECT 'p_size', round(avg(p_size), 6), round(stddev_samp(p_size), 6), min(p_size), max(p_size), median(p_size) FROM part"
)
def numeric_summary(spark, sf):
    return _r(profile.summary(M.table(spark, sf, "part"), ["p_retailprice", "p_size"]), "mean", "sd")


@query(select("SELECT kind, item, price FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY price DESC, item) AS rk FROM catalog) WHERE rk = 1", "catalog"))
def argmax_per_group(spark, sf):
    return profile.extreme_per_group(M.catalog(spark, sf).select("kind", "item", "price"), ["kind"], "price", "item")


@query(select("SELECT mask, item, price FROM (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY price, item) AS rk FROM catalog) WHERE rk = 1", "catalog"))
def cheapest_per_identity(spark, sf):
    return profile.extreme_per_group(M.catalog(spark, sf).select("mask", "item", "price"), ["mask"], "price", "item", largest=False)


@query(
    "WITH n AS (SELECT least(greatest(p_size % 23, -1), 16) AS x, least(greatest(CAST(floor(p_retailprice) AS INTEGER) % 19, -1), 16) AS y, count(*) AS n FROM part GROUP BY 1, 2) SELECT CAST(a.v AS INTEGER) AS x, CAST(b.v AS INTEGER) AS y, coalesce(n, 0) AS n, round(ln(1 + coalesce(n, 0)) / (SELECT max(ln(1 + n)) FROM n), 9) AS heat FROM range(-1, 17) a(v), range(-1, 17) b(v) LEFT JOIN n ON n.x = a.v AND n.y = b.v"
)
def pivot_grid(spark, sf):
    p = M.table(spark, sf, "part").select((F.col("p_size") % 23).alias("a"), (F.floor("p_retailprice").cast("int") % 19).alias("b"))
    return _r(profile.grid(p, "a", "b", -1, 16), "heat", places=9)


@query("SELECT o_orderstatus AS status, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1")
def cross_counts(spark, sf):
    o = M.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderpriority")
    return profile.cross_counts(o, "status", "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]).withColumnsRenamed({"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"})


@query(select("SELECT kind, size, count(*) AS n, array_to_string((list(name ORDER BY price DESC, item))[1:3], ', ') AS names FROM catalog GROUP BY 1, 2", "catalog"))
def top_names_per_cell(spark, sf):
    return profile.top_names(M.catalog(spark, sf), ["kind", "size"], "name", [F.desc("price"), F.col("item")])


@query(
    select(
        "SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(size), 6) AS mean FROM (SELECT size, (price > e[1])::INT + (price > e[2])::INT + (price > e[3])::INT + (price > e[4])::INT AS bin FROM catalog, (SELECT quantile_cont(price, [0.2, 0.4, 0.6, 0.8]) AS e FROM catalog)) GROUP BY 1",
        "catalog",
    )
)
def quintile_means(spark, sf):
    return _r(profile.quintile_means(M.catalog(spark, sf), "price", "size"), "mean")


@query(select("SELECT kind, CAST(bin AS BIGINT) AS bin, round(avg(size), 6) AS mean FROM (SELECT kind, size, (row_number() OVER (PARTITION BY kind ORDER BY price DESC, item) - 1) // 10 AS bin FROM catalog) GROUP BY 1, 2", "catalog"))
def positional_bins(spark, sf):
    return _r(profile.positional_means(M.catalog(spark, sf), "kind", [F.desc("price"), F.col("item")], "size"), "mean")


@query(
    "SELECT count(*) AS n FROM (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, l_partkey LIMIT 10) JOIN (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_partkey LIMIT 10) USING (l_partkey)"
)
def source_overlap(spark, sf):
    li = M.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return profile.overlap_top(li, li, "l_partkey", [F.desc("q"), F.col("l_partkey")], [F.desc("n"), F.col("l_partkey")])


@query(select("SELECT CASE WHEN mask = 0 THEN 'none' WHEN bit_count(mask) = 1 THEN 'one' ELSE 'many' END AS category, count(*) AS n FROM catalog GROUP BY 1 UNION ALL SELECT 'many', 0 WHERE NOT EXISTS (SELECT 1 FROM catalog WHERE bit_count(mask) > 1)", "catalog"))
def identity_category(spark, sf):
    size = F.bit_count("mask")
    n = M.catalog(spark, sf).groupBy(F.when(size == 0, "none").when(size == 1, "one").otherwise("many").alias("category")).agg(F.count("*").alias("n"))
    known = spark.range(1).select(F.explode(F.array(*map(F.lit, ["none", "one", "many"]))).alias("category"))
    return known.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


@query(select("SELECT kind AS category, count(*) AS n, least(100.0::DOUBLE, round(count(*) * 100.0::DOUBLE / 400, 1)) AS pct FROM catalog GROUP BY 1", "catalog"))
def category_progress(spark, sf):
    c = M.catalog(spark, sf)
    return profile.progress(c, "kind", c.select("kind"), 400)


@query(select("SELECT item, size, brand FROM catalog WHERE contains(lower(name), 'ring') AND kind = 'ECONOMY' AND size >= 5", "catalog"))
def find_items(spark, sf):
    return profile.find(M.catalog(spark, sf), {"name": "RING"}, {"kind": "ECONOMY"}, {"size": 5}, "-price").select("item", "size", "brand")


@query(select("SELECT item, name, CAST(level AS INTEGER) AS level, CAST(far AS INTEGER) AS far FROM (SELECT item, name, price, CASE WHEN lower(name) = 'red ring' THEN 0 WHEN contains(lower(name), 'red ring') THEN 1 ELSE 2 END AS level, CASE WHEN contains(lower(name), 'red ring') THEN 0 ELSE levenshtein(lower(name), 'red ring') END AS far FROM catalog) ORDER BY level, far, price DESC, name LIMIT 3", "catalog"))
def point_lookup(spark, sf):
    return profile.lookup(M.catalog(spark, sf), F.col("name"), "Red Ring", "price").select("item", "name", "level", "far")


@query("SELECT p_partkey AS item, ceil(round(p_retailprice * 1.1 * 100, 6)) / 100 AS cents, round(ln(1 + p_size), 9) AS logged, CAST(least(25, greatest(5, round_even(25 * sqrt(p_size / CAST((SELECT max(p_size) FROM part) AS DOUBLE)), 0))) AS INTEGER) AS target, round((p_size * 1 + 2 * (p_size % 3)) / CAST(p_size + p_size % 3 AS DOUBLE), 9) AS stars FROM part")
def numeric_functions(spark, sf):
    p = M.table(spark, sf, "part")
    p = p.crossJoin(F.broadcast(p.agg(F.max("p_size").alias("most"))))
    return p.select(F.col("p_partkey").alias("item"), profile.price_usd(F.col("p_retailprice") * 1.1).alias("cents"), F.round(F.log1p("p_size"), 9).alias("logged"), merge.share_target(F.col("p_size"), F.col("most")).alias("target"), F.round(profile.star_rating(F.array("p_size", F.col("p_size") % 3)), 9).alias("stars"))


@query("SELECT p_partkey AS item, list_transform(range(9), lambda i: round(exp(-pow(i - least(greatest(p_size, 0), 8), 2) / 2.0), 9)) AS bump FROM part")
def cost_bump(spark, sf):
    p = M.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("item"), F.transform(V.cost_bump(F.col("p_size")), lambda x: F.round(x, 9)).alias("bump"))


_COST = "'{' || p_size % 4 || '}{' || substr('WUBRG', p_partkey % 5 + 1, 1) || '}{' || substr('WUBRG', p_size % 5 + 1, 1) || '/P}'"


def _cost():
    letter = lambda c: F.substring(F.lit("WUBRG"), (c % 5 + 1).cast("int"), F.lit(1))
    return F.concat(F.lit("{"), (F.col("p_size") % 4).cast("string"), F.lit("}{"), letter(F.col("p_partkey")), F.lit("}{"), letter(F.col("p_size")), F.lit("/P}"))


@query(f"SELECT p_partkey AS item, {_COST} AS cost, list_transform(['W', 'U', 'B', 'R', 'G'], lambda c: CAST(length(replace({_COST}, '/P', '')) - length(replace(replace({_COST}, '/P', ''), c, '')) AS INTEGER)) AS pips FROM part")
def pip_counts(spark, sf):
    return M.table(spark, sf, "part").select(F.col("p_partkey").alias("item"), _cost().alias("cost"), V.pip_counts(_cost()).alias("pips"))


@query("SELECT p_partkey AS item, CASE p_size % 4 WHEN 0 THEN 0.0 WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN CAST(p_size AS DOUBLE) ELSE 7.0 END AS value, p_size % 4 = 0 OR p_size % 4 = 3 AS variable FROM part")
def parse_stat(spark, sf):
    size = F.col("p_size")
    raw = F.when(size % 4 == 0, "*").when(size % 4 == 1, size.cast("string")).when(size % 4 == 2, F.concat(size.cast("string"), F.lit(" // 4"))).otherwise("7-*")
    return M.table(spark, sf, "part").select(F.col("p_partkey").alias("item"), V.parse_stat(raw).alias("x")).select("item", "x.value", "x.variable")


@query(select("SELECT item, round((size - avg(size) OVER ()) / stddev_samp(size) OVER (), 9) AS size, round((price - avg(price) OVER ()) / stddev_samp(price) OVER (), 9) AS price FROM catalog", "catalog"))
def zscore(spark, sf):
    c = M.catalog(spark, sf).select("item", F.col("size").cast("double").alias("size"), "price")
    return _r(V.zscores(c, ["size", "price"]), "size", "price", places=9)


@query(
    select(
        "SELECT DISTINCT item, CASE WHEN k = 0 THEN tag WHEN k = 1 THEN 'kind:' || lower(kind) ELSE 'any' END AS tag FROM tags JOIN catalog USING (item), (SELECT unnest([0, 1, 2]) AS k)",
        "tags", "catalog",
    )
)
def tag_expand(spark, sf):
    """Tags of a three-level graph: a word of a name, its item's kind, and 'any'; kinds are their own parents too, and
    'any' has one that isn't there."""
    c = M.catalog(spark, sf)
    t = M.tags(spark, sf).join(c.select("item", F.concat(F.lit("kind:"), F.lower("kind")).alias("up")), "item")
    own = t.select("item", F.concat("tag", F.lit("@"), "up").alias("tag"), F.col("tag").alias("word"), "up")
    leaf = own.select(F.col("tag").alias("node"), F.col("up").alias("parent")).distinct()
    up = own.select(F.col("up").alias("node"), F.lit("any").alias("parent")).distinct()
    lost = spark.range(1).select(F.lit("any").alias("node"), F.lit("missing").alias("parent"))
    edges = leaf.unionByName(up).unionByName(lost).unionByName(up.select(F.col("node"), F.col("node").alias("parent")))
    closed = C.closure(edges.select("node").distinct(), edges)
    out = C.expand(own.select("item", "tag"), closed, c)
    return out.select("item", F.substring_index("tag", "@", 1).alias("tag")).distinct()


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT p_size AS node, p_size // 2 AS parent FROM part UNION SELECT DISTINCT p_size // 2, p_size // 4 FROM part UNION SELECT 0, 1), n AS (SELECT DISTINCT node FROM e), c AS (SELECT node, node AS ancestor FROM n UNION SELECT c.node, e.parent FROM c JOIN e ON e.node = c.ancestor WHERE e.parent IN (SELECT node FROM n)) SELECT node, ancestor FROM c"
)
def tag_closure(spark, sf):
    """Halving as a parent relation, with a cycle 0 -> 1 -> 0 and parents outside the nodes."""
    p = M.table(spark, sf, "part").select(F.col("p_size").alias("s"))
    half = lambda c, k: F.floor(c / k).cast("int")
    e = p.select(F.col("s").alias("node"), half(F.col("s"), 2).alias("parent"))
    e = e.unionByName(p.select(half(F.col("s"), 2).alias("node"), half(F.col("s"), 4).alias("parent")))
    e = e.unionByName(spark.range(1).select(F.lit(0).alias("node"), F.lit(1).alias("parent"))).distinct()
    return C.closure(e.select("node").distinct(), e)


@query(select("SELECT item, list_sort(list(tag)) AS tags FROM tags GROUP BY 1", "tags"))
def tags_per_item(spark, sf):
    return M.tags(spark, sf).groupBy("item").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


@query(select("SELECT tag, count(DISTINCT item) AS n FROM tags GROUP BY 1 ORDER BY n, tag LIMIT 10", "tags"))
def rarest_tags(spark, sf):
    return M.tags(spark, sf).groupBy("tag").agg(F.count_distinct("item").alias("n")).orderBy("n", "tag").limit(10)


@query(
    select(
        "SELECT * FROM (WITH theme AS (SELECT DISTINCT lower(p_type) || 's' AS theme FROM part UNION SELECT DISTINCT string_split(lower(p_name), ' ')[1] FROM part UNION SELECT 'nothing-at-all'), t AS (SELECT DISTINCT tag FROM tags) SELECT theme, coalesce(a.tag, b.tag) AS tag, CASE WHEN a.tag IS NOT NULL THEN 'exact' WHEN b.tag IS NOT NULL THEN 'singular' ELSE 'none' END AS match_source FROM theme LEFT JOIN t a ON a.tag = theme LEFT JOIN t b ON b.tag = regexp_replace(theme, 's$', ''))",
        "tags",
    )
)
def theme_match(spark, sf):
    """Ordered strategies: the exact tag, then the singular one."""
    p = M.table(spark, sf, "part")
    themes = p.select(F.concat(F.lower("p_type"), F.lit("s")).alias("theme")).union(p.select(F.split(F.lower("p_name"), " ")[0])).union(spark.range(1).select(F.lit("nothing-at-all"))).distinct()
    t = M.tags(spark, sf).select("tag").distinct()
    out = themes.join(t.select(F.col("tag").alias("a")), F.col("theme") == F.col("a"), "left").join(t.select(F.col("tag").alias("b")), X.singular(F.col("theme")) == F.col("b"), "left")
    return out.select("theme", F.coalesce("a", "b").alias("tag"), F.when(F.col("a").isNotNull(), "exact").when(F.col("b").isNotNull(), "singular").otherwise("none").alias("match_source"))


_BLOCK = "list_transform({v}, lambda x: x / coalesce(nullif(sqrt(list_sum(list_transform({v}, lambda y: y * y))), 0), 1))"


@query(
    "WITH f AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS t, list_transform(range(10), lambda k: CASE WHEN k = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS y, list_transform(range(9), lambda i: exp(-pow(i - least(vec_id % 12, 8), 2) / 2.0)) AS c, list_transform(range(5), lambda k: CASE WHEN k = vec_id % 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p, [CAST(vec_id % 7 AS DOUBLE), CAST(vec_id % 4 AS DOUBLE)] AS s, vec_id % 2 = 0 AS has FROM embeddings), "
    f"u AS (SELECT vec_id, label, {_BLOCK.format(v='t')} AS t, y, {_BLOCK.format(v='c')} AS c, p, {_BLOCK.format(v='s')} AS s, has FROM f), "
    "v AS (SELECT vec_id, label, list_concat(list_concat(list_transform(t, lambda x: x * 0.5::DOUBLE), list_transform(y, lambda x: x * CASE WHEN has THEN 0.1::DOUBLE ELSE 0.15::DOUBLE END)), list_concat(list_transform(list_concat(c, p), lambda x: x / sqrt(2.0) * CASE WHEN has THEN 0.3::DOUBLE ELSE 0.35::DOUBLE END), list_transform(s, lambda x: x * CASE WHEN has THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END))) AS v FROM u) "
    "SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.v, b.v) AS score FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id WHERE a.vec_id % 100 = 0)) WHERE rank <= 10"
)
def weighted_space_knn(spark, sf):
    e = M.table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    one_hot = lambda at, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == at).cast("double"))
    v = V.combined(
        F.col("embedding"), one_hot(F.col("label"), 10), V.cost_bump(F.col("vec_id") % 12), one_hot(F.col("vec_id") % 5, 5),
        F.array((F.col("vec_id") % 7).cast("double"), (F.col("vec_id") % 4).cast("double")), F.col("vec_id") % 2 == 0,
    )
    space = e.select("vec_id", "label", v.alias("v"))
    return _r(V.nearest(space, space.filter("vec_id % 100 = 0"), 10, "label"), "score")


@query(
    "SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))) AS score FROM embeddings a JOIN embeddings b ON a.vec_id != b.vec_id WHERE a.vec_id % 100 = 0)) WHERE rank <= 10"
)
def knn_cosine(spark, sf):
    e = M.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return _r(V.nearest(e, e.filter("vec_id % 100 = 0"), 10), "score")


@query(select("SELECT b.item, CAST(sum(b.qty) AS BIGINT) AS qty FROM baskets b WHERE b.item NOT IN (SELECT item FROM catalog WHERE staple) AND b.basket IN (SELECT basket FROM holders WHERE stratum < 3) GROUP BY 1", "baskets", "catalog", "holders"))
def semi_anti_joins(spark, sf):
    b = M.baskets(spark, sf).join(M.holders(spark, sf).filter("stratum < 3"), "basket", "left_semi")
    return b.join(M.catalog(spark, sf).filter("staple").select("item"), "item", "left_anti").groupBy("item").agg(F.sum("qty").alias("qty"))


@query(
    select(
        "SELECT coalesce(kind, 'all') AS kind, CAST(sum(qty) AS BIGINT) AS qty, count(DISTINCT basket) AS n_baskets FROM baskets JOIN catalog USING (item) GROUP BY ROLLUP (kind)",
        "baskets", "catalog",
    )
)
def role_breakdown(spark, sf):
    rows = M.baskets(spark, sf).join(M.catalog(spark, sf).select("item", "kind"), "item")
    return rows.rollup("kind").agg(F.sum("qty").alias("qty"), F.count_distinct("basket").alias("n_baskets")).select(F.coalesce("kind", F.lit("all")).alias("kind"), "qty", "n_baskets")


@query(select("SELECT row_number() OVER (ORDER BY n DESC, item) AS rank, item, n, median(n) OVER () AS mid FROM (SELECT item, count(*) AS n FROM baskets GROUP BY 1)", "baskets"))
def popularity_curve(spark, sf):
    n = M.baskets(spark, sf).groupBy("item").agg(F.count("*").alias("n"))
    out = ranked(n, F.desc("n"), F.col("item"))
    return out.crossJoin(F.broadcast(out.agg(F.median("n").alias("mid")))).select("rank", "item", "n", "mid")
