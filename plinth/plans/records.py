"""Ingest shapes: JSON, HTML, logs, merges and samples over the event, page and conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import merge, profile
from plinth.plans.registry import query
from plinth.plans.sql import select
from plinth.sources import model as M
from plinth.sources import readers


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, sf):
    return M.table(spark, sf, "events").select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k")


@query("SELECT event_type, min(CAST(json_extract(props, '$.k') AS INTEGER)) AS low, max(CAST(json_extract(props, '$.k') AS INTEGER)) AS high, count(DISTINCT CAST(json_extract(props, '$.k') AS INTEGER)) AS n FROM events GROUP BY 1")
def json_rows(spark, sf):
    e = M.table(spark, sf, "events").select("event_type", F.explode(F.map_values(F.from_json("props", "map<string,int>"))).alias("k")).filter("k is not null")
    return e.groupBy("event_type").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count_distinct("k").alias("n"))


@query("SELECT page_id, CAST(rank AS INTEGER) AS rank, href FROM (SELECT page_id, unnest(hs[1:4]) AS href, generate_subscripts(hs[1:4], 1) AS rank FROM (SELECT page_id, list_filter(list_transform(list_distinct_ordered, lambda x: x), lambda x: true) AS hs FROM (SELECT page_id, list_filter(h, lambda x, i: list_position(h, x) = i) AS list_distinct_ordered FROM (SELECT page_id, list_filter(regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1), lambda x: contains(x, '/')) AS h FROM pages))))")
def html_links(spark, sf):
    return readers.links(M.table(spark, sf, "pages"), "/")


@query("SELECT page_id, TRY_CAST(nullif(regexp_extract(html, 'track\\((\\d+)\\)', 1), '') AS INTEGER) AS tracked, nullif(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '') AS lang FROM pages")
def embedded_json(spark, sf):
    found = F.nullif(F.regexp_extract("html", r"track\((\d+)\)", 1), F.lit(""))
    return M.table(spark, sf, "pages").select("page_id", F.from_json(F.concat(F.lit('{"v":'), found, F.lit("}")), "v int")["v"].alias("tracked"), F.nullif(F.regexp_extract("html", '<html lang="([a-z]+)"', 1), F.lit("")).alias("lang"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1")
def last_write_wins(spark, sf):
    e = M.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return merge.last_write_wins(e, ["user_id"], ["ts", "event_id"]).drop("ts")


_HALVES = "o AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rk FROM events WHERE event_id % 2 = 0) WHERE rk = 1), n AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rk FROM events WHERE event_id % 2 = 1) WHERE rk = 1)"


def _halves(spark, sf):
    """An old and a new table of (user_id, event_type, value): the two halves of the events by parity of their ids."""
    e = M.table(spark, sf, "events").select("user_id", "event_type", "value", "ts", "event_id")
    one = lambda k: merge.last_write_wins(e.filter(F.col("event_id") % 2 == k), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")
    return one(0), one(1)


@query(f"WITH {_HALVES} SELECT * FROM n UNION ALL SELECT * FROM o WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM n)")
def upsert(spark, sf):
    old, new = _halves(spark, sf)
    return merge.upsert(old, new, ["user_id", "event_type"])


@query(f"WITH {_HALVES} SELECT user_id, event_type, CASE WHEN o.value IS NOT NULL AND (event_type = 'error' OR n.value IS NULL) THEN o.value ELSE n.value END AS value FROM o FULL JOIN n USING (user_id, event_type)")
def conditional_upsert(spark, sf):
    old, new = _halves(spark, sf)
    return merge.upsert(old, new, ["user_id", "event_type"], F.col("event_type") == "error")


@query(f"WITH {_HALVES} SELECT * FROM n WHERE user_id % 3 = 0 UNION ALL SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n WHERE user_id % 3 = 0)")
def replace_scope(spark, sf):
    old, new = _halves(spark, sf)
    return merge.replace_scope(old, new.filter("user_id % 3 = 0"), ["user_id"])


@query(f"WITH {_HALVES} SELECT o.user_id, o.event_type, n.value FROM o LEFT JOIN n USING (user_id, event_type)")
def column_backfill(spark, sf):
    old, new = _halves(spark, sf)
    return merge.backfill(old, new, ["user_id", "event_type"], "value")


@query("SELECT name, item FROM (SELECT name, item, row_number() OVER (PARTITION BY name ORDER BY p, item) AS rk FROM (SELECT p_name AS name, p_partkey AS item, 0 AS p FROM part WHERE p_size > 25 UNION ALL SELECT p_name, p_partkey, 1 FROM part WHERE p_size <= 25 UNION ALL SELECT string_split(p_name, ' ')[1], p_partkey, 1 FROM part)) WHERE rk = 1")
def alias_merge(spark, sf):
    p = M.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("item"), "p_size")
    faces = p.select(F.split("name", " ")[0].alias("name"), "item")
    return merge.alias_merge(p.filter("p_size > 25"), p.filter("p_size <= 25").select("name", "item").unionByName(faces), "name")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, event_id) AS rk FROM events) WHERE rk = 1")
def category_precedence(spark, sf):
    e = M.table(spark, sf, "events").select("user_id", "event_type", "event_id")
    place = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    return merge.first_per_key(e, ["user_id"], [place, F.col("event_id")])


@query(select("SELECT basket, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(basket || ':0'), basket) AS rk FROM holders) WHERE rk <= 25", "holders"))
def stratified_cap(spark, sf):
    """A sampling operator: at most 25 baskets a stratum, by a seeded hash."""
    return merge.stratified_cap(M.holders(spark, sf).select("basket", "stratum"), "stratum", "basket", 25)


@query(select("SELECT t.stratum, CAST(least(25, greatest(5, round_even(25 * sqrt(true_n / CAST((SELECT max(true_n) FROM truth) AS DOUBLE)), 0))) AS INTEGER) AS target, coalesce(n, 0) AS kept, greatest(0, CAST(least(25, greatest(5, round_even(25 * sqrt(true_n / CAST((SELECT max(true_n) FROM truth) AS DOUBLE)), 0))) AS INTEGER) - coalesce(n, 0)) AS wanted FROM truth t LEFT JOIN (SELECT stratum, count(*) AS n FROM holders WHERE basket % 9 = 0 GROUP BY 1) USING (stratum) WHERE t.stratum >= 2", "truth", "holders"))
def quota_left(spark, sf):
    t = M.true_counts(spark, sf)
    t = t.crossJoin(F.broadcast(t.agg(F.max("true_n").alias("most")))).select("stratum", merge.share_target(F.col("true_n"), F.col("most")).alias("target"))
    return merge.quota_left(t, M.holders(spark, sf).filter("basket % 9 = 0"), "stratum", t.filter("stratum < 2"))


@query(
    "SELECT p_partkey AS item, CAST(p_size AS INTEGER) AS qty, p_name AS name, p_size % 10 = 0 AS leader FROM part WHERE p_size % 7 != 0"
)
def decklist_lines(spark, sf):
    """Lines such as 'Commander: 3x red ring # note', made of the catalogue and parsed again."""
    p = M.table(spark, sf, "part")
    line = F.concat(F.when(F.col("p_size") % 10 == 0, "Commander: ").otherwise(""), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "x ").otherwise(" "), F.col("p_name"), F.lit(" # note"))
    line = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("# "), line)).otherwise(line)
    return p.select(F.col("p_partkey").alias("item"), readers.decklist_line(line).alias("x")).select("item", "x.*").filter("name is not null")


@query(
    "WITH k AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'stale' WHEN event_id % 5 = 1 THEN 'none' ELSE 'illegal_cards [2] (ring, red bolt)' END AS problems FROM events) SELECT 'u' || user_id AS url, event_type AS slot, problems, CASE WHEN problems = 'none' THEN 0 ELSE 2 END AS n_illegal FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rk FROM k WHERE problems != 'stale') WHERE rk = 1"
)
def audit_log_last(spark, sf):
    e = M.table(spark, sf, "events")
    problems = F.when(F.col("event_id") % 5 == 0, "stale").when(F.col("event_id") % 5 == 1, "none").otherwise("illegal_cards [2] (ring, red bolt)")
    lines = e.select(F.col("event_id").alias("line_no"), F.concat("event_type", F.lit(", problems: "), problems, F.lit(", u"), F.col("user_id").cast("string")).alias("line"))
    return readers.audit_log(lines).drop("illegal")


@query("SELECT count(*) AS n_seen, count(*) FILTER (value < 5) AS n_stale, count(*) FILTER (value >= 5 AND event_type != 'click') AS n_mismatch, count(*) FILTER (value >= 5 AND event_type = 'click' AND event_id % 4 = 0) AS n_wrong_size, count(*) FILTER (value >= 5 AND event_type = 'click' AND event_id % 4 != 0) AS n_kept FROM events")
def candidate_gates(spark, sf):
    e = M.table(spark, sf, "events")
    gate = F.when(F.col("value") < 5, "stale").when(F.col("event_type") != "click", "mismatch").when(F.col("event_id") % 4 == 0, "wrong_size").otherwise("kept")
    g = e.select(gate.alias("g"))
    return g.agg(F.count("*").alias("n_seen"), *[F.count_if(F.col("g") == x).alias(f"n_{x}") for x in ("stale", "mismatch", "wrong_size", "kept")])


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN true WHEN turn % 3 = 1 THEN role = 'user' ELSE false END AS kept FROM conversations")
def board_filter(spark, sf):
    c = M.table(spark, sf, "conversations")
    categories = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).when(F.col("turn") % 3 == 1, F.array("role")).otherwise(F.array(F.lit("user"), F.lit("Sideboard")))
    included = F.create_map(F.lit("user"), F.lit(True), F.lit("assistant"), F.lit(False), F.lit("system"), F.lit(False))
    return c.select("conv_id", "turn", readers.in_deck(categories, included).alias("kept"))


@query("SELECT word AS name, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word NOT IN (SELECT DISTINCT string_split(p_name, ' ')[2] FROM part WHERE len(string_split(p_name, ' ')) > 1) GROUP BY 1")
def unresolved_names(spark, sf):
    p = M.table(spark, sf, "part")
    names = p.select(F.explode(F.split("p_name", " ")).alias("name"))
    known = p.select(F.try_element_at(F.split("p_name", " "), F.lit(2)).alias("name")).filter("name is not null")
    return readers.unresolved(names, known)


@query("SELECT conv_id, turn, text IS NOT NULL AND text NOT IN ('', 'N/A') AND role IS NOT NULL AND role NOT IN ('', 'N/A') AS complete FROM conversations")
def completeness(spark, sf):
    return M.table(spark, sf, "conversations").select("conv_id", "turn", profile.complete(["text", "role"]).alias("complete"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, count(*) FILTER (o_orderdate < TIMESTAMP '1997-01-01') AS n_old FROM orders GROUP BY 1")
def dates(spark, sf):
    return M.table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")).alias("n_old"))


@query("SELECT user_id, count(*) AS raw, count(*) >= 100 AND bool_and(value > 0) AS truncated FROM events GROUP BY 1")
def truncation_detector(spark, sf):
    return M.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("raw"), ((F.count("*") >= 100) & F.bool_and(F.col("value") > 0)).alias("truncated"))


@query("SELECT stratum AS \"group\", url FROM (SELECT p_size AS stratum, 'https://x.test/?q=' || string_agg('!\"' || p_brand || '\"', ' or ' ORDER BY p_partkey) AS url FROM (SELECT *, sum(length(p_brand) + 5) OVER (PARTITION BY p_size ORDER BY p_partkey) AS run FROM part) WHERE run + 18 <= 200 GROUP BY 1)")
def search_urls(spark, sf):
    names = M.table(spark, sf, "part").select(F.col("p_size").alias("group"), F.col("p_partkey").alias("place"), F.col("p_brand").alias("name"))
    return readers.search_urls(names, "https://x.test/?q=", 200)


@query("SELECT CAST(n_nationkey AS INTEGER) AS a, n_name || ' // ' || coalesce(b, '?') AS name FROM (SELECT n_nationkey, n_name, lead(n_name) OVER (ORDER BY n_nationkey) AS b FROM nation) WHERE b IS NOT NULL")
def pair_resolution(spark, sf):
    """A whole name first, else both halves of a pair; names of a pair resolve only if both halves do."""
    n = M.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    asked = n.select(F.col("id").alias("a"), F.concat_ws(" // ", "name", F.concat(F.lit("NATION_"), (F.col("id") + 1).cast("string"))).alias("full"))
    half = lambda k: F.try_element_at(F.split("full", " // "), F.lit(k))
    out = asked.join(n.select(F.col("name").alias("whole"), F.col("id").alias("w")), F.col("full") == F.col("whole"), "left")
    for k in (1, 2):
        out = out.join(n.select(F.col("name").alias(f"h{k}"), F.col("id").alias(f"i{k}")), half(k) == F.col(f"h{k}"), "left")
    return out.filter("w is not null or (i1 is not null and i2 is not null)").select("a", F.col("full").alias("name"))
