"""Readers, sinks, table definitions and small record functions: each writes what it reads, from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plinth.functions import text as X
from plinth.operators import classify, merge
from plinth.plans.registry import query
from plinth.plans.sql import select
from plinth.sources import model as M
from plinth.sources import readers, sinks
from plinth.sources.scratch import scratch_path

_PART = "p_partkey long, p_name string, p_size int"


@query("SELECT p_partkey, p_name, p_size, true AS fresh, 'part' AS source FROM part")
def table_with_sidecar(spark, sf):
    p, path = M.table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), scratch_path(spark, "table")
    sinks.write_table(p, path, {"source": "part", "fetch_date": "2026-01-01T00:00:00+00:00"})
    meta, back = readers.read_sidecar(spark, path), spark.read.parquet(path)
    fresh = readers.is_fresh(meta, back.schema, days=36_500)
    return back.select("*", F.lit(fresh).alias("fresh"), F.lit(meta["source"]).alias("source"))


@query("SELECT p_partkey, p_name, p_size FROM part")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv(M.table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), path)
    return spark.read.schema(_PART).option("header", True).csv(path)


@query("SELECT p_partkey, p_name, p_size FROM part")
def json_lines_round_trip(spark, sf):
    path = scratch_path(spark, "json")
    sinks.write_json(M.table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), path)
    return readers.json_lines(spark, path, _PART, 4)


@query("SELECT r_regionkey, r_name FROM region")
def json_array_file(spark, sf):
    path = scratch_path(spark, "array")
    r = M.table(spark, sf, "region")
    whole = r.groupBy().agg(F.to_json(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name")))).alias("value"))  # five regions
    sinks.append_lines(whole, path)
    return readers.json_array(spark, path, "r_regionkey int, r_name string")


@query("SELECT r_regionkey AS entry, r_name AS name FROM region WHERE r_name = 'ASIA'")
def bulk_entry(spark, sf):
    index = M.table(spark, sf, "region").select(F.col("r_name").alias("type"), "r_regionkey")
    found = readers.bulk_entry(index, "ASIA")
    return spark.createDataFrame([(found["r_regionkey"], found["type"])], "entry int, name string")


@query("SELECT p_name AS name, CAST(sum(p_size) AS BIGINT) AS qty, bool_or(p_size % 10 = 0) AS leader FROM part GROUP BY 1")
def decklist_files(spark, sf):
    """Lists written as lines, by two appends, and read again by file."""
    path, p = scratch_path(spark, "decks"), M.table(spark, sf, "part")
    line = F.concat(F.when(F.col("p_size") % 10 == 0, "Commander: ").otherwise(""), F.col("p_size").cast("string"), F.lit("x "), F.col("p_name"))
    for odd in (0, 1):
        sinks.append_lines(p.filter(F.col("p_partkey") % 2 == odd).select(line.alias("value")), path)
    return readers.decklists(spark, path).groupBy("name").agg(F.sum("qty").alias("qty"), F.bool_or("leader").alias("leader"))


@query("SELECT 'events' AS source, CAST(run AS VARCHAR) AS run_at, (SELECT count(*) FROM events) AS items, CAST(run AS BIGINT) AS unresolved, '' AS notes FROM range(3) r(run)")
def ingest_log(spark, sf):
    path, n = scratch_path(spark, "log"), M.table(spark, sf, "events").count()
    for run in range(3):
        sinks.append_log(spark, path, "events", str(run), n, run)
    return spark.read.parquet(path)


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority LIKE '1%' THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def partition_overwrite(spark, sf):
    """One partition of a table is replaced, the others stay."""
    path, o = scratch_path(spark, "parts"), M.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    sinks.replace_partitions(o, path, ["o_orderpriority"])
    sinks.replace_partitions(o.filter("o_orderpriority like '1%'").withColumn("o_totalprice", F.lit(0.0)), path, ["o_orderpriority"])
    return spark.read.parquet(path)


@query(select("SELECT 'tscore' AS measure, count(*) FILTER (tscore <> 0) AS n FROM scored UNION ALL SELECT 'lift', count(*) FILTER (lift <> 0) FROM scored", "scored"))
def matrix_manifest(spark, sf):
    from plinth.plans.baskets import _scored

    sizes = sinks.write_matrices(_scored(spark, sf), scratch_path(spark, "matrices"), ["tscore", "lift"])["pairs"]
    return spark.createDataFrame(list(sizes.items()), "measure string, n long")


@query("SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS VARCHAR) AS note FROM nation")
def table_definitions(spark, sf):
    """A table that is made, widened by a column and renamed, each if it has to be, twice over."""
    db = f"plinth_{uuid.uuid4().hex}"
    for _ in range(2):
        sinks.create_tables(spark, db, {"old": "id int, name string"})
    M.table(spark, sf, "nation").select("n_nationkey", "n_name").write.insertInto(f"{db}.old")
    for _ in range(2):
        sinks.create_tables(spark, db, {"old": "id int, name string, note string"})
        sinks.rename_table(spark, f"{db}.old", f"{db}.new")
        spark.sql(f"DROP TABLE IF EXISTS {db}.old")
    return spark.table(f"{db}.new")


@query("SELECT p_partkey AS item, p_type NOT LIKE '%STEEL' AND p_size % 4 <> 1 AS held, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS n_leaders FROM part")
def board_membership(spark, sf):
    p = M.table(spark, sf, "part")
    first = F.when(F.col("p_size") % 4 == 1, "Maybe").otherwise("Main")
    cats = F.when(F.col("p_type").like("%STEEL"), F.array(first, F.lit("Sideboard"))).otherwise(F.array(first))
    lines = F.array(F.struct(F.when(F.col("p_size") % 5 == 0, F.array(F.lit("Commander"))).alias("categories")))
    included = F.create_map(F.lit("Main"), F.lit(True), F.lit("Maybe"), F.lit(False))
    return p.select(F.col("p_partkey").alias("item"), readers.in_deck(cats, included).alias("held"), F.size(readers.leaders(lines)).alias("n_leaders"))


@query("SELECT p_partkey AS item, p_size >= 5 AS big FROM part")
def big_bodies(spark, sf):
    power = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise("*")
    toughness = F.when(F.col("p_partkey") % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("p_size").cast("string"))
    return M.table(spark, sf, "part").select(F.col("p_partkey").alias("item"), classify.big_body(power, toughness).alias("big"))


@query("SELECT p_partkey AS item, list_value(p_brand, p_name || ', the Great', p_brand) AS names FROM part")
def names_merged_again(spark, sf):
    """Names that hold ', ' were cut at it and are put together by the list of known ones."""
    p = M.table(spark, sf, "part")
    names = p.select("p_name").distinct()
    if names.count() > 1_000_000:
        raise ValueError("the list of known names is sent to every task; a million is its bound")
    known = [f"{r[0]}, the Great" for r in names.collect()]
    cut = F.split(F.concat_ws(", ", "p_brand", F.concat("p_name", F.lit(", the Great")), "p_brand"), ", ")
    return p.select(F.col("p_partkey").alias("item"), X.resplit(cut, known).alias("names"))


@query("SELECT n_name AS node, r_name AS parent, 'tag of ' || n_name AS alias, 'item ' || n_nationkey AS item FROM nation JOIN region ON n_regionkey = r_regionkey")
def tag_registry(spark, sf):
    """Nested records of nations under regions, taken apart and joined again."""
    none = F.array().cast("array<string>")
    tags = F.array(F.struct(F.concat(F.lit("item "), F.col("n_nationkey").cast("string")).alias("oracle_id")))
    nations = M.table(spark, sf, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("slug"),
        F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.lit("gone")).alias("parent_ids"), tags.alias("taggings"),
        F.array(F.concat(F.lit("tag of "), F.col("n_name"))).alias("aliases"),
    )
    regions = M.table(spark, sf, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("slug"), none.alias("parent_ids"),
        F.array().cast("array<struct<oracle_id:string>>").alias("taggings"), none.alias("aliases"),
    )
    _, edges, taggings, aliases = readers.tag_registry(nations.unionByName(regions))
    return edges.join(aliases.withColumnRenamed("tag", "node"), "node").join(taggings.withColumnRenamed("tag", "node"), "node").select("node", "parent", "alias", "item")


@query("SELECT page_id, 0 AS k, 'page ' || page_id AS title, CASE WHEN page_id % 3 = 0 THEN 'N/A' ELSE '£' || page_id END AS price FROM pages")
def html_items(spark, sf):
    """Elements of a class, by an HTML parser."""
    key = F.col("page_id").cast("string")
    price = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit('<p class="price x">&pound;'), key, F.lit("</p>"))).otherwise("")
    html = F.concat(F.lit('<div class="item"><img src="a"><h3 class="title">page '), key, F.lit("</h3>"), price, F.lit("</div><p class='title'>other</p>"))
    pages = M.table(spark, sf, "pages").select("page_id", html.alias("html"))
    return readers.html_records(pages, "item", {"title": "title", "price": "price"})


@query("SELECT c_custkey, c_name FROM customer")
def checked_keys(spark, sf):
    """Rows whose key is unique and whose columns are filled; running it raises otherwise."""
    c = M.table(spark, sf, "customer").select("c_custkey", "c_name")
    return merge.require(merge.assert_unique(c, ["c_custkey"]), ["c_custkey", "c_name"])


@query("SELECT r_name AS name, '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region")
def markdown_report(spark, sf):
    text = sinks.markdown("Regions", {"all": M.table(spark, sf, "region").select("r_regionkey", "r_name")})
    rows = [(x.split("|")[2].strip(), x) for x in text.splitlines() if x[:3].strip("| ").isdigit()]
    return spark.createDataFrame(rows, "name string, line string")


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey % 2 = 0 AS legal FROM nation")
def flat_cards(spark, sf):
    """Nested card records read from JSON and laid flat."""
    path = scratch_path(spark, "cards")
    legal = F.struct(F.when(F.col("n_regionkey") % 2 == 0, "legal").otherwise("banned").alias("commander"))
    card = F.struct(F.col("n_nationkey").cast("string").alias("oracle_id"), F.col("n_name").alias("name"), legal.alias("legalities"))
    sinks.write_json(M.table(spark, sf, "nation").select(card.alias("card")), path)
    face = "struct<name:string,mana_cost:string,oracle_text:string,power:string,toughness:string,image_uri:string>"
    schema = f"card struct<oracle_id:string,name:string,mana_cost:string,cmc:double,type_line:string,oracle_text:string,power:string,toughness:string,image_uri:string,prices:struct<usd:string>,legalities:struct<commander:string>,card_faces:array<{face}>>"
    flat = readers.json_lines(spark, path, schema).select(*readers.flat_card())
    return flat.select(F.col("oracle_id").cast("int").alias("id"), "name", F.col("legal_commander").alias("legal"))
