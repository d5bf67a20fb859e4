"""Files and nested records to tables: JSON lines and arrays, decklists, logs, HTML, tag registries."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, partitions: int | None = None) -> DataFrame:
    """JSON lines, gzip or not; blank lines are skipped. A gzip file is one task, so its rows are dealt out after it."""
    rows = spark.read.schema(schema).json(path)
    return rows.repartition(partitions) if partitions else rows


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def bulk_entry(index: DataFrame, kind: str) -> dict:
    """The entry of a bulk index with the given type; KeyError if absent."""
    row = index.filter(F.col("type") == kind).orderBy(*index.columns).first()
    if row is None:
        raise KeyError(kind)
    return row.asDict(recursive=True)


def is_fresh(meta: dict, schema: T.StructType, days: int = 14, now: datetime | None = None) -> bool:
    """Whether a table's sidecar has the schema expected and was fetched within `days`."""
    now = now or datetime.now(timezone.utc)
    return meta.get("schema") == schema.simpleString() and now - datetime.fromisoformat(meta["fetch_date"]) < timedelta(days=days)


def embedded_json(html: Column, script_id: str, schema: T.DataType | str) -> Column:
    """The parsed JSON of <script id="..."> in a page, null without it."""
    found = F.regexp_extract(html, rf'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1)
    return F.from_json(F.nullif(found, F.lit("")), schema)


def decklist_line(line: Column) -> Column:
    """(qty, name, leader) of a decklist line; name is null for blank lines and comments."""
    text = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"#.*$", ""))
    leader = text.startswith("Commander:") | F.contains(text, F.lit("*CMDR*"))
    text = F.trim(F.replace(F.regexp_replace(text, "^Commander:", ""), F.lit("*CMDR*"), F.lit("")))
    qty = F.nullif(F.regexp_extract(text, r"^(\d+)x?\s+", 1), F.lit("")).try_cast("int")
    name = F.nullif(F.trim(F.regexp_replace(text, r"^\d+x?\s+", "")), F.lit(""))
    return F.struct(F.coalesce(qty, F.lit(1)).alias("qty"), name.alias("name"), leader.alias("leader"))


def decklists(spark: SparkSession, path: str) -> DataFrame:
    """(file, qty, name, leader) of text files with one item a line."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), decklist_line(F.col("value")).alias("x"))
    return lines.select("file", "x.*").filter("name is not null")


def unresolved(names: DataFrame, known: DataFrame, key: str = "name") -> DataFrame:
    """(key, n): names that nothing resolves, with how often they come."""
    return names.join(known.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


#: Problems for which a logged candidate wasn't kept.
DROPPED = ("stale", "mismatch", "wrong_size")


def audit_log(lines: DataFrame, order: str = "line_no", line: str = "line") -> DataFrame:
    """(url, slot, problems, n_illegal, illegal) of the last line of each URL, of those that were kept."""
    text = F.col(line)
    hit = r"^(.*?), problems: (.*), (\S+)$"
    rows = lines.select(
        F.col(order), F.regexp_extract(text, hit, 1).alias("slot"), F.regexp_extract(text, hit, 2).alias("problems"), F.regexp_extract(text, hit, 3).alias("url")
    ).filter("url != ''")
    flags = F.regexp_replace(F.col("problems"), r"\([^)]*\)", "")
    kept = rows.filter(~F.exists(F.array(*map(F.lit, DROPPED)), lambda d: F.contains(flags, d)))
    last = kept.groupBy("url").agg(F.max_by(F.struct("slot", "problems"), order).alias("x")).select("url", "x.*")
    n = F.nullif(F.regexp_extract("problems", r"illegal_cards \[(\d+)\]", 1), F.lit("")).try_cast("int")
    names = F.regexp_extract("problems", r"illegal_cards \[\d+\] \(([^)]*)\)", 1)
    return last.select("url", "slot", "problems", F.coalesce(n, F.lit(0)).alias("n_illegal"), F.filter(F.split(names, ", "), lambda x: x != "").alias("illegal"))


def links(pages: DataFrame, containing: str, first: int = 4) -> DataFrame:
    """(page_id, rank, href): each page's first distinct links that contain a string, in their order."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1)), lambda h: F.contains(h, F.lit(containing))))
    rows = pages.select("page_id", F.posexplode(F.slice(found, 1, first)).alias("k", "href"))
    return rows.select("page_id", (F.col("k") + 1).alias("rank"), "href")


def html_records(pages: DataFrame, item_class: str, fields: dict[str, str]) -> DataFrame:
    """(page_id, k, fields...): elements of a class, and the text of the first element of each field's class inside;
    'N/A' where there is none. A real HTML parser, in Arrow batches."""
    import pandas as pd

    schema = "page_id long, k int, " + ", ".join(f"`{f}` string" for f in fields)

    def run(batches):
        from html.parser import HTMLParser

        void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

        class Reader(HTMLParser):
            def __init__(self):
                super().__init__()
                self.depth, self.item, self.open, self.found = 0, None, {}, []

            def handle_starttag(self, tag, attrs):
                if tag in void:
                    return
                self.depth += 1
                classes = (dict(attrs).get("class") or "").split()
                if self.item is None and item_class in classes:
                    self.item = self.depth
                    self.found.append({})
                elif self.item is not None:
                    for name, c in fields.items():
                        if c in classes and name not in self.found[-1]:
                            self.found[-1][name] = ""
                            self.open[name] = self.depth

            def handle_endtag(self, tag):
                if tag in void:
                    return
                self.open = {n: d for n, d in self.open.items() if d < self.depth}
                if self.item == self.depth:
                    self.item = None
                self.depth -= 1

            def handle_data(self, data):
                for name in self.open:
                    self.found[-1][name] += data

        for b in batches:
            out = []
            for page, html in zip(b["page_id"], b["html"], strict=True):
                r = Reader()
                r.feed(html or "")
                out += [(page, k, *[(x.get(f) or "").strip() or "N/A" for f in fields]) for k, x in enumerate(r.found)]
            yield pd.DataFrame(out, columns=["page_id", "k", *fields])

    return pages.select("page_id", "html").mapInPandas(run, schema)


def tag_registry(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, taggings, aliases) of nested records {id, slug, parent_ids, taggings, aliases}; ids must be unique."""
    slugs = rows.select(F.col("id").alias("parent_id"), F.col("slug").alias("parent"))
    edges = rows.select(F.col("slug").alias("node"), F.explode("parent_ids").alias("parent_id")).join(slugs, "parent_id").select("node", "parent")
    taggings = rows.select(F.col("slug").alias("tag"), F.explode("taggings").alias("t")).select(F.col("t.oracle_id").alias("item"), "tag")
    aliases = rows.select(F.col("slug").alias("tag"), F.explode("aliases").alias("alias"))
    return rows.select(F.col("slug").alias("node")), edges, taggings, aliases


def flat_card(card: Column | str = "card") -> list[Column]:
    """Columns of a nested card record: of two-faced cards the faces' texts joined, and the front's where one is needed."""
    c = lambda p: F.col(f"{card}.{p}")
    faces = F.coalesce(c("card_faces"), F.array().cast("array<struct<name:string,mana_cost:string,oracle_text:string,power:string,toughness:string,image_uri:string>>"))
    joined = lambda f: F.nullif(F.array_join(F.filter(F.transform(faces, lambda x: x[f]), lambda v: v.isNotNull() & (v != "")), " // "), F.lit(""))
    text, kind = F.coalesce(c("oracle_text"), joined("oracle_text")), F.coalesce(c("type_line"), F.lit(""))
    leads = (F.contains(kind, F.lit("Legendary")) & F.contains(kind, F.lit("Creature"))) | F.contains(F.coalesce(text, F.lit("")), F.lit("can be your commander"))
    return [
        c("oracle_id").alias("oracle_id"), c("name").alias("name"), F.coalesce(c("mana_cost"), joined("mana_cost")).alias("mana_cost"), c("cmc").cast("double").alias("cmc"),
        kind.alias("type_line"), text.alias("oracle_text"), F.coalesce(c("power"), joined("power")).alias("power"), F.coalesce(c("toughness"), joined("toughness")).alias("toughness"),
        F.coalesce(c("image_uri"), F.try_element_at(faces, F.lit(1))["image_uri"]).alias("image_uri"), c("prices.usd").try_cast("double").alias("price_usd"),
        F.coalesce(c("legalities.commander") == "legal", F.lit(False)).alias("legal_commander"), F.contains(kind, F.lit("Land")).alias("is_land"), leads.alias("can_be_commander"),
    ]


def in_deck(categories: Column, included: Column) -> Column:
    """Board membership: no category, or the first one is included; 'Sideboard' anywhere keeps a line out. included: map."""
    none = F.coalesce(F.size(categories) == 0, F.lit(True))
    first = F.coalesce(F.try_element_at(included, F.try_element_at(categories, F.lit(1))), F.lit(True))
    return none | (first & ~F.array_contains(categories, "Sideboard"))


def leaders(cards: Column) -> Column:
    return F.filter(cards, lambda x: F.coalesce(F.array_contains(x["categories"], "Commander"), F.lit(False)))


def assemble(lines: DataFrame, names: DataFrame, leader_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Basket lines (basket, name, qty) to (basket, item, qty) of resolved items that don't lead the basket, and the
    audit (basket, n_unresolved, qty_unresolved, names)."""
    got = lines.join(names.select("name", "item"), "name", "left")
    resolved = got.filter("item is not null").join(leader_ids, ["basket", "item"], "left_anti").groupBy("basket", "item").agg(F.sum("qty").alias("qty"))
    lost = got.filter("item is null").groupBy("basket").agg(
        F.count_distinct("name").alias("n_unresolved"), F.sum("qty").alias("qty_unresolved"), F.array_sort(F.collect_set("name")).alias("names")
    )
    return resolved, lost


def search_urls(names: DataFrame, base: str, most: int = 2000) -> DataFrame:
    """(group, url): for each group the longest run of names, in their order, whose query fits the length."""
    size = F.length("name") + 5
    run = F.sum(size).over(W.partitionBy("group").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    fit = names.withColumn("run", run).filter(F.col("run") + len(base) <= most)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: F.concat(F.lit('!"'), x["name"], F.lit('"')))
    return fit.groupBy("group").agg(F.concat(F.lit(base), F.array_join(parts, " or ")).alias("url"))


def read_sidecar(spark: SparkSession, path: str) -> dict:
    """The JSON object that `sinks.write_table` puts beside a table, read by any file system that Spark reaches."""
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path.rstrip('/')}.meta").collect()))
