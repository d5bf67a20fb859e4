"""Benchmark decontamination over a distributed positional inverted index, in built-in SQL.

1. Items become windows of consecutive words. A term is a pair of neighbouring words (of a window of one word, that
   word), as single words of prose stand in every document; the windows' terms are the index's vocabulary.
2. One pass over the documents stores a posting (document, position, term) for each place of a term of the vocabulary.
   Others stand in no list that is ever read. One more posting, of a term of its own, ends each document and so holds
   its word count.
3. For each window, the postings of its rarest terms, less the terms' offsets, are candidate starts. Lists are
   intersected from the rarest on: the two rarest in one exchange by document and window, then all others in the
   documents that are left. A window is found where all its terms stand at their offsets.
4. The three rarest terms tell proximity as well: a window is near where they stand within SLACK words of their
   offsets, so that words put in, left out or moved between them don't hide it.

A row is known by its doc_id and its text's hash, so rows that repeat both get the same result each, and rows that
repeat a doc_id with other texts are kept apart. A null doc_id is a key like any other. Null and empty texts have no
words. Items without words, and rows without item_id, take no part; items that repeat an id add their windows to it.
Empty tables give no hits. Further columns are ignored. No list is ever held in one task: joins are keyed by document
and position, and terms only by broadcast of a counted vocabulary (or a shuffled join beyond BROADCAST_ROWS).
Time is linear in a text's length. Ties in rarity go to the term that is first in its window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plinth.llm.shared import materialize, small_side, text_hash, without_rows

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 8
#: Words that a term of a near window may be off.
SLACK = 4
#: The term that ends a document.
_END = -1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["doc_id", "h"]


def words(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


@dataclass
class Windows:
    """terms: (win_id, len, off, term_id) with len the number of words; items: (win_id, item_id); vocabulary: (key, one,
    two, term_id), two being null for single words. Each is written once."""

    terms: DataFrame
    items: DataFrame
    vocabulary: DataFrame


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> Windows:
    """Every run of `size` words of an item; an item of fewer words, but not none, is one window."""
    w = benchmark.filter("item_id is not null").select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(size)), " "))).alias("phrase"))
    each = materialize(each.distinct(), "decon-each")
    phrases = materialize(each.select("phrase").distinct().withColumn("win_id", F.monotonically_increasing_id()), "decon-phrases")
    split = F.split("phrase", " ")
    places = F.transform(F.sequence(F.lit(0), F.greatest(F.size(split) - 2, F.lit(0))), lambda i: F.struct(i.alias("off"), F.get(split, i).alias("one"), F.get(split, i + 1).alias("two")))
    terms = phrases.select("win_id", F.size(split).alias("len"), F.inline(places))
    vocabulary = terms.select("one", "two").distinct().withColumn("term_id", F.monotonically_increasing_id())
    vocabulary = materialize(vocabulary.select(_hash(F.col("one"), F.col("two")).alias("key"), "one", "two", "term_id"), "decon-vocabulary")
    known = small_side(vocabulary.drop("key").withColumnsRenamed({"one": "v1", "two": "v2"}))
    terms = terms.join(known, (F.col("one") == F.col("v1")) & F.col("two").eqNullSafe(F.col("v2"))).select("win_id", "len", "off", "term_id")
    return Windows(materialize(terms, "decon-terms"), each.join(phrases, "phrase").select("win_id", "item_id"), vocabulary)


def _hash(one: Column, two: Column) -> Column:
    return F.xxhash64(one, F.coalesce(two, F.lit("")))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, h, pos, term_id) for each place of a term of the vocabulary, and (…, word count, -1) for each row."""
    rows = docs.select("doc_id", text_hash(docs).alias("h"), words(F.col("text")).alias("w"))
    # the pair at the last place has an empty second word, and what follows it is the end
    pairs = F.arrays_zip(F.concat("w", F.array(F.lit(""))).alias("one"), F.concat(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), F.array(F.lit(""), F.lit(""))).alias("two"))
    at = rows.select("doc_id", "h", F.posexplode(pairs).alias("pos", "t")).select("doc_id", "h", "pos", F.col("t.one").alias("a"), F.col("t.two").alias("b"))
    ends = vocabulary.sparkSession.range(1).select(_hash(F.lit(""), F.lit("")).alias("key"), F.lit("").alias("one"), F.lit("").alias("two"), F.lit(_END).cast("long").alias("term_id"))
    known = small_side(vocabulary.filter("two is not null").unionByName(ends))
    # the hash is the only key; equality, told by prefixes both ways, is looked at where hashes meet
    equal = F.startswith("a", "one") & F.startswith("one", "a") & F.startswith("b", "two") & F.startswith("two", "b")
    met = at.withColumn("pair", _hash(F.col("a"), F.col("b"))).join(known, (F.col("pair") == F.col("key")) & equal)
    postings = met.select("doc_id", "h", "pos", "term_id")
    single = vocabulary.filter("two is null").select("one", "term_id")
    if not single.isEmpty():
        each = rows.select("doc_id", "h", F.posexplode("w").alias("pos", "a"))
        postings = postings.unionByName(each.join(small_side(single), F.col("a") == F.col("one")).select("doc_id", "h", "pos", "term_id"))
    return materialize(postings, "decon-index")


def ranked_terms(index: DataFrame, windows: Windows) -> DataFrame:
    """(win_id, len, off, term_id, rank, lost): the terms of each window from the rarest on; lost: how many stand nowhere."""
    counts = materialize(index.filter("term_id >= 0").groupBy("term_id").agg(F.count("*").alias("n")), "decon-counts")
    ranked = windows.terms.join(small_side(counts), "term_id", "left")
    whole = W.partitionBy("win_id")
    ranked = ranked.withColumn("lost", F.sum(F.col("n").isNull().cast("int")).over(whole))
    # of a term that stands twice in a window, only the first place ranks early
    first = F.row_number().over(W.partitionBy("win_id", "term_id").orderBy("off"))
    ranked = ranked.withColumn("again", first).withColumn("rank", F.row_number().over(whole.orderBy(F.col("again") > 1, F.col("n").isNull(), "n", "off")))
    return materialize(ranked.select("win_id", "len", "off", "term_id", "rank", "lost"), "decon-ranked")


def _candidates(index: DataFrame, ranked: DataFrame, most: int) -> DataFrame:
    """(doc_id, h, win_id, len, start, rank) where one of a window's `most` rarest terms stands; they repeat as rows do."""
    rare = ranked.filter(F.col("rank") <= most)
    found = index.join(small_side(rare), "term_id")
    return found.select(*_KEY, (F.col("pos") - F.col("off")).alias("start"), *(c for c in ranked.columns if c not in ("term_id", "off", "lost")))


def phrase_matches(index: DataFrame, windows: Windows, ranked: DataFrame | None = None) -> DataFrame:
    """(doc_id, h, win_id, len, start): every exact occurrence of a window."""
    ranked = (ranked_terms(index, windows) if ranked is None else ranked).filter("lost = 0")
    place = [*_KEY, "win_id", "len", "start"]
    agreed = _candidates(index, ranked, 2).filter("start >= 0")
    # bits, not a sum: postings of repeated rows repeat
    agreed = agreed.groupBy(*place).agg(F.bit_or(F.col("rank").cast("int")).alias("seen")).filter("seen = 3 or (seen = 1 and len <= 2)")
    agreed = materialize(agreed.select(*place), "decon-agreed")
    left = materialize(agreed.filter("len > 3").select(F.col("doc_id").alias("d"), F.col("h").alias("g")).distinct(), "decon-docs")
    met_by = lambda a, b: a["doc_id"].eqNullSafe(b["d"]) & (a["h"] == b["g"])
    inside = index.filter("term_id >= 0").join(small_side(left), met_by(index, left), "left_semi")
    have = inside.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("pos").alias("p"), F.col("term_id").alias("t"))
    need = agreed.join(small_side(ranked.filter("rank > 2").drop("rank", "lost")), ["win_id", "len"])
    need = need.select(*place, (F.col("start") + F.col("off")).alias("at"), "term_id")
    met = need.join(have, met_by(need, have) & (F.col("at") == F.col("p")) & (F.col("term_id") == F.col("t")), "left_semi")
    met = met.distinct().groupBy(*place).agg(F.count("*").alias("met")).filter("met = len - 3").select(*place)
    return materialize(met.unionByName(agreed.filter("len <= 3")), "decon-hits")


def proximity_matches(index: DataFrame, windows: Windows, slack: int = SLACK, ranked: DataFrame | None = None) -> DataFrame:
    """(doc_id, h, win_id, start): stretches where a window's rarest terms stand with no more than `slack` words between
    the starts that their offsets give; `start` is the smallest of these. Terms: the three rarest of those that stand
    anywhere at all, or as many as there are; at least two, but for a window that has one only.

    Starts are put in cells of slack + 1 and compared within a cell and the next, so a stretch is met in one of them.
    """
    ranked = ranked_terms(index, windows) if ranked is None else ranked
    terms = F.greatest(F.col("len") - 1, F.lit(1))
    ranked = ranked.withColumn("need", F.least(terms - F.col("lost"), F.lit(3))).filter(F.col("need") >= F.least(terms, F.lit(2)))
    found = _candidates(index, ranked, 3)
    cell = F.floor(F.col("start") / (slack + 1))
    spread = found.withColumn("cell", F.explode(F.array(cell, cell - 1)))
    near = spread.groupBy(*_KEY, "win_id", "need", "cell").agg(F.collect_set(F.struct("start", "rank")).alias("at"))
    within = lambda x: F.array_distinct(F.transform(F.filter("at", lambda y: (y["start"] >= x["start"]) & (y["start"] <= x["start"] + slack)), lambda y: y["rank"]))
    starts = F.transform(F.filter("at", lambda x: F.size(within(x)) == F.col("need")), lambda x: x["start"])
    return near.select(*_KEY, "win_id", F.array_min(starts).alias("start")).filter("start is not null").groupBy(*_KEY, "win_id").agg(F.min("start").alias("start"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, min_items: int = 2, slack: int | None = None) -> DataFrame:
    """(doc_id, h, n_words, n_hit, n_items, items, contaminated) for every row; with a slack, also n_near, the number of
    items that have a near window."""
    windows = item_windows(benchmark, size)
    index = build_index(docs, windows.vocabulary)
    ranked = ranked_terms(index, windows)
    hits = phrase_matches(index, windows, ranked)
    rows = W.partitionBy(*_KEY)
    spans = hits.groupBy(*_KEY, "start").agg(F.max("len").alias("len"))
    end = F.col("start") + F.col("len")
    before = F.max(end).over(rows.orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(before, F.lit(0)))))
    covered = spans.groupBy(*_KEY).agg(F.sum("new").alias("n_hit"))
    windows_of = small_side(windows.items)
    items = hits.select(*_KEY, "win_id").distinct().join(windows_of, "win_id")
    items = items.groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    none = F.lit(None)
    found = covered.select(*_KEY, "n_hit", none.cast("array<string>").alias("items"), none.cast("long").alias("n_near"))
    found = found.unionByName(items.select(*_KEY, none.cast("long").alias("n_hit"), "items", none.cast("long").alias("n_near")))
    if slack is not None:
        near = proximity_matches(index, windows, slack, ranked).join(windows_of, "win_id")
        near = near.groupBy(*_KEY).agg(F.count_distinct("item_id").alias("n_near"))
        found = found.unionByName(near.select(*_KEY, none.cast("long").alias("n_hit"), none.cast("array<string>").alias("items"), "n_near"))
    found = found.groupBy(*_KEY).agg(F.max("n_hit").alias("n_hit"), F.max("items").alias("items"), F.max("n_near").alias("n_near"))
    found = materialize(found.withColumnsRenamed({"doc_id": "d", "h": "g"}), "decon-found")
    every = index.filter(F.col("term_id") == _END).select(*_KEY, F.col("pos").cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return every.join(small_side(found), every["doc_id"].eqNullSafe(found["d"]) & (every["h"] == found["g"]), "left").select(
        *_KEY,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        (F.size(items) >= min_items).alias("contaminated"),
        *([F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")] if slack is not None else []),
    )


def check_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark, slack=SLACK).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = 1) -> DataFrame:
    """Documents without those that hold windows of min_items items or more; by default, of any."""
    bad = contamination(docs, benchmark, min_items=min_items).filter("contaminated").select("doc_id", "h")
    return without_rows(docs, materialize(bad, "decon-bad"))
