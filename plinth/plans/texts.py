"""Text queries and rule-based classification of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import text as X
from plinth.operators import classify as C
from plinth.operators import vectors as V
from plinth.plans.registry import query
from plinth.sources import model as M

_TOKENS = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+(?:[''’][\p{L}\p{M}\p{N}_]+)?'), lambda w: regexp_full_match(w, '[a-z]+([''’][a-z]+)?'))"
STOP = ["the", "and", "of", "in", "la", "le", "des", "der", "die", "und"]
_STOP = ", ".join(f"'{w}'" for w in STOP)


@query(f"SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM (SELECT word, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS word FROM documents) GROUP BY 1)")
def token_counts(spark, sf):
    return X.token_counts(M.table(spark, sf, "documents"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS word FROM documents) WHERE word NOT IN ({_STOP}) GROUP BY 1 ORDER BY n DESC, word LIMIT 20")
def stopword_top(spark, sf):
    return X.token_counts(M.table(spark, sf, "documents"), stopwords=STOP).select("word", "n").orderBy(F.desc("n"), "word").limit(20)


@query(f"SELECT word, count(*) AS df, CAST(sum(c) AS BIGINT) AS tf FROM (SELECT rid, word, count(*) AS c FROM (SELECT doc_id AS rid, unnest({_TOKENS}) AS word FROM documents) GROUP BY 1, 2) WHERE length(word) > 2 AND word NOT IN ({_STOP}) GROUP BY 1 HAVING count(*) >= 40")
def doc_freq(spark, sf):
    return X.doc_freq(M.table(spark, sf, "documents"), stopwords=STOP)


@query()
def repeated_words(spark, sf):
    hits = F.transform(X.repeated_words(F.col("text")), lambda x: F.lower(x))
    return M.table(spark, sf, "documents").select("doc_id", F.explode(hits).alias("hit")).groupBy("hit").agg(F.count("*").alias("n"))


@query()
def porter_stems(spark, sf):
    """Stems of the vocabulary: each distinct word is stemmed once."""
    words = X.token_counts(M.table(spark, sf, "documents"), stopwords=STOP)
    return words.select(X.stem(F.col("word")).alias("stem"), "n").groupBy("stem").agg(F.count("*").alias("n_words"), F.sum("n").alias("n"))


@query(
    f"WITH w AS (SELECT doc_id, unnest({_TOKENS}) AS word FROM documents), k AS (SELECT * FROM w WHERE length(word) >= 2), tf AS (SELECT doc_id, word, count(*) AS tf FROM k GROUP BY 1, 2), df AS (SELECT word, ln((1 + (SELECT count(DISTINCT doc_id) FROM k)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tf GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT doc_id, word, tf * idf AS x FROM tf JOIN df USING (word)) SELECT doc_id, word, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM r"
)
def tfidf_weights(spark, sf):
    return V.tfidf(_words(spark, sf)).withColumn("weight", F.round("weight", 6))


def _words(spark, sf):
    return M.table(spark, sf, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("word")).filter(F.length("word") >= 2)


@query()
def tfidf_space(spark, sf):
    """Benchmark items in a space of 8 dimensions."""
    words = M.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.explode(X.tokens(F.col("text"))).alias("word")).filter(F.length("word") >= 2)
    return V.truncated_svd(V.tfidf(words), 8)


@query(r"SELECT item_id, trim(regexp_replace(replace(regexp_replace(lower(text), '\([^)]*\)', ' ', 'g'), split_part(lower(text), ' ', 1), '~'), '\s+', ' ', 'g')) AS normalized FROM benchmark")
def rules_text(spark, sf):
    b = M.table(spark, sf, "benchmark")
    return b.select("item_id", X.rules_text(F.col("text"), F.substring_index("text", " ", 1)).alias("normalized"))


@query("SELECT page_id, CASE WHEN contains(html, '<title>') AND contains(split_part(html, '<title>', 2), '</title>') THEN split_part(split_part(html, '<title>', 2), '</title>', 1) END AS title FROM pages WHERE contains(html, '<title>')")
def text_between(spark, sf):
    p = M.table(spark, sf, "pages").filter(F.contains("html", F.lit("<title>")))
    return p.select("page_id", X.between(F.col("html"), "<title>", "</title>").alias("title"))


#: Roles of documents, the first wins a tie.
ROLES = ["stub", "toxic", "link", "contact", "license", "question", "numeric", "prose", "boilerplate", "other"]
TAG_RULES = [("quality:1", "prose", 1.0), ("quality:0", "boilerplate", 1.0), ("toxic:1", "toxic", 2.0), ("toxic:1", "prose", -1.0), ("lang:en", "prose", 0.5)]
COMBOS = [("boilerplate", ["quality:0", "lang:en"], 0.5)]
TEXT_RULES = [("question", r"\?", 1.0), ("link", r"https?://", 1.5), ("contact", r"[a-z0-9]@[a-z0-9]", 1.5), ("license", r"(?i)license|copyright", 2.0), ("numeric", r"[0-9]{4}", 1.0), ("prose", r"\. [A-ZÀ-Ý]", 1.0)]
STUB = 60


def _role_tables(spark, sf):
    docs = M.table(spark, sf, "documents").select(F.col("doc_id").alias("item"), "text", "lang")
    marks = M.table(spark, sf, "labels").select(F.col("doc_id").alias("item"), F.explode(F.array(*[F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in ("quality", "toxic")])).alias("tag"))
    tags = marks.unionByName(docs.select("item", F.concat(F.lit("lang:"), "lang").alias("tag"))).filter("tag is not null")
    rules = spark.createDataFrame(TAG_RULES, "tag string, role string, weight double")
    items = docs.select("item", (F.length(F.coalesce("text", F.lit(""))) < STUB).alias("is_override"))
    return items, C.tag_scores(tags, rules, COMBOS), C.text_scores(docs, TEXT_RULES)


_RULES = ", ".join(f"('{t}', '{r}', {w}::DOUBLE)" for t, r, w in TAG_RULES)
_TEXTS = " UNION ALL ".join(f"SELECT item, '{r}' AS role, {w}::DOUBLE AS score FROM d WHERE regexp_matches(text, '{p}')" for r, p, w in TEXT_RULES)
_PLACE = f"list_position([{', '.join(repr(r) for r in ROLES)}], role)"
_CTE = (
    "WITH d AS (SELECT doc_id AS item, coalesce(text, '') AS text, lang FROM documents), tags AS (SELECT doc_id AS item, 'quality:' || quality AS tag FROM labels UNION SELECT doc_id, 'toxic:' || toxic FROM labels UNION SELECT item, 'lang:' || lang FROM d WHERE lang IS NOT NULL), "
    f"rules(tag, role, weight) AS (VALUES {_RULES}), parts AS (SELECT item, role, greatest(weight, 0) AS credit, least(weight, 0) AS penalty FROM tags JOIN rules USING (tag) UNION ALL SELECT item, 'boilerplate', 0.5, 0 FROM tags WHERE tag IN ('quality:0', 'lang:en') GROUP BY 1 HAVING count(*) = 2), "
    f"tagt AS (SELECT item, role, sum(credit) AS credit, sum(penalty) AS penalty FROM parts GROUP BY 1, 2), textt AS (SELECT item, role, sum(score) AS score FROM ({_TEXTS}) GROUP BY 1, 2), "
)
_FINAL = (
    "comb AS (SELECT item, role, greatest(coalesce(credit, 0), coalesce(score, 0)) + coalesce(penalty, 0) AS score FROM tagt FULL JOIN textt USING (item, role) UNION ALL SELECT item, 'stub', 100.0 FROM d WHERE length(text) < 60), "
    f"first AS (SELECT item, role, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, {_PLACE}) AS rk FROM comb WHERE score >= 1) WHERE rk = 1), "
    f"second AS (SELECT item, role, score FROM (SELECT c.*, row_number() OVER (PARTITION BY c.item ORDER BY c.score DESC, {_PLACE.replace('role)', 'c.role)')}) AS rk FROM comb c JOIN first f ON f.item = c.item AND f.role != c.role WHERE c.score >= 1 AND c.role NOT IN ('stub', 'other')) WHERE rk = 1), "
    f"tp AS (SELECT item, role FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY credit + penalty DESC, {_PLACE}) AS rk FROM tagt WHERE credit + penalty >= 1) WHERE rk = 1), "
    f"xp AS (SELECT item, role FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, {_PLACE}) AS rk FROM textt WHERE score >= 1) WHERE rk = 1), "
    "out AS (SELECT d.item, coalesce(f.role, 'other') AS primary_role, coalesce(f.score, 0) AS primary_score, CASE WHEN f.role IS NULL THEN 'default' WHEN t.item IS NOT NULL AND x.item IS NOT NULL THEN 'both' WHEN t.item IS NOT NULL THEN 'tags' WHEN x.item IS NOT NULL THEN 'text' ELSE 'type' END AS primary_source, s.role AS secondary, coalesce(s.score, 0) AS secondary_score, CASE WHEN f.role IS NOT NULL THEN tp.role END AS tag_primary, CASE WHEN f.role IS NOT NULL THEN xp.role END AS text_primary FROM d LEFT JOIN first f ON f.item = d.item LEFT JOIN second s ON s.item = d.item LEFT JOIN tp ON tp.item = d.item LEFT JOIN xp ON xp.item = d.item LEFT JOIN tagt t ON t.item = d.item AND t.role = f.role AND t.credit + t.penalty > 0 LEFT JOIN textt x ON x.item = d.item AND x.role = f.role AND x.score > 0) "
)


def _assigned(spark, sf):
    items, by_tag, by_text = _role_tables(spark, sf)
    return C.classify(items, by_tag, by_text, ROLES, override="stub")


@query(_CTE.rstrip(", ") + " SELECT item, role, credit, penalty FROM tagt")
def role_tag_scores(spark, sf):
    return _role_tables(spark, sf)[1]


@query(_CTE.rstrip(", ") + " SELECT item, role, score FROM textt")
def role_text_scores(spark, sf):
    return _role_tables(spark, sf)[2]


@query(_CTE + _FINAL + "SELECT item, primary_role, primary_score, primary_source, secondary, secondary_score, tag_primary, text_primary FROM out")
def role_assign(spark, sf):
    return _assigned(spark, sf).drop("secondary_source").withColumnRenamed("primary", "primary_role")


@query(_CTE + _FINAL + "SELECT count(*) FILTER (tag_primary IS NOT NULL AND text_primary IS NOT NULL) AS n_both, count(*) FILTER (tag_primary = text_primary) AS n_agree, count(*) FILTER (tag_primary IS NOT NULL AND text_primary IS NULL) AS n_only_left, count(*) FILTER (tag_primary IS NULL AND text_primary IS NOT NULL) AS n_only_right, count(*) FILTER (tag_primary IS NULL AND text_primary IS NULL) AS n_neither, round(count(*) FILTER (tag_primary = text_primary) / nullif(CAST(count(*) FILTER (tag_primary IS NOT NULL AND text_primary IS NOT NULL) AS DOUBLE), 0), 9) AS rate FROM out")
def layer_agreement(spark, sf):
    return C.agreement(_assigned(spark, sf), "tag_primary", "text_primary").withColumn("rate", F.round("rate", 9))


@query(_CTE + _FINAL + "SELECT primary_role, primary_source, count(*) AS n FROM out GROUP BY 1, 2")
def role_distribution(spark, sf):
    return _assigned(spark, sf).groupBy(F.col("primary").alias("primary_role"), "primary_source").agg(F.count("*").alias("n"))


@query(_CTE + _FINAL + "SELECT item, primary_role, secondary, primary_score - secondary_score AS margin FROM out WHERE secondary IS NOT NULL AND primary_score - secondary_score <= 0.5")
def role_borderline(spark, sf):
    a = _assigned(spark, sf).filter("secondary is not null").withColumn("margin", F.col("primary_score") - F.col("secondary_score"))
    return a.filter("margin <= 0.5").select("item", F.col("primary").alias("primary_role"), "secondary", "margin")


@query(_CTE + _FINAL + "SELECT item, tag_primary, text_primary FROM out WHERE tag_primary != text_primary")
def role_disagreements(spark, sf):
    return _assigned(spark, sf).filter("tag_primary != text_primary").select("item", "tag_primary", "text_primary")


@query(_CTE + _FINAL + "SELECT role, CAST(sum(p) AS BIGINT) AS n_primary, CAST(sum(s) AS BIGINT) AS n_secondary FROM (SELECT primary_role AS role, 1 AS p, 0 AS s FROM out UNION ALL SELECT secondary, 0, 1 FROM out WHERE secondary IS NOT NULL) GROUP BY 1")
def role_survey(spark, sf):
    a = _assigned(spark, sf)
    both = F.explode(F.array(F.struct(F.col("primary").alias("role"), F.lit(1).alias("p"), F.lit(0).alias("s")), F.struct(F.col("secondary").alias("role"), F.lit(0).alias("p"), F.lit(1).alias("s")))).alias("x")
    return a.select(both).select("x.*").filter("role is not null").groupBy("role").agg(F.sum("p").alias("n_primary"), F.sum("s").alias("n_secondary"))


@query(_CTE + _FINAL + "SELECT CAST(l.toxic AS INTEGER) AS toxic, count(*) AS n, round(avg(CASE WHEN (o.primary_role = 'toxic') = (l.toxic = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM out o JOIN labels l ON l.doc_id = o.item GROUP BY 1")
def spot_check(spark, sf):
    marks = M.table(spark, sf, "labels").select(F.col("doc_id").alias("item"), F.col("toxic").cast("int").alias("toxic"))
    right = ((F.col("primary") == "toxic") == (F.col("toxic") == 1)).cast("double")
    return _assigned(spark, sf).join(marks, "item").groupBy("toxic").agg(F.count("*").alias("n"), F.round(F.avg(right), 9).alias("accuracy"))
