"""Association, eligibility, templates, graphs, enrichment and factors over baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.shared import small_side
from plinth.operators import association as A
from plinth.operators import eligibility as E
from plinth.operators import enrich, factor, graph, profile
from plinth.operators import templates as P
from plinth.operators import vectors as V
from plinth.operators.pairs import sums
from plinth.plans.registry import query
from plinth.plans.sql import select
from plinth.sources import model as M
from plinth.sources.scratch import materialize, spread

TOP_ITEM = 7


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _baskets(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(M.baskets(spark, sf), "baskets")


def _entries(spark: SparkSession, sf: str, b: DataFrame | None = None) -> DataFrame:
    """Indexed entries, weighted near-uniformly by stratum; `b`: the baskets, if they are written already."""
    b = _baskets(spark, sf) if b is None else b
    h = M.holders(spark, sf, b)
    w = h.join(F.broadcast(A.near_uniform(h)), "stratum").select("basket", F.col("weight").alias("w"))
    return _indexed(spark, sf, b, w)


def _indexed(spark: SparkSession, sf: str, b: DataFrame, w: DataFrame | None = None) -> DataFrame:
    n = M.pieces(spark, sf)
    return A.entries(b, A.item_index(b, tasks=n, once=True), w, tasks=n, once=True)


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.pair_stats(materialize(_entries(spark, sf), "entries"), tasks=M.pieces(spark, sf))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(A.scored(_stats(spark, sf)), "scored")


def _compared(spark: SparkSession, sf: str, b: DataFrame | None = None) -> DataFrame:
    b = _baskets(spark, sf) if b is None else b
    matched = P.matches(M.basket_leaders(spark, sf, b), P.leader_bridge(M.template_leaders(spark, sf, b)))
    return P.compared(matched, b, M.templates(spark, sf, held=b))


def _eligible(spark: SparkSession, sf: str) -> DataFrame:
    h = M.holders(spark, sf)
    return E.eligible(E.identity_counts(spark, h, A.near_uniform(h)))


def _edges(spark: SparkSession, sf: str, scored: DataFrame) -> DataFrame:
    return graph.topk_union(scored, "tscore", 15, M.catalog(spark, sf).filter("staple"))


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    return materialize(graph.edge_weights(graph.jaccard_gate(materialize(_edges(spark, sf, s), "edges"), 0.03), s), "edge-weights")


def _factors(spark: SparkSession, sf: str) -> DataFrame:
    """(item, topic, weight): a fixed synthetic factor."""
    topics = spark.range(8).select(F.col("id").alias("t"))
    items = spread(M.catalog(spark, sf).select("item"), M.pieces(spark, sf, "part", 8), "item")
    rows = items.crossJoin(F.broadcast(topics))
    return rows.select("item", F.col("t").cast("int").alias("topic"), ((F.col("item") * (F.col("t") + 3) + F.col("t") * 7) % 11).cast("double").alias("weight"))


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return graph.memberships(_factors(spark, sf))


@query(select("SELECT item, n_baskets, row_number() OVER (ORDER BY item) - 1 AS row FROM item_index", "item_index"))
def item_index(spark, sf):
    return A.with_rows(materialize(A.item_index(M.baskets(spark, sf), tasks=M.pieces(spark, sf)), "index"))


@query(select("SELECT i, j, raw, round(joint, 6) AS joint FROM pairs", "pairs"))
def pair_counts(spark, sf):
    return _rounded(A.pair_counts(_entries(spark, sf), tasks=M.pieces(spark, sf)), "joint")


@query(select("SELECT i, j, raw, round(pmi, 6) AS pmi FROM scored WHERE pmi IS NOT NULL", "scored"))
def pmi(spark, sf):
    return _rounded(A.scored(_stats(spark, sf)).select("i", "j", "raw", "pmi").filter("pmi is not null"), "pmi")


@query(select("SELECT i, j, raw, round(lift, 6) AS lift FROM scored WHERE lift IS NOT NULL", "scored"))
def lift(spark, sf):
    return _rounded(A.scored(_stats(spark, sf)).select("i", "j", "raw", "lift").filter("lift is not null"), "lift")


@query(select("SELECT i, j, raw, round(tscore, 6) AS tscore FROM scored", "scored"))
def tscore(spark, sf):
    return _rounded(A.scored(_stats(spark, sf)).select("i", "j", "raw", "tscore"), "tscore")


@query(select("SELECT i, j, raw, round(tscore, 6) AS tscore FROM scored ORDER BY round(tscore, 6) DESC, i, j LIMIT 20", "scored"))
def tscore_top(spark, sf):
    return _rounded(A.scored(_stats(spark, sf)).select("i", "j", "raw", "tscore"), "tscore").orderBy(F.desc("tscore"), "i", "j").limit(20)


@query(
    select(
        "SELECT stratum, i, j, raw, round((raw - m.n * o.n / CAST(t.n AS DOUBLE)) / sqrt(raw), 6) AS tscore FROM (SELECT h.stratum, a.item AS i, b.item AS j, count(*) AS raw FROM pooled a JOIN pooled b ON a.basket = b.basket AND a.item < b.item JOIN holders h ON h.basket = a.basket GROUP BY 1, 2, 3 HAVING count(*) >= 2) p "
        "JOIN (SELECT stratum, item, count(*) AS n FROM pooled JOIN holders USING (basket) GROUP BY 1, 2) m USING (stratum) JOIN (SELECT stratum, item, count(*) AS n FROM pooled JOIN holders USING (basket) GROUP BY 1, 2) o USING (stratum) JOIN (SELECT stratum, count(DISTINCT basket) AS n FROM pooled JOIN holders USING (basket) GROUP BY 1) t USING (stratum) WHERE m.item = i AND o.item = j",
        "pooled", "holders",
    )
)
def tscore_by_stratum(spark, sf):
    """Scopes as a grouping column: all strata in one plan."""
    b = _baskets(spark, sf)
    roster = M.holders(spark, sf, b).select("basket", "stratum")
    n = M.pieces(spark, sf)
    rows = materialize(spread(_indexed(spark, sf, b), n, "basket").join(roster, "basket"), "entries")
    return _rounded(A.scored(A.pair_stats(rows, 2, ("stratum",), n)).select("stratum", "i", "j", "raw", "tscore"), "tscore")


@query(select("SELECT count(*) AS n_pairs, (SELECT count(*) FROM item_index) AS n_items, round(count(*) / ((SELECT count(*) FROM item_index) * ((SELECT count(*) FROM item_index) - 1) / 2.0), 9) AS density FROM pairs", "pairs", "item_index"))
def matrix_density(spark, sf):
    rows = materialize(_entries(spark, sf), "entries")
    n = M.pieces(spark, sf)
    return A.density(A.pair_counts(rows, tasks=n), A.item_index(M.baskets(spark, sf), tasks=n)).withColumn("density", F.round("density", 9))


@query(select("SELECT stratum, n, round(weight, 9) AS weight FROM near_weights", "near_weights"))
def near_uniform_weights(spark, sf):
    return _rounded(A.near_uniform(M.holders(spark, sf)), "weight", places=9)


@query(
    select(
        "SELECT stratum, round((true_n / (SELECT sum(true_n) FROM truth)) / (n / (SELECT sum(n) FROM near_weights JOIN truth USING (stratum))), 9) AS weight FROM near_weights JOIN truth USING (stratum)",
        "near_weights", "truth",
    )
)
def design_weights(spark, sf):
    return _rounded(A.design_weights(M.holders(spark, sf), M.true_counts(spark, sf)), "weight", places=9)


@query(
    select(
        "SELECT * FROM (SELECT stratum, n, round(weight, 9) AS weight, 'low' AS side FROM near_weights ORDER BY weight, stratum LIMIT 3) UNION ALL SELECT * FROM (SELECT stratum, n, round(weight, 9) AS weight, 'high' AS side FROM near_weights ORDER BY weight DESC, stratum LIMIT 3)",
        "near_weights",
    )
)
def weight_extremes(spark, sf):
    return profile.extremes(_rounded(A.near_uniform(M.holders(spark, sf)), "weight", places=9), "weight", "stratum", 3)


_PARTNERS = f"SELECT CASE WHEN i = {TOP_ITEM} THEN j ELSE i END AS item, %s AS v FROM scored WHERE (i = {TOP_ITEM} OR j = {TOP_ITEM}) AND %s != 0"


@query(select(f"SELECT p.item, round(v, 6) AS value FROM ({_PARTNERS % ('tscore', 'tscore')}) p JOIN catalog c USING (item) WHERE c.staple = (SELECT staple FROM catalog WHERE item = {TOP_ITEM}) ORDER BY v DESC, item LIMIT 10", "scored", "catalog"))
def top_associated(spark, sf):
    return _rounded(A.top_partners(A.scored(_stats(spark, sf)), TOP_ITEM, "tscore", 10, M.catalog(spark, sf)), "value")


@query(
    select(
        " UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS measure, item, round(v, 6) AS value FROM ({_PARTNERS % (m, m)}) ORDER BY v DESC, item LIMIT 5)" for m in ("pmi", "lift", "tscore")),
        "scored",
    )
)
def measures_side_by_side(spark, sf):
    s = _scored(spark, sf)
    one = lambda m: A.top_partners(s, TOP_ITEM, m, 5).select(F.lit(m).alias("measure"), "item", "value")
    return _rounded(one("pmi").unionByName(one("lift")).unionByName(one("tscore")), "value")


@query(
    select(
        f"SELECT i, j, round(tscore, 6) AS tscore FROM scored, (SELECT list(item) AS near FROM (SELECT item FROM ({_PARTNERS % ('tscore', 'tscore')}) ORDER BY v DESC, item LIMIT 10)) WHERE (i = {TOP_ITEM} OR list_contains(near, i)) AND (j = {TOP_ITEM} OR list_contains(near, j))",
        "scored",
    )
)
def partner_submatrix(spark, sf):
    return _rounded(A.submatrix(_scored(spark, sf), TOP_ITEM, "tscore", 10), "tscore").select("i", "j", "tscore")


@query(
    select(
        "SELECT item, partner, round(lift, 6) AS lift FROM (SELECT item, CASE WHEN top_l > 5.0 THEN top_b ELSE same_b END AS partner, CASE WHEN top_l > 5.0 THEN top_l ELSE same_l END AS lift FROM (SELECT a AS item, arg_max(b, (v, -b)) AS top_b, max(v) AS top_l, arg_max(b, (v, -b)) FILTER (ka = kb) AS same_b, max(v) FILTER (ka = kb) AS same_l FROM (SELECT m.a, m.b, m.v, x.kind AS ka, y.kind AS kb FROM (SELECT i AS a, j AS b, round(lift, 9) AS v FROM scored UNION ALL SELECT j, i, round(lift, 9) FROM scored) m JOIN catalog x ON x.item = a JOIN catalog y ON y.item = b) GROUP BY 1)) WHERE partner IS NOT NULL",
        "scored", "catalog",
    )
)
def best_partner_floor(spark, sf):
    return _rounded(A.best_partner(_rounded(_scored(spark, sf), "lift", places=9), M.catalog(spark, sf)), "lift")


@query(select("SELECT i, j, round(pmi, 6) AS pmi FROM scored WHERE i NOT IN (SELECT item FROM catalog WHERE staple) AND j NOT IN (SELECT item FROM catalog WHERE staple) ORDER BY round(pmi, 6) DESC, i, j LIMIT 25", "scored", "catalog"))
def top_pairs_excluding(spark, sf):
    s, out = M.catalog(spark, sf).filter("staple"), A.scored(_stats(spark, sf)).select("i", "j", "pmi")
    n = s.count()
    for k in A.PAIR:
        out = out.join(small_side(s.select(F.col("item").alias(k)), n), k, "left_anti")
    return _rounded(out, "pmi").select("i", "j", "pmi").orderBy(F.desc("pmi"), "i", "j").limit(25)


@query(select("SELECT i, j, raw, CAST(round((raw_lift - 1) * 100) AS BIGINT) AS pct_over FROM scored WHERE raw >= 4", "scored"))
def percent_over_baseline(spark, sf):
    return A.scored(_stats(spark, sf)).filter("raw >= 4").select("i", "j", "raw", F.round((F.col("raw_lift") - 1) * 100).cast("long").alias("pct_over"))


@query(select("SELECT a AS item, round(sum(abs(v)), 5) AS mass FROM mirrored GROUP BY 1", "mirrored"))
def scope_popularity(spark, sf):
    return A.mirrored(_scored(spark, sf), "tscore").groupBy(F.col("a").alias("item")).agg(F.round(F.sum(F.abs("v")), 5).alias("mass"))


@query(select("SELECT mask, n, round(weighted, 6) AS weighted FROM identity_counts", "identity_counts"))
def identity_histogram(spark, sf):
    h = M.holders(spark, sf)
    return _rounded(E.identity_counts(spark, h, A.near_uniform(h)), "weighted")


@query(select("SELECT mask, n, round(weighted, 6) AS weighted FROM eligible", "eligible"))
def eligible_counts(spark, sf):
    return _rounded(_eligible(spark, sf), "weighted")


@query(select("SELECT c.item, coalesce(b.n, 0) AS deck_count, e.n AS eligible_count, round(coalesce(b.n, 0) / CAST(nullif(e.n, 0) AS DOUBLE), 9) AS play_rate FROM catalog c LEFT JOIN (SELECT item, count(*) AS n FROM baskets GROUP BY 1) b USING (item) LEFT JOIN eligible e USING (mask)", "catalog", "baskets", "eligible"))
def play_rate(spark, sf):
    return _rounded(E.play_rates(M.baskets(spark, sf), M.catalog(spark, sf), _eligible(spark, sf)), "play_rate", places=9)


_COND = "SELECT s.i, s.j, s.raw, (joint - ij.weighted * coalesce(m_i / nullif(ei.weighted, 0), 0) * coalesce(m_j / nullif(ej.weighted, 0), 0)) / sqrt(joint) AS t, (joint - m_i * m_j / total) / sqrt(joint) AS pooled_t FROM stats s JOIN catalog a ON a.item = i JOIN catalog b ON b.item = j JOIN eligible ei ON ei.mask = a.mask JOIN eligible ej ON ej.mask = b.mask JOIN eligible ij ON ij.mask = (a.mask | b.mask)"


@query(select(f"SELECT i, j, raw, round(t, 6) AS tscore FROM ({_COND})", "stats", "catalog", "eligible"))
def tscore_eligible(spark, sf):
    return _rounded(E.conditioned_tscore(_stats(spark, sf), M.catalog(spark, sf), _eligible(spark, sf)), "tscore")


@query(select(f"SELECT i, j, round(t, 6) AS v FROM ({_COND}) WHERE round(t, 6) > 0", "stats", "catalog", "eligible"))
def conditioned_matrix(spark, sf):
    out = _rounded(E.conditioned_tscore(_stats(spark, sf), M.catalog(spark, sf), _eligible(spark, sf)), "tscore")
    return out.filter("tscore > 0").select("i", "j", F.col("tscore").alias("v"))


@query(select(f"SELECT i, j, round((t - pooled_t) / abs(nullif(pooled_t, 0)) * 100, 3) AS pct_change FROM ({_COND}) WHERE raw >= 4", "stats", "catalog", "eligible"))
def conditioning_change(spark, sf):
    s = materialize(_stats(spark, sf), "stats")
    pooled = A.scored(s).filter("raw >= 4").select("i", "j", F.col("tscore").alias("pooled"))
    both = E.conditioned_tscore(s, M.catalog(spark, sf), _eligible(spark, sf)).join(pooled, ["i", "j"])
    return both.select("i", "j", F.round(F.try_divide(F.col("tscore") - F.col("pooled"), F.abs("pooled")) * 100, 3).alias("pct_change"))


@query(select("SELECT basket, template FROM matches", "matches"))
def template_matches(spark, sf):
    return P.matches(M.basket_leaders(spark, sf), P.leader_bridge(M.template_leaders(spark, sf)))


@query(select("SELECT basket, template, total, diff, round(trust, 9) AS trust FROM best", "best"))
def template_best_match(spark, sf):
    return _rounded(P.best_match(_compared(spark, sf)), "trust", places=9)


@query(select("SELECT basket, round(similarity, 9) AS similarity FROM similarity", "similarity"))
def template_similarity(spark, sf):
    return _rounded(P.similarity(M.holders(spark, sf), _compared(spark, sf)), "similarity", places=9)


def _retention(spark, sf):
    b = _baskets(spark, sf)
    best = materialize(P.best_match(_compared(spark, sf, b)), "best")
    return b, best, P.retention(best, b, M.templates(spark, sf, held=b), 400)


@query(select("SELECT template, item, similar_n, kept_n, round(weighted_cut, 6) AS weighted_cut, round(weighted_kept, 6) AS weighted_kept FROM retention", "retention"))
def template_retention(spark, sf):
    return _rounded(_retention(spark, sf)[2], "weighted_cut", "weighted_kept")


_OVERRIDE = "SELECT b.basket, b.item, 1 - trust * (1 - CASE WHEN cut <= 0.05 THEN 1.0 WHEN cut >= 1.0 THEN 0.0 ELSE (1.0 - cut) / 0.95 END) AS u FROM best x JOIN baskets b USING (basket) JOIN (SELECT template, item, weighted_cut / (weighted_cut + weighted_kept) AS cut FROM retention WHERE weighted_cut + weighted_kept > 0) r ON r.template = x.template AND r.item = b.item"


@query(select(f"SELECT basket, item, round(u, 6) AS u FROM ({_OVERRIDE})", "best", "baskets", "retention"))
def item_override(spark, sf):
    b, best, kept = _retention(spark, sf)
    return _rounded(P.item_overrides(best, b, kept), "u")


@query(
    select(
        f"SELECT a.item AS i, b.item AS j, count(*) AS raw, round(sum(a.w * coalesce(ua.u, 1) * coalesce(ub.u, 1)), 6) AS joint FROM pooled a JOIN pooled b ON a.basket = b.basket AND a.item < b.item LEFT JOIN ({_OVERRIDE}) ua ON ua.basket = a.basket AND ua.item = a.item LEFT JOIN ({_OVERRIDE}) ub ON ub.basket = b.basket AND ub.item = b.item GROUP BY 1, 2 HAVING count(*) >= 3",
        "pooled", "best", "baskets", "retention",
    )
)
def pair_counts_weighted(spark, sf):
    b, best, kept = _retention(spark, sf)
    u = P.item_overrides(best, b, materialize(kept, "kept"))
    n = M.pieces(spark, sf)
    rows = spread(_entries(spark, sf, b).drop("u"), n, "basket", "item").join(u, ["basket", "item"], "left").withColumn("u", F.coalesce("u", F.lit(1.0)))
    return _rounded(A.pair_counts(rows, tasks=n), "joint")


@query(
    select(
        "SELECT CAST(k AS INTEGER) AS bucket, k / 10.0::DOUBLE AS low, count(similarity) AS n FROM range(10) r(k) LEFT JOIN similarity ON similarity >= CAST(k AS DOUBLE) / 10 AND (similarity < CAST(k + 1 AS DOUBLE) / 10 OR k = 9) AND similarity <= 1 GROUP BY 1, 2",
        "similarity",
    )
)
def similarity_histogram(spark, sf):
    return P.histogram(P.similarity(M.holders(spark, sf), _compared(spark, sf)), "similarity")


@query(
    select(
        "SELECT CAST(q AS DOUBLE) AS q, round(list_extract(v, CAST(least(len(v) - 1, floor(q * len(v))) AS BIGINT) + 1), 9) AS value FROM (SELECT list(similarity ORDER BY similarity) AS v FROM similarity WHERE similarity IS NOT NULL), (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS q)",
        "similarity",
    )
)
def nearest_rank_quantiles(spark, sf):
    return _rounded(P.nearest_rank(P.similarity(M.holders(spark, sf), _compared(spark, sf)), "similarity", (0.1, 0.25, 0.5, 0.75, 0.9)), "value", places=9)


@query(select("SELECT i, j FROM kept_edges", "kept_edges"))
def topk_union(spark, sf):
    return _edges(spark, sf, _scored(spark, sf))


@query(select("SELECT i, j, round(jaccard, 9) AS jaccard FROM gated", "gated"))
def jaccard_gate(spark, sf):
    return _rounded(graph.jaccard_gate(materialize(_edges(spark, sf, _scored(spark, sf)), "edges"), 0.03), "jaccard", places=9)


@query(select("SELECT i, j, round(jaccard, 9) AS jaccard, round(tscore, 6) AS tscore, round(raw_lift, 6) AS raw_lift, round(weight, 6) AS weight FROM weighted_edges", "weighted_edges"))
def edge_weight(spark, sf):
    return _rounded(_rounded(_weighted(spark, sf), "jaccard", places=9), "tscore", "raw_lift", "weight")


@query(
    select(
        "SELECT item, round(max_lift, 6) AS max_lift, round(rate, 9) AS play_rate FROM (SELECT a AS item, max(v) AS max_lift FROM (SELECT i AS a, raw_lift AS v FROM weighted_edges UNION ALL SELECT j, raw_lift FROM weighted_edges) GROUP BY 1) JOIN (SELECT c.item, coalesce(b.n, 0) / CAST(nullif(e.n, 0) AS DOUBLE) AS rate FROM catalog c LEFT JOIN (SELECT item, count(*) AS n FROM baskets GROUP BY 1) b USING (item) LEFT JOIN eligible e USING (mask)) USING (item) WHERE max_lift < 3.5 AND rate >= 0.01",
        "weighted_edges", "catalog", "baskets", "eligible",
    )
)
def staple_detector(spark, sf):
    rates = E.play_rates(M.baskets(spark, sf), M.catalog(spark, sf), _eligible(spark, sf))
    return _rounded(_rounded(graph.generic_items(_weighted(spark, sf), rates, 3.5, 0.01), "max_lift"), "play_rate", places=9)


#: Rounds written out one after another: more than the test tables need; further ones change nothing.
_CORE = ", ".join(
    f"core{r + 1} AS MATERIALIZED (SELECT a.item, a.topic FROM core{r} a JOIN ends e ON e.a = a.item JOIN core{r} b ON b.item = e.b AND b.topic = a.topic GROUP BY 1, 2 HAVING count(*) >= 3)"
    for r in range(24)
)


@query(
    f"WITH ends AS MATERIALIZED (SELECT i AS a, j AS b FROM ({select('SELECT i, j FROM weighted_edges', 'weighted_edges')}) UNION ALL SELECT j, i FROM ({select('SELECT i, j FROM weighted_edges', 'weighted_edges')})), "
    f"core0 AS MATERIALIZED ({select('SELECT item, topic FROM members', 'members')}), {_CORE} SELECT item, topic FROM core24"
)
def kcore(spark, sf):
    return graph.kcore(_weighted(spark, sf).select("i", "j"), _members(spark, sf), 3)


@query()
def community_labels(spark, sf):
    return graph.communities(_weighted(spark, sf))


@query(select("SELECT item, topic, weight, round(share, 9) AS share FROM members", "members"))
def memberships_capped(spark, sf):
    return _rounded(_members(spark, sf), "share", places=9)


@query(select("SELECT c.item, coalesce(m.topic, -1) AS topic FROM catalog c LEFT JOIN (SELECT item, topic FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY share DESC, topic) AS rk FROM members) WHERE rk = 1) m USING (item)", "catalog", "members"))
def primary_topic(spark, sf):
    return graph.primary_topic(M.catalog(spark, sf), _members(spark, sf))


@query(select("SELECT basket, topic, round(share, 9) AS share FROM (SELECT basket, topic, w / nullif(sum(w) OVER (PARTITION BY basket), 0) AS share FROM (SELECT basket, topic, sum(weight) AS w FROM baskets JOIN factors USING (item) GROUP BY 1, 2)) WHERE share >= 0.1", "baskets", "factors"))
def basket_projection(spark, sf):
    return _rounded(graph.project_baskets(M.baskets(spark, sf), _factors(spark, sf)), "share", places=9)


@query("WITH g AS (SELECT label AS a, vec_id % 7 + label % 3 AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM g GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS x, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS ya, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS yb, (SELECT count(*) FROM g) AS n) SELECT n, round((x - ya * yb / (n * (n - 1) / 2.0)) / ((ya + yb) / 2 - ya * yb / (n * (n - 1) / 2.0)), 9) AS ari FROM s")
def ari(spark, sf):
    g = M.table(spark, sf, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 7 + F.col("label") % 3).alias("b"))
    return _rounded(graph.rand_index(g, "a", "b"), "ari", places=9)


@query(select("SELECT topic, tag, both_n, n, k, round(share, 9) AS share, round(recall, 9) AS recall, round(resolution, 9) AS resolution, round(lift, 9) AS lift, round(p, 6) AS p FROM enriched", "enriched"))
def enrichment(spark, sf):
    return _rounded(_rounded(enrich.enrichment(_members(spark, sf), M.tags(spark, sf)), "share", "recall", "resolution", "lift", places=9), "p")


@query(select("SELECT topic, tag, round(p9, 6) AS p, round(q, 6) AS q FROM tested", "tested"))
def bh_fdr(spark, sf):
    tests = materialize(_rounded(enrich.enrichment(_members(spark, sf), M.tags(spark, sf)), "p", places=9).select("topic", "tag", "p"), "tests")
    return _rounded(enrich.step_up(tests, "p", ["topic", "tag"]), "p", "q").select("topic", "tag", "p", "q")


@query(
    select(
        "SELECT (SELECT count(DISTINCT tag) FROM tags) AS n_labels, (SELECT count(DISTINCT tag) FROM significant) AS covered, (SELECT count(*) FROM (SELECT tag FROM significant GROUP BY 1 HAVING max(resolution) >= 0.05)) AS resolved_5, (SELECT count(*) FROM (SELECT tag FROM significant GROUP BY 1 HAVING max(resolution) >= 0.10)) AS resolved_10, (SELECT count(*) FROM (SELECT tag FROM significant GROUP BY 1 HAVING max(resolution) >= 0.20)) AS resolved_20, (SELECT count(*) FROM (SELECT tag FROM significant GROUP BY 1 HAVING max(resolution) >= 0.30)) AS resolved_30, (SELECT median(coalesce(c, 0)) FROM (SELECT DISTINCT topic FROM members) LEFT JOIN (SELECT topic, count(*) AS c FROM significant GROUP BY 1) USING (topic)) AS median_labels",
        "tags", "significant", "members",
    )
)
def granularity(spark, sf):
    """Gates that fit the test tables, whose labels are dealt at random; the operator's own are far stricter."""
    tested = materialize(_rounded(enrich.enrichment(_members(spark, sf), M.tags(spark, sf)), "p", places=9), "tested")
    found = materialize(enrich.enriched(tested, 1.05, 0.96), "enriched")
    return enrich.granularity(found, _members(spark, sf), M.tags(spark, sf))


@query(select("SELECT topic, tag, both_n, round(lift, 9) AS lift, round(q, 6) AS q FROM significant", "significant"))
def enriched_pairs(spark, sf):
    """The gates of `granularity`."""
    tested = materialize(_rounded(enrich.enrichment(_members(spark, sf), M.tags(spark, sf)), "p", places=9), "tested")
    return _rounded(_rounded(enrich.enriched(tested, 1.05, 0.96).select("topic", "tag", "both_n", "lift", "q"), "lift", places=9), "q")


@query(
    select(
        "SELECT topic, size, modal_mask, round(c / CAST(total AS DOUBLE), 9) AS purity FROM (SELECT topic, mask AS modal_mask, c, sum(c) OVER (PARTITION BY topic) AS total, row_number() OVER (PARTITION BY topic ORDER BY c DESC, mask) AS rk FROM (SELECT topic, mask, count(*) AS c FROM (SELECT topic, item, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, item) AS rk FROM members) JOIN catalog USING (item) WHERE rk <= 30 GROUP BY 1, 2)) JOIN (SELECT topic, count(*) AS size FROM members GROUP BY 1) USING (topic) WHERE rk = 1",
        "members", "catalog",
    )
)
def purity(spark, sf):
    return _rounded(enrich.purity(_members(spark, sf), M.catalog(spark, sf)), "purity", places=9)


@query()
def purity_null(spark, sf):
    """Seeded draws, so the same each time; tests hold them against their definition."""
    return enrich.purity_null(_members(spark, sf), M.catalog(spark, sf))


_NAMES = "WITH st AS (SELECT topic, tag, k, k / CAST(n AS DOUBLE) AS share, (k / CAST(n AS DOUBLE)) / (w / CAST(big AS DOUBLE)) AS lift FROM (SELECT m.topic, t.tag, count(DISTINCT m.item) AS k FROM members m JOIN tags t USING (item) GROUP BY 1, 2) JOIN (SELECT topic, count(*) AS n FROM members GROUP BY 1) USING (topic) JOIN (SELECT tag, count(DISTINCT item) AS w FROM tags GROUP BY 1) USING (tag), (SELECT count(*) AS big FROM catalog) WHERE k >= 4), ok AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(share * ln(1 + lift), 9) DESC, tag) AS rk, max(share) OVER (PARTITION BY topic) AS most FROM st WHERE share >= 0.02 AND lift >= 1.05), top AS (SELECT topic, max(tag) FILTER (rk = 1) AS one, max(tag) FILTER (rk = 2) AS two, max(most) AS most FROM ok WHERE rk <= 2 GROUP BY 1), broad AS (SELECT topic, tag AS broad FROM (SELECT topic, tag, row_number() OVER (PARTITION BY topic ORDER BY round(share, 9) DESC, tag) AS rk FROM st WHERE lift >= 1.0) WHERE rk = 1) SELECT topic, CASE WHEN most < 0.2 AND broad IS NOT NULL AND broad != one AND NOT coalesce(broad = two, false) THEN concat_ws('/', broad, one) ELSE concat_ws('/', one, two) END AS name FROM top LEFT JOIN broad USING (topic)"


@query("WITH " + ", ".join(f"{n} AS ({select(f'SELECT * FROM {n}', n)})" for n in ("members", "tags", "catalog")) + f" SELECT * FROM ({_NAMES})")
def community_names(spark, sf):
    n = M.catalog(spark, sf).count()
    return enrich.community_names(_members(spark, sf).select("item", "topic"), M.tags(spark, sf), n, share=0.02, lift=1.05, broad_lift=1.0)


@query(
    select(
        "SELECT topic, n_pairs, round(med, 6) AS median_lift FROM (SELECT a.topic, count(*) AS n_pairs, median(s.raw_lift) AS med FROM (SELECT topic, item FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, item) AS rk FROM members) WHERE rk <= 14) a JOIN (SELECT topic, item FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, item) AS rk FROM members) WHERE rk <= 14) b ON a.topic = b.topic AND a.item < b.item JOIN scored s ON s.i = a.item AND s.j = b.item GROUP BY 1)",
        "members", "scored",
    )
)
def group_contrast(spark, sf):
    """Pairs of each group's 14 heaviest members (a feature of the report) and their median lift."""
    from pyspark.sql.window import Window as W

    rank = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("weight"), "item"))
    top = materialize(_members(spark, sf).withColumn("rank", rank).filter("rank <= 14").select("topic", "item"), "top")
    pairs = top.select("topic", F.col("item").alias("i")).join(top.select("topic", F.col("item").alias("j")), "topic").filter("i < j")
    found = pairs.join(A.scored(_stats(spark, sf)).select("i", "j", "raw_lift"), ["i", "j"])
    return found.groupBy("topic").agg(F.count("*").alias("n_pairs"), F.round(F.median("raw_lift"), 6).alias("median_lift"))


@query(select("SELECT h.stratum, count(DISTINCT b.basket) AS n_baskets, count(DISTINCT b.item) AS pool FROM holders h JOIN baskets b USING (basket) GROUP BY 1", "holders", "baskets"))
def pool_stats(spark, sf):
    rows = M.baskets(spark, sf).join(M.holders(spark, sf).select("basket", "stratum"), "basket")
    return rows.groupBy("stratum").agg(F.count_distinct("basket").alias("n_baskets"), F.count_distinct("item").alias("pool"))


@query(select("SELECT c_custkey AS basket, CAST(coalesce(sum(qty), 0) AS BIGINT) AS n FROM customer LEFT JOIN baskets ON basket = c_custkey GROUP BY 1 HAVING coalesce(sum(qty), 0) < 600", "baskets"))
def size_audit(spark, sf):
    everyone = M.table(spark, sf, "customer").select(F.col("c_custkey").alias("basket"))
    return profile.size_audit(M.baskets(spark, sf), everyone, 600)


@query()
def symnmf_fit(spark, sf):
    return factor.as_table(spark, factor.symnmf(_weighted(spark, sf), 8, rounds=60))


@query()
def nmf_fit(spark, sf):
    b = M.baskets(spark, sf)
    return factor.as_table(spark, factor.nmf(_indexed(spark, sf, b), 5, rounds=6))


@query()
def hierarchy(spark, sf):
    return factor.tree_table(spark, factor.hierarchy(_weighted(spark, sf), 4, least=40, deepest=2, stable=0.3, rounds=40))


@query()
def skip_gram(spark, sf):
    from pyspark.ml.functions import vector_to_array

    return V.skip_gram(M.baskets(spark, sf), 16).getVectors().select(F.col("word").cast("long").alias("item"), vector_to_array("vector").alias("v"))


@query(
    select(
        "SELECT b.basket, b.item, round(mean_pmi, 6) AS mean_pmi, round(rate, 6) AS inclusion FROM (SELECT a.basket, a.item, avg(coalesce(s.pmi, 0)) AS mean_pmi FROM pooled a JOIN pooled o ON o.basket = a.basket AND o.item != a.item LEFT JOIN scored s ON s.i = least(a.item, o.item) AND s.j = greatest(a.item, o.item) GROUP BY 1, 2) b JOIN (SELECT item, n_baskets / CAST((SELECT count(*) FROM holders) AS DOUBLE) AS rate FROM item_index) r USING (item)",
        "pooled", "scored", "item_index", "holders",
    )
)
def cut_candidates(spark, sf):
    """An extension beyond the reference: each basket's items with their mean association to the rest."""
    b = _baskets(spark, sf)
    rows = materialize(_entries(spark, sf, b), "entries")
    tasks = M.pieces(spark, sf)
    scored = A.scored(A.pair_stats(rows, tasks=tasks)).select("i", "j", F.coalesce("pmi", F.lit(0.0)).alias("pmi"))
    found = sums(rows, scored, "pmi", tasks=tasks).groupBy("basket", "item").agg(F.sum("s").alias("s"))
    n = rows.groupBy("basket").agg((F.count("*") - 1).alias("others"))
    rate = A.item_index(b, tasks=tasks).crossJoin(F.broadcast(M.holders(spark, sf, b).agg(F.count("*").alias("all")))).select("item", F.round(F.col("n_baskets") / F.col("all"), 6).alias("inclusion"))
    out = rows.select("basket", "item").join(n.filter("others > 0"), "basket").join(found, ["basket", "item"], "left").join(rate, "item")
    return out.select("basket", "item", F.round(F.coalesce("s", F.lit(0.0)) / F.col("others"), 6).alias("mean_pmi"), "inclusion")
