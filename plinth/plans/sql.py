"""The same model as SQL: named table expressions, put together by `select`."""

from __future__ import annotations

#: name: (query, names that it reads)
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "baskets": (
        "SELECT o_custkey AS basket, l_partkey AS item, CAST(sum(l_quantity) AS BIGINT) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
        (),
    ),
    "catalog": (
        "SELECT p_partkey AS item, p_name AS name, p_type AS kind, p_brand AS brand, p_size AS size, p_retailprice AS price, CASE WHEN p_partkey % 6 = 5 THEN 0 ELSE CAST(1 << CAST(p_partkey % 5 AS INTEGER) AS INTEGER) END AS mask, p_type = 'ECONOMY' AS staple FROM part",
        (),
    ),
    "holders": (
        "SELECT c_custkey AS basket, c_nationkey AS stratum, CAST((c_custkey * 7) % 32 AS INTEGER) AS mask FROM customer WHERE c_custkey IN (SELECT basket FROM baskets)",
        ("baskets",),
    ),
    "truth": ("SELECT s_nationkey AS stratum, count(*) AS true_n FROM supplier GROUP BY 1", ()),
    "firsts": ("SELECT stratum AS template, min(basket) AS basket FROM holders GROUP BY 1", ("holders",)),
    "templates": (
        "SELECT template, item, qty FROM (SELECT template, item, qty, row_number() OVER (PARTITION BY template ORDER BY qty DESC, item) AS rk FROM firsts JOIN baskets USING (basket)) WHERE rk <= 40",
        ("firsts", "baskets"),
    ),
    "template_leaders": (
        "SELECT template, template AS declared, CASE WHEN template % 5 = 0 THEN (template + 1) % 25 END AS partner, CASE WHEN template % 3 = 0 THEN [(template + 2) % 25] ELSE [] END AS alternatives FROM firsts",
        ("firsts",),
    ),
    "basket_leaders": (
        "SELECT DISTINCT basket, unnest(CASE WHEN basket % 4 = 0 THEN [stratum, CAST(basket % 25 AS INTEGER)] ELSE [stratum] END) AS leader FROM holders",
        ("holders",),
    ),
    "tags": (
        "SELECT DISTINCT item, unnest(list_concat(string_split(lower(name), ' '), [lower(kind), lower(brand)])) AS tag FROM catalog",
        ("catalog",),
    ),
    "item_index": ("SELECT item, count(*) AS n_baskets FROM baskets GROUP BY 1 HAVING count(*) >= 3", ("baskets",)),
    "near_weights": (
        "SELECT stratum, n, median(n) OVER () / n AS weight FROM (SELECT stratum, count(*) AS n FROM holders GROUP BY 1)",
        ("holders",),
    ),
    "pooled": (
        "SELECT b.basket, b.item, coalesce(w.weight, 1.0) AS w FROM baskets b JOIN item_index USING (item) JOIN holders h USING (basket) LEFT JOIN near_weights w USING (stratum)",
        ("baskets", "item_index", "holders", "near_weights"),
    ),
    "pairs": (
        "SELECT a.item AS i, b.item AS j, count(*) AS raw, sum(a.w) AS joint FROM pooled a JOIN pooled b ON a.basket = b.basket AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 3",
        ("pooled",),
    ),
    "marginals": ("SELECT item, count(*) AS n_baskets, sum(w) AS weight FROM pooled GROUP BY 1", ("pooled",)),
    "totals": ("SELECT count(*) AS n_baskets, sum(w) AS total FROM (SELECT DISTINCT basket, w FROM pooled)", ("pooled",)),
    "stats": (
        "SELECT p.*, a.weight AS m_i, b.weight AS m_j, a.n_baskets AS n_i, b.n_baskets AS n_j, t.total, t.n_baskets AS n FROM pairs p JOIN marginals a ON a.item = i JOIN marginals b ON b.item = j, totals t",
        ("pairs", "marginals", "totals"),
    ),
    "scored": (
        "SELECT i, j, raw, joint, ln((joint + 1) * total / ((m_i + 1) * (m_j + 1))) * raw / (raw + 1) * least(m_i, m_j) / (least(m_i, m_j) + 1) AS pmi, joint * total / nullif(m_i * m_j, 0) AS lift, (joint - m_i * m_j / total) / sqrt(joint) AS tscore, raw * CAST(n AS DOUBLE) / (n_i * n_j) AS raw_lift FROM stats",
        ("stats",),
    ),
    "masks": ("SELECT CAST(range AS INTEGER) AS mask FROM range(32)", ()),
    "identity_counts": (
        "SELECT m.mask, count(h.basket) AS n, coalesce(sum(w.weight), 0.0) AS weighted FROM masks m LEFT JOIN holders h USING (mask) LEFT JOIN near_weights w USING (stratum) GROUP BY 1",
        ("masks", "holders", "near_weights"),
    ),
    "eligible": (
        "SELECT c.mask, CAST(sum(d.n) AS BIGINT) AS n, sum(d.weighted) AS weighted FROM masks c JOIN identity_counts d ON (d.mask & c.mask) = c.mask GROUP BY 1",
        ("masks", "identity_counts"),
    ),
    "matches": (
        "SELECT DISTINCT basket, template FROM basket_leaders JOIN (SELECT template, declared AS leader FROM template_leaders UNION SELECT template, partner FROM template_leaders WHERE partner IS NOT NULL UNION SELECT template, unnest(alternatives) FROM template_leaders) USING (leader)",
        ("basket_leaders", "template_leaders"),
    ),
    "sizes": ("SELECT basket, CAST(sum(qty) AS BIGINT) AS total, count(*) AS n_items FROM baskets GROUP BY 1", ("baskets",)),
    "compared": (
        "SELECT m.basket, m.template, s.total, s.n_items, CAST(coalesce(sum(CASE WHEN b.item IS NULL THEN 0 ELSE least(b.qty, t.qty) END), 0) AS BIGINT) AS overlap, count(b.item) AS shared, ts.n AS n_template FROM matches m JOIN sizes s USING (basket) JOIN templates t USING (template) JOIN (SELECT template, count(*) AS n FROM templates GROUP BY 1) ts USING (template) LEFT JOIN baskets b ON b.basket = m.basket AND b.item = t.item GROUP BY ALL",
        ("matches", "sizes", "templates", "baskets"),
    ),
    "best": (
        "SELECT basket, template, total, diff, CASE WHEN diff <= 10 THEN 1.0 WHEN diff >= total - 20 THEN 0.0 ELSE (total - 20 - diff) / CAST(total - 20 - 10 AS DOUBLE) END AS trust FROM (SELECT basket, template, total, total - overlap AS diff, row_number() OVER (PARTITION BY basket ORDER BY total - overlap, template) AS rk FROM compared) WHERE rk = 1",
        ("compared",),
    ),
    "similarity": (
        "SELECT h.basket, max(shared / CAST(n_items + n_template - shared AS DOUBLE)) AS similarity FROM holders h LEFT JOIN compared USING (basket) GROUP BY 1",
        ("holders", "compared"),
    ),
    "retention": (
        "SELECT x.template, t.item, count(*) FILTER (diff <= 400) AS similar_n, count(*) FILTER (diff <= 400 AND b.item IS NOT NULL) AS kept_n, sum(CASE WHEN b.item IS NULL THEN trust / (1 + exp((diff - 20) / 10.0)) ELSE 0.0 END) AS weighted_cut, sum(CASE WHEN b.item IS NOT NULL THEN trust * (1 - 1 / (1 + exp((diff - 20) / 10.0))) ELSE 0.0 END) AS weighted_kept FROM best x JOIN templates t USING (template) LEFT JOIN baskets b ON b.basket = x.basket AND b.item = t.item GROUP BY 1, 2",
        ("best", "templates", "baskets"),
    ),
    "mirrored": ("SELECT i AS a, j AS b, tscore AS v FROM scored UNION ALL SELECT j, i, tscore FROM scored", ("scored",)),
    "kept_edges": (
        "SELECT DISTINCT least(a, b) AS i, greatest(a, b) AS j FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY v DESC, b) AS rk FROM mirrored WHERE v > 0 AND a NOT IN (SELECT item FROM catalog WHERE staple) AND b NOT IN (SELECT item FROM catalog WHERE staple)) WHERE rk <= 15",
        ("mirrored", "catalog"),
    ),
    "edge_ends": ("SELECT i AS a, j AS b FROM kept_edges UNION ALL SELECT j, i FROM kept_edges", ("kept_edges",)),
    "degrees": ("SELECT a, count(*) AS d FROM edge_ends GROUP BY 1", ("edge_ends",)),
    "gated": (
        "SELECT i, j, shared / CAST(du.d + dv.d - shared AS DOUBLE) AS jaccard FROM (SELECT e.i, e.j, count(y.b) AS shared FROM kept_edges e LEFT JOIN edge_ends x ON x.a = e.i LEFT JOIN edge_ends y ON y.a = e.j AND y.b = x.b GROUP BY 1, 2) s JOIN degrees du ON du.a = i JOIN degrees dv ON dv.a = j WHERE shared / CAST(du.d + dv.d - shared AS DOUBLE) >= 0.03",
        ("kept_edges", "edge_ends", "degrees"),
    ),
    "weighted_edges": (
        "SELECT g.i, g.j, g.jaccard, s.tscore, s.raw_lift, s.tscore * ln(1 + s.raw_lift) AS weight FROM gated g JOIN scored s ON s.i = g.i AND s.j = g.j",
        ("gated", "scored"),
    ),
    "factors": (
        "SELECT item, CAST(topic AS INTEGER) AS topic, CAST((item * (topic + 3) + topic * 7) % 11 AS DOUBLE) AS weight FROM catalog, range(8) r(topic)",
        ("catalog",),
    ),
    "shares": ("SELECT item, topic, weight, weight / nullif(sum(weight) OVER (PARTITION BY item), 0) AS share FROM factors", ("factors",)),
    "members": (
        "SELECT item, topic, weight, share FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY share DESC, topic) AS rk FROM shares WHERE share >= 0.1) WHERE rk <= 5",
        ("shares",),
    ),
    "logfact": ("SELECT n, lgamma(n + 1) AS lf FROM range(1) r(n)", ()),
    "enriched": (
        "WITH size_t AS (SELECT topic, count(*) AS n FROM members GROUP BY 1), size_l AS (SELECT tag, count(*) AS k FROM tags WHERE item IN (SELECT item FROM members) GROUP BY 1), pool AS (SELECT count(DISTINCT item) AS big FROM members), hit AS (SELECT topic, tag, count(*) AS both_n FROM members JOIN tags USING (item) GROUP BY 1, 2), base AS (SELECT h.topic, h.tag, both_n, n, k, big FROM hit h JOIN size_t USING (topic) JOIN size_l USING (tag), pool WHERE both_n >= 5), tail AS (SELECT topic, tag, unnest(range(both_n, least(n, k) + 1)) AS x, both_n, n, k, big FROM base), terms AS (SELECT *, CASE WHEN n - x > big - k THEN 0 ELSE exp(lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(big - k + 1) - lgamma(n - x + 1) - lgamma(greatest(big - k - n + x, 0) + 1) - lgamma(big + 1) + lgamma(n + 1) + lgamma(big - n + 1)) END AS p FROM tail) SELECT topic, tag, both_n, n, k, both_n / CAST(n AS DOUBLE) AS share, both_n / CAST(k AS DOUBLE) AS recall, least(both_n / CAST(n AS DOUBLE), both_n / CAST(k AS DOUBLE)) AS resolution, both_n / (CAST(n AS DOUBLE) * k / big) AS lift, least(sum(p), 1.0) AS p FROM terms GROUP BY topic, tag, both_n, n, k, big",
        ("members", "tags"),
    ),
    "tested": (
        "SELECT *, greatest(0, least(1, min(p9 * big / rk) OVER (ORDER BY p9 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) AS q FROM (SELECT *, round(p, 9) AS p9, count(*) OVER () AS big, count(*) OVER (ORDER BY round(p, 9) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk FROM enriched)",
        ("enriched",),
    ),
    "significant": ("SELECT * FROM tested WHERE lift >= 1.05 AND q <= 0.96", ("tested",)),
}


def select(body: str, *names: str) -> str:
    """A statement over named parts and all that they read."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for below in PARTS[name][1]:
                add(below)
            order.append(name)

    for n in names:
        add(n)
    return ("WITH " + ", ".join(f"{n} AS MATERIALIZED ({PARTS[n][0]})" for n in order) + " " if order else "") + body
