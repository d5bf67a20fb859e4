"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import anisotropic, decontaminate, histogram_sort, language_id, piece_codec, secret_scan, simhash, tool_calls, toxicity, warc
from plinth.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


QUERIES["op8_secret_scan"] = op8_secret_scan


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.dedup_documents(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.check_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES |= {"op6_simhash": op6_simhash, "op4_decontaminate": op4_decontaminate}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op4_decontaminate"] = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS MATERIALIZED (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS MATERIALIZED (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS phrase, least(len(w), 8) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
lens AS (SELECT DISTINCT n FROM windows),
runs AS MATERIALIZED (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM places, lens WHERE i + n - 1 <= len(w)),
hits AS MATERIALIZED (SELECT r, i, runs.n, item_id FROM runs JOIN windows USING (phrase)),
covered AS (SELECT r, count(DISTINCT hit) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS hit FROM hits) GROUP BY 1),
found AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY 1),
phrases AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS w FROM windows),
terms AS (SELECT phrase, k AS off, w[k + 1] AS one, w[k + 2] AS two, greatest(len(w) - 1, 1) AS n_terms
  FROM (SELECT phrase, w, unnest(range(0, greatest(len(w) - 1, 1))) AS k FROM phrases)),
postings AS MATERIALIZED (SELECT r, i - 1 AS pos, w[i] AS one, w[i + 1] AS two FROM places WHERE i < len(w)
  UNION ALL SELECT r, i - 1, w[i], NULL FROM places),
counts AS (SELECT one, two, count(*) AS c FROM postings GROUP BY 1, 2),
ranked AS (SELECT *, n_terms - sum((c IS NULL)::INT) OVER (PARTITION BY phrase) AS there,
    row_number() OVER (PARTITION BY phrase ORDER BY again > 1, c IS NULL, c, off) AS rank
  FROM (SELECT t.*, c.c, row_number() OVER (PARTITION BY phrase, t.one, t.two ORDER BY off) AS again
    FROM terms t LEFT JOIN counts c ON c.one = t.one AND c.two IS NOT DISTINCT FROM t.two)),
rare AS MATERIALIZED (SELECT phrase, off, one, two, rank, least(there, 3) AS need FROM ranked WHERE rank <= 3 AND least(there, 3) >= least(n_terms, 2)),
starts AS MATERIALIZED (SELECT DISTINCT r, phrase, pos - off AS s, rank, need FROM postings p JOIN rare t ON p.one = t.one AND p.two IS NOT DISTINCT FROM t.two),
near AS (SELECT DISTINCT r, phrase FROM (SELECT a.r, a.phrase, a.s FROM starts a JOIN starts b ON a.r = b.r AND a.phrase = b.phrase AND b.s BETWEEN a.s AND a.s + {decontaminate.SLACK}
  GROUP BY a.r, a.phrase, a.s, a.need HAVING count(DISTINCT b.rank) = a.need)),
close AS (SELECT r, count(DISTINCT item_id) AS n_near FROM near JOIN windows USING (phrase) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(len(ids), 0) >= 2 AS contaminated, coalesce(n_near, 0) AS n_near
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r) LEFT JOIN close USING (r)
"""


def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.shard_documents(table(spark, sf_dir, "documents"))


QUERIES["op5_histogram_sort"] = op5_histogram_sort


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(table(spark, sf_dir, "documents"))


QUERIES["op9_piece_codec"] = op9_piece_codec


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(table(spark, sf_dir, "documents"))


QUERIES["op10_language_id"] = op10_language_id


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op2_toxicity"] = op2_toxicity


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES["op1_warc"] = op1_warc
ORACLES["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT *, octet_length(encode(body)) AS size, max(page_id) OVER (PARTITION BY body) AS head FROM p),
m AS (SELECT *, size >= 1000 AND head IS NOT NULL AND page_id IS DISTINCT FROM head AS again FROM g)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN head END AS refers_to
FROM m
"""


def op3_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic.search_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES["op3_anisotropic"] = op3_anisotropic


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link_conversations(table(spark, sf_dir, "conversations"))


QUERIES["op7_tool_calls"] = op7_tool_calls
