"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontaminate, divergence, jaccard_join, langid, packing, pii, quality, sharding, simhash, sstable, token_counts, url_filter
from .shared import small_batches, table


def op1_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document by extendible hashing, at most 1 MB of text each."""
    return sharding.assign(table(spark, sf_dir, "documents"), limit=1 << 20)


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from the sorted-string-table shards."""
    small_batches(spark)
    return sstable.shards_digest(sstable.token_shards(spark, table(spark, sf_dir, "documents")))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by line, tokens on a bound counted where most of their characters lie."""
    small_batches(spark)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict on every document."""
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark phrase."""
    small_batches(spark)
    return decontaminate.leaks_digest(decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    small_batches(spark)
    return langid.languages(table(spark, sf_dir, "documents"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pieces_digest(packing.pack_documents(table(spark, sf_dir, "documents")))


def op9_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 4-word shingle similarity of 0.85 or more."""
    small_batches(spark)
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data found in every document."""
    return pii.spans_digest(pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "spans"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and the terms that set it apart."""
    small_batches(spark)
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under fingerprints at most two bits apart."""
    small_batches(spark)
    return simhash.components(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after ten rounds from eight first centroids."""
    return centroids.clusters_digest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_extendible_shards, op2_sstable, op3_url_rules, op4_section_tokens, op5_quality_cascade, op6_decontaminate, op7_language, op8_pack, op9_jaccard_components, op10_pii, op11_source_divergence, op12_simhash_components, op13_centroids]
    return {f.__name__: f for f in found}


#: A shard is the shortest hash prefix with at most 1 MB under it, so its parent has more.
OP1_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
n AS (
  SELECT k.depth, d.h >> (60 - k.depth) AS prefix, sum(d.n_bytes) AS shard_bytes
  FROM d CROSS JOIN (SELECT CAST(unnest(range(0, 25)) AS INT) AS depth) k GROUP BY ALL),
s AS (
  SELECT n.* FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.prefix = n.prefix >> 1
  WHERE n.shard_bytes <= 1048576 AND (n.depth = 0 OR p.shard_bytes > 1048576))
SELECT d.doc_id, d.h, CAST(d.n_bytes AS BIGINT) AS n_bytes, s.depth, s.prefix, CAST(0 AS BIGINT) AS page,
       CAST(s.shard_bytes AS BIGINT) AS shard_bytes
FROM d JOIN s ON s.prefix = d.h >> (60 - s.depth)
"""

OP3_SQL = """
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule_host, rule_path, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
b AS (
  SELECT u.*, r.rule_host || r.rule_path AS rule, r.action,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN action
            WHEN regexp_matches(host, '(^|[.-])(spam-farm|cheap-pills|casino)[.-]') THEN 'block' ELSE 'allow' END AS verdict
FROM b WHERE k = 1
"""

OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x
  FROM documents),
g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1)
  GROUP BY doc_id),
b AS (
  SELECT w.doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(x) AS n_lines,
         CAST(len(x) - len(list_distinct(x)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 5 > n_words OR n_dup_lines * 10 > n_lines * 3
            OR word_chars < n_words * 2 OR word_chars > n_words * 15
            OR (len(t) - len(replace(t, '!', ''))) * 2 > n_words
            OR len(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) * 2 > word_chars) AS kept
FROM f
"""

OP6_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
g AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, n FROM g JOIN p USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


#: All pairs that share a shingle, and components by closure; for tables of some thousand rows.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(m, w.doc_id) AS BIGINT) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY 1) USING (doc_id)
"""


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN v USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, sum(total) AS whole, count(*) AS terms FROM v GROUP BY 1),
g AS (
  SELECT lang, source, CAST(coalesce(own, 0) AS HUGEINT) AS own, CAST(coalesce(whole, 0) AS HUGEINT) AS whole, coalesce(terms, 0) AS terms
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS own FROM c GROUP BY 1, 2) USING (lang, source) LEFT JOIN l USING (lang)),
s AS (
  SELECT g.lang, g.source, v.term, coalesce(n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (own + terms) AS p, 1 + 1000000000::HUGEINT * (total + 1) // (whole + terms) AS q
  FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
x AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source),
words AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM s WHERE n > 0 AND p > q),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM words))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""


def op13_sql(rounds: int = 10) -> str:
    """One step a round: distances, the nearest centroid, exact floors of means."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, c, sum((x - y) * (x - y)) AS d FROM x JOIN c{k} USING (i) GROUP BY r, c),
a{k} AS MATERIALIZED (SELECT r, vec_id, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if k < rounds:
            steps.append(f"""
c{k + 1} AS MATERIALIZED (
  SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, y) AS y
  FROM c{k} LEFT JOIN (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{k} JOIN x USING (r) GROUP BY c, i) USING (c, i))""")
    return f"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS e FROM embeddings),
k AS (SELECT * FROM e WHERE len(e) = 64 AND len(list_filter(e, lambda z: z IS NOT NULL AND isfinite(z))) = 64),
x AS MATERIALIZED (SELECT r, vec_id, CAST(unnest(range(1, 65)) AS INT) AS i, CAST(floor(1024 * unnest(e)) AS BIGINT) AS x FROM k),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM k QUALIFY c < 8),
c0 AS MATERIALIZED (SELECT c, i, x AS y FROM x JOIN f USING (r)),{','.join(steps)},
h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_extendible_shards": OP1_SQL, "op3_url_rules": OP3_SQL, "op5_quality_cascade": OP5_SQL, "op6_decontaminate": OP6_SQL, "op9_jaccard_components": OP9_SQL, "op11_source_divergence": OP11_SQL, "op13_centroids": op13_sql()}
