"""One thin query for each operator, over its whole table with production parameters, and the SQL that must give the same rows."""

from __future__ import annotations

import corpus_pipeline  # noqa: F401  registers the pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemetrics.llm.centroids import cluster_vectors
from sitemetrics.llm.decontaminate import contamination
from sitemetrics.llm.fingerprint import compare_with_next
from sitemetrics.llm.mixing import replicate
from sitemetrics.llm.near_dedup import near_duplicates
from sitemetrics.llm.neighbours import nearest
from sitemetrics.llm.ordinal_quality import fit_ordinal, quality_scores
from sitemetrics.llm.pitman_yor import language_model_scores
from sitemetrics.llm.registry import CHECKS, QUERIES, query, table
from sitemetrics.llm.revisits import resolve_revisits
from sitemetrics.llm.secrets import secret_spans
from sitemetrics.llm.token_output import store_tokens
from sitemetrics.llm.toxicity import fit_toxicity, toxicity_scores, training_rows
from sitemetrics.llm.whitening import whiten

__all__ = ["CHECKS", "QUERIES"]

#: Lower-cases A-Z alone, as the operators do.
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_SQL = rf"""
WITH RECURSIVE seq AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) = 1 THEN w
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM seq),
classes AS (SELECT min(doc_id) AS node, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
member AS (SELECT node, len(s) AS n, unnest(s) AS x FROM classes),
common AS (
  SELECT a.node AS u, b.node AS v, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM member a JOIN member b ON a.x = b.x AND a.node < b.node GROUP BY a.node, b.node),
link AS (SELECT u, v FROM common WHERE 100 * c >= 80 * (na + nb - c) UNION SELECT v, u FROM common WHERE 100 * c >= 80 * (na + nb - c)),
reach AS (SELECT u AS node, u AS other FROM link UNION SELECT r.node, l.v FROM reach r JOIN link l ON r.other = l.u),
component AS (SELECT node, min(other) AS c FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(p.c, k.node, s.doc_id) AS component_id,
       s.doc_id = coalesce(p.c, k.node, s.doc_id) AS kept
FROM sets s LEFT JOIN classes k ON list_sort(s.s) = k.s LEFT JOIN component p ON p.node = k.node
"""


@query("op5_minhash_near_dedup", NEAR_SQL)
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=2, percent=80)


LEAK_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, list_slice(w, s, s + k - 1) AS ws
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
doc_win AS (
  SELECT doc_id, s, k, list_slice(w, s, s + k - 1) AS ws
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, s, win.k, item_id FROM doc_win JOIN win ON win.k = doc_win.k AND win.ws = doc_win.ws),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op3_benchmark_decontamination", LEAK_SQL)
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query("op4_bit_packed_tokens")
def op4_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


MIX_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rate AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM n)::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE / n AS rate FROM n),
term AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rate
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM term WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
u AS (SELECT *, CAST('0x' || substr(md5('7:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (
  SELECT u.doc_id, any_value(t.rate) AS mix_rate, count(*) FILTER (WHERE t.c <= u.u) AS copies
  FROM u JOIN term t ON u.source IS NOT DISTINCT FROM t.source GROUP BY u.doc_id),
copy AS (SELECT doc_id, mix_rate, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS mix_copy FROM counted)
SELECT d.*, c.mix_rate, c.mix_copy, substr(md5('order7:' || d.doc_id || ':' || c.mix_copy), 1, 12) AS mix_key
FROM copy c JOIN documents d USING (doc_id)
"""


@query("op8_source_mixing", MIX_SQL)
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "documents")).withColumn("mix_copy", F.col("mix_copy").cast("int"))


@query("op9_ordinal_quality")
def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_ordinal(docs, table(spark, sf_dir, "labels")))


@query("op10_toxic_grammar")
def op10_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), where=training_rows("id"))
    return toxicity_scores(docs, model).select("doc_id", (~training_rows("doc_id")).alias("held_out"), "score", "predicted")


@query("op6_secret_markov")
def op6_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


@query("op2_improbable_features")
def op2_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


@query("op7_pitman_yor_scores")
def op7_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


#: Captures of every page, in SQL that Spark and DuckDB both read: a response; a later revisit by another spelling of the URL, with the
#: same, a weak, a changed or no etag; a revisit before the response; and, for some, a second response with another etag.
CAPTURES = """
SELECT page_id * 4 AS record_id, url, 1700000000 + (page_id * 7919) % 2592000 AS fetched, 'response' AS kind,
       substr(md5(html), 1, 16) AS etag, concat('day ', CAST(page_id % 1000 AS STRING)) AS last_modified,
       concat('text/html; ', CAST(length(html) AS STRING)) AS content, 'max-age=60' AS cache FROM pages
UNION ALL
SELECT page_id * 4 + 1, CASE page_id % 3 WHEN 0 THEN replace(url, 'http://', 'https://www.') WHEN 1 THEN concat(url, '#part') ELSE url END,
       1700000000 + (page_id * 7919) % 2592000 + 1 + (page_id * 31) % 864000, 'revisit',
       CASE WHEN page_id % 7 = 0 THEN 'changed' WHEN page_id % 5 = 0 THEN NULL ELSE concat('W/', substr(md5(html), 1, 16)) END,
       CASE WHEN page_id % 35 = 5 THEN NULL ELSE concat('day ', CAST(page_id % 1000 AS STRING)) END, 'ignored', concat('max-age=', CAST(page_id % 100 AS STRING)) FROM pages
UNION ALL
SELECT page_id * 4 + 2, url, 1700000000 + (page_id * 7919) % 2592000 - 5, 'revisit', substr(md5(html), 1, 16), NULL, 'ignored', NULL FROM pages WHERE page_id % 4 = 0
UNION ALL
SELECT page_id * 4 + 3, concat(url, '#again'), 1700000000 + (page_id * 7919) % 2592000 + 400000, 'response',
       concat('second-', CAST(page_id AS STRING)), 'later', 'text/plain', 'no-store' FROM pages WHERE page_id % 3 = 0
"""

REVISIT_SQL = rf"""
WITH c AS ({CAPTURES}),
p AS (SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM c),
k AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
         || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS page,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[A-Za-z]+|ref|gclid|fbclid)(=|$)'))), '&') AS named FROM p),
u AS (SELECT * EXCLUDE (page, named), page || CASE WHEN named <> '' THEN '?' || named ELSE '' END AS key FROM k),
r AS (SELECT key, fetched, max_by(c, record_id) AS c FROM (SELECT key, fetched, record_id, u AS c FROM u WHERE kind = 'response') GROUP BY key, fetched),
j AS (SELECT v.*, r.c AS old FROM (SELECT * FROM u WHERE kind = 'revisit') v ASOF LEFT JOIN r ON v.key = r.key AND v.fetched > r.fetched),
s AS (
  SELECT *, CASE WHEN old IS NULL THEN 'no_response' WHEN coalesce(etag, last_modified) IS NULL THEN 'no_validator'
            WHEN CASE WHEN etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = regexp_replace(old.etag, '^W/', '')
                 ELSE last_modified = old.last_modified END THEN 'resolved' ELSE 'mismatch' END AS state FROM j)
SELECT record_id, key AS canonical_url, fetched, state, CASE WHEN state = 'resolved' THEN old.record_id END AS response_id,
       CASE WHEN state <> 'resolved' THEN concat_ws(chr(10), 'Content-Type: ' || content, 'Cache-Control: ' || cache)
            WHEN cache IS NULL THEN concat_ws(chr(10), 'Content-Type: ' || old.content, 'Cache-Control: ' || old.cache)
            ELSE concat_ws(chr(10), 'Content-Type: ' || old.content, 'Cache-Control: ' || cache) END AS headers
FROM s
"""


@query("op1_revisit_resolution", REVISIT_SQL)
def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = spark.sql(CAPTURES.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))
    header = [F.struct(F.lit(name).alias("name"), F.col(column).alias("value")) for name, column in (("Content-Type", "content"), ("Cache-Control", "cache"))]
    records = captures.withColumn("headers", F.filter(F.array(*header), lambda h: h["value"].isNotNull()))
    found = resolve_revisits(records)
    return found.withColumn("headers", F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n"))


@query("op11_collision_neighbours")
def op11_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), queries=F.col("id") % 20 == 0, k=20)


def _cluster_sql(rounds: int, clusters: int, factor: int) -> str:
    near = "list_reduce(list_transform(range(1, 65), lambda i: (r.v[i] - c.v[i]) * (r.v[i] - c.v[i])), lambda a, b: a + b)"
    steps = [f"""kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""", f"""c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS k, v FROM kept WHERE vec_id IS NOT NULL
  ORDER BY k LIMIT {clusters})"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS (
  SELECT vec_id, v, min(struct_pack(d := d, k := k)) AS best
  FROM (SELECT r.rowid, r.vec_id, r.v, c.k, {near} AS d FROM (SELECT *, row_number() OVER () AS rowid FROM kept) r, c{n} c) GROUP BY rowid, vec_id, v)""")
        if n < rounds:
            mean = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
            steps.append(f"""c{n + 1} AS (
  SELECT c.k, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
    SELECT k, list(x ORDER BY i) AS v FROM (
      SELECT k, i, {mean} AS x FROM (SELECT best.k AS k, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{n}) GROUP BY k, i) GROUP BY k) m USING (k))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, best.k AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.k = best.k"""


@query("op12_subvector_clusters", _cluster_sql(rounds=3, clusters=16, factor=64))
def op12_subvector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), dims=64, clusters=16, rounds=3, factor=64)


@query("op13_bit_sliced_whitening")
def op13_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), most=8)
