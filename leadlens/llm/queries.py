"""One registered query per training-data operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.llm import clusters, language, neardup, pieces, quality, spelling, suffixes, templates, tokencount, topk, toxicity, urls, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("vec"))
    return topk.top_k(rows, F.col("vec_id") % 20 == 0, k=20)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_report(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_report(_read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_read(spark, sf_dir, "pages"))
    return warc.read_records(index).select(
        F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leak_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_tokens(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(_read(spark, sf_dir, "pages"), rules)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(_read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"), least_length=7, least_count=2, one_in=31, ratio=10)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_report(_read(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, salt="3")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_topk, op2_sentencepiece, op3_suffix_dedup, op4_warc, op5_decontam, op6_quality, op7_token_counts,
                          op8_url_filter, op9_toxicity, op10_near_dedup,
                          op11_language_id, op12_spelling_variants, op13_centroid_clusters)
}



def _cluster_rounds(rounds: int = 10) -> str:
    """Lloyd's rounds in long form, (row, i, x) against (c, i, x), one pair of tables a round."""
    ctes = []
    for r in range(rounds + 1):
        ctes.append(f"""
near{r} AS MATERIALIZED (
  SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT v.row, k.c, sum((v.x - k.x) * (v.x - k.x)) AS d FROM comps v JOIN cent{r} k ON v.i = k.i GROUP BY 1, 2) GROUP BY row)""")
        if r < rounds:
            ctes.append(f"""
cent{r + 1} AS MATERIALIZED (
  SELECT k.c, k.i, coalesce(m.x, k.x) AS x
  FROM cent{r} k LEFT JOIN (SELECT c, i, (s - ((s % n) + n) % n) // n AS x
                            FROM (SELECT a.c, v.i, sum(v.x) AS s, count(*) AS n FROM near{r} a JOIN comps v ON a.row = v.row GROUP BY 1, 2)) m
    ON m.c = k.c AND m.i = k.i)""")
    return ",".join(ctes)


ORACLE: dict[str, str] = {
    "op12_spelling_variants": r"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
        FROM range(256) r(i))),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n, list_transform(string_split(run, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS points
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT run, n, xor(list_reduce(
           list_concat([CAST(4294967295 AS BIGINT)],
                       list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':', ''), lambda c: CAST(unicode(c) AS BIGINT)),
                       flatten(list_transform(points, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + u // 64, 128 + u % 64] END))),
           lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h
  FROM runs, crc_table),
words AS MATERIALIZED (
  SELECT w, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
                    ELSE run END AS w, n FROM hashed)
  WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
-- words that lose one letter: the same place and rest is a replacement, a whole other word an insertion
cuts AS MATERIALIZED (
  SELECT w, i, substr(w, 1, i - 1) || substr(w, i + 1) AS rest FROM (SELECT w, CAST(unnest(range(1, length(w) + 1)) AS INTEGER) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.w AS x, b.w AS y FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.w <> b.w
  UNION SELECT c.w, s.w FROM cuts c JOIN words s ON c.rest = s.w
  UNION SELECT s.w, c.w FROM cuts c JOIN words s ON c.rest = s.w),
ranked AS (
  SELECT x, y, o.n, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY o.n DESC, encode(y)) AS place
  FROM near JOIN words o ON o.w = near.y),
forms AS MATERIALIZED (
  SELECT w.w AS word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN r.y END AS form,
         CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.x = w.w AND r.place = 1),
chain AS (
  SELECT word, word AS reached, 0 AS step FROM forms
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON c.reached = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY word) e ON e.word = f.word""",
    "op13_centroid_clusters": f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comps AS MATERIALIZED (SELECT row, unnest(range(1, 65)) AS i, unnest(v) AS x FROM kept),
seeds AS (
  SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), vec_id, v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL),
cent0 AS MATERIALIZED (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM seeds WHERE c < 8),{_cluster_rounds()},
spread AS (SELECT c, sum(d) AS s FROM near10 GROUP BY c),
digests AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM cent10 GROUP BY c)
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(p.s AS BIGINT) AS cluster_inertia,
       CAST((SELECT sum(s) FROM spread) AS BIGINT) AS inertia, g.h AS centroid_sha256
FROM kept k JOIN near10 a ON a.row = k.row JOIN spread p ON p.c = a.c JOIN digests g ON g.c = a.c""",
    "op1_topk": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, least(len(q.vec), len(c.vec)) + 1), lambda i: q.vec[i] * c.vec[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op4_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS keeper FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN k.keeper IS NULL OR k.keeper = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k.keeper <> d.page_id THEN k.keeper END AS refers_to
FROM d LEFT JOIN k ON d.digest = k.digest""",
    "op8_url_filter": """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                            ('org', '/fr/', 'allow')) t(rhost, rpath, verdict)),
m AS (
  SELECT h.page_id, h.host, h.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rhost || r.rpath) DESC) AS n
  FROM h JOIN r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath))
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.n = 1""",
    "op10_near_dedup": r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON x = p.r JOIN sizes q ON y = q.r WHERE 100 * c >= 75 * (p.n + q.n - c)
          UNION ALL SELECT a.r, b.r FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.r < b.r AND len(a.w) > 0 AND len(b.w) > 0),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM ends UNION SELECT r.x, e.y FROM reach r JOIN ends e ON r.y = e.x),
least_of AS (SELECT x, min(d.doc_id) AS m FROM reach JOIN words d ON d.r = y GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM words d LEFT JOIN sizes s ON d.r = s.r LEFT JOIN least_of l ON d.r = l.x""",
}
