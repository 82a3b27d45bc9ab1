"""The registered queries opN_<name>: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakemart.llm import (
    centroid_clustering, divergence_audit, embedding_near_dedup, language_id, line_dedup, mixing, packing, pii, shard_shuffle, simhash_near_dedup, substring_dedup, topk_search, warc,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


#: Shares of tokens that op8_mixing aims at.
TARGETS = {"good": 0.7, "plain": 0.25, "toxic": 0.05}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.quality_domains(table(spark, sf_dir, "labels")), TARGETS)


def op9_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_shuffle.shuffle_into_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_dictionary, op2_line_dedup, op3_language_id, op4_topk_search, op5_embedding_near_dedup,
        op6_pii, op7_packing, op8_mixing, op9_shard_shuffle, op10_simhash_near_dedup,
        op11_source_divergence, op12_centroid_clustering, op13_substring_dedup,
    )
}

def clustering_sql(k: int = 16, rounds: int = 3) -> str:
    """The assignments of all rounds, one after the other."""
    steps = [f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k, x FROM v QUALIFY k < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
  SELECT v.vec_id, v.x, min({k} * list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT + c.k) AS code
  FROM v, c{r} c GROUP BY v.vec_id, v.x)""")
        if r < rounds:
            steps.append(f"""s{r} AS (
  SELECT k, i, sum(y) AS s, count(*) AS n FROM (SELECT code % {k} AS k, unnest(range(1, 65)) AS i, unnest(x) AS y FROM a{r}) GROUP BY k, i),
c{r + 1} AS (
  SELECT c.k, coalesce(m.x, c.x) AS x
  FROM c{r} c LEFT JOIN (SELECT k, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY k) m ON c.k = m.k)""")
    return ",\n".join(steps) + f"""
SELECT a.vec_id, c.k::INT AS cluster, (a.code // {k})::BIGINT AS distance, (sum(a.code // {k}) OVER (PARTITION BY c.k))::BIGINT AS cluster_inertia,
  (sum(a.code // {k}) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.code % {k}"""


ORACLES = {
    "op1_warc_dictionary": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f""",
    "op2_line_dedup": r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
word AS (
  SELECT doc_id, number, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\x0B\x0C]+'), lambda w: w <> '') AS words
  FROM line),
occ AS (SELECT doc_id, number, words, row_number() OVER (ORDER BY doc_id, number) AS place FROM word WHERE len(words) >= 1),
d AS (SELECT words, min(place) AS place FROM occ GROUP BY words),
l AS (SELECT * FROM d WHERE len(words) >= 5),
v AS (SELECT words, place, k, list_concat(words[:k - 1], words[k + 1:]) AS rest FROM (SELECT words, place, unnest(range(1, len(words) + 1)) AS k FROM l)),
by_place AS (SELECT rest, k, min(place) AS place FROM v GROUP BY ALL),
by_rest AS (SELECT rest, min(place) AS place FROM v GROUP BY rest),
near AS (
  SELECT v.words FROM v JOIN by_place b ON v.rest = b.rest AND v.k = b.k WHERE b.place < v.place
  UNION SELECT v.words FROM v JOIN l ON v.rest = l.words WHERE l.place < v.place
  UNION SELECT l.words FROM l JOIN by_rest b ON b.rest = l.words WHERE b.place < l.place),
gone AS (
  SELECT occ.doc_id, count(*) AS n, string_agg(occ.number::VARCHAR, ',' ORDER BY occ.number) AS dropped
  FROM occ JOIN d ON occ.words = d.words LEFT JOIN near ON occ.words = near.words
  WHERE near.words IS NOT NULL OR occ.place > d.place GROUP BY occ.doc_id)
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN 0 ELSE len(string_split(t.text, chr(10))) END::BIGINT AS n_lines,
  coalesce(gone.n, 0)::BIGINT AS n_dropped, coalesce(gone.dropped, '') AS dropped
FROM documents t LEFT JOIN gone ON t.doc_id = gone.doc_id""",
    "op4_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10""",
    "op5_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (coalesce(n.total, 0) + l.v) AS p,
    1 + (1000000000 * (k.lang_n + 1)::HUGEINT) // (l.total + l.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
  UNION ALL SELECT a.lang, a.source, b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM l)),
both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op12_centroid_clustering": clustering_sql(),
    "op13_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, unnest(list_transform(range(1, len(w) - 18), lambda s: array_to_string(w[s:s + 19], ' '))) AS x
  FROM d WHERE len(w) >= 20),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS place FROM h) WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS k FROM later),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
rest AS (
  SELECT word.doc_id, count(gone.k) AS n, string_agg(word, ' ' ORDER BY word.k) FILTER (gone.k IS NULL) AS text
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.k = word.k GROUP BY word.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(rest.n, 0)::BIGINT AS n_removed, sha256(coalesce(rest.text, '')) AS kept_sha256
FROM d LEFT JOIN rest ON rest.doc_id = d.doc_id""",
}
