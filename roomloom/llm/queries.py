"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, leaks, neardup, packing, pii, quality, repeats, sharding, tokenfile, toxicity, urlrules, warc, whitening
from .common import shared_folder, small_arrow_batches

Query = Callable[[SparkSession, str], DataFrame]

#: The rules of the url query, as (action, host, path).
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_arrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    read = tokenfile.read_tokens(spark, path)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(pii.count_of(F.col("pii"), k).alias(f"n_{k}") for k in pii.BASE_KINDS),
        F.sha2(pii.span_list(F.col("pii"), pii.BASE_KINDS), 256).alias("base_sha256"),
        pii.span_list(F.col("pii")).alias("spans"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), size=50)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)
    return white.select(
        F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error"
    )


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(toxicity.fold_of("id") == 0, F.lit(False))
    return scored.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", "predicted", "matches")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)
    digest = centroids.centroid_digest(F.col("centroid")).alias("centroid_sha256")
    return placed.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest)


QUERIES: dict[str, Query] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_file": op6_token_file,
    "op7_sharding": op7_sharding,
    "op8_pii": op8_pii,
    "op9_url_filter": op9_url_filter,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_whitening": op11_whitening,
    "op12_toxicity": op12_toxicity,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op9_url_filter"] = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(action, r_host, r_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
judged AS (
  SELECT p.*, (SELECT r_host || r_path || ' ' || action FROM rules
               WHERE (p.host = r_host OR p.host LIKE '%.' || r_host) AND starts_with(p.path, r_path)
               ORDER BY length(r_host) DESC, length(r_path) DESC LIMIT 1) AS won
  FROM parts p)
SELECT page_id, host, path, split_part(won, ' ', 1) AS rule,
       CASE WHEN won IS NULL THEN 'allow' ELSE split_part(won, ' ', 2) END AS verdict
FROM judged
"""

ORACLE_SQL["op5_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 6),
win AS (SELECT r, i, w[i:i+4] AS five FROM g),
twice AS (SELECT r, five FROM win GROUP BY r, five HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT k) AS n
            FROM (SELECT win.r, unnest(range(i, i + 5)) AS k FROM win JOIN twice USING (r, five)) GROUP BY r),
base AS (
  SELECT d.r, d.doc_id, d.source, d.text, len(w.w) AS n_words,
         length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(c.n, 0) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN covered c USING (r)),
lines AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT r, source, text, line, regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') <> '' AS has_word,
              trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
              len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
       FROM lines),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw WHERE has_word GROUP BY r),
hosts AS (SELECT source, count(*) AS n_docs FROM d GROUP BY source),
common AS (SELECT l.source, l.norm FROM (SELECT source, norm, count(DISTINCT text) AS n_texts, count(DISTINCT r) AS n FROM lw WHERE norm <> '' GROUP BY source, norm) l
           JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE l.n_texts >= 10 AND l.n >= 10 AND (l.n > 0.05 * h.n_docs OR l.n >= 50)),
gone AS (SELECT lw.r, sum(lw.n) AS n FROM lw JOIN common c ON lw.source IS NOT DISTINCT FROM c.source AND lw.norm = c.norm GROUP BY lw.r),
judged AS (
  SELECT b.*, coalesce(dup.n_dup_lines, 0) AS n_dup_lines, b.n_words - coalesce(gone.n, 0) AS n_left,
         b.n_words < 10 OR 100 * n_repeat_words > 20 * b.n_words AS base_failed
  FROM base b LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, cast(n_words AS BIGINT) AS n_words, cast(word_chars AS BIGINT) AS word_chars, cast(n_symbols AS BIGINT) AS n_symbols,
       cast(n_dup_lines AS BIGINT) AS n_dup_lines, cast(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_left < n_words AND (n_left < 10 OR n_left < 0.3 * n_words)) AS kept
FROM judged
"""

ORACLE_SQL["op4_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, html, octet_length(encode(html)) AS n FROM p),
g AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS largest FROM q)
SELECT page_id, cast(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < largest THEN largest END AS refers_to
FROM g
"""

ORACLE_SQL["op1_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _centroid_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round as two tables: the nearest centroid of each vector, then the centroids' means."""
    steps = [f"""x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: cast(floor(1024 * cast(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('3:', vec_id)), x) - 1 AS j, x AS c FROM x
  WHERE vec_id IS NOT NULL ORDER BY sha256(concat('3:', vec_id)), x LIMIT {k})"""]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT vec_id, x, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
  SELECT vec_id, x, j, cast(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM x, c{t}) GROUP BY vec_id, x)""")
        steps.append(f"""m{t} AS MATERIALIZED (SELECT j, list(cast((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
  SELECT j, i, cast(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{t}, range(1, 65) r(i) GROUP BY j, i) GROUP BY j),
c{t + 1} AS MATERIALIZED (SELECT j, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (j))""")
    return f"""WITH {', '.join(steps[:-1])}
SELECT vec_id, cast(j AS INT) AS cluster, d AS distance, cast(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
       cast(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (j)"""


ORACLE_SQL["op13_centroids"] = _centroid_sql()
