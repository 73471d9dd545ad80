"""The queries of this subpackage: one opN_<name> for each operator, over the whole of its table."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, centroids, decontaminate, fill_middle, fingerprint, language_id, mixing, near_dedup, quality, suffix_dedup, token_counts, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    learned = language_id.learn(docs.where(~held_out))
    return language_id.identify(docs, learned, "text", "doc_id", held_out.alias("held_out"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))[0]


#: Verdict, host and path prefix: fixed values.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=[1, 2, 3], most=3)
    taken = F.col("copies") * F.col("size") + F.coalesce(mixing.words(F.col("part")), F.lit(0))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"), fill_middle.GRAMMARS["letter runs"])
    back = fill_middle.restored(F.col("output"), F.col("form"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return cut.select(F.col("id").alias("doc_id"), "n", "form", F.length("prefix").cast("bigint").alias("prefix_chars"), F.length("middle").cast("bigint").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, centers, _ = centroids.cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, width=64, scale=64)
    near = near.withColumnRenamed("id", "vec_id")
    sums = near.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row a centroid
    told = [(r.cluster, r.cluster_inertia, sum(x.cluster_inertia for x in sums), hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest()) for r in sums]
    return near.join(F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")), "cluster")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_bpe, op3_suffix_dedup, op4_near_dedup, op5_warc, op6_decontaminate, op7_fingerprint, op8_quality, op9_url_filter, op10_token_counts, op11_mixing, op12_fill_middle, op13_centroids)}

#: 100-byte windows as hexadecimal digits; a window that also starts earlier covers its bytes; islands of covered bytes.
_OP3 = """
WITH raw AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM raw),
windows AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS w FROM starts),
firsts AS (SELECT w, min((doc_id, p)) AS f FROM windows GROUP BY w HAVING count(*) > 1),
later AS (SELECT x.doc_id, x.p FROM windows x JOIN firsts USING (w) WHERE (x.doc_id, x.p) > firsts.f),
marked AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM later),
numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS (SELECT doc_id, run, min(p) AS s, max(p) + 100 AS e FROM numbered GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM spans
  UNION ALL SELECT raw.doc_id, coalesce(max(e), 0), any_value(length(h)) // 2 FROM raw LEFT JOIN spans USING (doc_id) GROUP BY raw.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM pieces JOIN raw USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST((length(h) - length(k)) // 2 AS BIGINT) AS n_removed,
  (SELECT count(*) FROM spans WHERE spans.doc_id = raw.doc_id) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM raw JOIN kept USING (doc_id)
"""

_OP4 = """
WITH RECURSIVE lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM lowered),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM sets),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n, y.n AS m, count(*) AS c FROM each x JOIN each y ON x.v = y.v AND x.doc_id < y.doc_id
  AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (n + m - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT edges.b, reach.c FROM reach JOIN edges ON reach.doc_id = edges.a AND reach.c < edges.b),
least_ AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_ USING (doc_id)
"""

_OP5 = """
WITH raw AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
led AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS lead FROM raw)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM led
"""

#: 60 bits of a hash order a source's documents; the level of targets is the first that a source's bound allows.
_OP11 = """
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS HUGEINT) AS size,
  CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, sum(size) AS size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
steps AS (SELECT source, size, w, 3 * size * (6 // w) AS ratio, sum(size) OVER () AS total, sum(w) OVER () AS all_w FROM s),
levels AS (SELECT *, total - coalesce(sum(3 * size) OVER before, 0) AS rest, all_w - coalesce(sum(w) OVER before, 0) AS rest_w FROM steps
  WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest, rest_w FROM levels WHERE rest * w <= 3 * size * rest_w ORDER BY rest_w DESC LIMIT 1),
goals AS (SELECT source, size AS source_size, CASE WHEN w * rest <= 3 * size * rest_w THEN CAST(w * rest AS DOUBLE) / CAST(rest_w AS DOUBLE) ELSE CAST(3 * size AS DOUBLE) END AS target,
  CASE WHEN w * rest <= 3 * size * rest_w THEN (2 * w * rest + rest_w) // (2 * rest_w) ELSE 3 * size END AS budget FROM s CROSS JOIN level),
placed AS (SELECT d.*, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END AS passes, CASE WHEN source_size = 0 THEN 0 ELSE budget % source_size END AS rest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN goals ON d.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM placed
"""

_OP12 = """
WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN coalesce(text, '') = '' THEN [] ELSE regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') END AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT)) AS r FROM cut),
placed AS (SELECT doc_id, t, u, n, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

#: One round of plain assignment to the nearest centroid and exact means, three times over, and a last assignment.
_ROUND = """
near{i} AS (SELECT vec_id, v, min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))), j := j)) AS best FROM kept CROSS JOIN c{i} GROUP BY vec_id, v),
means{i} AS (SELECT best.j AS j, i, CAST(sum(v[i]) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM near{i} CROSS JOIN range(1, 65) AS t(i) GROUP BY ALL),
c{k} AS (SELECT c{i}.j AS j, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM means{i} GROUP BY j) AS m USING (j)),
"""
_OP13 = """
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT 16)),
""" + "".join(_ROUND.format(i=i, k=i + 1) for i in range(3)) + """
last AS (SELECT vec_id, v, min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))), j := j)) AS best FROM kept CROSS JOIN c3 GROUP BY vec_id, v)
SELECT vec_id, CAST(best.j AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM last JOIN c3 ON c3.j = best.j
"""

#: SQL expresses neither the other methods' models and samples nor the byte-pair merges; tests hold them against brute force.
ORACLES: dict[str, str] = {"op3_suffix_dedup": _OP3, "op4_near_dedup": _OP4, "op5_warc": _OP5, "op11_mixing": _OP11, "op12_fill_middle": _OP12, "op13_centroids": _OP13}
