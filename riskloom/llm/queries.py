"""Registered queries of the text operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosstok, decontam, katz, langid, linededup, pieces, quality, revisit, secrets, sharding, simhash, substring, vectorcodes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, counts=True).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_decontaminate(spark, sf_dir):
    return decontam.hit_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_katz(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.score(docs.withColumn("held_out", katz.held_out_of(F.col("doc_id"))))


def op5_sentencepiece(spark, sf_dir):
    return pieces.encode_report(table(spark, sf_dir, "documents"))


def op6_substring(spark, sf_dir):
    return substring.repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op7_revisits(spark, sf_dir):
    out = revisit.resolve(revisit.captures(table(spark, sf_dir, "pages")))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return out.withColumn("headers", listed).withColumn("status", F.col("status").cast("long"))


def op8_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op9_language_id(spark, sf_dir):
    docs = langid.split(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = langid.fit(docs.filter("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_secrets(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.known_findings())
    return found.withColumn("found_sha256", F.sha2("found", 256)).drop("found")


def op11_cross_tokenizer(spark, sf_dir):
    return crosstok.align_report(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark, sf_dir):
    coded, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    return vectorcodes.label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(vectorcodes.digest(books)).alias("codebooks_sha256"))


def op13_sharding(spark, sf_dir):
    dealt = sharding.assign(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_decontaminate": op2_decontaminate, "op3_simhash": op3_simhash,
           "op4_katz": op4_katz, "op5_sentencepiece": op5_sentencepiece, "op6_substring": op6_substring, "op7_revisits": op7_revisits, "op8_quality": op8_quality, "op9_language_id": op9_language_id, "op10_secrets": op10_secrets,
           "op11_cross_tokenizer": op11_cross_tokenizer, "op12_vector_codes": op12_vector_codes, "op13_sharding": op13_sharding}

SQL = {
    "op12_vector_codes": """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT vec_id, label, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS x FROM kept, range(16) AS t(p)),
c0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM part
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
a0 AS (
  SELECT vec_id, p, x, arg_min(e, d * 1000 + e) AS e FROM (
    SELECT part.vec_id, part.p, part.x, c.e, list_sum(list_transform(list_zip(part.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM part JOIN c0 c USING (p)) GROUP BY vec_id, p, x),
m0 AS (
  SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x FROM (
    SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a0) GROUP BY p, e, i) GROUP BY p, e),
c1 AS (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c0 c LEFT JOIN m0 m USING (p, e)),
a1 AS (
  SELECT vec_id, p, x, arg_min(e, d * 1000 + e) AS e FROM (
    SELECT part.vec_id, part.p, part.x, c.e, list_sum(list_transform(list_zip(part.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM part JOIN c1 c USING (p)) GROUP BY vec_id, p, x),
m1 AS (
  SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x FROM (
    SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a1) GROUP BY p, e, i) GROUP BY p, e),
c2 AS (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c1 c LEFT JOIN m1 m USING (p, e)),
last AS (
  SELECT vec_id, label, p, min(d * 1000 + e) AS k FROM (
    SELECT part.vec_id, part.label, part.p, c.e, list_sum(list_transform(list_zip(part.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM part JOIN c2 c USING (p)) GROUP BY vec_id, label, p),
rows AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', CAST(k % 1000 AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(k // 1000) AS BIGINT) AS error
  FROM last GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256
FROM rows""",
    "op13_sharding": """
WITH crc_table AS (
  WITH RECURSIVE r AS (
    SELECT k, 0 AS s, CAST(k AS BIGINT) AS c FROM range(256) AS t(k)
    UNION ALL SELECT k, s + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM r WHERE s < 8)
  SELECT list(c ORDER BY k) AS t FROM r WHERE s = 8),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS m, strlen(coalesce(text, '')) + 8 AS size FROM documents),
sums AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM d, crc_table),
run AS (
  SELECT doc_id, m, size, coalesce(sum(size) OVER (ORDER BY substr(m, 1, 15), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
    sum(size) OVER () AS total FROM d),
dealt AS (SELECT *, CAST((2 * b + size) * 24 // (2 * total) AS INTEGER) AS shard FROM run)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(m, 1, 15), doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt JOIN sums USING (doc_id)""",
    "op7_revisits": f"""
WITH raw AS ({revisit.CAPTURES.format(pages="pages")}),
cut AS (SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS v FROM raw),
split AS (
  SELECT *, lower(regexp_extract(v, '^([^/?]*)', 1)) AS host, regexp_replace(regexp_extract(v, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(v, '\\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS q FROM cut),
rec AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)$', ''), '^(www|m)\\.', '') || path
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS u FROM split),
pair AS (
  SELECT r.*, f.record_id AS response_id, f.etag AS f_etag, f.last_modified AS f_lm, f.digest AS f_digest, f.size AS f_size,
    row_number() OVER (PARTITION BY r.record_id ORDER BY f.seen_at DESC NULLS LAST, f.record_id DESC NULLS LAST) AS k
  FROM rec r LEFT JOIN rec f ON f.u = r.u AND f.type = 'response' AND f.status = 200 AND (f.seen_at, f.record_id) < (r.seen_at, r.record_id)
  WHERE r.type = 'revisit'),
judged AS (
  SELECT *, CASE WHEN etag IS NOT NULL AND f_etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = regexp_replace(f_etag, '^W/', '')
      WHEN last_modified IS NOT NULL AND f_lm IS NOT NULL THEN last_modified = f_lm
      WHEN digest IS NOT NULL AND f_digest IS NOT NULL THEN digest = f_digest END AS same
  FROM pair WHERE k = 1),
named AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no earlier response' WHEN same IS NULL THEN 'unvalidated'
    WHEN same THEN 'resolved' ELSE 'changed' END AS outcome FROM judged)
SELECT record_id, u AS canonical_url, outcome, response_id, CAST(CASE WHEN outcome = 'resolved' THEN 200 END AS BIGINT) AS status,
  CASE WHEN outcome = 'resolved' THEN f_digest END AS digest,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: ' || cache || '; content-length: ' || f_size || '; date: ' || CAST(seen_at AS VARCHAR)
    || CASE WHEN coalesce(etag, f_etag) IS NOT NULL THEN '; etag: ' || coalesce(etag, f_etag) ELSE '' END END AS headers
FROM named""",
    "op6_substring": f"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p, p + 19), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM dw WHERE len(w) >= 20)),
late AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM late),
one AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM dw),
kept AS (
  SELECT one.doc_id, string_agg(x, ' ' ORDER BY q) FILTER (WHERE gone.q IS NULL) AS s, count(gone.q) AS n
  FROM one LEFT JOIN gone USING (doc_id, q) GROUP BY one.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id)""",
    "op1_line_dedup": f"""
WITH raw AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM raw),
keyed AS (
  SELECT *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT a.doc_id, a.line, a.pos, b.k IS NOT NULL AND a.doc_id <> b.keeper AS gone FROM keyed a LEFT JOIN shared b ON a.k = b.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op2_decontaminate": f"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (
  SELECT doc_id, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, sizes WHERE len(w) >= k)),
hit AS (SELECT doc_id, p, grams.k, item_id FROM grams JOIN win ON grams.g = win.g AND grams.k = win.k),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
