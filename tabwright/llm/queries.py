"""The registered query of each operator, with production parameters, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import (
    classifier, fim, fingerprints, html_text, mixing, near_dup, packing, quality_rules, repeats, sharding, spelling, token_counts, warc,
)
from tabwright.llm.common import table


def op1_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op2_imatch(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, folder, "documents"))


def op3_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(table(spark, folder, "documents"))


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(table(spark, folder, "pages"))


def op5_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.kd_shards(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_compression(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return classifier.scored(documents, classifier.fit(documents, table(spark, folder, "labels")))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read_archives(spark, warc.write_archives(table(spark, folder, "pages")))


def op8_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.removed(table(spark, folder, "documents")).drop("starts")


def op9_setsketch(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"), size=4)


def op10_entropy_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.entropy_balance(table(spark, folder, "documents"))
    return mixed.withColumn("taken", F.col("copies") * F.col("size"))


def op11_fim(spark: SparkSession, folder: str) -> DataFrame:
    moved = fim.restored(fim.transformed(table(spark, folder, "documents")))
    digests = [F.sha2(F.encode(c, "UTF-8"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, folder, "documents"))


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


QUERIES: dict[str, Callable] = {
    "op1_pack": op1_pack,
    "op2_imatch": op2_imatch,
    "op3_host_rules": op3_host_rules,
    "op4_html_text": op4_html_text,
    "op5_kd_shards": op5_kd_shards,
    "op6_compression": op6_compression,
    "op7_warc": op7_warc,
    "op8_repeats": op8_repeats,
    "op9_setsketch": op9_setsketch,
    "op10_entropy_mix": op10_entropy_mix,
    "op11_fim": op11_fim,
    "op12_spelling": op12_spelling,
    "op13_token_counts": op13_token_counts,
}

WORDS = r"[^\x20\x09-\x0D]+"

OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS i FROM again) GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS l FROM d
), counts AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), rules AS (
  SELECT *, n_words < 10 AS few_words, n_repeat_words * 100 > n_words * 20 AS repeats, n_symbols > word_chars * 0.1 AS symbols,
    n_dup_lines > n_lines * 0.5 AS dup_lines, word_chars < n_words * 2 OR word_chars > n_words * 15 AS word_length
  FROM counts
), flagged AS (
  SELECT *, few_words OR repeats AS base_failed, symbols OR dup_lines OR word_length AS strict_failed FROM rules
), hosts AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed OR strict_failed) AS DOUBLE) AS f FROM flagged GROUP BY source
), moments AS (
  SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS square, count(*) / sum(n) AS sampling FROM hosts
), prior AS (
  SELECT mean, greatest(mean * (1 - mean) / greatest(square - mean * mean - mean * (1 - mean) * sampling, mean * (1 - mean) * 1e-6, 1e-12) - 1, 0) AS strength
  FROM moments
), rates AS (
  SELECT source, n, mean, strength, (f + mean * strength) / (n + strength) AS rate FROM hosts, prior
), judged AS (
  SELECT source, rate - 1.645::DOUBLE * sqrt(rate * (1 - rate) / (n + strength + 1)) > mean + 0.1::DOUBLE AS host_bad FROM rates
)
SELECT flagged.*, host_bad, NOT base_failed AND NOT (host_bad AND strict_failed) AS kept
FROM flagged JOIN judged ON flagged.source IS NOT DISTINCT FROM judged.source
"""

OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), l AS (
  SELECT *, max(CASE WHEN payload_bytes >= 1000 THEN page_id END) OVER (PARTITION BY payload_digest) AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM l
"""

OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), again AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept_text, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept_text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP9_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 3], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), c AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents
), drawn AS (
  SELECT *, CAST(len(l) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(l) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(l) + 1) AS c2,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS c3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS c4
  FROM d
), parts AS (
  SELECT *, array_to_string(l[1:least(c1, c2)], '') AS p, array_to_string(l[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
    array_to_string(l[greatest(c1, c2) + 1:], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 100 THEN 'plain' WHEN c4 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

OP12_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT range AS i, 0 AS k, CAST(range AS UBIGINT) AS c FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents)
), counted AS (
  SELECT doc_id, r, count(*) AS n, hex(encode(doc_id || ':' || r)) AS x FROM runs GROUP BY doc_id, r
), summed AS (
  SELECT doc_id, r, n, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(0, len(x) // 2), lambda b: CAST('0x' || x[2 * b + 1 : 2 * b + 2] AS UBIGINT))),
    lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1]))) AS h
  FROM counted, crc
), made AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN r[1 : CAST(h % length(r) AS BIGINT)] || r[CAST(h % length(r) AS BIGINT) + 2 :] ELSE r END AS word FROM summed
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), without AS (
  SELECT word, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)
), pairs AS (
  SELECT a.word, b.word AS near FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT a.word, w.word FROM without a JOIN w ON a.rest = w.word
  UNION
  SELECT w.word, a.word FROM without a JOIN w ON a.rest = w.word
), best AS (
  SELECT p.word, count(*) AS n_near, min({'less': -o.n, 'form': p.near}) AS b FROM pairs p JOIN w o ON o.word = p.near GROUP BY p.word
), told AS (
  SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN -b.less >= 5 * w.n THEN b.form END AS form,
    CASE WHEN -b.less >= 5 * w.n THEN -b.less END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word
), chain AS (
  SELECT word, word AS here FROM told
  UNION ALL
  SELECT chain.word, told.form FROM chain JOIN told ON told.word = chain.here WHERE told.form IS NOT NULL
)
SELECT told.word, form, here AS root, n, n_near, form_n
FROM told JOIN chain ON chain.word = told.word JOIN (SELECT word AS last FROM told WHERE form IS NULL) ON last = here
"""

ORACLES: dict[str, str] = {
    "op3_host_rules": OP3_SQL, "op7_warc": OP7_SQL, "op8_repeats": OP8_SQL, "op9_setsketch": OP9_SQL, "op11_fim": OP11_SQL, "op12_spelling": OP12_SQL,
}
