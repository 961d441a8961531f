"""A file inventory derived from the ``documents`` table: paths, copies, attributes and times from doc_id and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syncsift.schema import RESERVED

ROOT = "/data"
#: A window small enough that short documents exercise it.
WINDOW = 64
SUFFIXES = ("", " (1)", " (2)", " (conflicted copy)", "-DESKTOP-ABC123", ".sb-a1b2c3", "")


def _pick(n: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document, with content and text. A changed byte outside or inside the first window makes some copies diverge."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    i, raw = F.col("doc_id"), F.encode("text", "UTF-8")
    d = d.withColumn("raw", raw)
    changed = F.concat(F.substring("raw", 1, 199), F.lit("#").cast("binary"), F.expr("substring(raw, 201)"))
    early = F.concat(F.substring("raw", 1, 9), F.lit("@").cast("binary"), F.expr("substring(raw, 11)"))
    name = F.concat(F.lit("doc_"), F.substring(F.md5(F.substring("text", 1, 16).cast("binary")), 1, 8), _pick(i, SUFFIXES), F.lit(".txt"))
    deep = F.when(i % 31 == 3, F.repeat(F.lit("d/"), 17)).otherwise("")
    top = F.when(i % 29 == 7, F.lit(f"{RESERVED}/")).otherwise("")
    bits = sum((F.when(i % k == 1, F.lit(b)).otherwise(0) for k, b in ((11, 0x1000), (13, 0x40000), (17, 0x400000), (19, 0x400))), F.lit(0))
    return d.select(
        "doc_id",
        F.concat(F.lit(f"{ROOT}/"), top, "source", F.lit("/"), "lang", F.lit("/"), deep, i.cast("string"), F.lit("/"), name).alias("path"),
        F.octet_length("raw").cast("long").alias("size"),
        (F.lit(638_000_000_000_000_000) + (i * 7919 % 1000) * 600_000_000 + i % 10 * 10_000).cast("long").alias("mtime_ticks"),
        bits.cast("int").alias("attributes"),
        F.concat(F.lit("vol"), (i % 3).cast("string")).alias("volume_id"),
        F.when(i % 23 == 5, i - 3).otherwise(i).cast("string").alias("file_id"),
        F.when(i % 37 == 2, "offline").cast("string").alias("placeholder_kind"),
        (i % 19 == 1).alias("is_reparse_point"),
        F.when((i % 8 == 3) & (F.octet_length("raw") > 20), early).when((i % 3 == 0) & (F.octet_length("raw") > 400), changed).otherwise(F.col("raw")).alias("content"),
        "text",
    )


#: The same in DuckDB, as the view that the other statements begin with.
SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, encode(coalesce(text, '')) AS raw FROM documents),
inv AS (SELECT doc_id,
  '{ROOT}/' || CASE WHEN doc_id % 29 = 7 THEN '{RESERVED}/' ELSE '' END || source || '/' || lang || '/' || CASE WHEN doc_id % 31 = 3 THEN repeat('d/', 17) ELSE '' END
    || doc_id || '/doc_' || substr(md5(substr(text, 1, 16)), 1, 8) || ['', ' (1)', ' (2)', ' (conflicted copy)', '-DESKTOP-ABC123', '.sb-a1b2c3', ''][doc_id % 7 + 1] || '.txt' AS path,
  octet_length(raw)::BIGINT AS size,
  (638000000000000000 + (doc_id * 7919 % 1000) * 600000000 + doc_id % 10 * 10000)::BIGINT AS mtime_ticks,
  ((doc_id % 11 = 1)::INT * 4096 + (doc_id % 13 = 1)::INT * 262144 + (doc_id % 17 = 1)::INT * 4194304 + (doc_id % 19 = 1)::INT * 1024)::INT AS attributes,
  'vol' || doc_id % 3 AS volume_id,
  (CASE WHEN doc_id % 23 = 5 THEN doc_id - 3 ELSE doc_id END)::VARCHAR AS file_id,
  CASE WHEN doc_id % 37 = 2 THEN 'offline' END AS placeholder_kind,
  doc_id % 19 = 1 AS is_reparse_point,
  CASE WHEN doc_id % 8 = 3 AND octet_length(raw) > 20 THEN raw[1:9] || '@'::BLOB || raw[11:] WHEN doc_id % 3 = 0 AND octet_length(raw) > 400 THEN raw[1:199] || '#'::BLOB || raw[201:] ELSE raw END AS content, text
  FROM docs),
marked AS (SELECT *, parse_filename(path) AS name, starts_with(path, '{ROOT}/{RESERVED}/') AS excluded,
  coalesce(placeholder_kind, CASE WHEN attributes & 4096 <> 0 THEN 'offline' WHEN attributes & 262144 <> 0 THEN 'recall_on_open'
    WHEN attributes & 4194304 <> 0 THEN 'recall_on_data_access' WHEN attributes & 1024 <> 0 THEN 'reparse_point' END) AS kind,
  len(string_split(substr(path, {len(ROOT) + 2}), '/')) AS depth FROM inv),
judged AS (SELECT *, CASE WHEN excluded THEN 'excluded' WHEN row_number() OVER (PARTITION BY volume_id, file_id ORDER BY excluded, path) > 1 THEN 'repeated'
  WHEN depth > 16 THEN 'too_deep' ELSE 'kept' END AS fate FROM marked),
files AS (SELECT *, kind IS NOT NULL AS is_placeholder,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, ' \\(conflicted copy\\)(\\.[^.]*)$', '\\1'), '-DESKTOP-[0-9A-Za-z]{{6,12}}(\\.[^.]*)$', '\\1'),
    ' \\(1\\)(\\.[^.]*)$', '\\1'), ' \\(2\\)(\\.[^.]*)$', '\\1'), '\\.sb-[0-9a-f]{{1,32}}(\\.[^.]*)$', '\\1') AS base FROM judged WHERE fate = 'kept'),
readable AS (SELECT * FROM files WHERE NOT is_placeholder),
grouped AS (SELECT *, count(*) OVER (PARTITION BY base, size) AS group_members FROM readable),
members AS (SELECT *, sha256(CASE WHEN size <= {2 * WINDOW} THEN content ELSE content[1:{WINDOW}] || content[size - {WINDOW - 1}:] END) AS partial, sha256(content) AS full_hash,
  CASE WHEN doc_id % 17 = 4 THEN 'simulated' END AS error FROM grouped WHERE group_members >= 2),
verdicts AS (SELECT base, size, count(*)::BIGINT AS members, CASE WHEN count(error) > 0 THEN 'unresolved' WHEN count(DISTINCT partial) = count(*) THEN 'eliminated_l2'
  WHEN count(DISTINCT full_hash) = 1 THEN 'identical_duplicate' ELSE 'real_conflict' END AS verdict, min(full_hash) AS least FROM members GROUP BY base, size),
decided AS (SELECT m.*, v.verdict FROM members m JOIN verdicts v USING (base, size))
"""
