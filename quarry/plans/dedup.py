"""Queries of the duplicate planner over the documents as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import dedup as D
from quarry.plans.registry import query
from quarry.sources.tables import files_of, keyset_page, table

FILES = """
files AS (
  SELECT '/' || source || '/doc_' || CAST(doc_id AS VARCHAR)
         || CASE WHEN doc_id % 5 = 0 THEN ' (1)' WHEN doc_id % 7 = 0 THEN '_copy' ELSE '' END || '.txt' AS path,
         1 AS volume_id, doc_id AS file_id, n_chars AS size, doc_id * 1000 AS mtime_ns, text AS content
  FROM documents
)"""
RANKED = (
    FILES
    + """,
ranked AS (
  SELECT *, CASE WHEN file_id IN (3, 50) THEN 0 ELSE 1 END AS r_explicit,
         CASE WHEN starts_with(path, '/src3/') THEN 0 WHEN starts_with(path, '/src1/') THEN 1 ELSE 2 END AS r_location,
         CASE WHEN file_id IN (10, 60, 70) THEN 0 ELSE 1 END AS r_verified,
         CASE WHEN file_id % 5 = 0 OR file_id % 7 = 0 THEN 1 ELSE 0 END AS r_copy,
         lpad(lower(to_hex(volume_id)), 32, '0') || ':' || lpad(lower(to_hex(file_id)), 32, '0') AS r_identity
  FROM files WHERE size > 0
),
members AS (
  SELECT *, count(*) OVER (PARTITION BY content) AS members,
         row_number() OVER (PARTITION BY content ORDER BY r_explicit, r_location, r_verified, r_copy, r_identity, path) - 1 AS member_order
  FROM ranked
),
dup AS (SELECT *, sha256(content) AS sha256 FROM members WHERE members > 1)"""
)


def files(spark: SparkSession, sf: str) -> DataFrame:
    return files_of(table(spark, sf, "documents"))


def members(spark: SparkSession, sf: str) -> DataFrame:
    ranked = D.keeper_ranks(files(spark, sf), preferred=["/src3", "/src1"], explicit=[3, 50], verified=[10, 60, 70])
    return D.duplicate_members(ranked)


@query(
    f"""WITH {RANKED}
SELECT sha256, size, max(CASE WHEN member_order = 0 THEN path END) AS keep_path, count(*) - 1 AS redundant_count,
       size * (count(*) - 1) AS reclaimable_bytes, CAST(NULL AS BIGINT) AS physical_reclaimable_bytes
FROM dup GROUP BY sha256, size"""
)
def dedup_exact_plan(spark, sf):
    return D.duplicate_plan(members(spark, sf))


@query(
    f"""WITH {RANKED}
SELECT sha256, file_id, path, member_order, CASE WHEN member_order = 0 THEN 'keeper' ELSE 'redundant' END AS role FROM dup"""
)
def dedup_members(spark, sf):
    return members(spark, sf).select("sha256", "file_id", "path", F.col("member_order").cast("long"), "role")


@query(
    f"""WITH {RANKED}
SELECT sha256, CASE
  WHEN count(DISTINCT r_explicit) > 1 THEN 'explicit_user_decision'
  WHEN count(DISTINCT r_location) > 1 THEN 'preferred_location'
  WHEN count(DISTINCT r_verified) > 1 THEN 'verified_reference'
  WHEN count(DISTINCT r_copy) > 1 THEN 'clean_name_tiebreak'
  ELSE 'stable_identity' END AS reason
FROM dup GROUP BY sha256"""
)
def dedup_keeper_reason(spark, sf):
    return D.keeper_reasons(members(spark, sf))


@query(f"""WITH {RANKED} SELECT file_id, path FROM files WHERE file_id NOT IN (SELECT file_id FROM dup WHERE member_order > 0)""")
def dedup_survivors(spark, sf):
    return D.survivors(files(spark, sf), members(spark, sf)).select("file_id", "path")


@query(
    f"""WITH {RANKED},
plan AS (SELECT sha256, size, count(*) - 1 AS redundant FROM dup GROUP BY sha256, size)
SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files WHERE size > 0) AS admitted,
       (SELECT count(*) FROM files WHERE content IS NULL) AS failures, count(*) AS groups,
       CAST(coalesce(sum(redundant), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(size * redundant), 0) AS BIGINT) AS reclaimable_bytes,
       CASE WHEN (SELECT count(*) FROM files WHERE content IS NULL) > 0 THEN 'partial' ELSE 'full_hash' END AS verification_mode
FROM plan"""
)
def dedup_plan_stats(spark, sf):
    return D.plan_statistics(files(spark, sf), D.duplicate_plan(members(spark, sf)))


@query(
    f"""WITH {FILES}
SELECT size, n, CAST(sum(n) OVER () AS BIGINT) AS total
FROM (SELECT size, count(*) AS n FROM files WHERE size > 0 GROUP BY size HAVING count(*) > 1)"""
)
def size_buckets_with_total(spark, sf):
    return D.size_buckets(files(spark, sf))


@query(
    f"""WITH {FILES},
n AS (SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS norm FROM files),
r AS (SELECT *, count(*) OVER (PARTITION BY norm) AS members,
             row_number() OVER (PARTITION BY norm ORDER BY mtime_ns DESC, path DESC) AS rank FROM n WHERE length(norm) > 0)
SELECT file_id, path, sha256(norm) AS text_sha256, length(norm) AS text_chars, members, rank FROM r WHERE members > 1"""
)
def normalized_text_dupes(spark, sf):
    found = D.normalised_duplicates(files(spark, sf))
    return found.select(
        "file_id", "path", "text_sha256", F.col("text_chars").cast("long"), "members", F.col("rank").cast("long")
    )


@query(
    f"""WITH {FILES}
SELECT file_id, sha256(content) AS sha256, (file_id % 2 = 0 AND size >= 100) AS from_cache FROM files"""
)
def fingerprint_cache(spark, sf):
    rows = files(spark, sf)
    keys = ["volume_id", "file_id", "size", "mtime_ns"]
    cached = rows.filter("file_id % 2 = 0 and size >= 100").select(*keys, F.sha2("content", 256).alias("sha256"))
    return D.with_cached_digests(rows, cached, keys).select("file_id", "sha256", "from_cache")


@query(
    f"""WITH {FILES}
SELECT sha256(content) AS sha256, count(DISTINCT path) AS paths, CASE WHEN count(DISTINCT path) = 1 THEN min(path) END AS path
FROM files GROUP BY 1"""
)
def identity_unique_path(spark, sf):
    return D.unique_paths(files(spark, sf).withColumn("sha256", F.sha2("content", 256)), ["sha256"])


@query(
    f"""WITH {RANKED},
page AS (SELECT * FROM dup ORDER BY sha256, member_order LIMIT 200)
SELECT p.file_id, p.sha256, f.content IS NOT NULL AND sha256(f.content) = p.sha256 AND f.size = p.size AS verified
FROM page p LEFT JOIN files f ON p.file_id = f.file_id"""
)
def dedup_verify_page(spark, sf):
    page = members(spark, sf).orderBy("sha256", "member_order").limit(200).select("file_id", "sha256", "size")
    now = files(spark, sf).select("file_id", F.sha2("content", 256).alias("now_sha256"), F.col("size").alias("now_size"))
    ok = F.coalesce((F.col("now_sha256") == F.col("sha256")) & (F.col("now_size") == F.col("size")), F.lit(False))
    return page.join(now, "file_id", "left").select("file_id", "sha256", ok.alias("verified"))


@query(
    f"""WITH {RANKED},
items AS (
  SELECT 'duplicate' AS kind, path, sha256 AS evidence FROM dup WHERE member_order > 0
  UNION ALL SELECT 'empty_file', path, '' FROM files WHERE size = 0
  UNION ALL SELECT 'short_note', path, CAST(size AS VARCHAR) FROM files WHERE size BETWEEN 1 AND 60
)
SELECT kind, path, evidence FROM items WHERE (kind, path) > ('duplicate', '/src1') ORDER BY kind, path LIMIT 100"""
)
def curation_plan_page(spark, sf):
    rows = files(spark, sf)
    items = (
        members(spark, sf).filter("role = 'redundant'").select(F.lit("duplicate").alias("kind"), "path", F.col("sha256").alias("evidence"))
        .unionByName(rows.filter("size = 0").select(F.lit("empty_file").alias("kind"), "path", F.lit("").alias("evidence")))
        .unionByName(rows.filter("size between 1 and 60").select(F.lit("short_note").alias("kind"), "path", F.col("size").cast("string").alias("evidence")))
    )
    return keyset_page(items, ["kind", "path"], ["duplicate", "/src1"], 100)


@query(
    """SELECT conv_id, turn, role, sha256(text) AS fingerprint FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) AS n FROM conversations) WHERE n = 1 OR role = 'system'"""
)
def chunk_collapse(spark, sf):
    rows = table(spark, sf, "conversations")
    return D.collapse_chunks(rows, "conv_id", "role", "text", "turn", "system").select("conv_id", "turn", "role", "fingerprint")
