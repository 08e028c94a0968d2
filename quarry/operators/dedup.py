"""Exact duplicate planning over an inventory of files.

A file is a row with path, volume_id, file_id, size, mtime_ns and content.  Size buckets prune what is
hashed, and files are equal when their SHA-256 and their size agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: a numbered or worded copy suffix at the end of a file's stem.
COPY_SUFFIX = r"(?i)(?:\s*\(\d+\)|[ _-](?:copy|copia)(?:[ _-]?\d+)?)$"
REASONS = [
    "explicit_user_decision",
    "preferred_location",
    "verified_reference",
    "clean_name_tiebreak",
    "stable_identity",
    "stable_path",
]
RANKS = ["r_explicit", "r_location", "r_verified", "r_copy", "r_identity", "path"]


def stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def admitted(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files that are neither empty nor too large, one row per physical identity and path."""
    rows = files.filter(F.col("size") > 0)
    return rows.filter(F.col("size") <= max_bytes) if max_bytes is not None else rows


def size_buckets(files: DataFrame) -> DataFrame:
    """size, n, total: buckets of more than one file, and the number of files in all such buckets."""
    buckets = admitted(files).groupBy("size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    total = buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return buckets.crossJoin(F.broadcast(total))  # one row: the grand total beside each bucket


def keeper_ranks(
    files: DataFrame, preferred: list[str] = (), explicit: list[int] = (), verified: list[int] = ()
) -> DataFrame:
    """Add the six rank columns; lower is kept."""
    location = F.lit(len(preferred))
    for ordinal, root in reversed(list(enumerate(preferred))):
        location = F.when((F.col("path") == root) | F.col("path").startswith(root.rstrip("/") + "/"), ordinal).otherwise(location)
    return files.withColumns(
        {
            "r_explicit": F.when(F.col("file_id").isin(list(explicit)), 0).otherwise(1),
            "r_location": location,
            "r_verified": F.when(F.col("file_id").isin(list(verified)), 0).otherwise(1),
            "r_copy": stem(F.col("path")).rlike(COPY_SUFFIX).cast("int"),
            "r_identity": F.concat_ws(":", F.lpad(F.lower(F.hex("volume_id")), 32, "0"), F.lpad(F.lower(F.hex("file_id")), 32, "0")),
        }
    )


def duplicate_members(ranked: DataFrame) -> DataFrame:
    """Every member of every duplicate group: sha256, member_order (0: keeper), role, and the rank columns.

    Only files whose size occurs twice are hashed.  Members are grouped by digest and size.
    """
    rows = admitted(ranked)
    shared = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("size")
    hashed = rows.join(shared, "size", "left_semi").withColumn("sha256", F.sha2("content", 256))
    group = Window.partitionBy("sha256", "size")
    ordered = group.orderBy(*RANKS)
    return (
        hashed.drop("content")
        .withColumn("members", F.count(F.lit(1)).over(group))
        .filter("members > 1")
        .withColumn("member_order", F.row_number().over(ordered) - 1)
        .withColumn("role", F.when(F.col("member_order") == 0, "keeper").otherwise("redundant"))
    )


def duplicate_plan(members: DataFrame) -> DataFrame:
    """One row per group; what physical storage is reclaimed is unknown and stays null."""
    return members.groupBy("sha256", "size").agg(
        F.min(F.struct(*RANKS, "file_id"))["path"].alias("keep_path"),
        (F.count(F.lit(1)) - 1).alias("redundant_count"),
        (F.first("size") * (F.count(F.lit(1)) - 1)).alias("reclaimable_bytes"),
        F.lit(None).cast("long").alias("physical_reclaimable_bytes"),
    )


def keeper_reasons(members: DataFrame) -> DataFrame:
    """sha256 and the first rank by which the group's members differ."""
    differs = [F.min(c) != F.max(c) for c in RANKS]
    reason = F.lit("stable_identity")
    for label, d in reversed(list(zip(REASONS, differs, strict=True))):
        reason = F.when(d, label).otherwise(reason)
    return members.groupBy("sha256").agg(reason.alias("reason"))


def survivors(files: DataFrame, members: DataFrame) -> DataFrame:
    """Files that no plan calls redundant."""
    gone = members.filter("role = 'redundant'").select("volume_id", "file_id")
    return files.join(gone, ["volume_id", "file_id"], "left_anti")


def plan_statistics(files: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: files seen, files admitted, groups, redundant files, reclaimable bytes, verification mode."""
    seen = files.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("size") > 0).alias("admitted"),
        F.count_if(F.col("content").isNull()).alias("failures"),
    )
    planned = plan.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("redundant_count"), F.lit(0)).alias("redundant"),
        F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"),
    )
    mode = F.when(F.col("failures") > 0, "partial").otherwise("full_hash")
    return seen.crossJoin(planned).withColumn("verification_mode", mode)  # one row beside one row


def with_cached_digests(files: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Digests from the cache where identity, size and times agree; only the misses are hashed."""
    hit = files.join(cache.select(*keys, F.col("sha256").alias("cached")), keys, "left")
    digest = F.when(F.col("cached").isNotNull(), F.col("cached")).otherwise(F.sha2("content", 256))
    return hit.withColumns({"sha256": digest, "from_cache": F.col("cached").isNotNull()}).drop("cached")


def normalised_text(text: Column) -> Column:
    """White space collapsed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalised_duplicates(files: DataFrame) -> DataFrame:
    """Redundant files of equal normalised text: the newest, and of equals the last path, stays."""
    keyed = files.withColumn("norm", normalised_text(F.col("content"))).withColumns(
        {"text_sha256": F.sha2("norm", 256), "text_chars": F.length("norm")}
    )
    group = Window.partitionBy("text_sha256", "text_chars")
    return (
        keyed.drop("content", "norm")
        .withColumn("members", F.count(F.lit(1)).over(group))
        .filter("members > 1 and text_chars > 0")
        .withColumn("rank", F.row_number().over(group.orderBy(F.desc("mtime_ns"), F.desc("path"))))
    )


def unique_paths(files: DataFrame, identity: list[str]) -> DataFrame:
    """The path of each identity that has exactly one; others are abstained from, with their count."""
    return files.groupBy(*identity).agg(F.count_distinct("path").alias("paths"), F.min("path").alias("first")).select(
        *identity, "paths", F.when(F.col("paths") == 1, F.col("first")).alias("path")
    )


def collapse_chunks(chunks: DataFrame, item: str, kind: str, body: str, ordinal: str, exempt: str) -> DataFrame:
    """Of equal chunks of one item and kind the first stays; chunks of the exempt kind all stay."""
    keyed = chunks.withColumn("fingerprint", F.sha2(body, 256))
    first = F.row_number().over(Window.partitionBy(item, kind, "fingerprint").orderBy(ordinal))
    return keyed.withColumn("_first", first).filter((F.col("_first") == 1) | (F.col(kind) == exempt)).drop("_first")
