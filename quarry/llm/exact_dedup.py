"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Three content-comparing stages: within each input partition (map-side combine), within salted digest
groups, and over the salt winners.  Every stage groups by digest *and* full normalised text, so equality
is always equality of content; the digest only spreads the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A text held by at least 1/HOT_SHARE of all rows is hot; there can be at most HOT_SHARE such texts.
HOT_SHARE = 1000


def normalised(text):
    """Lower-case A-Z only; null counts as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One stored row per distinct normalised text: digest (binary), keep_id, group_size.

    Raises at run time should two different texts ever share a SHA-256 digest.
    """
    norm = normalised(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"),
        norm.alias("norm"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        (F.spark_partition_id() % salts).alias("salt"),
    )
    salted = rows.groupBy("digest", "norm", "salt").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    combined = salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    per_digest = combined.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")
    )
    size = F.when(F.col("texts") == 1, F.col("n")).otherwise(
        F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long")
    )
    return stored(per_digest.select("digest", "keep_id", size.alias("group_size")), "winners")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, join_salts: int = 64
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.  Null and empty texts are one group.  Rows that
    repeat an id with the same text count in group_size and are all marked alike; a null id is kept only
    if its whole group has none.  An empty input gives an empty result.  Other columns are ignored,
    whatever their names.

    The way back from texts to rows joins on the digest.  The hot texts (at most HOT_SHARE of them by
    pigeonhole, so a broadcast of fixed size) have their rows salted and their winner repeated per salt.
    """
    best = winners(docs, id_col, text_col, salts)
    total = best.agg(F.sum("group_size")).first()[0] or 0
    is_hot = F.col("group_size") >= F.lit(max(2, -(-total // HOT_SHARE)))
    spread = best.withColumn(
        "salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(join_salts - 1))).otherwise(F.array(F.lit(0))))
    )
    hot = best.filter(is_hot).select("digest", F.lit(True).alias("hot"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest")
    )
    rows = rows.join(F.broadcast(hot), "digest", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(join_salts)).cast("int")).otherwise(F.lit(0))
    )
    return rows.join(spread, ["digest", "salt"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
