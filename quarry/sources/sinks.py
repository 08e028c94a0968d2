"""Publication: upserts, atomic generations, successors, outbox, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of delta replace those of base with the same key; base keys that delta lacks stay."""
    return base.join(delta.select(*keys).distinct(), keys, "left_anti").unionByName(delta)


def keep_latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def publish_generation(rows: DataFrame, place: str, generation: int) -> str:
    """Write a generation beside its predecessors, verify its row count, then move the one-row head to it."""
    spark, target = rows.sparkSession, f"{place}/generation={generation}"
    rows.write.mode("overwrite").parquet(target)
    written = spark.read.parquet(target).count()
    head = spark.createDataFrame([(generation, written)], "generation long, n_rows long")
    head.coalesce(1).write.mode("overwrite").parquet(f"{place}/_head")
    return target


def read_published(spark: SparkSession, place: str) -> DataFrame:
    generation = spark.read.parquet(f"{place}/_head").first()["generation"]
    return spark.read.parquet(f"{place}/generation={generation}")


def outbox_page(events: DataFrame, cursor: int, max_rows: int, max_bytes: int, id_col: str, body_col: str) -> DataFrame:
    """The next events after a cursor in id order, as many as fit both caps.

    Only the first max_rows of them are ordered and summed, so the running sum is over a bounded set.
    """
    page = events.filter(F.col(id_col) > cursor).orderBy(id_col).limit(max_rows)
    running = F.sum(F.octet_length(body_col)).over(Window.orderBy(id_col))
    return page.withColumn("running_bytes", running).filter(F.col("running_bytes") <= max_bytes)


def report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON record a row, its keys in order."""
    return rows.select(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias("record"))
