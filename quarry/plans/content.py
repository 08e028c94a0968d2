"""Queries of chunking, extraction and streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from quarry.functions.text import quality
from quarry.operators import chunking as K
from quarry.operators.dedup import collapse_chunks
from quarry.plans.registry import query
from quarry.sources import formats as X
from quarry.sources.tables import scan_files, table
from quarry.streaming import events as S


@query()
def html_visible_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_text("html").alias("text"))


@query()
def content_types(spark, sf):
    """Types of the tables' own contents: prose, HTML and JSON."""
    rows = (
        table(spark, sf, "pages").select(F.lit("pages").alias("owner"), F.encode("html", "utf-8").alias("b"))
        .unionByName(table(spark, sf, "events").select(F.lit("events").alias("owner"), F.encode("props", "utf-8").alias("b")))
        .unionByName(table(spark, sf, "documents").select(F.lit("documents").alias("owner"), F.encode("text", "utf-8").alias("b")))
    )
    return rows.select("owner", X.read_type("b")["type"].alias("type")).groupBy("owner", "type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, substr(regexp_replace(text, '\\r\\n?', '\n', 'g'), 1, 500) AS text, length(text) > 500 AS truncated FROM documents")
def bounded_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.bounded(F.col("text"), 500).alias("b")).select("doc_id", "b.text", "b.truncated")


@query()
def table_file_listing(spark, sf):
    """The table files themselves, as an inventory scan sees them."""
    files = scan_files(spark, sf, "*.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size")


def chunked(spark, sf):
    return K.chunks(table(spark, sf, "documents"), "doc_id", "text")


@query()
def chunks_natural_window(spark, sf):
    return chunked(spark, sf).select("item", "ordinal", "start_char", "end_char", "fingerprint", "chunk_id")


@query()
def chunks_quality_gated(spark, sf):
    good = chunked(spark, sf).withColumn("kind", F.lit("document")).filter(quality(F.col("text"))["eligible"])
    return collapse_chunks(good, "item", "kind", "text", "ordinal", "title").select("item", "ordinal", "chunk_id")


@query()
def index_plan(spark, sf):
    rows = chunked(spark, sf)
    return K.plan(rows, rows.filter("item % 4 = 0"))


def _scratch(spark, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{base.rstrip('/')}/quarry-stream-{uuid.uuid4().hex[:10]}-{name}"


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return S.watch(spark, sf, schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) FROM events) GROUP BY ALL")
def stream_idempotent(spark, sf):
    place = _scratch(spark, "events")
    day = _events(spark, sf).withColumn("day", F.to_date("ts"))
    S.run_once(S.idempotent(day, ["user_id", "event_type", "day"], "ts", "40 days"), place, f"{place}-cp")
    return spark.read.parquet(place).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf):
    """The batch form of the windowed stream: Spark runs the same plan on either."""
    out = S.windowed(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "6 hours", "1 day")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER w >= INTERVAL 4 HOUR OR lag(ts) OVER w IS NULL AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark, sf):
    rows = S.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "4 hours", "1 day")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT count(*) AS applied, max(event_id) AS mark FROM events")
def receipt_watermark(spark, sf):
    place = _scratch(spark, "receipts")
    S.run_batches(_events(spark, sf), S.Outbox("event_id", lambda rows: rows.select("event_id").write.mode("append").parquet(place), place=f"{place}-mark"), f"{place}-cp")
    return spark.read.parquet(place).agg(F.count(F.lit(1)).alias("applied"), F.max("event_id").alias("mark"))
