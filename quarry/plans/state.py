"""Queries of corpus state: successors, reuse, coverage, epochs, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import evidence as E
from quarry.operators import state as S
from quarry.plans.registry import query
from quarry.plans.retrieval import SCORED, all_scores
from quarry.sources.tables import table


def docs(spark, sf):
    return table(spark, sf, "documents")


@query(
    """SELECT p_partkey, p_name, 'kept' AS origin FROM part WHERE p_partkey % 10 <> 3 AND p_partkey % 10 <> 7
UNION ALL SELECT p_partkey, upper(p_name), 'delta' FROM part WHERE p_partkey % 10 = 3"""
)
def generation_successor(spark, sf):
    base = table(spark, sf, "part").select("p_partkey", "p_name")
    delta = base.filter("p_partkey % 10 = 3").withColumn("p_name", F.upper("p_name"))
    return S.successor(base, delta, base.filter("p_partkey % 10 = 7"), "p_partkey")


@query(
    """WITH p AS (SELECT text, min(doc_id) AS vec FROM documents WHERE doc_id % 3 = 0 GROUP BY text)
SELECT d.doc_id, p.vec, p.vec IS NOT NULL AS reused FROM documents d LEFT JOIN p ON d.text = p.text"""
)
def payload_reuse(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("k"))
    published = rows.filter("doc_id % 3 = 0").select("k", F.col("doc_id").alias("vec"))
    return S.with_reused(rows, published, ["k"], "vec").select("doc_id", "vec", "reused")


@query(
    """WITH d AS (SELECT DISTINCT sha256(text) AS h FROM documents) SELECT count(*) AS keys, """
    + ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS UBIGINT) AS HUGEINT)) % 4294967296 AS BIGINT) AS word{i}" for i in range(4))
    + " FROM d"
)
def content_set_digest(spark, sf):
    return S.content_set_digest(docs(spark, sf), F.col("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'v2' END AS cached_type, CASE WHEN doc_id % 4 = 1 THEN 'reuse' ELSE 'detect' END AS action FROM documents")
def detector_cache(spark, sf):
    files = docs(spark, sf).select("doc_id", "n_chars")
    cache = files.filter("doc_id % 2 = 1").withColumns({"version": F.when(F.col("doc_id") % 4 == 1, "2").otherwise("1"), "type": F.lit("v2")})
    return S.cached_detection(files, cache, ["doc_id", "n_chars"], "2").select("doc_id", "cached_type", "action")


@query(
    """WITH i AS (SELECT doc_id, n_chars AS now FROM documents WHERE doc_id % 5 <> 0), d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE n_chars END AS signature FROM documents WHERE doc_id % 6 <> 0)
SELECT count(now) AS live, count(*) FILTER (now IS NOT NULL AND signature IS NOT NULL) AS extracted, count(*) FILTER (now = signature) AS current, count(*) FILTER (now IS NOT NULL AND signature IS NULL) AS missing,
count(*) FILTER (now <> signature) AS stale, count(*) FILTER (now IS NULL AND signature IS NOT NULL) AS orphans FROM i FULL JOIN d USING (doc_id)"""
)
def extraction_coverage(spark, sf):
    rows = docs(spark, sf).select("doc_id", "n_chars")
    durable = rows.filter("doc_id % 6 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("n_chars")).alias("signature"))
    return S.coverage(rows.filter("doc_id % 5 <> 0"), durable, "doc_id", F.col("n_chars"))


@query(
    """WITH l AS (SELECT event_type, max_by(user_id, event_id) AS epoch FROM events GROUP BY 1) SELECT event_type, epoch, CASE WHEN epoch = (SELECT max(epoch) FROM l) THEN 'aligned' ELSE 'conflict' END AS status FROM l"""
)
def publication_epochs(spark, sf):
    return S.epochs(table(spark, sf, "events"), "event_type", "event_id", "user_id")


@query(
    "SELECT source, count(*) AS items, count(*) FILTER (doc_id % 3 = 0) AS cache_hits, count(*) FILTER (doc_id % 3 <> 0) AS new_work, round(count(*) FILTER (doc_id % 3 = 0) / count(*), 6) AS hit_rate FROM documents GROUP BY source"
)
def replay_metrics(spark, sf):
    return S.replay_metrics(docs(spark, sf), "source", F.col("doc_id") % 3 == 0)


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_type <> 'error' THEN 'applied' WHEN event_id % 3 = 0 THEN 'failed' WHEN value > 50 THEN 'needs_recovery' ELSE 'abandoned' END AS status FROM events"""
)
def recovery_view(spark, sf):
    events = table(spark, sf, "events")
    receipts = events.filter("event_id % 3 = 0").select("event_id", F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("outcome"))
    return S.recovery_view(events.select("event_id", (F.col("value") > 50).alias("crossed")), receipts, "event_id")


@query("SELECT DISTINCT '/' || source || '/x' AS path, CASE WHEN source IN ('src1', 'src2') THEN '/' || source END AS protected_by FROM documents")
def protected_paths(spark, sf):
    paths = docs(spark, sf).select(F.concat(F.lit("/"), "source", F.lit("/x")).alias("path")).distinct()
    return S.protected(paths, spark.createDataFrame([("/src1",), ("/src2",)], "root string"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def admission_policy(spark, sf):
    return S.admitted(docs(spark, sf).select("doc_id"), table(spark, sf, "labels").filter("toxic = 1"), ["doc_id"])


@query(
    """SELECT l_orderkey, string_agg('lines!A' || l_linenumber || chr(9) || CAST(l_partkey AS VARCHAR), chr(10) ORDER BY l_linenumber) FILTER (l_linenumber <> 2) AS text, count(*) FILTER (l_linenumber = 2) AS uncached_formulas
FROM (SELECT l_orderkey, l_linenumber, any_value(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL HAVING count(*) = 1) GROUP BY l_orderkey HAVING count(*) FILTER (l_linenumber <> 2) > 0"""
)
def cell_projection(spark, sf):
    """Order lines as a sheet's cells: line 2 is a formula whose value was never cached."""
    rows = table(spark, sf, "lineitem")
    once = rows.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.first("l_partkey").alias("p")).filter("n = 1")
    cell = F.struct(
        F.col("l_linenumber").alias("line"), F.lit("lines").alias("sheet"), F.concat(F.lit("A"), F.col("l_linenumber").cast("string")).alias("cell"),
        F.when(F.col("l_linenumber") == 2, "").otherwise(F.col("p").cast("string")).alias("value"), F.when(F.col("l_linenumber") == 2, "SUM(A1)").otherwise("").alias("formula"),
    )
    sheets = once.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    found = S.cell_lines(sheets, "l_orderkey", "cells")
    return found.filter("text <> ''").withColumn("uncached_formulas", F.col("uncached_formulas").cast("long"))


@query("""SELECT '{"rank":' || (doc_id % 9) || ',"resource":"' || source || '","evidence":"' || doc_id || '","score":' || CAST(n_chars AS DOUBLE) || '}' AS hit FROM documents""")
def hit_projection(spark, sf):
    rows = docs(spark, sf).select((F.col("doc_id") % 9).alias("rank"), F.col("source").alias("resource"), F.col("doc_id").cast("string").alias("evidence"), F.col("n_chars").cast("double").alias("score"))
    return rows.select(S.hit_projection(rows).alias("hit"))


@query(
    r"""WITH w AS (SELECT doc_id, trim(regexp_replace('TC-' || doc_id || ' note ' || regexp_split_to_array(text, '\n')[1], '[^\p{L}\p{N}.-]+', '_', 'g'), '_') AS w FROM documents)
SELECT doc_id, regexp_replace(substr(w, 1, 80), '_+[^_]{0,2}$', '') AS stem FROM w"""
)
def document_stems(spark, sf):
    title = F.get(F.split("text", "\n"), F.lit(0))
    ids = F.array(F.concat(F.lit("TC-"), F.col("doc_id").cast("string")))
    return docs(spark, sf).select("doc_id", S.stem(title, F.lit("note"), ids).alias("stem"))


@query(
    """SELECT doc_id, 'acme' AS name, CASE doc_id % 3 WHEN 0 THEN 'issuer' ELSE 'mentioned' END AS role FROM documents WHERE doc_id % 3 < 2
UNION ALL SELECT doc_id, 'globex', 'issuer' FROM documents WHERE doc_id % 3 = 1"""
)
def entity_roles(spark, sf):
    openings = F.array(*map(F.lit, ("issued by acme in may", "acme and others", "nothing here")))
    k = (F.col("doc_id") % 3).cast("int")
    author = F.when(k == 1, "globex").otherwise("")
    rows = docs(spark, sf).select("doc_id", F.explode(S.entity_roles(F.get(openings, k), author, ["acme", "globex"])).alias("x"))
    return rows.select("doc_id", "x.name", "x.role")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ['ISO 9001:2015', 'RFC 2616'] ELSE ['IEEE 802.11'] END AS refs FROM events")
def standard_references(spark, sf):
    text = F.when(F.col("event_id") % 2 == 0, "see ISO 9001 and ISO 9001:2015, RFC-2616").otherwise("IEEE 802.11 and IEEE-802.11")
    return table(spark, sf, "events").select("event_id", S.references(text).alias("refs"))


@query(
    f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM scored)
SELECT query_id, vec_id, rank, round(score, 5) AS score, CASE WHEN score < 0.05 THEN 'below_floor' WHEN rank > 20 THEN 'beyond_limit' ELSE 'returned' END AS stage FROM r WHERE vec_id IN (3, 100, 250)"""
)
def target_diagnostics(spark, sf):
    return S.trace_targets(all_scores(spark, sf), [3, 100, 250], "vec_id", 20, 0.05)


@query("SELECT 0 AS id, 'radiator without pressure | cooling | presión' AS expanded")
def query_expansion(spark, sf):
    text = E.expand_query("radiator without pressure", {"cooling": ["radiator", "cooler"], "presión": ["pressure"], "voltage": ["volt"]})
    return spark.createDataFrame([(0, text)], "id int, expanded string")
