"""Queries of compiled searches, constraints, evidence, routes and implementations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import api
from quarry.operators import evidence as E
from quarry.operators import registry as G
from quarry.operators.neardup import groups
from quarry.plans.registry import query
from quarry.sources.tables import table


def docs(spark, sf):
    return table(spark, sf, "documents")


@query(
    """WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents),
r AS (SELECT doc_id, CASE WHEN list_has_all(w, ['onenth', 'thereand', 'with', 'that']) THEN 0 WHEN list_has_all(w, ['onenth', 'thereand', 'that']) THEN 1
WHEN list_has_all(w, ['onenth', 'thereand']) OR list_has_all(w, ['onenth', 'that']) OR list_has_all(w, ['thereand', 'that']) THEN 2 END AS rung FROM w) SELECT doc_id, rung FROM r WHERE rung = (SELECT min(rung) FROM r)"""
)
def query_rungs(spark, sf):
    """All terms, else those that are no grammar words, else any two of these: the first rung with hits."""
    return E.climb(docs(spark, sf), "doc_id", "text", E.compile_query("onenth thereand with that"))


@query()
def search_end_to_end(spark, sf):
    return api.search(docs(spark, sf), "what tion and that thing", limit=10)[0]


@query("SELECT 0 AS query_id, 'partial' AS status, ['catalogue', 'semantic'] AS missing")
def search_completeness(spark, sf):
    return api.search(docs(spark, sf), "tion and that thing")[1]


@query(
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'coherent' ELSE 'mismatch' END AS status, event_id % 2 = 1 AS hard_mismatch FROM events"""
)
def structured_constraints(spark, sf):
    text = F.when(F.col("event_id") % 2 == 0, "unit TC-22 tested on 05/03/2024 at 115 kV").otherwise("unit TC-23 tested on 05/03/2024 at 115 kV")
    rows = table(spark, sf, "events").select("event_id", text.alias("text"))
    return rows.select("event_id", E.structured_support(F.col("text"), "TC-22 2024-03-05 115 kV").alias("s")).select("event_id", "s.status", "s.hard_mismatch")


@query(
    """SELECT event_id % 40 AS query_id, event_id, NOT bool_or(event_id % 6 = 0) OVER (PARTITION BY event_id % 40) AS abstains FROM events
QUALIFY NOT (bool_or(event_id % 6 = 0) OVER (PARTITION BY event_id % 40) AND event_id % 5 = 0)"""
)
def coherent_preference(spark, sf):
    e = F.col("event_id")
    hits = table(spark, sf, "events").select(
        (e % 40).alias("query_id"), e, F.struct((e % 6 == 0).alias("coherent"), (e % 5 == 0).alias("hard_mismatch")).alias("support")
    )
    return E.prefer_coherent(hits).select("query_id", "event_id", "abstains")


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN ['literal_requested_event_occurrence_is_negated'] WHEN 1 THEN ['source_explicitly_limits_observed_event_evidence'] ELSE [] END AS reasons FROM events"""
)
def role_counter_evidence(spark, sf):
    texts = F.array(*map(F.lit, ("the leak did not occur", "example only: a leak", "a leak was recorded")))
    rows = table(spark, sf, "events").select("event_id", F.get(texts, (F.col("event_id") % 3).cast("int")).alias("t"))
    return rows.select("event_id", E.counter_evidence(F.lower("t"), "leak").alias("reasons"))


@query()
def densest_snippets(spark, sf):
    rows = docs(spark, sf).filter(F.lower("text").contains("tion"))
    return rows.select("doc_id", E.densest_snippet(F.col("text"), ["tion", "ing", "the"], 120).alias("s")).select("doc_id", "s.start", "s.snippet")


@query(
    """SELECT lang, count(*) AS cases, count(*) FILTER (quality = 1 AND n_chars > 1000) AS true_positive, count(*) FILTER (quality = 0 AND n_chars > 1000) AS false_positive,
count(*) FILTER (quality = 1 AND n_chars BETWEEN 300 AND 1000) AS false_negative, count(*) FILTER (quality = 0 AND n_chars BETWEEN 300 AND 1000) AS true_negative, count(*) FILTER (n_chars < 300) AS abstained
FROM labels JOIN documents USING (doc_id) GROUP BY lang"""
)
def evidence_evaluation_matrix(spark, sf):
    rows = docs(spark, sf).select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    cases = rows.select("lang", (F.col("quality") == 1).alias("expected"), F.when(F.col("n_chars") >= 300, F.col("n_chars") > 1000).alias("predicted"))
    return E.evidence_matrix(cases, ["lang"])


@query(
    """SELECT d.doc_id AS citation, d.doc_id + CASE WHEN d.doc_id % 20 = 0 THEN 1000000 ELSE 0 END AS owner_id,
CASE WHEN d.doc_id % 20 = 0 THEN NULL ELSE substr(text, 11, 30) END AS cited,
CASE WHEN d.doc_id % 20 = 0 THEN 'owner_missing' WHEN 40 > length(text) THEN 'locator_out_of_range' WHEN d.doc_id % 7 = 0 THEN 'text_changed' ELSE 'verified' END AS status FROM documents d"""
)
def evidence_rehydration(spark, sf):
    doc = F.col("doc_id")
    cited = F.sha2(F.substring("text", 11, 30), 256)
    citations = docs(spark, sf).select(
        doc.alias("citation"), (doc + F.when(doc % 20 == 0, 1_000_000).otherwise(0)).alias("owner_id"), F.lit(10).alias("start"), F.lit(40).alias("end"),
        F.when(doc % 7 == 0, "0").otherwise(cited).alias("sha256"),
    )
    return E.rehydrate(citations, docs(spark, sf).select(doc.alias("owner_id"), "text"))


@query(
    """WITH h AS (SELECT DISTINCT conv_id % 5 AS q, conv_id % 9 AS r, conv_id AS e FROM conversations), e AS (
SELECT 'query:' || q AS a, 'evidence:' || e AS b FROM h UNION SELECT 'evidence:' || e, 'resource:' || r FROM h)
SELECT split_part(n, ':', 1) AS kind, count(*) AS nodes FROM (SELECT a AS n FROM e UNION SELECT b FROM e) GROUP BY 1"""
)
def evidence_graph_nodes(spark, sf):
    conv = F.col("conv_id")
    hits = table(spark, sf, "conversations").select((conv % 5).alias("query_id"), (conv % 9).alias("resource"), conv.alias("evidence")).distinct()
    nodes, _ = E.evidence_graph(hits)
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"))


@query(
    """WITH r AS (SELECT 'src' || doc_id % 4 AS request_id, doc_id % 4 AS k FROM documents GROUP BY ALL)
SELECT request_id, CASE k WHEN 0 THEN 'builtin' WHEN 1 THEN 'fast' WHEN 2 THEN NULL ELSE 'remote' END AS implementation, CASE WHEN k = 2 THEN 'abstained' ELSE 'selected' END AS status FROM r"""
)
def capability_broker(spark, sf):
    names = "implementation string, capability string, mime_types array<string>, languages array<string>, network boolean, max_bytes long, quality double, cost double"
    have = spark.createDataFrame(
        [
            ("builtin", "text", ["text/plain"], ["*"], False, None, 0.5, 1.0),
            ("fast", "text", ["text/plain", "text/html"], ["en"], False, 1000, 0.7, 0.1),
            ("remote", "text", ["text/plain"], ["*"], True, None, 0.9, 5.0),
        ],
        names,
    )
    asked = [("src0", "text", "text/plain", "de", False, 10), ("src1", "text", "text/html", "en", False, 10), ("src2", "text", "text/html", "en", False, 5000), ("src3", "text", "text/plain", "en", True, 10)]
    return G.broker(have, spark.createDataFrame(asked, "request_id string, capability string, mime string, language string, allow_network boolean, bytes long"))


@query(
    """SELECT route, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT n_chars, CASE WHEN lang = 'en' THEN 'english' WHEN starts_with(lang, 'e') OR lang = 'fr' THEN 'romance' END AS route FROM documents) WHERE route IS NOT NULL AND n_chars > 0 GROUP BY route"""
)
def route_registry(spark, sf):
    media = F.when(F.col("lang") == "en", "text/en").when(F.col("lang").isin("es", "fr"), "text/romance").otherwise("other")
    keep = lambda rows: rows.filter("n_chars > 0")
    routed = G.run_routes(docs(spark, sf).withColumn("media_type", media), [G.Route("english", "text/en", keep), G.Route("romance", "text/rom", keep)])
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT min(s) AS component, count(*) AS members FROM (SELECT 'src' AS g, n_regionkey AS s, n_nationkey FROM nation) GROUP BY s HAVING count(*) > 1")
def region_components(spark, sf):
    """Nations of one region, linked in a chain, are one component: named by the region after the fact."""
    nation = table(spark, sf, "nation")
    first = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("a"))
    pairs = nation.join(first, "n_regionkey").filter("n_nationkey <> a").select("a", F.col("n_nationkey").alias("b"))
    found = groups(pairs).join(nation.select(F.col("n_nationkey").alias("member"), "n_regionkey"), "member")
    return found.groupBy("component").agg(F.first("n_regionkey").alias("r"), F.count(F.lit(1)).alias("members")).select(F.col("r").alias("component"), "members")
