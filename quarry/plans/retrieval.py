"""Queries of near duplicates, lexical and vector retrieval, fusion and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import neardup as N
from quarry.operators import retrieval as R
from quarry.plans.registry import query
from quarry.sources.tables import table

SIGNED = """
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
f AS (
  SELECT doc_id, len(w) AS n, unnest(list_transform(w, lambda x: 'token:' || x)) AS f, 1 AS weight FROM w WHERE len(w) > 0
  UNION ALL
  SELECT doc_id, len(w), unnest(list_transform(generate_series(1, len(w) - 4), lambda i: 'shingle:' || array_to_string(w[i:i+4], chr(31)))), 2 FROM w WHERE len(w) >= 5),
h AS (SELECT doc_id, n, CAST('0x' || substr(sha256(f), 1, 16) AS UBIGINT) AS h, CAST(sum(weight) AS BIGINT) AS weight FROM f GROUP BY doc_id, n, f),
bits AS (SELECT doc_id, n, b, CAST(sum(CASE WHEN (h >> CAST(b AS UBIGINT)) & 1 = 1 THEN weight ELSE -weight END) AS BIGINT) AS c FROM h, generate_series(0, 63) t(b) GROUP BY doc_id, n, b),
signed AS (SELECT doc_id, n AS n_tokens, sum(CASE WHEN c >= 0 THEN CAST(1 AS HUGEINT) << CAST(b AS INTEGER) ELSE 0 END) AS u FROM bits GROUP BY doc_id, n)"""
PAIRS = (
    SIGNED
    + """,
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, 1 - bit_count(xor(CAST(a.u AS UBIGINT), CAST(b.u AS UBIGINT))) / 64 AS score FROM signed a JOIN signed b ON a.doc_id < b.doc_id
  WHERE bit_count(xor(CAST(a.u AS UBIGINT), CAST(b.u AS UBIGINT))) <= 5)"""
)


def signed(spark, sf):
    return N.signatures(table(spark, sf, "documents"), "doc_id", "text")


@query(
    f"WITH {SIGNED} SELECT doc_id, n_tokens, CAST(u - CASE WHEN u >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END AS BIGINT) AS simhash FROM signed"
)
def simhash_signatures(spark, sf):
    return signed(spark, sf)


@query(f"WITH {PAIRS} SELECT a, b, score FROM pairs")
def simhash_near_pairs(spark, sf):
    return N.near_pairs(signed(spark, sf), "doc_id")


@query(
    f"""WITH RECURSIVE {PAIRS},
e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
r AS (SELECT a AS member, a AS label FROM e UNION SELECT e.b, r.label FROM r JOIN e ON r.member = e.a WHERE r.label < e.b),
l AS (SELECT member, min(label) AS component FROM r GROUP BY member),
d AS (SELECT a AS member, count(*) AS degree FROM e GROUP BY a),
s AS (SELECT l.component, min(p.score) AS min_score FROM pairs p JOIN l ON p.a = l.member GROUP BY 1)
SELECT component, count(*) AS members, arg_min(member, (-degree, member)) AS representative,
  substr(sha256(string_agg(CAST(member AS VARCHAR), chr(31) ORDER BY member)), 1, 32) AS group_key, any_value(min_score) AS min_score
FROM l JOIN d USING (member) JOIN s USING (component) GROUP BY component"""
)
def simhash_components(spark, sf):
    from quarry.plans.shared import checkpointed

    pairs = checkpointed(N.near_pairs(signed(spark, sf), "doc_id"))
    return N.group_summary(N.groups(pairs), pairs)


@query(
    f"""WITH documents AS (SELECT conv_id || ':' || turn AS doc_id, text FROM conversations), {SIGNED},
votes AS (SELECT CAST(split_part(doc_id, ':', 1) AS BIGINT) AS conv_id, i, sum(CASE WHEN (u >> CAST(i AS INTEGER)) & 1 = 1 THEN n_tokens ELSE -n_tokens END) AS v
  FROM signed, generate_series(0, 63) g(i) GROUP BY ALL),
rolled AS (SELECT conv_id, sum(CASE WHEN v >= 0 THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE 0 END) AS u FROM votes GROUP BY conv_id)
SELECT conv_id, CAST(u - CASE WHEN u >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END AS BIGINT) AS simhash FROM rolled"""
)
def signature_rollup(spark, sf):
    """A conversation's signature from those of its turns, each weighted by its words."""
    turns = table(spark, sf, "conversations").select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("page"), "text")
    pages = N.signatures(turns, "page", "text").select(F.split("page", ":")[0].cast("long").alias("conv_id"), F.col("n_tokens").alias("weight"), "simhash")
    return N.document_rollup(pages, "conv_id", "weight", "simhash")


@query(
    """WITH s AS (SELECT page_id, sha256(html) AS h, length(html) AS ink FROM pages),
v AS (SELECT page_id, ink, CAST('0x' || substr(h, 1, 16) AS UBIGINT) AS g, CAST('0x' || substr(h, 17, 16) AS UBIGINT) AS v, CAST('0x' || substr(h, 33, 16) AS UBIGINT) AS hd, CAST('0x' || substr(h, 49, 16) AS UBIGINT) AS ft FROM s),
p AS (SELECT a.page_id AS a, b.page_id AS b, 1 - bit_count(xor(a.g, b.g)) / 64 AS g, 1 - bit_count(xor(a.v, b.v)) / 64 AS v,
  CASE WHEN a.ink % 11 >= 5 AND b.ink % 11 >= 5 THEN 1 - bit_count(xor(a.hd, b.hd)) / 64 ELSE 0 END AS hd, (a.ink % 11 >= 5 AND b.ink % 11 >= 5) AS inked,
  CASE WHEN a.ink % 7 >= 3 AND b.ink % 7 >= 3 THEN 1 - bit_count(xor(a.ft, b.ft)) / 64 ELSE 0 END AS ft, a.ink % 2 = b.ink % 2 AS same FROM v a JOIN v b ON b.page_id = a.page_id + 1)
SELECT a, b, round(greatest(0.45 * g + 0.25 * v + 0.20 * hd + 0.05 * ft + 0.05 * CAST(same AS INTEGER), CASE WHEN inked THEN 0.72 * hd + 0.28 * g ELSE 0 END), 6) AS score FROM p"""
)
def layout_pair_scores(spark, sf):
    """Consecutive pages; parts of a digest stand in for the layout signatures of rendered pages."""
    h = F.sha2("html", 256)
    part = lambda i: F.conv(F.substring(h, 1 + 16 * i, 16), 16, -10).cast("long")
    ink = F.length("html")
    rows = table(spark, sf, "pages").select(
        "page_id", part(0).alias("geometry"), part(1).alias("visual"), part(2).alias("header"), part(3).alias("footer"),
        (ink % 11).alias("header_ink"), (ink % 7).alias("footer_ink"), (ink % 2).alias("sequence"),
    )
    l, r = rows.alias("l"), rows.alias("r")
    names = ("geometry", "visual", "header", "footer", "header_ink", "footer_ink")
    side = lambda s: {n: F.col(f"{s}.{n}") for n in names}
    scored = N.layout_score(side("l"), side("r"), F.col("l.sequence") == F.col("r.sequence"))
    return l.join(r, F.col("r.page_id") == F.col("l.page_id") + 1).select(
        F.col("l.page_id").alias("a"), F.col("r.page_id").alias("b"), F.round(scored["score"], 6).alias("score")
    )


@query(
    """SELECT (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS unlabelled,
(SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)) AS orphans,
(SELECT count(*) FROM documents WHERE NOT regexp_matches(text, '[\\p{L}\\p{N}_]')) AS without_signature"""
)
def derived_coverage(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    counts = [
        docs.join(labels, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("unlabelled")),
        labels.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans")),
        docs.filter(~F.col("text").rlike(r"[\p{L}\p{N}_]")).agg(F.count(F.lit(1)).alias("without_signature")),
    ]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # three single rows


# --- lexical -----------------------------------------------------------------------------------------

TERMS = [
    (0, "onenth"), (0, "thereand"), (1, "the"), (1, "oneds"), (2, "der"), (2, "und"), (2, "elle"),
    (3, "tion"), (3, "that"), (3, "with"), (3, "nowhereword"),
]
BM25 = f"""
q(query_id, term) AS (VALUES {', '.join(map(str, TERMS))}),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
c AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
tf AS (SELECT doc_id, term, len(w) AS dl, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
idf AS (SELECT term, greatest(CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END, 1e-6) AS idf FROM tf, c GROUP BY term, n),
scored AS (SELECT query_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS matched FROM tf JOIN q USING (term) JOIN idf USING (term), c GROUP BY ALL)"""


def terms(spark):
    return spark.createDataFrame(TERMS, "query_id long, term string")


def bm25_scores(spark, sf):
    docs = table(spark, sf, "documents")
    return R.bm25(R.postings(docs, "doc_id", "text", terms(spark)), docs, terms(spark), "doc_id", "text")


@query(
    f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 20"
)
def bm25_topk(spark, sf):
    rows = bm25_scores(spark, sf).select("query_id", "doc_id", F.round("score", 6).alias("score"))
    return R.top(rows, ["query_id"], [F.desc("score"), F.asc("doc_id")], 20)


@query(
    f"""WITH {BM25}, k AS (SELECT query_id, count(*) AS terms FROM q GROUP BY query_id),
t AS (SELECT s.*, CASE WHEN matched = terms THEN 0 WHEN matched >= 2 AND terms BETWEEN 3 AND 5 THEN 1 END AS tier FROM scored s JOIN k USING (query_id))
SELECT query_id, doc_id, round(score, 6) AS score, tier FROM t WHERE tier IS NOT NULL AND tier = (SELECT min(tier) FROM t u WHERE u.query_id = t.query_id)"""
)
def lexical_fallback_ladder(spark, sf):
    found = R.lexical_ladder(bm25_scores(spark, sf), terms(spark), "doc_id")
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "tier")


@query(
    f"WITH {BM25} SELECT 'fts_' || d.source AS ranking, s.query_id, s.doc_id, row_number() OVER (PARTITION BY d.source, query_id ORDER BY round(score, 6) DESC, s.doc_id) AS rank FROM scored s JOIN documents d USING (doc_id) QUALIFY rank <= 3"
)
def per_source_rankings(spark, sf):
    rows = bm25_scores(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    rows = rows.withColumn("ranking", F.concat(F.lit("fts_"), "source"))
    found = R.top(rows, ["ranking", "query_id"], [F.desc(F.round("score", 6)), F.asc("doc_id")], 3)
    return found.select("ranking", "query_id", "doc_id", "rank")


@query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)
SELECT doc_id, len(list_distinct(list_filter(w, lambda x: x IN ('and', 'the', 'that')))) AS matched, round(len(list_distinct(list_filter(w, lambda x: x IN ('and', 'the', 'that')))) / 3, 6) AS coverage,
  contains(' ' || array_to_string(w, ' ') || ' ', ' and the that ') AS phrase FROM w WHERE len(list_filter(w, lambda x: x IN ('and', 'the', 'that'))) > 0"""
)
def query_term_coverage(spark, sf):
    found = R.term_support(table(spark, sf, "documents"), "doc_id", "text", ["and", "the", "that"])
    return found.select("doc_id", F.col("matched").cast("long").alias("matched"), F.round("coverage", 6).alias("coverage"), "phrase")


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS place FROM w),
l AS (SELECT doc_id, place, max(place) FILTER (t = 'and') OVER o AS a, max(place) FILTER (t = 'the') OVER o AS b, max(place) FILTER (t = 'that') OVER o AS c
  FROM p WHERE t IN ('and', 'the', 'that') WINDOW o AS (PARTITION BY doc_id ORDER BY place))
SELECT doc_id, min(CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN place - least(a, b, c) + 1 END) AS span FROM l GROUP BY doc_id"""
)
def minimum_term_span(spark, sf):
    return R.term_support(table(spark, sf, "documents"), "doc_id", "text", ["and", "the", "that"]).select("doc_id", "span")


@query("SELECT doc_id, substr(text, greatest(1, instr(lower(text), 'tion ') - 80), 240) AS snippet FROM documents WHERE instr(lower(text), 'tion ') > 0 AND instr(lower(text), 'été') = 0")
def substring_scan(spark, sf):
    rows = table(spark, sf, "documents").filter(F.lower("text").contains("tion ") & ~F.lower("text").contains("été"))
    return rows.select("doc_id", R.centred_snippet(F.col("text"), "tion ").alias("snippet"))


@query(
    """SELECT 'path' AS kind, page_id AS owner, url AS term FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 50 = 0)
UNION ALL SELECT 'name', page_id, regexp_extract(url, '[^/]*$') FROM pages WHERE lower(regexp_extract(url, '[^/]*$')) IN (SELECT lower(regexp_extract(url, '[^/]*$')) FROM pages WHERE page_id % 60 = 0)
UNION ALL SELECT 'hash', doc_id, sha256(text) FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 97 = 0)"""
)
def exact_terms_lookup(spark, sf):
    pages, docs = table(spark, sf, "pages"), table(spark, sf, "documents")
    name = F.element_at(F.split("url", "/"), -1)
    named = pages.select(F.lit("name").alias("kind"), F.col("page_id").alias("owner"), name.alias("term"), F.lower(name).alias("key"))
    paths = pages.select(F.lit("path").alias("kind"), F.col("page_id").alias("owner"), F.col("url").alias("term"), F.col("url").alias("key"))
    digest = F.sha2("text", 256)
    hashed = docs.select(F.lit("hash").alias("kind"), F.col("doc_id").alias("owner"), digest.alias("term"), digest.alias("key"))
    wanted = (
        pages.filter("page_id % 50 = 0").select(F.lit("path").alias("kind"), F.col("url").alias("key"))
        .unionByName(pages.filter("page_id % 60 = 0").select(F.lit("name").alias("kind"), F.lower(name).alias("key")))
        .unionByName(docs.filter("doc_id % 97 = 0").select(F.lit("hash").alias("kind"), digest.alias("key")))
    )
    everything = paths.unionByName(named).unionByName(hashed)
    return everything.join(wanted.distinct(), ["kind", "key"], "left_semi").select("kind", "owner", "term")


# --- vectors -----------------------------------------------------------------------------------------

SCORED = """
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
scored AS (SELECT q.vec_id AS query_id, u.vec_id, u.label, list_sum(list_transform(list_zip(q.e, u.e), lambda z: z[1] * z[2])) / (q.n * u.n) AS score FROM u q, u WHERE q.vec_id % 100 = 0)"""


def vector_queries(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def all_scores(spark, sf):
    """Every vector against every query vector (ids divisible by 100), in one block of stated queries."""
    block = [(r[0], list(r[1])) for r in vector_queries(spark, sf).orderBy("query_id").collect()]
    return R.score_block(table(spark, sf, "embeddings"), "vec_id", "embedding", block, ["label"])


@query(f"WITH {SCORED} SELECT query_id, vec_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM scored QUALIFY rank <= 20")
def vector_topk(spark, sf):
    found = R.vector_search(table(spark, sf, "embeddings"), vector_queries(spark, sf), "vec_id", "embedding", 20)
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


@query(
    f"""WITH {SCORED}, b AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY round(score, 6) DESC, vec_id) = 1)
SELECT query_id, label, vec_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM b QUALIFY rank <= 5"""
)
def vector_best_per_label(spark, sf):
    found = R.best_per_item(all_scores(spark, sf), ["label"], 5, "vec_id")
    return found.select("query_id", "label", "vec_id", F.round("score", 5).alias("score"), "rank")


@query(
    f"""WITH {SCORED}, r AS (SELECT *, label * 0.05 - 0.1 AS floor, score >= label * 0.05 - 0.1 AS kept FROM scored)
SELECT query_id, vec_id, round(score, 5) AS score, bool_and(NOT kept) OVER (PARTITION BY query_id) AS abstains FROM r QUALIFY kept"""
)
def score_floor_filter(spark, sf):
    floors = spark.createDataFrame([(i, i * 0.05 - 0.1) for i in range(10)], "label int, floor double")
    kept = R.calibrated(all_scores(spark, sf).withColumn("label", F.col("label").cast("int")), floors, "label")
    return kept.filter("kept").select("query_id", "vec_id", F.round("score", 5).alias("score"), "abstains")


@query(
    f"""WITH {SCORED}, own AS (SELECT s.*, s.label = q.label AS positive FROM scored s JOIN embeddings q ON s.query_id = q.vec_id)
SELECT round(min(score) FILTER (positive), 5) AS least_positive, round(max(score) FILTER (NOT positive), 5) AS most_negative,
 CASE WHEN min(score) FILTER (positive) > max(score) FILTER (NOT positive) THEN round((min(score) FILTER (positive) + max(score) FILTER (NOT positive)) / 2, 5) END AS floor FROM own"""
)
def image_calibration(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    rows = all_scores(spark, sf).join(labels.filter("query_id % 100 = 0"), "query_id")
    found = R.floor_between(rows, F.col("label") == F.col("own"))
    return found.select(*[F.round(c, 5).alias(c) for c in found.columns])


@query(
    f"""WITH {SCORED}, v2 AS (SELECT query_id // 200 AS channel, vec_id, max(score) AS score FROM scored GROUP BY ALL)
SELECT channel, vec_id, round(score, 5) AS score FROM v2 QUALIFY row_number() OVER (PARTITION BY channel ORDER BY round(score, 6) DESC, vec_id) <= 10"""
)
def variant_merge(spark, sf):
    """Queries in pairs are variants of one: the best score of an item over the variants counts once."""
    rows = all_scores(spark, sf).withColumn("channel", F.floor(F.col("query_id") / 200))
    best = rows.groupBy("channel", "vec_id").agg(F.max("score").alias("score"))
    found = R.top(best, ["channel"], [F.desc(F.round("score", 6)), F.asc("vec_id")], 10)
    return found.select("channel", "vec_id", F.round("score", 5).alias("score"))


@query(
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id, p.label AS concept, p.label % 3 AS family, list_sum(list_transform(list_zip(e, c), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(c, lambda x: x * x)))) AS score FROM v, p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, family ORDER BY round(score, 6) DESC, concept) AS own FROM s WHERE round(score, 6) > 0)
SELECT vec_id, concept, round(score, 5) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY own > 1, round(score, 6) DESC, concept) AS place FROM r QUALIFY place <= 4"""
)
def prototype_classify(spark, sf):
    """Label centroids are the concepts' prototypes: the best of each family first, then the rest up to four."""
    rows = table(spark, sf, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    block = [(r[0], list(r[1])) for r in centres.orderBy("label").collect()]  # one row a label
    scored = R.score_block(rows, "vec_id", "embedding", block).filter(F.round("score", 6) > 0)
    scored = scored.select("vec_id", F.col("query_id").alias("concept"), (F.col("query_id") % 3).alias("family"), "score")
    order = [F.desc(F.round("score", 6)), F.asc("concept")]
    own = R.top(scored, ["vec_id", "family"], order, 1_000_000, "own")
    found = R.top(own, ["vec_id"], [F.asc(F.col("own") > 1), *order], 4, "place")
    return found.select("vec_id", "concept", F.round("score", 5).alias("score"), "place")


@query(
    f"""WITH {SCORED}, t AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) <= 10)
SELECT t.query_id, t.vec_id, c.doc_id IS NULL AS stale FROM t LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 > 0) c ON t.vec_id = c.doc_id"""
)
def snapshot_currency(spark, sf):
    found = R.vector_search(table(spark, sf, "embeddings"), vector_queries(spark, sf), "vec_id", "embedding", 10)
    current = table(spark, sf, "documents").filter("doc_id % 3 > 0").select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("current"))
    return found.join(current, "vec_id", "left").select("query_id", "vec_id", F.col("current").isNull().alias("stale"))


# --- fusion ------------------------------------------------------------------------------------------

RANKINGS = """
rankings AS (
  SELECT conv_id % 7 AS query_id, CASE role WHEN 'user' THEN 'lexical' ELSE 'semantic' END AS ranking, 'i' || (turn * 13 + conv_id) % 37 AS item_id, conv_id * 1000 + turn AS position FROM conversations)"""


def rankings(spark, sf):
    rows = table(spark, sf, "conversations")
    return rows.select(
        (F.col("conv_id") % 7).alias("query_id"),
        F.when(F.col("role") == "user", "lexical").otherwise("semantic").alias("ranking"),
        F.concat(F.lit("i"), ((F.col("turn") * 13 + F.col("conv_id")) % 37).cast("string")).alias("item_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("position"),
    )


RRF = (
    RANKINGS
    + """,
f AS (SELECT query_id, ranking, item_id, min(position) AS position FROM rankings GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, ranking ORDER BY position) AS rank FROM f),
fused AS (SELECT query_id, item_id, sum(CASE ranking WHEN 'lexical' THEN 1.5 ELSE 1.0 END / (60 + rank)) AS score FROM r GROUP BY ALL)"""
)


def fused(spark, sf):
    return R.weighted_rrf(rankings(spark, sf), {"lexical": 1.5, "semantic": 1.0})


@query(f"WITH {RRF} SELECT query_id, item_id, round(score, 9) AS score FROM fused")
def rrf_fusion(spark, sf):
    return fused(spark, sf).select("query_id", "item_id", F.round("score", 9).alias("score"))


CANDIDATES = """
candidates AS (
  SELECT conv_id % 7 AS query_id, CASE WHEN role = 'user' THEN 'lexical' ELSE 'semantic' END AS ranking, conv_id * 100 + turn + 1 AS source_rank,
    'r' || conv_id % 19 AS resource, 'v1' AS revision, 'e' || conv_id || '-' || turn AS evidence, turn > 4 AS coherent, turn = 1 AS hard_mismatch,
    CASE WHEN conv_id % 11 = 0 THEN 'DUPLICATE' WHEN conv_id % 13 = 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS disposition,
    CASE WHEN turn = 3 THEN 'HISTORICAL' ELSE 'CURRENT' END AS state FROM conversations),
visible AS (SELECT * FROM candidates WHERE disposition = 'ACTIVE' AND state = 'CURRENT'),
kept AS (SELECT * FROM visible v WHERE NOT (hard_mismatch AND (SELECT bool_or(coherent) FROM visible u WHERE u.query_id = v.query_id))),
evidence AS (SELECT query_id, resource, revision, evidence, sum(1 / (60 + source_rank)) AS score, list_sort(list_distinct(list(ranking))) AS rankings FROM kept GROUP BY ALL)"""


def candidates(spark, sf):
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf, "conversations").select(
        (conv % 7).alias("query_id"),
        F.when(F.col("role") == "user", "lexical").otherwise("semantic").alias("ranking"),
        (conv * 100 + turn + 1).alias("source_rank"),
        F.concat(F.lit("r"), (conv % 19).cast("string")).alias("resource"),
        F.lit("v1").alias("revision"),
        F.concat(F.lit("e"), conv.cast("string"), F.lit("-"), turn.cast("string")).alias("evidence"),
        F.lit(None).cast("string").alias("locator"),
        F.lit("").alias("snippet"),
        F.when(conv % 11 == 0, "DUPLICATE").when(conv % 13 == 0, "SUPERSEDED").otherwise("ACTIVE").alias("disposition"),
        F.when(turn == 3, "HISTORICAL").otherwise("CURRENT").alias("state"),
        (turn > 4).alias("coherent"),
        (turn == 1).alias("hard_mismatch"),
    )


@query(f"WITH {CANDIDATES} SELECT query_id, resource, revision, evidence, round(score, 9) AS score, rankings FROM evidence")
def evidence_rrf(spark, sf):
    return R.evidence_rrf(candidates(spark, sf)).withColumn("score", F.round("score", 9))


@query(
    f"""WITH {CANDIDATES}, s AS (SELECT query_id, 'r' || k AS resource, k + 1 AS source_rank FROM (SELECT DISTINCT query_id FROM evidence), generate_series(0, 9) g(k)),
b AS (SELECT query_id, resource, min_by(evidence, (-round(score, 9), evidence)) AS evidence FROM evidence GROUP BY ALL)
SELECT e.query_id, e.resource, e.evidence, round(e.score + CASE WHEN b.evidence = e.evidence THEN coalesce(0.5 / (60 + s.source_rank), 0) ELSE 0 END, 9) AS score
FROM evidence e JOIN b USING (query_id, resource) LEFT JOIN s USING (query_id, resource)"""
)
def discovery_boost(spark, sf):
    found = R.evidence_rrf(candidates(spark, sf))
    signals = found.select("query_id").distinct().select(
        "query_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"), F.lit("title").alias("source"), F.lit("v1").alias("revision")
    )
    signals = signals.withColumns({"resource": F.concat(F.lit("r"), F.col("k").cast("string")), "source_rank": F.col("k") + 1})
    out = R.discovery_boost(found, signals, 0.5)
    return out.select("query_id", "resource", "evidence", F.round("score", 9).alias("score"))


@query(
    f"""WITH {CANDIDATES}, h AS (SELECT *, substr(evidence, -1) = '2' AS counter FROM evidence),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, resource ORDER BY counter, round(score, 9) DESC, evidence) AS own_rank FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY counter, round(score, 9) DESC, evidence) AS rank FROM o WHERE own_rank <= 2 QUALIFY rank <= 8)
SELECT query_id, resource, evidence, counter, rank, (SELECT count(*) FROM h WHERE h.query_id = k.query_id) - count(*) OVER (PARTITION BY query_id) AS omitted FROM k"""
)
def diversity_cap(spark, sf):
    hits = R.evidence_rrf(candidates(spark, sf)).withColumn("counter", F.col("evidence").endswith("2"))
    return R.diverse(hits, 2, 8, ["evidence"]).select("query_id", "resource", "evidence", "counter", "rank", "omitted")


@query()
def overlap_clusters(spark, sf):
    rows = table(spark, sf, "conversations").select(
        (F.col("conv_id") % 7).alias("query_id"),
        F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("resource"),
        F.lit("v1").alias("revision"),
        F.lit("body").alias("section"),
        F.concat(F.lit("e"), F.col("turn").cast("string")).alias("evidence"),
        (F.col("turn") * 60).alias("start"),
        (F.col("turn") * 60 + F.length("text") % 100).cast("long").alias("end"),
        (1.0 / (60 + F.length("text"))).alias("score"),
    )
    return R.cluster_overlaps(rows, 10).withColumn("score", F.round("score", 9))


@query(
    """WITH RECURSIVE h AS (SELECT conv_id AS query_id, turn AS rank, 'e' || turn AS evidence, length(text) AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (SELECT query_id, rank, evidence, chars, n, chars <= 900 AS packed, CASE WHEN chars <= 900 THEN 900 - chars ELSE 900 END AS rest FROM h WHERE n = 1
  UNION ALL SELECT h.query_id, h.rank, h.evidence, h.chars, h.n, h.chars <= r.rest, CASE WHEN h.chars <= r.rest THEN r.rest - h.chars ELSE r.rest END
  FROM r JOIN h ON h.query_id = r.query_id AND h.n = r.n + 1)
SELECT query_id, rank, evidence, chars, packed, rest AS "left" FROM r"""
)
def context_packing(spark, sf):
    hits = table(spark, sf, "conversations").select(
        "conv_id", F.col("turn").alias("rank"), F.concat(F.lit("e"), F.col("turn").cast("string")).alias("evidence"), F.length("text").cast("long").alias("chars")
    )
    return R.pack_context(hits.withColumnRenamed("conv_id", "query_id"), 900)


JUDGED = (
    RRF
    + """,
ranked AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM fused),
judged AS (SELECT q AS query_id, 'i' || i AS item_id, (q * 5 + i) % 4 AS grade FROM generate_series(0, 8) a(q), generate_series(0, 36, 3) b(i)),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item_id) AS r FROM judged WHERE grade > 0),
ideal AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN r <= 10 THEN (2 ** grade - 1) / log2(r + 1) END) AS ideal FROM g GROUP BY 1),
hits AS (SELECT query_id, count(*) AS found, min(rank) AS first, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg FROM ranked JOIN g USING (query_id, item_id) WHERE rank <= 10 GROUP BY 1),
metrics AS (SELECT q.query_id, CASE WHEN relevant > 0 THEN coalesce(found / relevant, 0) END AS recall, CASE WHEN relevant > 0 THEN coalesce(1 / first, 0) END AS mrr,
  CASE WHEN relevant > 0 THEN coalesce(least(1, dcg / ideal), 0) END AS ndcg FROM (SELECT DISTINCT query_id FROM ranked UNION SELECT query_id FROM judged) q LEFT JOIN ideal USING (query_id) LEFT JOIN hits USING (query_id))"""
)


def metrics(spark, sf):
    ranked = R.top(fused(spark, sf), ["query_id"], [F.desc(F.round("score", 9)), F.asc("item_id")], 10)
    judged = spark.createDataFrame([(q, f"i{i}", (q * 5 + i) % 4) for q in range(9) for i in range(0, 37, 3)], "query_id long, item_id string, grade int")
    return R.retrieval_metrics(ranked, judged, 10)


@query(f"WITH {JUDGED} SELECT query_id, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM metrics")
def retrieval_metrics(spark, sf):
    found = metrics(spark, sf)
    return found.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query(f"WITH {JUDGED} SELECT count(*) AS cases, round(avg(recall), 6) AS mean_recall, round(avg(mrr), 6) AS mean_mrr, round(avg(ndcg), 6) AS mean_ndcg FROM metrics")
def suite_report(spark, sf):
    return R.suite_report(metrics(spark, sf))


@query(
    f"""WITH {RANKINGS}, e AS (SELECT q AS query_id, r AS ranking FROM generate_series(0, 8) a(q), (VALUES ('lexical'), ('semantic'), ('catalogue')) b(r) WHERE r <> 'catalogue' OR q % 4 = 0),
m AS (SELECT query_id, list_sort(list(ranking)) AS missing FROM e WHERE NOT EXISTS (SELECT 1 FROM rankings x WHERE x.query_id = e.query_id AND x.ranking = e.ranking) GROUP BY 1)
SELECT q.query_id, CASE WHEN missing IS NULL THEN 'complete' ELSE 'partial' END AS status, coalesce(missing, []) AS missing FROM (SELECT DISTINCT query_id FROM e) q LEFT JOIN m USING (query_id)"""
)
def completeness_gaps(spark, sf):
    rows = [(q, r) for q in range(9) for r in ("lexical", "semantic", "catalogue") if r != "catalogue" or q % 4 == 0]
    expected = spark.createDataFrame(rows, "query_id long, ranking string")
    return R.completeness(expected, rankings(spark, sf).select("query_id", "ranking").distinct())
