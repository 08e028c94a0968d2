"""The relational slice: predicates, joins, aggregates, windows, ordering and sets over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import relational as R
from quarry.plans.registry import query
from quarry.sources.sinks import keep_latest, outbox_page, report, upsert
from quarry.sources.tables import excluded, files_of, keyset_page, published, table, union_sources


@query("SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_phone, 'unknown' AS c_segment_note FROM customer")
def legacy_column_projection(spark, sf):
    wanted = {"c_custkey": None, "c_name": None, "c_phone": None, "c_segment_note": "unknown"}
    out = R.legacy_projection(table(spark, sf, "customer"), wanted)
    return out.withColumn("c_phone", F.col("c_phone").cast("string"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building' AND c_nationkey BETWEEN 3 AND 12")
def catalogue_filter(spark, sf):
    rows = R.equality_filter(table(spark, sf, "customer"), {"c_mktsegment": "bUILDING", "c_name": None})
    return rows.filter(F.col("c_nationkey").between(3, 12)).select("c_custkey", "c_mktsegment")


@query("SELECT doc_id, lang, source, n_chars FROM documents ORDER BY lang ASC NULLS FIRST, source ASC NULLS FIRST, n_chars DESC, doc_id LIMIT 50")
def catalogue_page(spark, sf):
    order = [F.asc_nulls_first("lang"), F.asc_nulls_first("source"), F.desc("n_chars"), F.asc("doc_id")]
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").orderBy(*order).limit(50)


@query("SELECT page_id, url FROM pages WHERE url = 'https://example.com' OR left(url, 20) = 'https://example.com/' OR instr(url, '/a') > 0 OR lower(url) LIKE '%.html'")
def path_predicates(spark, sf):
    url = F.col("url")
    scope = (url == "https://example.com") | url.startswith("https://example.com/")
    return table(spark, sf, "pages").filter(scope | (F.instr(url, "/a") > 0) | F.lower(url).endswith(".html")).select("page_id", "url")


@query("SELECT page_id, url, regexp_extract(url, '[^/]*$') AS basename FROM pages")
def basename(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.element_at(F.split("url", "/"), -1).alias("basename"))


@query(
    """SELECT event_id, event_type, user_id, value FROM events
WHERE event_type IN ('error', 'purchase') AND (user_id, event_id) > (40, 100) ORDER BY user_id, event_id LIMIT 75"""
)
def keyset_page_events(spark, sf):
    rows = table(spark, sf, "events").filter(F.col("event_type").isin("error", "purchase"))
    return keyset_page(rows, ["user_id", "event_id"], [40, 100], 75).select("event_id", "event_type", "user_id", "value")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_discount > 0.05 AND l.l_returnflag = 'R')")
def semi_exists(spark, sf):
    lines = table(spark, sf, "lineitem").filter("l_discount > 0.05 and l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def anti_not_exists(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_anti")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def in_subquery(spark, sf):
    lines = table(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").select("p_partkey").join(lines, "p_partkey", "left_semi")


@query(
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events
WHERE CAST(json_extract(props, '$.k') AS BIGINT) IN (1, 5, 9)"""
)
def json_array_exists(spark, sf):
    rows = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    # an EXISTS over the values: the JSON is parsed once and tested against the list
    hit = F.exists(F.array(*map(F.lit, (1, 5, 9))), lambda x: x == F.col("k"))
    return rows.filter(hit).select("event_id", "k", F.expr("try_parse_json(props) is not null").alias("valid"))


@query(
    """SELECT priority, count(*) AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM (
  SELECT value, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS priority FROM events)
GROUP BY priority"""
)
def case_priority(spark, sf):
    kind = F.col("event_type")
    priority = F.when(kind == "error", 0).when(kind == "purchase", 1).when(kind == "signup", 2).otherwise(3)
    rows = table(spark, sf, "events").select(priority.alias("priority"), "value")
    return rows.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("large"))


@query("SELECT count(*) AS seen, count(*) FILTER (n_chars > 0 AND n_chars <= 5000) AS admitted, count(*) FILTER (n_chars > 5000) AS too_large FROM documents")
def size_admission(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if((n > 0) & (n <= 5000)).alias("admitted"),
        F.count_if(n > 5000).alias("too_large"),
    )


@query("SELECT doc_id, source FROM documents WHERE NOT (source IN ('src1', 'src2') OR starts_with(source, 'src1') OR source LIKE '%9')")
def exclusion_policy(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source")
    return rows.filter(~excluded(F.col("source"), names=["src1", "src2"], prefixes=["src1"], suffixes=["9"]))


@query(
    """WITH redlist(token) AS (VALUES ('index.html'), ('b'), ('0'))
SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages WHERE lower(regexp_extract(url, '[^/]*$')) IN (SELECT token FROM redlist)
   OR lower(regexp_extract(url, '[^.]*$')) IN (SELECT token FROM redlist)"""
)
def redlist_match(spark, sf):
    red = spark.createDataFrame([("index.html",), ("b",), ("0",)], "token string")
    name = F.element_at(F.split("url", "/"), -1)
    keys = F.array(F.lower(name), F.lower(F.element_at(F.split("url", r"\."), -1)))
    rows = table(spark, sf, "pages").select("page_id", name.alias("name"), F.explode(F.array_distinct(keys)).alias("token"))
    return rows.join(F.broadcast(red), "token", "left_semi").select("page_id", "name").distinct()


@query(
    """SELECT n_name, r_name, count(*) AS orders, sum(o_totalprice) AS total FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus = 'F' GROUP BY n_name, r_name"""
)
def star_join(spark, sf):
    orders = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_custkey", "o_totalprice")
    rows = orders.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))


@query(
    """SELECT a.l_orderkey, a.l_linenumber FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_shipdate = b.l_shipdate
WHERE b.l_quantity > 45"""
)
def multi_key_join(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    rows = table(spark, sf, "lineitem")
    return rows.select(*keys).join(rows.filter("l_quantity > 45").select(*keys), keys).select("l_orderkey", "l_linenumber")


@query(
    """SELECT c_custkey, count(o_orderkey) AS orders, coalesce(sum(o_totalprice), 0) AS total, max(o_orderdate) AS latest
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"""
)
def left_outer_optional(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"), F.max("o_orderdate").alias("latest")
    )
    rows = table(spark, sf, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("total", F.lit(0.0)).alias("total"), "latest")


@query(
    """WITH expected(kind, weight) AS (VALUES ('error', 3), ('click', 1), ('signup', 2))
SELECT event_id, event_type, weight, value * weight AS weighted FROM expected JOIN events ON event_type = kind"""
)
def value_relation_join(spark, sf):
    expected = spark.createDataFrame([("error", 3), ("click", 1), ("signup", 2)], "event_type string, weight long")
    rows = table(spark, sf, "events").join(F.broadcast(expected), "event_type")
    return rows.select("event_id", "event_type", "weight", (F.col("value") * F.col("weight")).alias("weighted"))


@query(
    """WITH right_side AS (SELECT doc_id AS r_id, lang, source FROM documents),
left_side AS (SELECT page_id AS l_id, ['en','de','fr','es'][1 + page_id % 4] AS lang, 'src' || (page_id % 23) AS source FROM pages),
s AS (SELECT lang, source, count(*) AS n, min(r_id) AS r_id FROM right_side GROUP BY ALL),
w AS (SELECT source, count(*) AS n, min(r_id) AS r_id FROM right_side GROUP BY ALL)
SELECT l_id, CASE WHEN s.n = 1 THEN s.r_id WHEN s.n IS NULL AND w.n = 1 THEN w.r_id END AS r_id,
       CASE WHEN s.n = 1 THEN 'strict' WHEN s.n > 1 THEN 'ambiguous' WHEN w.n = 1 THEN 'loose' WHEN w.n > 1 THEN 'ambiguous' ELSE 'missing' END AS status
FROM left_side l LEFT JOIN s ON l.lang = s.lang AND l.source = s.source LEFT JOIN w ON l.source = w.source"""
)
def cascaded_counterpart(spark, sf):
    right = table(spark, sf, "documents").select(F.col("doc_id").alias("r_id"), "lang", "source")
    lang = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("page_id") % 4 + 1).cast("int"))
    left = table(spark, sf, "pages").select(
        F.col("page_id").alias("l_id"), lang.alias("lang"), F.concat(F.lit("src"), (F.col("page_id") % 23).cast("string")).alias("source")
    )
    return R.cascaded_match(left, right, ["lang", "source"], ["source"], "l_id", "r_id")


@query(
    """SELECT user_id, event_id, event_type, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"""
)
def latest_row(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    newest = rows.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"))
    return newest.select("user_id", "x.event_id", "x.event_type", "x.ts")


@query(
    """WITH roots(root) AS (VALUES ('/src1'), ('/src1/doc_1'), ('/src2'), ('/src12')),
p AS (SELECT '/' || source || '/doc_' || doc_id AS path FROM documents)
SELECT path, max_by(root, length(root)) AS root FROM p JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY path"""
)
def nearest_root(spark, sf):
    roots = spark.createDataFrame([("/src1",), ("/src1/doc_1",), ("/src2",), ("/src12",)], "root string")
    paths = table(spark, sf, "documents").select(
        F.concat(F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string")).alias("path")
    )
    return R.nearest_root(paths, roots)


@query(
    """SELECT a, doc_id AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS a FROM documents WHERE text IS NOT NULL) WHERE a < doc_id"""
)
def content_compare_join(spark, sf):
    """Every copy beside the first document with its content: a hot text makes one row a copy, not one a pair."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("b"), F.col("text").alias("tb"), "n_chars", F.sha2("text", 256).alias("digest"))
    first = rows.groupBy("n_chars", "digest").agg(F.min("b").alias("a"), F.min_by("tb", "b").alias("ta"))
    return rows.join(first, ["n_chars", "digest"]).filter("a < b and ta = tb").select("a", "b")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600")
def group_having(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 600")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10")
def two_key_having(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")).filter("n > 10")


@query("SELECT CAST(sum(n) AS BIGINT) AS total, max(n) AS largest, count(*) AS groups FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def nested_aggregate(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("total"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("groups"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus ORDER BY o_orderstatus")
def status_histogram(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).orderBy("o_orderstatus")


@query(
    """SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases,
sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS spent, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id"""
)
def conditional_counts(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(kind == "error").alias("errors"),
        F.count_if(kind == "purchase").alias("purchases"),
        F.sum(F.when(kind == "purchase", F.col("value")).otherwise(0)).alias("spent"),
        F.count_distinct("event_type").alias("kinds"),
    )


@query("SELECT coalesce(max(o_orderkey), 0) AS head, coalesce(min(o_orderdate), TIMESTAMP '1970-01-01') AS first, count(*) AS n, max(o_orderkey) + 1 AS next_id FROM orders")
def heads_and_floors(spark, sf):
    return table(spark, sf, "orders").agg(
        F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("head"),
        F.coalesce(F.min("o_orderdate"), F.lit("1970-01-01").cast("timestamp_ntz")).alias("first"),
        F.count(F.lit(1)).alias("n"),
        (F.max("o_orderkey") + 1).alias("next_id"),
    )


@query("SELECT p_brand, p_type, min(p_name) AS representative, min(p_partkey) AS first_key, count(*) AS members FROM part GROUP BY p_brand, p_type")
def group_representative(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand", "p_type").agg(
        F.min("p_name").alias("representative"), F.min("p_partkey").alias("first_key"), F.count(F.lit(1)).alias("members")
    )


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def argmax_group(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey")
    return rows.agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_totalprice", "o_orderkey").alias("o_totalprice"))


@query("SELECT DISTINCT l_shipdate, l_returnflag FROM lineitem WHERE l_quantity < 3")
def select_distinct(spark, sf):
    return table(spark, sf, "lineitem").filter("l_quantity < 3").select("l_shipdate", "l_returnflag").distinct()


@query(
    """SELECT event_type, count(*) AS n, sum(value) AS total, min(value) AS least, max(value) AS most, avg(value) AS mean,
quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type"""
)
def distribution_summary(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count("value").alias("n"),
        F.sum("value").alias("total"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.avg("value").alias("mean"),
        F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"),
        F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"),
    )


@query(
    """WITH d AS (SELECT sha256(concat_ws(chr(30), 'V' || octet_length(encode(CAST(o_orderkey AS VARCHAR))) || ':' || o_orderkey,
  'V' || octet_length(encode(CAST(o_custkey AS VARCHAR))) || ':' || o_custkey, 'V' || octet_length(encode(o_orderstatus)) || ':' || o_orderstatus)) AS h FROM orders)
SELECT count(*) AS n_rows, """
    + ", ".join(
        f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS UBIGINT) AS HUGEINT)) % 4294967296 AS BIGINT) AS word{i}" for i in range(4)
    )
    + " FROM d"
)
def table_digest(spark, sf):
    return R.table_digest(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query(
    """SELECT source, CAST(sum(k) AS BIGINT) AS n, list(lang || '=' || k ORDER BY lang) AS langs FROM (
  SELECT source, lang, count(*) AS k FROM documents GROUP BY ALL) GROUP BY source"""
)
def counter_maps(spark, sf):
    per = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("k"))
    entries = F.sort_array(F.collect_list(F.concat_ws("=", "lang", F.col("k").cast("string"))))
    return per.groupBy("source").agg(F.sum("k").alias("n"), entries.alias("langs"))


@query("SELECT l_shipdate, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1)")
def count_over_total(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_shipdate").agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("total"))))


@query("SELECT c_custkey, c_name, count(*) OVER () AS total FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 25")
def count_over_page(spark, sf):
    rows = table(spark, sf, "customer").filter("c_acctbal < 0").select("c_custkey", "c_name")
    return R.with_total(rows).orderBy("c_custkey").limit(25)


@query("SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 5")
def cap_per_group(spark, sf):
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return R.top_per_key(rows, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 5)


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS own FROM orders),
k AS (SELECT * FROM r WHERE own <= 2 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40)
SELECT k.*, (SELECT count(*) FROM r) - (SELECT count(*) FROM k) AS omitted FROM k"""
)
def cap_then_limit(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    kept = R.top_per_key(rows, ["o_custkey"], order, 2, "own").orderBy(*order).limit(40)
    counts = rows.agg(F.count(F.lit(1)).alias("all")).crossJoin(kept.agg(F.count(F.lit(1)).alias("shown")))
    return kept.crossJoin(F.broadcast(counts)).withColumn("omitted", F.col("all") - F.col("shown")).drop("all", "shown")


@query(
    """SELECT user_id, event_type, min(pos) AS first_pos, row_number() OVER (PARTITION BY user_id ORDER BY min(pos)) AS item_rank FROM (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events) GROUP BY user_id, event_type"""
)
def rank_with_dedup(spark, sf):
    rows = R.ranked(table(spark, sf, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], "pos")
    first = rows.groupBy("user_id", "event_type").agg(F.min("pos").alias("first_pos"))
    return R.ranked(first, ["user_id"], [F.asc("first_pos")], "item_rank")


@query(
    """WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
w AS (SELECT conv_id, n, unnest(generate_series(0, least(n, 4) - 1)) AS j FROM (SELECT DISTINCT conv_id, n FROM n)),
p AS (SELECT conv_id, CAST(CASE WHEN n <= 4 THEN j ELSE round_even(CAST(j AS DOUBLE) * (n - 1) / 3, 0) END AS BIGINT) AS i FROM w)
SELECT n.conv_id, n.turn FROM n JOIN p ON n.conv_id = p.conv_id AND n.i = p.i"""
)
def even_subset(spark, sf):
    """Four evenly spaced turns of each conversation, ends included; a short one is taken whole."""
    by = Window.partitionBy("conv_id")
    rows = table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        (F.row_number().over(by.orderBy("turn")) - 1).cast("long").alias("i"),
        F.count(F.lit(1)).over(by).alias("n"),
    )
    picks = F.transform(F.array(*map(F.lit, range(4))), lambda j: F.bround(j * (F.col("n") - 1) / 3.0).cast("long"))
    return rows.filter((F.col("n") <= 4) | F.array_contains(picks, F.col("i"))).select("conv_id", "turn")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def top_k(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30)


@query(
    """SELECT doc_id, n_chars, substr(text, greatest(1, instr(text, ' the ') - 80), 240) AS snippet FROM (
  SELECT * FROM documents WHERE instr(text, ' the ') > 0 ORDER BY n_chars, doc_id LIMIT 20)"""
)
def late_materialisation(spark, sf):
    """Keys are ordered and cut first; texts are fetched for the survivors only."""
    rows = table(spark, sf, "documents")
    top = rows.filter(F.instr("text", " the ") > 0).select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(20)
    snippet = F.substring(F.col("text"), F.greatest(F.lit(1), F.instr("text", " the ") - 80), F.lit(240))
    return rows.join(F.broadcast(top.select("doc_id")), "doc_id").select("doc_id", "n_chars", snippet.alias("snippet"))


@query(
    """WITH u AS (SELECT 'orders' AS source_kind, o_orderkey AS record_id, o_orderstatus AS status FROM orders WHERE o_totalprice > 400000
UNION ALL SELECT 'lineitem', l_orderkey, l_linestatus FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT 'events', event_id, event_type FROM events WHERE value > 99)
SELECT source_kind, status, count(*) AS n FROM u GROUP BY ALL"""
)
def union_all_sources(spark, sf):
    sources = {
        "orders": table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("status")),
        "lineitem": table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("record_id"), F.col("l_linestatus").alias("status")),
        "events": table(spark, sf, "events").filter("value > 99").select(F.col("event_id").alias("record_id"), F.col("event_type").alias("status")),
    }
    return union_sources(sources).groupBy("source_kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    return a.union(b).union(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@query(
    """SELECT *, 'only_left' AS side FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')
UNION ALL SELECT *, 'only_right' FROM (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"""
)
def set_reconcile_except(spark, sf):
    a = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    b = table(spark, sf, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("k"))
    return R.set_differences(a, b)


@query(
    """WITH a AS (SELECT DISTINCT l_suppkey AS k, l_returnflag AS v FROM lineitem WHERE l_quantity < 5), b AS (SELECT DISTINCT l_suppkey AS k, l_returnflag AS v FROM lineitem WHERE l_quantity > 48),
f AS (SELECT coalesce(a.k, b.k) AS k, a.v AS av, b.v AS bv FROM a FULL JOIN b ON a.k = b.k AND a.v = b.v)
SELECT k, count(*) FILTER (bv IS NULL) AS missing_right, count(*) FILTER (av IS NULL) AS missing_left, bool_and(av IS NOT NULL AND bv IS NOT NULL) AS exact FROM f GROUP BY k"""
)
def set_equality_flags(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("v"), "l_quantity")
    return R.set_equality(rows.filter("l_quantity < 5"), rows.filter("l_quantity > 48"), "k", "v")


@query(
    """WITH a AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed'
WHEN a.p_brand IS NOT DISTINCT FROM b.p_brand AND a.p_size IS NOT DISTINCT FROM b.p_size THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.p_partkey = b.p_partkey"""
)
def projection_match(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    live = part.filter("p_partkey % 11 <> 0").withColumn("p_size", F.expr("case when p_partkey % 7 = 0 then null else p_size end"))
    return R.projection_match(part.filter("p_partkey % 10 <> 0"), live, "p_partkey", ["p_brand", "p_size"])


@query(
    """SELECT count(*) AS differences FROM ((SELECT * FROM nation EXCEPT ALL SELECT * FROM nation WHERE n_nationkey <> 7)
UNION ALL (SELECT * FROM nation WHERE n_nationkey <> 7 EXCEPT ALL SELECT * FROM nation))"""
)
def full_row_equality(spark, sf):
    a = table(spark, sf, "nation")
    b = a.filter("n_nationkey <> 7")
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("differences"))


@query(
    """WITH RECURSIVE e AS (SELECT page_id AS p, page_id * 2 + 1 AS c FROM pages WHERE page_id * 2 + 1 IN (SELECT page_id FROM pages) UNION ALL SELECT page_id, page_id * 2 + 2 FROM pages WHERE page_id * 2 + 2 IN (SELECT page_id FROM pages)),
r AS (SELECT 3 AS node, 0 AS depth UNION SELECT c, depth + 1 FROM r JOIN e ON p = node) SELECT node, depth FROM r"""
)
def recursive_reachability(spark, sf):
    id_ = F.col("page_id")
    pages = table(spark, sf, "pages")
    edges = pages.select(id_.alias("p"), F.explode(F.array(id_ * 2 + 1, id_ * 2 + 2)).alias("c"))
    edges = edges.join(pages.select(id_.alias("c")), "c", "left_semi")
    return R.closure(edges, spark.createDataFrame([(3,)], "node long"), "p", "c")


@query(
    """WITH q AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY source) AS n FROM documents),
s AS (SELECT source, n, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT source, n FROM q))
SELECT q.source, q.doc_id FROM q JOIN s USING (source) WHERE q.place <= CEIL(CAST(100 AS DOUBLE) / s.k)"""
)
def fair_share_quota(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id")
    return R.fair_share(rows, "source", ["doc_id"], 100).select("source", "doc_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_number, json_type(props) AS kind FROM events")
def props_json_extract(spark, sf):
    k = F.get_json_object("props", "$.k")
    kind = F.when(F.expr("schema_of_variant(try_parse_json(props))").startswith("OBJECT"), "OBJECT")
    return table(spark, sf, "events").select("event_id", k.alias("k"), k.try_cast("long").alias("k_number"), kind.alias("kind"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name FROM customer UNION ALL SELECT 900001, 'NEW'")
def upsert_rows(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", "c_name")
    changed = base.filter("c_custkey % 3 = 0").withColumn("c_name", F.upper("c_name"))
    return upsert(base, changed.unionByName(spark.createDataFrame([(900001, "NEW")], changed.schema)), ["c_custkey"])


@query("SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def keep_latest_version(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return keep_latest(rows, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("event_type")


@query(
    """SELECT event_id, props, running_bytes FROM (SELECT event_id, props, CAST(sum(octet_length(encode(props))) OVER (ORDER BY event_id) AS BIGINT) AS running_bytes FROM (
  SELECT * FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100)) WHERE running_bytes <= 700"""
)
def outbox_cursor(spark, sf):
    return outbox_page(table(spark, sf, "events"), 500, 100, 700, "event_id", "props").select("event_id", "props", "running_bytes")


@query(
    """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS record FROM nation"""
)
def json_report(spark, sf):
    return report(table(spark, sf, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def published_snapshot(spark, sf):
    heads = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "o_orderpriority string")
    return published(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), heads, "o_orderpriority")


@query("SELECT n_regionkey, count(*) AS nations, grouping(n_regionkey) AS total FROM nation GROUP BY ROLLUP (n_regionkey)")
def rollup_extra(spark, sf):
    return table(spark, sf, "nation").rollup("n_regionkey").agg(
        F.count(F.lit(1)).alias("nations"), F.grouping("n_regionkey").cast("long").alias("total")
    )


@query("SELECT l_orderkey AS k FROM lineitem WHERE l_tax > 0.07 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def intersect_extra(spark, sf):
    a = table(spark, sf, "lineitem").filter("l_tax > 0.07").select(F.col("l_orderkey").alias("k"))
    return a.intersect(table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k")))
