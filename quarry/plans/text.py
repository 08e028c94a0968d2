"""Queries of the text functions: normalising, hashing, quality, titles, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.plans.registry import query
from quarry.sources.tables import table


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed FROM documents")
def whitespace_collapse(spark, sf):
    return docs(spark, sf).select("doc_id", X.collapse(F.col("text")).alias("collapsed"))


@query("SELECT doc_id, strip_accents(replace(lower(text), 'ß', 'ss')) AS folded FROM documents")
def accent_case_fold(spark, sf):
    return docs(spark, sf).select("doc_id", X.fold("text").alias("folded"))


@query("SELECT page_id, upper(trim(regexp_replace(replace(strip_accents(url), '_', ' '), '\\s+', ' ', 'g'))) AS folded FROM pages")
def classifier_fold(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.classifier_fold("url").alias("folded"))


@query(
    """SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS words, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS distinct_words
FROM documents"""
)
def word_counts(spark, sf):
    return docs(spark, sf).select(
        "doc_id",
        F.size(X.query_words(F.col("text"))).cast("long").alias("words"),
        F.size(F.array_distinct(X.signature_words(F.col("text")))).cast("long").alias("distinct_words"),
    )


@query(
    """SELECT doc_id, substr(sha256(text), 1, 32) AS sha128, octet_length(encode(text)) AS bytes, substr(sha256(encode('guard' || chr(0)) || encode(text)), 1, 16) AS guard64,
CAST(CAST(CAST('0x' || substr(sha256(text), 1, 16) AS UBIGINT) AS HUGEINT) - CASE WHEN CAST('0x' || substr(sha256(text), 1, 16) AS UBIGINT) >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END AS BIGINT) AS key64
FROM documents"""
)
def content_fingerprint(spark, sf):
    f = X.fingerprint(F.col("text"))
    return docs(spark, sf).select(
        "doc_id", f["sha128"].alias("sha128"), f["bytes"].cast("long").alias("bytes"), f["guard64"].alias("guard64"), X.sha_long(F.col("text")).alias("key64")
    )


@query("""SELECT '{"lang":"' || lang || '","n":' || n_chars || ',"source":"' || source || '"}' AS record, doc_id FROM documents""")
def canonical_json(spark, sf):
    record = X.canonical_json({"source": F.col("source"), "lang": F.col("lang"), "n": F.col("n_chars")})
    return docs(spark, sf).select(record.alias("record"), "doc_id")


QUALITY = r"""
q AS (
  SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS v FROM documents),
s AS (
  SELECT doc_id, v, greatest(length(v), 1) AS n, len(regexp_extract_all(v, '\p{L}')) / greatest(length(v), 1) AS ratio,
         list_filter(regexp_split_to_array(v, '\s+'), lambda t: t <> '') AS t, len(regexp_extract_all(v, '(?s)(?:�|Ã.|Â.|â€|ðŸ)')) AS bad FROM q),
c AS (SELECT *, len(t) AS k, len(list_filter(t, lambda x: regexp_full_match(x, '[A-Za-z0-9+/]{32,}={0,2}'))) AS coded FROM s),
quality AS (
  SELECT doc_id, ratio, k, CASE
    WHEN length(v) = 0 THEN 'empty' WHEN length(v) < 3 THEN 'too_short' WHEN length(v) >= 32 AND ratio < 0.08 THEN 'low_alphabetic_content'
    WHEN list_max(list_transform(t, lambda x: length(x))) > 512 THEN 'oversized_token' WHEN bad >= 2 AND bad / n >= 0.005 THEN 'mojibake'
    WHEN regexp_matches(v, '[A-Za-z0-9+/]{80,}') OR (k >= 3 AND coded >= 2 AND coded / k >= 0.35) THEN 'encoded_binary_text'
    WHEN k >= 40 AND len(list_distinct(list_transform(t, lambda x: lower(x)))) / k <= 0.07 THEN 'repetitive_machine_text' ELSE 'eligible' END AS reason FROM c)"""


@query(f"WITH {QUALITY} SELECT doc_id, reason = 'eligible' AS eligible, reason, round(ratio, 6) AS alphabetic_ratio, k AS token_count FROM quality")
def quality_assessment(spark, sf):
    rows = docs(spark, sf).select("doc_id", X.quality(F.col("text")).alias("q"))
    return rows.select(
        "doc_id", "q.eligible", "q.reason", F.round("q.alphabetic_ratio", 6).alias("alphabetic_ratio"), F.col("q.token_count").cast("long").alias("token_count")
    )


@query(
    f"""WITH {QUALITY} SELECT reason, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS poor, count(*) FILTER (toxic = 1) AS toxic
FROM quality JOIN labels USING (doc_id) GROUP BY reason"""
)
def quality_confusion_vs_labels(spark, sf):
    rows = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(X.quality(F.col("text"))["reason"].alias("reason"), "quality", "toxic")
    return rows.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("quality") == 1).alias("good"),
        F.count_if(F.col("quality") == 0).alias("poor"),
        F.count_if(F.col("toxic") == 1).alias("toxic"),
    )


@query(
    r"""WITH v AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS v FROM documents),
c AS (SELECT doc_id, v, length(v) AS n, round(len(regexp_extract_all(v, '[\p{L}\p{N}]')) / greatest(length(v), 1) + 1e-9, 5) AS alnum,
  round((len(regexp_extract_all(v, '[\p{Cc}\p{Co}�]')) + len(regexp_extract_all(v, 'Ã|Â|â€|ðŸ'))) / greatest(length(v), 1) + 1e-9, 5) AS susp,
  round(len(list_distinct(string_split(regexp_replace(v, '\s', '', 'g'), ''))) / greatest(length(regexp_replace(v, '\s', '', 'g')), 1) + 1e-9, 5) AS uniq FROM v)
SELECT doc_id, n AS characters, alnum AS alphanumeric_ratio, uniq AS unique_ratio,
  CASE WHEN n < 24 THEN 'too_short' WHEN susp > 0.01 THEN 'suspicious_unicode_or_mojibake' WHEN alnum < 0.35 THEN 'low_alphanumeric_density'
  WHEN n >= 40 AND uniq < 0.035 THEN 'low_character_diversity' ELSE 'usable' END AS reason FROM c"""
)
def native_text_quality(spark, sf):
    rows = docs(spark, sf).select("doc_id", X.native_quality(F.col("text"), 24).alias("q"))
    return rows.select("doc_id", F.col("q.characters").cast("long").alias("characters"), "q.alphanumeric_ratio", "q.unique_ratio", "q.reason")


@query(
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_split_to_array(text, '[\r\n]')[1], '\s+', ' ', 'g')) AS l FROM documents),
c AS (SELECT doc_id, regexp_replace(l, '^[ \-—_|:;,.\t]+|[ \-—_|:;,.\t]+$', '', 'g') AS title FROM t)
SELECT doc_id, CASE WHEN length(title) BETWEEN 5 AND 180 AND NOT regexp_matches(title, '(?i)^(?:p[aá]gina|page|copyright|all rights reserved|hoja\d*|sheet\d*|elabor[oó]|revis[oó]|aprob[oó])\b')
 AND NOT regexp_matches(title, '(?i)(?:@|https?://|www\.)') AND len(regexp_extract_all(title, '\p{L}+')) BETWEEN 2 AND 22
 AND len(regexp_extract_all(title, '\p{L}')) / greatest(length(title), 1) >= 0.45 THEN title END AS title FROM c"""
)
def title_candidates(spark, sf):
    return docs(spark, sf).select("doc_id", X.clean_title(F.get(F.split("text", r"[\r\n]"), F.lit(0))).alias("title"))


@query(
    r"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\r\n]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')[1:24] AS lines FROM documents),
c AS (SELECT doc_id, list_transform(lines, lambda x: regexp_replace(x, '^[ \-—_|:;,.\t]+|[ \-—_|:;,.\t]+$', '', 'g')) AS titles FROM t)
SELECT doc_id, list_filter(titles, lambda title: length(title) BETWEEN 5 AND 180 AND NOT regexp_matches(title, '(?i)^(?:p[aá]gina|page|copyright|all rights reserved|hoja\d*|sheet\d*|elabor[oó]|revis[oó]|aprob[oó])\b')
 AND NOT regexp_matches(title, '(?i)(?:@|https?://|www\.)') AND len(regexp_extract_all(title, '\p{L}+')) BETWEEN 2 AND 22
 AND len(regexp_extract_all(title, '\p{L}')) / greatest(length(title), 1) >= 0.45)[1] AS title FROM c"""
)
def first_titles(spark, sf):
    return docs(spark, sf).select("doc_id", X.first_title(F.col("text")).alias("title"))


@query(
    """SELECT event_id, 'due ' || strftime(ts, '%Y-%m-%d') AS text, [strftime(ts, '%Y-%m-%d')] AS dates FROM events"""
)
def date_extraction(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = table(spark, sf, "events").select("event_id", F.concat(F.lit("due "), day).alias("text"))
    return rows.withColumn("dates", X.dates(F.col("text")))


@query(
    r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\b[A-Za-z][A-Za-z0-9_.]*(?:[-_/][A-Za-z0-9_.]+)*[-_/][0-9][A-Za-z0-9_.-]*\b'))) AS compound,
len(list_distinct(regexp_extract_all(text, '\b[0-9a-fA-F]{16,64}\b'))) AS hashes FROM documents"""
)
def identifier_counts(spark, sf):
    return docs(spark, sf).select(
        "doc_id",
        F.size(X.every(F.col("text"), X.COMPOUND)).cast("long").alias("compound"),
        F.size(X.every(F.col("text"), X.HASH)).cast("long").alias("hashes"),
    )


@query()
def structured_evidence(spark, sf):
    text = F.col("text")
    found = docs(spark, sf).select(
        "doc_id", X.dates(text).alias("dates"), X.every(text, X.LONG_NUMBER).alias("numbers"), X.measurements(text).alias("measurements"), X.exact_terms(text).alias("terms")
    )
    return found.filter((F.size("dates") > 0) | (F.size("numbers") > 0) | (F.size("measurements") > 0) | (F.size("terms") > 0))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(' ' || replace(lower(text), ' ', '  ') || ' ', '[^\p{L}\p{N}]the[^\p{L}\p{N}]')) AS the_count,
len(regexp_extract_all(' ' || replace(lower(text), ' ', '  ') || ' ', '[^\p{L}\p{N}]der[^\p{L}\p{N}]')) AS der_count FROM documents"""
)
def alias_counts(spark, sf):
    low = F.lower("text")
    return docs(spark, sf).select(
        "doc_id", X.alias_hits(low, "the").cast("long").alias("the_count"), X.alias_hits(low, "der").cast("long").alias("der_count")
    )


@query(
    """SELECT p_partkey, DATE '1899-12-31' + CAST(CASE WHEN p_partkey >= 60 THEN p_partkey - 1 ELSE p_partkey END AS INTEGER) AS day_1900, DATE '1904-01-01' + CAST(p_partkey AS INTEGER) AS day_1904 FROM part"""
)
def excel_serial_dates(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", X.excel_date(key).alias("day_1900"), X.excel_date(key, True).alias("day_1904"))


@query(
    """WITH d AS (SELECT p_partkey, CAST(p_size * 97 AS DOUBLE) AS w, CAST((p_partkey % 53 + 1) * 61 AS DOUBLE) AS h FROM part),
s AS (SELECT *, least(1.0, 1024.0 / greatest(w, h), sqrt(500000.0 / (w * h))) AS f FROM d)
SELECT p_partkey, CAST(greatest(1, floor(w * f)) AS BIGINT) AS width, CAST(greatest(1, floor(h * f)) AS BIGINT) AS height FROM s"""
)
def resize_dimensions(spark, sf):
    w, h = (F.col("p_size") * 97).cast("double"), ((F.col("p_partkey") % 53 + 1) * 61).cast("double")
    size = X.bounded_size(w, h, 1024, 500_000)
    return table(spark, sf, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


@query("SELECT doc_id, length(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) < 40 OR doc_id % 100 < 45 AS needs_ocr FROM documents")
def ocr_fallback(spark, sf):
    """The document's id stands in for the recogniser's character count and confidence."""
    rows = docs(spark, sf)
    short = F.length(X.stripped(F.col("text"))) < 40
    return rows.select("doc_id", (short | X.needs_ocr(F.col("text"), F.col("n_chars"), (F.col("doc_id") % 100).cast("double"))).alias("needs_ocr"))


@query(
    "SELECT vec_id, round(-list_sum(list_transform(list_distinct(b), lambda v: (len(list_filter(b, lambda x: x = v)) / len(b)) * log2(len(list_filter(b, lambda x: x = v)) / len(b)))), 6) AS entropy "
    "FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4) AS INTEGER)) AS b FROM embeddings)"
)
def histogram_entropy(spark, sf):
    """Entropy of each vector's quantised components, as of an image's grey histogram."""
    bins = F.transform("embedding", lambda x: F.floor(x.cast("double") * 4).cast("int"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.explode(bins).alias("bin")).groupBy("vec_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("vec_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select("vec_id", F.round(F.log2("t") - F.col("s") / F.col("t"), 6).alias("entropy"))
