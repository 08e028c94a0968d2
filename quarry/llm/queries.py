"""The driver's queries for the ten operators, their SQL where SQL can state them, and the pipeline."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ngram_model
from quarry.llm.bpe import bpe_encode
from quarry.llm.chat import format_chat
from quarry.llm.decontaminate import decontaminate
from quarry.llm.exact_dedup import exact_dedup
from quarry.llm.jaccard_join import jaccard_join
from quarry.llm.language_id import fold, language_id, learn
from quarry.llm.licenses import NOTICES, scan_licenses
from quarry.llm.line_dedup import dedup_lines
from quarry.llm.secrets import scan_secrets


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; another folder can be set by QUARRY_TOKENIZERS."""
    folder = os.environ.get("QUARRY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_table(spark, sf_dir, "documents"), vocabulary(), with_output=False)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents")).drop("found")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 7)
    model = ngram_model.train(docs.filter(~held_out))
    found = ngram_model.score(docs, model)
    return found.select(
        "doc_id", fold(F.col("doc_id"), 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).drop("text")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(_table(spark, sf_dir, "conversations")).drop("messages")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = learn(docs.filter(~fold(F.col("doc_id"))), "text", "lang")
    found = language_id(docs, model, with_spans=False)
    return found.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"), notices=NOTICES)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = (
        op1_bpe_encode,
        op2_exact_dedup,
        op3_decontaminate,
        op4_secret_scan,
        op5_lm_scoring,
        op6_line_dedup,
        op7_chat_format,
        op8_language_id,
        op9_license_scan,
        op10_jaccard_join,
        pipeline,
    )
    return {f.__name__: f for f in found}


OP2_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""


#: Whole conversations: those of the small tables are shorter than a block.
OP7_SQL = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS mid, conv_id, turn, role, text FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
),
cut AS (
  SELECT mid, conv_id, turn, unnest(regexp_split_to_array(coalesce(text, ''), '\r?\n')) AS line,
         generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\r?\n'), 1) AS i FROM m
),
parsed AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^((?:\s{0,3}>)*)', 1), '\s', '', 'g')) AS level,
         regexp_replace(line, '^(?:\s{0,3}>)+ ?', '') AS body FROM cut
),
l AS (
  SELECT *, level = 0 AND NOT (regexp_matches(lower(body),
           '^\s*(on .{1,200} wrote|am .{1,200} schrieb.{0,100}|le .{1,200} a écrit|el .{1,200} escribió)\s*:\s*$')
           AND coalesce(lead(level) OVER (PARTITION BY mid ORDER BY i) > 0, false)) AS own,
         nullif(trim(regexp_replace(lower(body), '\s+', ' ', 'g')), '') AS k FROM parsed
),
origin AS (SELECT conv_id, k, min(turn) AS origin FROM l WHERE own AND k IS NOT NULL GROUP BY ALL),
votes AS (
  SELECT l.conv_id, l.turn, level, origin, count(*) AS n FROM l JOIN origin o ON l.conv_id = o.conv_id AND l.k = o.k
  WHERE level > 0 AND origin < l.turn GROUP BY ALL
),
reply AS (SELECT conv_id, turn, arg_min(origin, (level, -n, -origin)) AS reply_to, sum(n) AS n_linked FROM votes GROUP BY ALL),
up AS (
  SELECT conv_id, turn, reply_to AS root FROM reply
  UNION ALL SELECT u.conv_id, u.turn, r.reply_to FROM up u JOIN reply r ON u.conv_id = r.conv_id AND u.root = r.turn
),
root AS (SELECT conv_id, turn, min(root) AS root FROM up GROUP BY ALL),
said AS (
  SELECT mid, regexp_replace(regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (own), ''), '\n{3,}', chr(10) || chr(10), 'g'),
         '^\s+|\s+$', '', 'g') AS text, count(*) FILTER (level > 0) AS quoted FROM l GROUP BY mid
),
rows AS (
  SELECT m.conv_id, m.turn, coalesce(m.role, 'unknown') AS role, coalesce(root, m.turn) AS root, coalesce(n_linked, 0) AS n_linked, s.text, s.quoted
  FROM m JOIN said s USING (mid) LEFT JOIN reply r ON m.conv_id = r.conv_id AND m.turn = r.turn LEFT JOIN root t ON m.conv_id = t.conv_id AND m.turn = t.turn
)
SELECT conv_id, 0 AS first_root, true AS tail, 0 AS turn_block, 0 AS spread, count(*) AS n_messages, CAST(sum(quoted) AS BIGINT) AS n_quoted,
       CAST(sum(n_linked) AS BIGINT) AS n_linked,
       string_agg('<|' || role || '|>' || chr(10) || text, chr(10) || chr(10) ORDER BY root, turn, role, text) AS chat
FROM rows GROUP BY ALL
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r AS (SELECT a AS v, a AS label FROM e UNION SELECT e.b, r.label FROM r JOIN e ON r.v = e.a WHERE r.label < e.b),
label AS (SELECT v, min(label) AS label FROM r GROUP BY v),
links AS (SELECT a AS v, count(*) AS n FROM e GROUP BY a)
SELECT doc_id, coalesce(label, doc_id) AS class_id, coalesce(links.n, 0) AS n_links
FROM documents LEFT JOIN label ON doc_id = label.v LEFT JOIN links ON doc_id = links.v
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op7_chat_format": OP7_SQL, "op10_jaccard_join": OP10_SQL}
