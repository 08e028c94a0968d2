"""Lexical and vector retrieval, rank fusion, diversity, and retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: BM25 as full-text search engines define it, and the constant of reciprocal rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60


def postings(docs: DataFrame, key: str, text: str, queries: DataFrame | None = None) -> DataFrame:
    """key, term, tf, length; combined on the map side, one row a document and term.

    With queries (a small, stated set with a column term) only their terms become rows: the rest of a
    document never leaves its task.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = docs.select(key, words.alias("w")).withColumn("length", F.size("w"))
    if queries is not None:
        wanted = queries.agg(F.collect_set("term").alias("wanted"))
        rows = rows.crossJoin(F.broadcast(wanted))  # one row
        rows = rows.withColumn("w", F.filter("w", lambda x: F.array_contains("wanted", x)))
    return (
        rows.select(key, "length", F.explode("w").alias("term"))
        .groupBy(key, "term", "length")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def bm25(posted: DataFrame, docs: DataFrame, queries: DataFrame, key: str, text: str) -> DataFrame:
    """query_id, key, score, matched (terms of the query in the document): larger is better.

    queries: query_id, term, one row a distinct term: a stated, small set that is broadcast.  posted may be
    the postings of these terms alone.
    """
    size = F.size(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    corpus = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(size).alias("avg_length"))
    terms = queries.select("term").distinct()
    hits = posted.join(F.broadcast(terms), "term")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.crossJoin(F.broadcast(corpus)).select("term", "avg_length", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"))
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    scored = hits.join(F.broadcast(queries), "term").join(F.broadcast(idf), "term")
    return scored.groupBy("query_id", key).agg(F.sum(gain).alias("score"), F.count(F.lit(1)).alias("matched"))


def lexical_ladder(scored: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """The first rung that has hits for a query: all its terms, else any two of three to five, else none.

    scored: the output of bm25; all rungs come from one pass over the match counts.
    """
    sizes = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))
    tier = F.when(F.col("matched") == F.col("terms"), 0).when((F.col("matched") >= 2) & F.col("terms").between(3, 5), 1)
    rows = scored.join(F.broadcast(sizes), "query_id").withColumn("tier", tier).filter("tier is not null")
    best = rows.groupBy("query_id").agg(F.min("tier").alias("best"))
    return rows.join(F.broadcast(best), "query_id").filter("tier = best").select("query_id", key, "score", "tier")


def top(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    return rows.withColumn(name, place).filter(F.col(name) <= k)


def minimum_span(positions: Column, terms: int) -> Column:
    """Fewest words that hold all terms; positions: array of struct(at, term) in order of at."""
    folded = F.aggregate(
        positions,
        F.struct(F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("last"), F.lit(None).cast("int").alias("best")),
        lambda acc, x: F.struct(
            F.map_concat(F.map_filter(acc["last"], lambda k, v: k != x["term"]), F.create_map(x["term"], x["at"])).alias("last"),
            F.least(
                acc["best"],
                F.when(
                    F.size(F.map_filter(acc["last"], lambda k, v: k != x["term"])) + 1 == terms,
                    x["at"] - F.least(x["at"], F.coalesce(F.array_min(F.map_values(F.map_filter(acc["last"], lambda k, v: k != x["term"]))), x["at"])) + 1,
                ),
            ).alias("best"),
        ),
    )
    return folded["best"]


def term_support(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, matched, coverage, phrase, span: how much of a query a text holds literally; texts without any term are left out."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    at = F.filter(
        F.transform(words, lambda w, i: F.struct(i.alias("at"), F.array_position(F.array(*map(F.lit, terms)), w).cast("int").alias("term"))),
        lambda x: x["term"] > 0,
    )
    rows = docs.select(key, words.alias("words"), at.alias("at")).filter(F.size("at") > 0)
    matched = F.size(F.array_distinct(F.transform("at", lambda x: x["term"])))
    phrase = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).contains(f" {' '.join(terms)} ")
    return rows.select(
        key, matched.alias("matched"), (matched / len(terms)).alias("coverage"), phrase.alias("phrase"), minimum_span(F.col("at"), len(terms)).alias("span")
    )


def centred_snippet(text: Column, needle: str, before: int = 80, size: int = 240) -> Column:
    return F.substring(text, F.greatest(F.lit(1), F.instr(F.lower(text), needle.lower()) - before), F.lit(size))


# --- vectors -----------------------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision and within -1..1; null for a zero vector or unequal lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((norm > 0) & (F.size(a) == F.size(b)), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def score_block(vectors: DataFrame, key: str, vector: str, block: list[tuple[int, list[float]]], keep: list[str] = ()) -> DataFrame:
    """query_id, score and kept columns of each vector against one block of queries: a matrix product a batch.

    The block is a bounded list of stated queries; it travels with the task, and no pair is shuffled.
    """
    ids = [i for i, _ in block]
    matrix = np.array([v for _, v in block], dtype=np.float64)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    kept = [F.col(c) for c in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([np.asarray(v, dtype=np.float64) for v in batch[vector]])
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
            scores = np.clip(rows @ matrix.T, -1, 1)
            out = batch.drop(columns=vector)
            out = out.loc[out.index.repeat(len(ids))].reset_index(drop=True)
            out["query_id"] = np.tile(np.array(ids, dtype=np.int64), len(batch))
            out["score"] = scores.ravel()
            yield out

    rows = vectors.select(key, *kept, vector)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != vector)
    return rows.mapInPandas(run, f"{schema}, query_id long, score double")


def vector_search(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, keep: list[str] = (), block: int = 256) -> DataFrame:
    """The k best vectors of each query; queries (query_id, vector) are taken in blocks.

    Each block's scores are cut to k a query and partition before they are shuffled.
    """
    found, own = [], []
    rows = queries.select("query_id", vector).orderBy("query_id").toLocalIterator()
    for r in rows:
        own.append((r[0], [float(x) for x in r[1]]))
        if len(own) == block:
            found.append(score_block(vectors, key, vector, own, keep))
            own = []
    if own:
        found.append(score_block(vectors, key, vector, own, keep))
    order = [F.desc(F.round("score", 6)), F.asc(key)]
    return reduce(DataFrame.unionByName, [top(x, ["query_id"], order, k) for x in found])


def best_per_item(scored: DataFrame, item: list[str], k: int, tie: str) -> DataFrame:
    """The best row of each item, then the k best items."""
    order = [F.desc(F.round("score", 6)), F.asc(tie)]
    best = top(scored, ["query_id", *item], order, 1, "_own").drop("_own")
    return top(best, ["query_id"], order, k)


def calibrated(scored: DataFrame, floors: DataFrame, kind: str) -> DataFrame:
    """Rows at or over their kind's floor, and for each query whether all were rejected."""
    rows = scored.join(F.broadcast(floors), kind).withColumn("kept", F.col("score") >= F.col("floor"))
    verdict = rows.groupBy("query_id").agg((~F.bool_or("kept")).alias("abstains"))
    return rows.join(verdict, "query_id").select(*scored.columns, "kept", "abstains")


def floor_between(scored: DataFrame, positive: Column) -> DataFrame:
    """One row: the midpoint between the least positive and the greatest negative score, if they are separable."""
    both = scored.agg(F.min(F.when(positive, F.col("score"))).alias("p"), F.max(F.when(~positive, F.col("score"))).alias("n"))
    return both.select(F.col("p").alias("least_positive"), F.col("n").alias("most_negative"), F.when(F.col("p") > F.col("n"), (F.col("p") + F.col("n")) / 2).alias("floor"))


# --- fusion ------------------------------------------------------------------------------------------


def weighted_rrf(rankings: DataFrame, weights: dict[str, float], item: str = "item_id") -> DataFrame:
    """query_id, item, score: ranks are counted over first occurrences of an item in each ranking.

    rankings: query_id, ranking, item, position.
    """
    first = rankings.groupBy("query_id", "ranking", item).agg(F.min("position").alias("position"))
    rank = F.row_number().over(Window.partitionBy("query_id", "ranking").orderBy("position"))
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    part = F.coalesce(weight[F.col("ranking")], F.lit(1.0)) / (RRF_K + rank)
    return first.withColumn("part", part).groupBy("query_id", item).agg(F.sum("part").alias("score"))


def evidence_rrf(candidates: DataFrame, include_history: bool = False) -> DataFrame:
    """query_id, resource, revision, evidence, score, reasons of visible evidence.

    candidates: query_id, ranking, source_rank, resource, revision, evidence, locator, snippet,
    disposition, state, coherent, hard_mismatch.  Duplicates are never shown, superseded and historical
    ones only on demand.  Evidence with the same locator and snippet counts as one.  Once a query has
    coherent evidence, hard mismatches go.  The rank is the ranking's own, gaps included.
    """
    visible = candidates.filter("disposition <> 'DUPLICATE'")
    if not include_history:
        visible = visible.filter("disposition <> 'SUPERSEDED' and state not in ('HISTORICAL', 'SUPERSEDED')")
    snippet = F.lower(F.trim(F.regexp_replace("snippet", r"\s+", " ")))
    alias = F.when((snippet != "") & F.col("locator").isNotNull(), snippet)
    same = Window.partitionBy("query_id", "resource", "revision", "locator", alias)
    keyed = visible.withColumn("evidence", F.when(alias.isNotNull(), F.min(F.struct("ranking", "source_rank", "evidence")).over(same)["evidence"]).otherwise(F.col("evidence")))
    keys = ["query_id", "resource", "revision", "evidence"]
    once = keyed.groupBy(*keys, "ranking").agg(
        F.min("source_rank").alias("source_rank"), F.bool_or("coherent").alias("coherent"), F.bool_or("hard_mismatch").alias("hard_mismatch")
    )
    any_coherent = once.groupBy("query_id").agg(F.bool_or("coherent").alias("some_coherent"))
    kept = once.join(any_coherent, "query_id").filter("not (some_coherent and hard_mismatch)")
    return kept.groupBy(*keys).agg(F.sum(1 / (RRF_K + F.col("source_rank"))).alias("score"), F.array_sort(F.collect_set("ranking")).alias("rankings"))


def discovery_boost(fused: DataFrame, signals: DataFrame, weight: float) -> DataFrame:
    """Add weight / (60 + rank), once a source, to the best evidence of each resource that already has some.

    signals: query_id, source, resource, revision, source_rank.
    """
    keys = ["query_id", "resource", "revision"]
    boost = signals.groupBy(*keys, "source").agg(F.min("source_rank").alias("r")).groupBy(*keys).agg(F.sum(weight / (RRF_K + F.col("r"))).alias("boost"))
    best = fused.groupBy(*keys).agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "evidence"))["evidence"].alias("evidence"))
    target = best.join(boost, keys)
    return fused.join(target, [*keys, "evidence"], "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("boost")


def cluster_overlaps(ordered: DataFrame, distance: int) -> DataFrame:
    """Greedy merging of overlapping or close spans of a section, in rank order.

    ordered: query_id, resource, revision, section, start, end, score, evidence.  A group is the evidence
    of one section for one query.  Returns the surviving evidence with the number of spans merged into it
    and their summed score.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "evidence"], ascending=[False, True])
        kept: list[list] = []
        for row in pdf.itertuples(index=False):
            for k in kept:
                gap = max(row.start, k[5]) - min(row.end, k[6])
                if gap < 0 or gap < distance:
                    k[7] += row.score
                    k[8] += 1
                    break
            else:
                kept.append([row.query_id, row.resource, row.revision, row.section, row.evidence, row.start, row.end, row.score, 1])
        return pd.DataFrame(kept, columns=["query_id", "resource", "revision", "section", "evidence", "start", "end", "score", "merged"])

    schema = "query_id long, resource string, revision string, section string, evidence string, start long, end long, score double, merged long"
    return ordered.groupBy("query_id", "resource", "revision", "section").applyInPandas(merge, schema)


def diverse(hits: DataFrame, per_resource: int, limit: int, tie: list[str]) -> DataFrame:
    """At most per_resource hits of a resource and limit hits in all, counter-evidence last; omitted counts the rest."""
    order = [F.asc("counter"), F.desc(F.round("score", 9)), *[F.asc(c) for c in tie]]
    capped = top(hits, ["query_id", "resource"], order, per_resource, "own_rank")
    kept = top(capped, ["query_id"], order, limit)
    sizes = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("all"))
    shown = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("shown"))
    return kept.join(sizes.join(shown, "query_id").select("query_id", (F.col("all") - F.col("shown")).alias("omitted")), "query_id")


def pack_context(hits: DataFrame, budget: int) -> DataFrame:
    """Hits in rank order that fit a budget of characters, those that don't fit skipped; hits: query_id, rank, evidence, chars.

    A group is one query's hits, which the diversity limit bounds.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        left, rows = budget, []
        for row in pdf.sort_values(["rank", "evidence"]).itertuples(index=False):
            fits = row.chars <= left
            left -= row.chars if fits else 0
            rows.append((row.query_id, row.rank, row.evidence, row.chars, fits, left))
        return pd.DataFrame(rows, columns=["query_id", "rank", "evidence", "chars", "packed", "left"])

    return hits.groupBy("query_id").applyInPandas(pack, "query_id long, rank long, evidence string, chars long, packed boolean, left long")


# --- metrics -----------------------------------------------------------------------------------------


def retrieval_metrics(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """query_id, recall, mrr, ndcg at k; null where a query has no relevant judgement.

    ranked: query_id, item_id, rank; judged: query_id, item_id, grade.
    """
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    relevant = judged.filter("grade > 0")
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "item_id"))
    ideal = relevant.withColumn("r", ideal_rank).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("r") <= k, gain(F.col("grade")) / F.log2(F.col("r") + 1.0))).alias("ideal")
    )
    hits = ranked.filter(F.col("rank") <= k).join(relevant, ["query_id", "item_id"]).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("found"), F.min("rank").alias("first"), F.sum(gain(F.col("grade")) / F.log2(F.col("rank") + 1.0)).alias("dcg")
    )
    queries = ranked.select("query_id").union(judged.select("query_id")).distinct()
    rows = queries.join(ideal, "query_id", "left").join(hits, "query_id", "left")
    value = lambda c: F.when(F.col("relevant") > 0, F.coalesce(c, F.lit(0.0)))
    return rows.select(
        "query_id",
        value(F.col("found") / F.col("relevant")).alias("recall"),
        value(1.0 / F.col("first")).alias("mrr"),
        value(F.least(F.lit(1.0), F.col("dcg") / F.col("ideal"))).alias("ndcg"),
    )


def suite_report(metrics: DataFrame) -> DataFrame:
    """One row: number of cases and macro averages, cases without a value left out of each."""
    return metrics.agg(
        F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("recall", "mrr", "ndcg")]
    )


def completeness(expected: DataFrame, executed: DataFrame) -> DataFrame:
    """Per query: status complete or partial, and the required rankings that did not run."""
    missing = expected.join(executed, ["query_id", "ranking"], "left_anti").groupBy("query_id").agg(F.array_sort(F.collect_set("ranking")).alias("missing"))
    rows = expected.select("query_id").distinct().join(missing, "query_id", "left")
    none = F.array().cast("array<string>")
    return rows.select("query_id", F.when(F.col("missing").isNull(), "complete").otherwise("partial").alias("status"), F.coalesce("missing", none).alias("missing"))
