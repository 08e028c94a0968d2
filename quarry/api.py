"""The read API: one function a question, each returning a DataFrame and never touching the corpus's files.

``search`` runs a query from its text to cited evidence: it is compiled, its rankings are run and unioned,
filtered before fusion, fused by reciprocal rank, made diverse, and checked for rankings that are missing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import clean_title, exact_terms
from quarry.operators import evidence as E
from quarry.operators import lifecycle as L
from quarry.operators import retrieval as R
from quarry.operators.dedup import duplicate_members, duplicate_plan, keeper_ranks, plan_statistics, survivors
from quarry.plans.shared import checkpointed


@dataclass(frozen=True)
class ReadBudget:
    """Bounds of one read; a job group lets the caller cancel it."""

    rows: int = 1000
    candidates: int = 300
    group: str = "quarry-read"

    def bounded(self, rows: DataFrame) -> DataFrame:
        return rows.limit(self.rows)

    def start(self, rows: DataFrame) -> DataFrame:
        rows.sparkSession.sparkContext.setJobGroup(self.group, "quarry read", interruptOnCancel=True)
        return rows


def search(corpus: DataFrame, text: str, limit: int = 10, per_resource: int = 2, budget: ReadBudget = ReadBudget()) -> tuple[DataFrame, DataFrame]:
    """(hits, completeness) of one query over a corpus of doc_id, source, text.

    hits: rank, resource, evidence, score, rankings, snippet, omitted.  The lexical ranking takes the first
    rung that has hits; titles only add to documents that a ranking grounded.
    """
    spark = corpus.sparkSession
    plan = E.compile_query(text)
    fetch = max(n for _, _, n in E.ranking_steps(plan, limit, budget.candidates))
    found, executed = [], []
    climbed = E.climb(corpus, "doc_id", "text", plan)
    terms = spark.createDataFrame([(0, t) for t in plan.terms], "query_id long, term string")
    kept = corpus.join(climbed.select("doc_id"), "doc_id", "left_semi")
    scored = R.bm25(R.postings(kept, "doc_id", "text", terms), corpus, terms, "doc_id", "text")
    found.append(R.top(scored, ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")], fetch).select("query_id", F.lit("lexical").alias("ranking"), F.col("rank").alias("source_rank"), "doc_id"))
    executed.append("lexical")
    wanted = spark.range(1).select(exact_terms(F.lit(text)).alias("t")).first()["t"]
    if wanted:
        exact = [F.contains(F.lower("text"), F.lit(x["term"].lower())).cast("int") for x in wanted]
        hits = corpus.select("doc_id", reduce(lambda a, b: a + b, exact).alias("n")).filter("n > 0")
        ranked = R.top(hits.withColumn("query_id", F.lit(0).cast("long")), ["query_id"], [F.desc("n"), F.asc("doc_id")], fetch)
        found.append(ranked.select("query_id", F.lit("exact").alias("ranking"), F.col("rank").alias("source_rank"), "doc_id"))
        executed.append("exact")
    candidates = reduce(DataFrame.unionByName, found).join(corpus.select("doc_id", "source"), "doc_id").select(
        "query_id", "ranking", "source_rank",
        F.concat(F.lit("source:"), "source").alias("resource"),
        F.lit("current").alias("revision"),
        F.col("doc_id").cast("string").alias("evidence"),
        F.lit(None).cast("string").alias("locator"), F.lit("").alias("snippet"),
        F.lit("ACTIVE").alias("disposition"), F.lit("CURRENT").alias("state"),
        F.lit(False).alias("coherent"), F.lit(False).alias("hard_mismatch"),
    )
    # a few hundred rows at most: what follows is planned on them, not on the corpus
    fused = R.evidence_rrf(checkpointed(candidates))
    title = clean_title(F.get(F.split("text", "\n"), F.lit(0)))
    titled = corpus.select(F.concat(F.lit("source:"), "source").alias("resource"), "doc_id", F.lower(title).alias("title"))
    share = reduce(lambda a, b: a + b, [F.coalesce(F.contains("title", F.lit(t)).cast("int"), F.lit(0)) for t in plan.terms])
    titles = checkpointed(R.top(titled.select("resource", "doc_id", share.alias("n")).filter("n > 0").withColumn("query_id", F.lit(0).cast("long")), ["query_id"], [F.desc("n"), F.asc("doc_id")], fetch))
    executed.append("title")
    signals = titles.select("query_id", F.lit("title").alias("source"), "resource", F.lit("current").alias("revision"), F.col("rank").alias("source_rank"))
    boosted = R.discovery_boost(fused, signals, 0.5).withColumn("counter", F.lit(False))
    hits = R.diverse(boosted, per_resource, limit, ["evidence"])
    # at most ``limit`` hits are left: texts are fetched and cut for these alone
    shown = corpus.select(F.col("doc_id").cast("string").alias("evidence"), "text").join(F.broadcast(hits.limit(limit)), "evidence")
    snippet = E.densest_snippet(F.col("text"), plan.terms, 240)["snippet"]
    hits = shown.select("rank", "resource", "evidence", F.round("score", 9).alias("score"), "rankings", snippet.alias("snippet"), "omitted").orderBy("rank")
    expected = spark.createDataFrame([(0, r) for _, r, _ in E.ranking_steps(plan, limit, budget.candidates)], "query_id long, ranking string")
    ran = spark.createDataFrame([(0, r) for r in executed], "query_id long, ranking string")
    return budget.bounded(hits), R.completeness(expected, ran)


def context(corpus: DataFrame, text: str, chars: int = 4000, limit: int = 10, budget: ReadBudget = ReadBudget()) -> DataFrame:
    """The hits of a query, in rank order, whose snippets fit a number of characters together."""
    hits, _ = search(corpus, text, limit, budget=budget)
    sized = checkpointed(hits.select(F.lit(0).cast("long").alias("query_id"), F.col("rank").cast("long").alias("rank"), "evidence", F.length("snippet").cast("long").alias("chars"), "snippet"))
    packed = R.pack_context(sized.drop("snippet"), chars).filter("packed").drop("packed")
    return sized.select("evidence", "snippet").join(packed, "evidence").orderBy("rank")


def evidence(citations: DataFrame, owners: DataFrame) -> DataFrame:
    """What citations (citation, owner_id, start, end, sha256) hold in their owners' texts now, and whether it is what was cited."""
    return E.rehydrate(citations, owners)


def asset_health(assets: DataFrame, stages: dict[str, DataFrame], key: str, budget: ReadBudget = ReadBudget()) -> DataFrame:
    """Which stages each asset has been through and the first one it lacks."""
    return budget.bounded(L.stage_facts(assets, stages, key).orderBy(key))


def dedupe(files: DataFrame, preferred: list[str] = (), explicit: list[int] = (), verified: list[int] = ()) -> dict[str, DataFrame]:
    """plan, members, survivors and statistics of an inventory of files."""
    members = duplicate_members(keeper_ranks(files, preferred, explicit, verified))
    plan = duplicate_plan(members)
    return {"plan": plan, "members": members, "survivors": survivors(files, members), "statistics": plan_statistics(files, plan)}


def diagnostics(owners: dict[str, DataFrame], root: str | None = None, contains: str | None = None, budget: ReadBudget = ReadBudget()) -> DataFrame:
    return budget.bounded(L.scoped(L.federated(owners), root, contains).orderBy("owner", "record_id"))


def lineage(edges: DataFrame, target: int, upstream: bool = True) -> DataFrame:
    return L.lineage(edges, edges.sparkSession.createDataFrame([(target,)], "node long"), upstream)


#: Which question a text asks of the corpus's own state, by words that it uses.
OPERATIONS = {"duplicates": ["duplicate", "duplicado", "copies"], "errors": ["error", "failed", "fallo"], "findings": ["finding", "review", "hallazgo"], "lineage": ["derived", "lineage", "origen"]}


def operational_intent(text: str) -> str | None:
    low = f" {text.lower()} "
    return next((k for k, words in OPERATIONS.items() if any(w in low for w in words)), None)


def scopes(tables: dict[str, DataFrame], question) -> dict[str, DataFrame]:
    """The same question of each scope, on its own: results are never ranked across scopes."""
    return {name: question(rows) for name, rows in tables.items()}
