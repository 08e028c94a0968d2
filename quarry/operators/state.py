"""Corpus state: successors, reuse, coverage, epochs, replays and projections of results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.relational import nearest_root


def successor(base: DataFrame, delta: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """The next generation: base rows that are neither replaced nor removed, and the delta; origin tells which."""
    kept = base.join(delta.select(key).union(removed.select(key)).distinct(), key, "left_anti").withColumn("origin", F.lit("kept"))
    return kept.unionByName(delta.withColumn("origin", F.lit("delta")))


def with_reused(requests: DataFrame, published: DataFrame, key: list[str], payload: str) -> DataFrame:
    """Requests with the published payload of equal content, and whether there is one to reuse."""
    have = published.groupBy(*key).agg(F.min_by(payload, payload).alias(payload))
    rows = requests.join(have, key, "left")
    return rows.withColumn("reused", F.col(payload).isNotNull())


def content_set_digest(rows: DataFrame, key: Column) -> DataFrame:
    """One row: number of distinct keys and a digest of their set that no order of rows changes."""
    digests = rows.select(F.sha2(key, 256).alias("d")).distinct()
    part = lambda i: F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    whole = F.lit(2**32).cast("decimal(38,0)")
    return digests.agg(
        F.count(F.lit(1)).alias("keys"),
        *[F.pmod(F.coalesce(F.sum(part(i)), F.lit(0).cast("decimal(38,0)")), whole).cast("long").alias(f"word{i}") for i in range(4)],
    )


def cached_detection(files: DataFrame, cache: DataFrame, identity: list[str], version: str) -> DataFrame:
    """Files with a cached type of the same identity and detector version; the others are to be detected."""
    hits = cache.filter(F.col("version") == version).select(*identity, F.col("type").alias("cached_type"))
    rows = files.join(hits, identity, "left")
    return rows.withColumn("action", F.when(F.col("cached_type").isNull(), "detect").otherwise("reuse"))


def coverage(inventory: DataFrame, durable: DataFrame, key: str, signature: Column) -> DataFrame:
    """One row: live files, those with a durable row, those whose signature still holds, missing, stale and orphans."""
    d = durable.select(key, "signature")
    both = inventory.select(key, signature.alias("now")).join(d, key, "full")
    now, had = F.col("now").isNotNull(), F.col("signature").isNotNull()
    return both.agg(
        F.count_if(now).alias("live"),
        F.count_if(now & had).alias("extracted"),
        F.count_if(now & had & (F.col("now") == F.col("signature"))).alias("current"),
        F.count_if(now & ~had).alias("missing"),
        F.count_if(now & had & (F.col("now") != F.col("signature"))).alias("stale"),
        F.count_if(~now & had).alias("orphans"),
    )


def epochs(journal: DataFrame, owner: str, sequence: str, epoch: str) -> DataFrame:
    """owner, epoch, status: each owner's last event, in conflict where it isn't at the newest epoch."""
    last = journal.groupBy(owner).agg(F.max_by(epoch, sequence).alias("epoch"))
    newest = last.agg(F.max("epoch").alias("newest"))
    rows = last.crossJoin(F.broadcast(newest))  # one row
    return rows.select(owner, "epoch", F.when(F.col("epoch") == F.col("newest"), "aligned").otherwise("conflict").alias("status"))


def replay_metrics(work: DataFrame, route: str, cached: Column) -> DataFrame:
    """Per route: items, cache hits, new work and the share of hits."""
    return work.groupBy(route).agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(cached).alias("cache_hits"),
        F.count_if(~cached).alias("new_work"),
        F.round(F.count_if(cached) / F.count(F.lit(1)), 6).alias("hit_rate"),
    )


def recovery_view(attempts: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """Attempts beside their receipts: applied, to be recovered, or lost."""
    rows = attempts.join(receipts.select(key, F.col("outcome")), key, "left")
    status = F.when(F.col("outcome") == "ok", "applied").when(F.col("outcome").isNotNull(), "failed").when(F.col("crossed"), "needs_recovery").otherwise("abandoned")
    return rows.select(key, status.alias("status"))


def protected(paths: DataFrame, trees: DataFrame, path: str = "path") -> DataFrame:
    """Paths with the protected tree that holds them, null where none does."""
    held = nearest_root(paths, trees, path, "root").withColumnRenamed("root", "protected_by")
    return paths.join(held, path, "left")


def admitted(items: DataFrame, hidden: DataFrame, identity: list[str]) -> DataFrame:
    """Items that no hide rule names; rules look at identity alone."""
    return items.join(hidden.select(*identity).distinct(), identity, "left_anti")


def cell_lines(rows: DataFrame, key: str, cells: str) -> DataFrame:
    """One line a filled cell, in order; formulas without a cached value are counted and left out.

    cells: array of struct(sheet, cell, value, formula).
    """
    dropped = F.size(F.filter(cells, lambda c: (c["formula"] != "") & (c["value"] == "")))
    lines = F.transform(F.filter(cells, lambda c: c["value"] != ""), lambda c: F.concat(c["sheet"], F.lit("!"), c["cell"], F.lit("\t"), c["value"]))
    return rows.select(key, F.array_join(lines, "\n").alias("text"), dropped.alias("uncached_formulas"))


def hit_projection(hits: DataFrame) -> Column:
    """The stable outward form of a hit."""
    return F.to_json(F.struct("rank", "resource", "evidence", F.round("score", 6).alias("score")))


def stem(title: Column, kind: Column, identifiers: Column, longest: int = 80) -> Column:
    """A readable file stem: identifiers, kind and title, in words joined by underscores."""
    words = F.regexp_replace(F.regexp_replace(F.concat_ws(" ", F.array_join(identifiers, " "), kind, title), r"[^\p{L}\p{N}.-]+", "_"), "^_+|_+$", "")
    return F.regexp_replace(F.substring(words, 1, longest), "_+[^_]{0,2}$", "")


def entity_roles(folded_opening: Column, author: Column, names: list[str]) -> Column:
    """struct(name, role) of every name: issuer if declared, else mentioned; names that aren't there are left out."""
    out = []
    for name in names:
        said = folded_opening.rlike(rf"\b(?:issued by|published by|emitido por|publicado por)\s*[:=-]?\s*{re.escape(name)}\b")
        role = F.when((author == name) | said, "issuer").when(folded_opening.contains(name), "mentioned")
        out.append(F.when(role.isNotNull(), F.struct(F.lit(name).alias("name"), role.alias("role"))))
    return F.array_compact(F.array(*out))


#: Authorities and the form of their identifiers.
AUTHORITIES = {"ISO": r"\bISO(?:/IEC)?[ -]?(\d{3,5})(?:[:-](\d{4}))?", "IEEE": r"\bIEEE[ -]?(?:Std\.? ?)?(\d{2,4}(?:\.\d+)?)", "RFC": r"\bRFC[ -]?(\d{3,5})", "NIST": r"\bNIST SP[ -]?(\d{3}-\d+)"}


def references(text: Column) -> Column:
    """Distinct authority identifiers in a text, the most specific of those with one beginning."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in AUTHORITIES.values()]))
    clean = F.array_distinct(F.transform(found, lambda x: F.upper(F.regexp_replace(x, r"[ -]+", " "))))
    return F.array_sort(F.filter(clean, lambda x: ~F.exists(clean, lambda y: (y != x) & y.startswith(x))))


def trace_targets(scored: DataFrame, targets: list[int], key: str, k: int, floor: float) -> DataFrame:
    """Where each of a few named items left the search: rank over all, score, and the stage that dropped it."""
    own = scored.filter(F.col(key).isin(targets)).select("query_id", key, F.col("score").alias("own"))
    above = own.join(scored.select("query_id", "score", F.col(key).alias("other")), "query_id").groupBy("query_id", key, "own").agg(
        F.count_if((F.round("score", 6) > F.round("own", 6)) | ((F.round("score", 6) == F.round("own", 6)) & (F.col("other") < F.col(key)))).alias("better")
    )
    stage = F.when(F.col("own") < floor, "below_floor").when(F.col("better") >= k, "beyond_limit").otherwise("returned")
    return above.select("query_id", key, (F.col("better") + 1).alias("rank"), F.round("own", 5).alias("score"), stage.alias("stage"))
