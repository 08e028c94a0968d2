"""Rule-based classification over tables of rules, corrections, destinations and image decisions.

Rules are data: rows of (label, scope-independent pattern).  The scoring operator is what this module is;
the small rule set at the end is our own, for text corpora.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import alias_count

#: What a match in each scope adds to a rule's base score.
SCOPE_BONUS = {"path": 0.18, "title": 0.27, "author": 0.08, "metadata": 0.12, "opening": 0.24, "text": 0.0}
SIGNAL_BONUS, MOST_SIGNALS, CAP = 0.04, 5, 0.92
ORGANISATION_WEIGHTS = {"path": 0.62, "title": 0.74, "author": 0.88, "metadata": 0.70, "opening": 0.62, "text": 0.38}

RULES = {
    "license_notice": ["licen[sc]e", r"version \d"],
    "credentials": ["token =", "AKIA"],
    "contact": [r"@[\w.]+", r"\(\d{3}\) \d{3}-\d{4}"],
    "table": [r"\|"],
    "english_prose": [r"(^|[^\p{L}])the($|[^\p{L}])", r"(^|[^\p{L}])with($|[^\p{L}])"],
    "german_prose": [r"(^|[^\p{L}])der($|[^\p{L}])", r"(^|[^\p{L}])und($|[^\p{L}])"],
}


def pattern_evidence(docs: DataFrame, key: str, scopes: dict[str, Column], rules: dict[str, list[str]], base: float) -> DataFrame:
    """key, label, score, signals: one row a label that any rule matched in any scope.

    Every pattern is one boolean per scope, evaluated once, where the row is: no join, no shuffle.
    """
    labels, counts = [], {}
    for n, (_, patterns) in enumerate(rules.items()):
        for s, t in scopes.items():
            hits = [F.coalesce(F.regexp_like(t, F.lit(f"(?i){p}")), F.lit(False)).cast("int") for p in patterns]
            counts[n, s] = reduce(lambda a, b: a + b, hits)
    docs = docs.select(key, *[c.alias(f"hits {n} {s}") for (n, s), c in counts.items()])
    for n, label in enumerate(rules):
        count = {s: F.col(f"hits {n} {s}") for s in scopes}
        signals = reduce(lambda a, b: a + b, count.values())
        best = F.greatest(*[F.when(c > 0, base + SCOPE_BONUS[s]).otherwise(0.0) for s, c in count.items()], F.lit(0.0))
        score = F.least(F.lit(CAP), best + SIGNAL_BONUS * F.least(signals - 1, F.lit(MOST_SIGNALS)))
        labels.append(F.struct(F.lit(label).alias("label"), F.round(score, 6).alias("score"), signals.alias("signals")))
    rows = docs.select(key, F.explode(F.filter(F.array(*labels), lambda x: x["signals"] > 0)).alias("x"))
    return rows.select(key, "x.label", "x.score", "x.signals")


def alias_evidence(docs: DataFrame, key: str, scopes: dict[str, Column], aliases: dict[str, list[str]], counted: Callable[[Column, str], Column] = alias_count) -> DataFrame:
    """key, label, score, hits: scope weight of the best hit, a little for each further one; counted(text, alias) gives the hits."""
    labels = []
    for label, own in aliases.items():
        count = {s: reduce(lambda a, b: a + b, [counted(t, a) for a in own]) for s, t in scopes.items()}
        hits = reduce(lambda a, b: a + b, count.values())
        best = F.greatest(*[F.when(c > 0, ORGANISATION_WEIGHTS[s]).otherwise(0.0) for s, c in count.items()], F.lit(0.0))
        score = F.least(F.lit(0.94), best + 0.05 * F.least(hits - 1, F.lit(4)))
        labels.append(F.struct(F.lit(label).alias("label"), F.round(score, 6).alias("score"), hits.alias("hits")))
    rows = docs.select(key, F.explode(F.filter(F.array(*labels), lambda x: x["hits"] > 0)).alias("x"))
    return rows.select(key, "x.label", "x.score", "x.hits")


def consolidate(evidence: DataFrame, key: str) -> DataFrame:
    """key, labels: the best score of each label, best first, ties by label."""
    best = evidence.groupBy(key, "label").agg(F.max("score").alias("score"))
    order = F.struct((-F.col("score")).alias("s"), F.col("label"), F.col("score"))
    return best.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: F.struct(x["label"], x["score"])).alias("labels"))


def classify(docs: DataFrame, evidence: DataFrame, key: str, partial: Column) -> DataFrame:
    """key, primary, confidence, margin, ambiguous, uncertainty of every document.

    A margin under 0.10 is ambiguous and costs 0.08, as does a partial source; uncertainty is baja from
    0.82, media from 0.68, else alta.
    """
    rows = docs.select(key, partial.alias("partial")).join(consolidate(evidence, key), key, "left")
    first, second = F.get("labels", F.lit(0)), F.get("labels", F.lit(1))
    score = F.coalesce(first["score"], F.lit(0.35))
    margin = F.when(second.isNotNull(), F.round(first["score"] - second["score"], 6)).otherwise(1.0)
    ambiguous = margin < 0.10
    confidence = F.round(F.greatest(F.lit(0.0), score - F.when(F.col("partial"), 0.08).otherwise(0.0) - F.when(ambiguous, 0.08).otherwise(0.0)), 6)
    uncertainty = F.when(F.col("confidence") >= 0.82, "baja").when(F.col("confidence") >= 0.68, "media").otherwise("alta")
    return rows.select(
        key, F.coalesce(first["label"], F.lit("otro")).alias("primary"), confidence.alias("confidence"), margin.alias("margin"), ambiguous.alias("ambiguous")
    ).withColumn("uncertainty", uncertainty)


def corrected(classified: DataFrame, corrections: DataFrame, key: str, dimension: str) -> DataFrame:
    """The latest valid correction of each document overrides one dimension; one whose fingerprint has drifted doesn't.

    corrections: key, fingerprint, value, revoked, sequence; classified has a fingerprint.
    """
    latest = corrections.groupBy(key).agg(F.max(F.struct("sequence", "fingerprint", "value", "revoked")).alias("c"))
    rows = classified.join(latest, key, "left")
    valid = F.coalesce((F.col("c.fingerprint") == F.col("fingerprint")) & ~F.col("c.revoked"), F.lit(False))
    status = F.when(F.col("c").isNull(), "none").when(F.col("c.revoked"), "revoked").when(valid, "applied").otherwise("fingerprint_drift")
    return rows.withColumns({dimension: F.when(valid, F.col("c.value")).otherwise(F.col(dimension)), "correction": status}).drop("c")


def destinations(classified: DataFrame, key: str, name: Column) -> DataFrame:
    """key, destination, abstained: a directory by kind and confidence, a stable suffix where two would collide."""
    reason = (
        F.when(F.col("primary") == "otro", "insufficient_identification").when(F.col("uncertainty") == "alta", "low_confidence").when(F.col("ambiguous"), "review_only")
    )
    proposed = F.when(reason.isNull(), F.concat_ws("/", F.lit(""), F.col("primary"), name))
    rows = classified.select(key, proposed.alias("proposed"), reason.alias("abstained"))
    taken = rows.filter("proposed is not null").groupBy("proposed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    marked = rows.join(taken, "proposed", "left")
    suffix = F.concat(F.lit("~"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8))
    return marked.select(key, F.when(F.col("n") > 1, F.concat("proposed", suffix)).otherwise(F.col("proposed")).alias("destination"), "abstained")


def image_decision(scores: dict[str, Column], texture: Column, animated: Column) -> Column:
    """struct(winner, score, runner_up, margin) of additive class scores; a weak winner falls back to photo, graphic or other."""
    ordered = F.sort_array(F.array(*[F.struct((-s).alias("s"), F.lit(n).alias("label")) for n, s in scores.items()]))
    top, second = ordered[0], ordered[1]
    best = -top["s"]
    fallback = F.when((scores["photo"] >= 2) | texture, "photo").when(scores["graphic"] >= 2.2, "graphic").otherwise("other")
    winner = F.when(animated, "animated").when(best < 3.0, fallback).otherwise(top["label"])
    return F.struct(winner.alias("winner"), F.round(best, 6).alias("score"), second["label"].alias("runner_up"), F.round(best + second["s"], 6).alias("margin"))


def single_flight(locations: DataFrame, content: list[str], path: str, most: int = 100) -> DataFrame:
    """One row a piece of work: its content key, number of locations and the first of them.

    Locations are capped in the sample only; the count covers all.
    """
    first = F.row_number().over(Window.partitionBy(*content).orderBy(path))
    rows = locations.withColumn("_n", first)
    return rows.groupBy(*content).agg(F.count(F.lit(1)).alias("locations"), F.sort_array(F.collect_list(F.when(F.col("_n") <= most, F.col(path)))).alias("sample"))
