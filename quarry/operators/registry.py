"""Named routes and interchangeable implementations, chosen by declared facts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Route:
    """A DataFrame-to-DataFrame extractor for a prefix of media types."""

    name: str
    media_prefix: str
    apply: Callable[[DataFrame], DataFrame]


def run_routes(files: DataFrame, routes: list[Route], media: str = "media_type") -> DataFrame:
    """Each file goes through the first route whose prefix its type has; results are tagged by route."""
    choice = F.lit(None).cast("string")
    for r in reversed(routes):
        choice = F.when(F.col(media).startswith(r.media_prefix), r.name).otherwise(choice)
    routed = files.withColumn("route", choice)
    parts = [r.apply(routed.filter(F.col("route") == r.name).drop("route")).withColumn("route", F.lit(r.name)) for r in routes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def broker(implementations: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, implementation, status: the best implementation that fits a request, or abstained.

    implementations: implementation, capability, mime_types, languages, network, max_bytes, quality, cost;
    requests: request_id, capability, mime, language, allow_network, bytes.  Both are small stated tables.
    Of those that fit, the highest quality, then the lowest cost, then the name decides.
    """
    i, r = F.broadcast(implementations).alias("i"), requests.alias("r")
    fits = (
        F.array_contains("i.mime_types", F.col("r.mime"))
        & (F.array_contains("i.languages", F.col("r.language")) | F.array_contains("i.languages", F.lit("*")))
        & (F.col("r.allow_network") | ~F.col("i.network"))
        & (F.coalesce(F.col("i.max_bytes"), F.lit(2**62)) >= F.col("r.bytes"))
    )
    found = r.join(i, F.col("i.capability") == F.col("r.capability"), "left").select("r.request_id", F.when(fits, F.struct((-F.col("i.quality")).alias("q"), F.col("i.cost").alias("c"), F.col("i.implementation").alias("n"))).alias("x"))
    best = found.groupBy("request_id").agg(F.min("x")["n"].alias("implementation"))
    return best.withColumn("status", F.when(F.col("implementation").isNull(), "abstained").otherwise("selected"))
