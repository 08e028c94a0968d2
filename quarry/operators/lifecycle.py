"""Diagnostics, findings, lineage, retention, retries and reconciliation of corpus state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.relational import closure, top_per_key


def federated(owners: dict[str, DataFrame]) -> DataFrame:
    """record_id, path, code, message, status, owner of every owner's records in one table."""
    from quarry.sources.tables import union_sources

    columns = ["record_id", "path", "code", "message", "status"]
    return union_sources({k: v.select(*columns) for k, v in owners.items()}, "owner")


def scoped(rows: DataFrame, root: str | None = None, contains: str | None = None, path: str = "path") -> DataFrame:
    if root is not None:
        rows = rows.filter((F.col(path) == root) | F.col(path).startswith(root.rstrip("/") + "/"))
    return rows.filter(F.instr(path, contains) > 0) if contains else rows


#: The order in which recommendations are listed.
PRIORITY = {"deletion_candidate": 0, "manual_review": 1, "keep_protected": 2}


def priority(recommendation: Column) -> Column:
    out = F.lit(3)
    for name, p in PRIORITY.items():
        out = F.when(recommendation == name, p).otherwise(out)
    return out


def findings_page(findings: DataFrame, size: int, after: tuple | None = None, status: str = "open") -> DataFrame:
    """Findings by priority, confidence (highest first), route, path and reason, after a cursor of these."""
    rows = findings.filter(F.col("status") == status).withColumns({"priority": priority(F.col("recommendation")), "less_sure": -F.col("confidence")})
    order = ["priority", "less_sure", "route_name", "path", "reason_code"]
    if after is not None:
        rows = rows.filter(F.struct(*order) > F.struct(*[F.lit(v).alias(c) for c, v in zip(order, after, strict=True)]))
    return rows.orderBy(*order).limit(size).drop("less_sure")


def latest_stage(events: DataFrame, run: str, stage: str, order: list[str]) -> DataFrame:
    """run, stage and the last event of each."""
    rest = [c for c in events.columns if c not in (run, stage, *order)]
    return events.groupBy(run, stage).agg(F.max(F.struct(*order, *rest)).alias("x")).select(run, stage, "x.*")


def idempotent(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first event of each idempotency key."""
    return top_per_key(events, key, [F.asc(c) for c in order], 1, "_n").drop("_n")


def reconcile_findings(previous: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Status after a run: open where the reason is there again, resolved where it is gone, new where it wasn't."""
    p = previous.select(*key, F.col("status").alias("was"))
    c = current.select(*key).distinct().withColumn("now", F.lit(True))
    joined = p.join(c, key, "full")
    action = (
        F.when(F.col("was").isNull(), "new")
        .when(F.col("now").isNull() & (F.col("was") == "open"), "resolved")
        .when(F.col("now") & (F.col("was") == "resolved"), "reopened")
        .otherwise("unchanged")
    )
    status = F.when(F.col("now"), "open").otherwise("resolved")
    return joined.select(*key, action.alias("action"), status.alias("status"))


def lineage(edges: DataFrame, targets: DataFrame, upstream: bool, most: int | None = None) -> DataFrame:
    """Everything a target is derived from, or everything derived from it, at its least distance, up to most if given."""
    ends = ("child", "parent") if upstream else ("parent", "child")
    return closure(edges, targets, *ends, most)


def retention(scans: DataFrame, edges: DataFrame, heads: DataFrame, now: int, least_age: int | None) -> DataFrame:
    """scan_id, disposition, reason: what a head reaches is held, the rest is judged by age.

    scans: scan_id, ended; edges: parent, child; heads: scan_id.
    """
    held = closure(edges, heads, "parent", "child").select(F.col("node").alias("scan_id"), F.lit(True).alias("held"))
    rows = scans.join(held, "scan_id", "left")
    age = F.lit(now) - F.col("ended")
    if least_age is None:
        verdict = [F.lit("protected"), F.lit("policy_not_configured")]
    else:
        young = (F.col("ended") > now) | (age < least_age)
        verdict = [
            F.when(F.col("ended").isNull(), "blocked").when(young, "protected").otherwise("eligible"),
            F.when(F.col("ended").isNull(), "terminal_timestamp_missing").when(young, "minimum_age_not_reached").otherwise("explicit_age_policy_matched"),
        ]
    return rows.select(
        "scan_id",
        F.when(F.col("held"), "protected").otherwise(verdict[0]).alias("disposition"),
        F.when(F.col("held"), "reachable_from_head").otherwise(verdict[1]).alias("reason"),
    )


#: Failures that more resources, another worker or a later try may mend.
RESOURCE_ERRORS = ["MemoryError", "PermissionError", "MemoryBudgetExceeded", "ResourceError"]
TIMEOUTS, INTERRUPTED, CHILD = ["DocumentTimeout"], ["InterruptedProcessing"], ["ChildExitError", "ChildProcessError"]


def failure_policy(error: Column, message: Column) -> Column:
    """struct(reason, retryable, recommendation) of a failure."""
    low = F.lower(message)
    rule = lambda reason, retry, what: F.struct(F.lit(reason).alias("reason"), F.lit(retry).alias("retryable"), F.lit(what).alias("recommendation"))
    return (
        F.when(error == "Encrypted", rule("password_required", False, "keep_protected"))
        .when(error.isin(TIMEOUTS), rule("document_timeout", True, "retry"))
        .when(error.isin(INTERRUPTED), rule("interrupted_processing", True, "retry"))
        .when(error.isin(CHILD), rule("child_exit", True, "retry"))
        .when(error.isin(RESOURCE_ERRORS), rule("resource_failure", True, "retry"))
        .when((error == "OperationalError") & (low.contains("locked") | low.contains("busy")), rule("state_contention", True, "retry"))
        .when(low.contains("source metadata changed"), rule("source_changed", True, "retry"))
        .otherwise(rule("unknown_failure", False, "manual_review"))
    )


def retry_decision(status: Column, attempts: Column, next_try: Column, now: int, most: int) -> Column:
    """What to do with a cached result."""
    return (
        F.when(status == "complete", "reuse")
        .when(status == "permanent", "skip_permanent")
        .when(attempts >= most, "give_up")
        .when(next_try > now, "wait")
        .when(status == "transient", "retry")
        .otherwise("process")
    )


def workload(planned: DataFrame, published: DataFrame, key: list[str]) -> DataFrame:
    """One row: contents, occurrences, bytes and what of them a published content can serve.

    planned: key, occurrences, bytes; published: key, reusable.
    """
    rows = planned.join(published, key, "left")
    ready = F.coalesce(F.col("reusable"), F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("contents"),
        F.sum("occurrences").alias("occurrences"),
        F.sum("bytes").alias("bytes"),
        F.sum(F.col("bytes") * F.col("occurrences")).alias("total_bytes"),
        F.count_if(ready).alias("reusable"),
        F.count_if(~ready).alias("new_unique"),
        F.sum(F.when(ready, F.col("bytes")).otherwise(0)).alias("reused_bytes"),
    )


def staged(previous: DataFrame, current: DataFrame, key: str, revision: str) -> DataFrame:
    """key, action: unchanged revisions are skipped, changed ones staged, unseen ones deactivated."""
    p, c = previous.select(key, F.col(revision).alias("old")), current.select(key, F.col(revision).alias("new"))
    action = F.when(F.col("new").isNull(), "deactivate").when(F.col("old").isNull(), "insert").when(F.col("old") == F.col("new"), "skip").otherwise("replace")
    return p.join(c, key, "full").select(key, action.alias("action"))


def rebind(owners: DataFrame, transitions: DataFrame, path: str = "path") -> DataFrame:
    """Owner rows with their paths moved as the transitions (old, new) say, and whether they were."""
    moved = owners.join(transitions.withColumnRenamed("old", path), path, "left")
    rest = [c for c in owners.columns if c != path]
    return moved.select(F.coalesce("new", path).alias(path), *rest, F.col("new").isNotNull().alias("moved"))


def stale_owners(incoming: DataFrame, stored: DataFrame, path: str, key: str) -> DataFrame:
    """Paths whose stored owner is another file than the incoming one."""
    both = incoming.select(path, F.col(key).alias("incoming")).join(stored.select(path, F.col(key).alias("stored")), path)
    return both.filter(F.col("incoming") != F.col("stored"))


def duplicate_relation(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """file_id, disposition of each wanted file: keeper, duplicate, ambiguous or unique, with the group's proof counts.

    A group proves itself if it has one keeper and as many members as it says; its counts are made once a
    group, not once a file.
    """
    groups = members.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "keeper").alias("keepers"), F.count_distinct("file_id").alias("identities")
    )
    own = members.select("file_id", "sha256", "role").join(groups, "sha256")
    rows = wanted.join(own, "file_id", "left")
    sound = (F.col("keepers") == 1) & (F.col("identities") == F.col("n"))
    disposition = F.when(F.col("sha256").isNull(), "unique").when(~sound, "ambiguous").when(F.col("role") == "keeper", "keeper").otherwise("duplicate")
    return rows.select("file_id", disposition.alias("disposition"), F.coalesce("n", F.lit(1)).alias("members"))


def fuse_frames(frames: DataFrame, key: str, at: str, within: int) -> DataFrame:
    """key, start, frames: times within a distance of a cluster's first one fall into it.

    The anchor is the cluster's start, so each key's times are folded in order; a key's times are bounded
    by its length.
    """
    times = frames.groupBy(key).agg(F.sort_array(F.collect_list(at)).alias("t"))
    fold = F.aggregate(
        "t",
        F.array().cast("array<struct<start:bigint,n:bigint>>"),
        lambda acc, t: F.when(
            (F.size(acc) > 0) & (t - F.element_at(acc, -1)["start"] <= within),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), (F.element_at(acc, -1)["n"] + 1).alias("n"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(t.cast("long").alias("start"), F.lit(1).cast("long").alias("n"))))),
    )
    return times.select(key, F.explode(fold).alias("x")).select(key, "x.start", F.col("x.n").alias("frames"))


def stage_facts(assets: DataFrame, stages: dict[str, DataFrame], key: str) -> DataFrame:
    """key, first_gap, facts: which stages an asset has been through and the first one it lacks."""
    rows = assets.select(key).distinct()
    for name, table in stages.items():
        rows = rows.join(table.select(key).distinct().withColumn(f"has_{name}", F.lit(True)), key, "left")
    has = {n: F.coalesce(F.col(f"has_{n}"), F.lit(False)) for n in stages}
    gap = F.lit(None).cast("string")
    for name in reversed(list(stages)):
        gap = F.when(~has[name], name).otherwise(gap)
    return rows.select(key, gap.alias("first_gap"), F.array_compact(F.array(*[F.when(h, n) for n, h in has.items()])).alias("facts"))
