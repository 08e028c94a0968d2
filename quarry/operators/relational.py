"""Relational shapes that Spark has no single call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key. Spark prunes the rows of each task to n a key before the shuffle."""
    return ranked(rows, keys, order, name).filter(F.col(name) <= n)


def with_total(rows: DataFrame, name: str = "total") -> DataFrame:
    """The row count beside each row: one aggregated row is joined, no window gathers the table."""
    return rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias(name))))


def equality_filter(rows: DataFrame, wanted: dict[str, str | None]) -> DataFrame:
    """Conjunction of case-insensitive equalities; None doesn't restrict, a missing column gives no rows."""
    for column, value in wanted.items():
        if value is None:
            continue
        if column not in rows.columns:
            return rows.limit(0)
        rows = rows.filter(F.lower(column) == value.lower())
    return rows


def legacy_projection(rows: DataFrame, columns: dict[str, object]) -> DataFrame:
    """Columns by name, a constant where the table lacks one."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(d).alias(c) for c, d in columns.items()])


def cascaded_match(left: DataFrame, right: DataFrame, strict: list[str], loose: list[str], left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id, status: matched on the strict keys, else on the loose ones, ambiguous where several, else missing."""

    def match(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
        found = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(right_id).alias("only"))
        return rows.join(found, keys).select(
            left_id,
            F.when(F.col("n") == 1, F.col("only")).alias(right_id),
            F.when(F.col("n") == 1, label).otherwise("ambiguous").alias("status"),
        )

    first = match(left, strict, "strict")
    rest = left.join(first.select(left_id), left_id, "left_anti")
    second = match(rest, loose, "loose")
    missing = rest.join(second.select(left_id), left_id, "left_anti").select(
        left_id, F.lit(None).cast(right.schema[right_id].dataType).alias(right_id), F.lit("missing").alias("status")
    )
    return first.unionByName(second).unionByName(missing)


def nearest_root(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """The longest root that contains each path.

    A path's containing folders are its prefixes at each separator, so containment is an equi-join on
    them and no pair of path and root is ever formed.
    """
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = paths.select(path, F.explode(prefixes).alias(root)).join(roots.select(root), root)
    return found.groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: an order-independent digest of framed rows, and their number.

    Rows are hashed where they are and summed by 32-bit words, so no task orders the table.
    """
    framed = F.concat_ws(
        "\x1e",
        *[F.coalesce(F.concat(F.lit("V"), F.octet_length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("N")) for c in columns],
    )
    digest = F.sha2(framed, 256)
    word = lambda i: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.pmod(F.coalesce(F.sum(word(i)), F.lit(0).cast("decimal(38,0)")), F.lit(2**32).cast("decimal(38,0)")).cast("long").alias(f"word{i}") for i in range(4)],
    )


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, tagged."""
    return a.subtract(b).withColumn("side", F.lit("only_left")).unionByName(b.subtract(a).withColumn("side", F.lit("only_right")))


def set_equality(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Per key of either side: whether both sides have the same set of values."""
    both = (
        a.select(key, value, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(b.select(key, value, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(key, value)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )
    return both.groupBy(key).agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("missing_right"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("missing_left"),
        (F.min("l") + F.min("r") == 2).alias("exact"),
    )


def projection_match(published: DataFrame, live: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key: same, changed, added or removed between two projections, nulls being equal."""
    l, r = published.select(key, *columns).alias("l"), live.select(key, *columns).alias("r")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    status = (
        F.when(F.col(f"l.{key}").isNull(), "added")
        .when(F.col(f"r.{key}").isNull(), "removed")
        .when(same, "same")
        .otherwise("changed")
    )
    return l.join(r, F.col(f"l.{key}") == F.col(f"r.{key}"), "full").select(
        F.coalesce(f"l.{key}", f"r.{key}").alias(key), status.alias("status")
    )


def fair_share(rows: DataFrame, root: str, order: list[str], budget: int) -> DataFrame:
    """Rows admitted when each root in turn may take ceil(remaining budget / remaining roots).

    The roots and their sizes are few (one row a root); only they are seen together.
    """
    sizes = [(r[0], r[1]) for r in rows.groupBy(root).count().orderBy(root).collect()]
    left, quota = budget, []
    for i, (name, n) in enumerate(sizes):
        take = min(n, -(-left // (len(sizes) - i)))
        quota.append((name, take))
        left -= take
    table = rows.sparkSession.createDataFrame(quota, f"{root} string, quota long")
    kept = ranked(rows, [root], [F.col(c) for c in order], "place").join(F.broadcast(table), root)
    return kept.filter(F.col("place") <= F.col("quota"))


def closure(edges: DataFrame, seeds: DataFrame, parent: str, child: str, most: int | None = None) -> DataFrame:
    """node, depth: everything reachable from the seeds, at its least depth (up to most, if given), over a graph that may have cycles.

    Breadth first, one join a level, on the frontier only, until a level finds nothing new.  The levels met so far are kept as one
    checkpointed table, so that the plan does not grow with the depth.
    """
    from quarry.plans.shared import checkpointed

    e = edges.select(F.col(parent).alias("node"), F.col(child).alias("next")).filter("node is not null and next is not null").distinct()
    found = checkpointed(seeds.select(F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("depth")).distinct())
    frontier, depth = found, 0
    while most is None or depth < most:
        depth += 1
        reached = frontier.join(e, "node").select(F.col("next").alias("node")).distinct()
        frontier = checkpointed(reached.join(found, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return found
        found = checkpointed(found.unionByName(frontier))
    return found
