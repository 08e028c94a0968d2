"""Intermediate tables in the folder that all executors share, and size-checked joins.

The shared folder is the session's ``spark.checkpoint.dir``.  Only where that is unset (tests on one
machine) a temporary folder of our own takes its place.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted table of narrow rows is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000

_own_dir: str | None = None
_noting: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if _own_dir is None:
            _own_dir = "file://" + tempfile.mkdtemp(prefix="quarry-")
        base = _own_dir
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder."""
    path = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex[:12]}-{tag}"
    for places in _noting:
        places.append(path)
    return path


@contextmanager
def noted(places: list[str]) -> Iterator[None]:
    """Add the places of the tables that are written meanwhile to the list, for delete() once they are read."""
    _noting.append(places)
    try:
        yield
    finally:
        _noting[:] = [x for x in _noting if x is not places]  # lists of the same places are equal


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, what a query shuffled is deleted when the query ends, as its result is in the shared folder by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, places: list[str]) -> None:
    """Delete the tables at these places and empty the list."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while places:
        path = jvm.org.apache.hadoop.fs.Path(places.pop())
        path.getFileSystem(conf).delete(path, True)


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a stored table of narrow rows for broadcast if its counted rows are few; else leave it to a shuffle."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Rows of docs whose key is not in the stored one-column table dropped; rows with a null key stay."""
    return docs.join(sized(dropped), key, "left_anti").select(docs.columns)


def with_row_ids(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """docs with a column that tells rows apart: the id where one row alone has it, else a number below 0 from id and text.

    Rows that agree in id and text have one number.
    """
    several = stored(docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(id_col), "ids")
    own = F.col(id_col).cast("long")
    made = -1 - F.shiftrightunsigned(F.xxhash64(own, F.col(text_col)), 1)
    if several.isEmpty():
        return docs.withColumn(name, F.coalesce(own, made))
    shared = sized(several.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias(f"{name} shared")))
    marked = docs.join(shared, F.col(id_col) == F.col(f"{name} shared"), "left")
    return marked.withColumn(name, F.when(F.col(f"{name} shared").isNull(), F.coalesce(own, made)).otherwise(made)).drop(f"{name} shared")


#: Rows and bytes of an Arrow batch at most: a worker that several operators share keeps what it once took.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers unless their path already has it, and bound their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = str(Path(__file__).resolve().parents[2])
    if root in os.environ.get("PYTHONPATH", "").split(":") or os.path.realpath(os.getcwd()) == root:
        return
    if getattr(spark.sparkContext, "_quarry_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="quarry-zip-")) / "quarry.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(Path(root, "quarry").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._quarry_shipped = True
