"""Readers for the analytic tables, snapshots of generations, and pages of them."""

from __future__ import annotations

import tomllib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_of(documents: DataFrame) -> DataFrame:
    """The documents as an inventory of files: path, identity, size, mtime, content.

    Paths are made up from the source and id; every fifth name has a numbered copy suffix and every
    seventh of the others a worded one.
    """
    suffix = F.when(F.col("doc_id") % 5 == 0, " (1)").when(F.col("doc_id") % 7 == 0, "_copy").otherwise("")
    path = F.concat(F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), suffix, F.lit(".txt"))
    return documents.select(
        path.alias("path"),
        F.lit(1).cast("long").alias("volume_id"),
        F.col("doc_id").alias("file_id"),
        F.col("n_chars").alias("size"),
        (F.col("doc_id") * 1000).alias("mtime_ns"),
        F.col("text").alias("content"),
    )


def scan_files(spark: SparkSession, root: str, glob: str | None = None, with_content: bool = False) -> DataFrame:
    """Recursive listing of a root: path, size, mtime and, on demand, content; columns that are not asked for are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(root)
    columns = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return rows.select(*columns, *(["content"] if with_content else []))


def excluded(
    path: Column, names: list[str] = (), prefixes: list[str] = (), fragments: list[str] = (), suffixes: list[str] = ()
) -> Column:
    """Whether the exclusion policy rejects a path: exact last names, prefixes, fragments or suffixes."""
    tests = [F.element_at(F.split(path, "/"), -1).isin(list(names))] if names else []
    tests += [path.startswith(p) for p in prefixes] + [path.contains(f) for f in fragments] + [path.endswith(s) for s in suffixes]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def published(generations: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """Rows of the generations that the heads table publishes."""
    return generations.join(heads.select(key), key, "left_semi")


def keyset_page(rows: DataFrame, order: list[str], after: list, size: int) -> DataFrame:
    """The ``size`` rows that follow a cursor in a total order of columns."""
    cursor = F.struct(*[F.lit(v).alias(c) for c, v in zip(order, after, strict=True)])
    return rows.filter(F.struct(*order) > cursor).orderBy(*order).limit(size)


def union_sources(sources: dict[str, DataFrame], kind: str = "source_kind") -> DataFrame:
    """One iterator per owner projected to a common record, tagged by owner."""
    tagged = [df.withColumn(kind, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Strict JSON lines: a record that doesn't fit the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def overlay(spark: SparkSession, path: str, known: set[str]) -> DataFrame:
    """Rows (section, label, alias) of an optional TOML file that adds to the rule tables; unknown sections are refused."""
    with open(path, "rb") as f:
        content = tomllib.load(f)
    if unknown := set(content) - known:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    rows = [(section, label, alias) for section, labels in content.items() for label, own in labels.items() for alias in own]
    return spark.createDataFrame(rows, "section string, label string, alias string")
