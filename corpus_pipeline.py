"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, benchmark decontamination, BPE.

Each stage is called with the rows its predecessor kept, written as Parquet and read again.  When a stage
begins, its predecessor's result has been written, so the predecessor's intermediate tables are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import bpe_encode
from quarry.llm.decontaminate import decontaminate
from quarry.llm.exact_dedup import exact_dedup
from quarry.llm.jaccard_join import jaccard_join
from quarry.llm.language_id import UNDETERMINED, fold, language_id, learn
from quarry.llm.queries import vocabulary
from quarry.llm.scratch import delete, new_path, noted, sized, stored, with_row_ids, without


#: Tells rows apart where ids don't.
ROW = "pipeline row"
#: Tables of the stage that began last, still read when its result is written.
_last: list[str] = []


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the preceding stage's tables, note this one's."""
    delete(spark, _last)
    with noted(_last):
        yield


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (no letter at all) go."""
    with stage_tables(spark):
        model = learn(docs.filter(~fold(F.col("doc_id"))), "text", "lang")
        labelled = language_id(docs, model, with_spans=False, whole_rows=True)
        return labelled.filter(F.col("lang_pred") != UNDETERMINED).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: that with the largest id that is its own, else one whose id is null or shared."""
    with stage_tables(spark):
        rows = with_row_ids(docs, "doc_id", "text", ROW)
        found = exact_dedup(rows, ROW)
        kept = without(rows, stored(found.filter(~F.col("kept")).select(F.col("doc_id").alias(ROW)).distinct(), "copies"), ROW)
        again = stored(kept.filter(F.col(ROW) < 0).groupBy(ROW).count().filter("count > 1").select(ROW), "repeated")
        if not again.isEmpty():  # rows that agree in id and text
            first = kept.join(sized(again), ROW, "left_semi").dropDuplicates([ROW])
            kept = without(kept, again, ROW).unionByName(first)
        return kept.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a connected group of similar texts the row with the smallest id stays; ids that are null or shared count as below all."""
    with stage_tables(spark):
        rows = with_row_ids(docs, "doc_id", "text", ROW)
        found = jaccard_join(rows, ROW)
        gone = found.filter(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias(ROW)).distinct()
        return without(rows, stored(gone, "near-copies"), ROW).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    with stage_tables(spark):
        rows = with_row_ids(docs, "doc_id", "text", ROW)
        found = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ROW)
        return without(rows, stored(found.select(F.col("doc_id").alias(ROW)).distinct(), "contaminated"), ROW).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every remaining document."""
    with stage_tables(spark):
        return bpe_encode(docs, vocabulary(), with_output=True).drop("decoded")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: Language labels, set similarity by shingles and token ids are beyond SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
