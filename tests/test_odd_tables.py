"""Queries against their SQL on tables made for one case each."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from quarry.catalogue import ORACLES, QUERIES


def same_rows(spark, folder, name, ids, texts):
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())}), folder / "documents.parquet")
    out = QUERIES[name](spark, str(folder))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = db.execute(f"SELECT {', '.join(out.columns)} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in out.collect()]
    assert sorted(got) == sorted(want)
    return got


#: Occurrences of aliases that share one mark: blanks serve two, other marks one.
SHARED_MARKS = ["the\nthe", "the the  the", "The-the-the der, der\nder", "other der", "the", ""]


def test_alias_counts_of_shared_marks(spark, tmp_path):
    got = same_rows(spark, tmp_path, "alias_counts", range(6), SHARED_MARKS)
    assert sorted(got)[:3] == [(0, 1, 0), (1, 3, 0), (2, 2, 2)]


def test_lineage_impact_ends_where_its_sql_does(spark, tmp_path):
    """A chain of derivations: four times to a child, whose last id ends in 49 or 99, then to a seventh of that."""
    ids, node = [], 5
    for _ in range(7):
        last = 81 * node + (49 - 81 * node) % 50
        ids += [last // 27, last // 9, last // 3, last]
        node = last // 7
    got = same_rows(spark, tmp_path, "lineage_impact", ids, ["x"] * 28)
    assert max(depth for _, depth in got) == 24


def test_organisation_evidence_of_shared_marks(spark, tmp_path):
    same_rows(spark, tmp_path, "organisation_evidence", range(6), SHARED_MARKS)
