import random

import corpus_pipeline
from quarry.llm.bpe import PrefixBPE
from quarry.llm.queries import vocabulary
from tests.llm import brute
from tests.llm.conftest import SF


def test_stages_against_plain_versions(spark, tmp_path):
    """Every stage is held against a plain version on the rows that it was given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(10_000, "12 34 ... !?", "en", "x", 12), (10_001, None, None, None, None)], docs.schema)
    docs = docs.unionByName(junk)
    rows = {r.doc_id: r for r in docs.collect()}
    kept = dict(rows)
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        results.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == list(rows[0].asDict())
    assert results[0] == {i for i, r in kept.items() if r.text and any(c.isalpha() for c in r.text)}
    best = {}
    for i in results[0]:
        t = rows[i].text
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        best[key] = max(i, best.get(key, -1))
    assert results[1] == set(best.values())
    groups = brute.jaccard({i: rows[i].text for i in results[1]})
    assert results[2] == {i for i, (c, _) in groups.items() if c == i}
    passages = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert results[3] == {i for i in results[2] if not any(p in rows[i].text for p in passages)}
    assert results[4] == results[3]
    bpe = PrefixBPE(vocabulary())
    for r in docs.limit(50).collect():
        assert bytes(r.ids) == bpe.encode_packed(rows[r.doc_id].text) and r.n_tokens == len(r.ids) // 4


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() > 50


def test_rows_without_an_id_of_their_own(spark):
    """Null and repeated ids: a row is judged by its own text, and of wholly equal rows one stays."""
    rng = random.Random(3)
    text = lambda n=60: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    alone, twice, near, other = text(), text(), text(), text()
    rows = [(1, alone), (1, twice), (2, twice), (2, twice), (None, other), (None, other), (3, other.upper())]
    rows += [(4, near), (4, near + " end"), (None, near + " more"), (5, f"{text()} {passage}"), (5, text()), (None, f"{text()} {passage}")]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], schema)
    _, exact, similar, contaminated, _ = [f for _, f in corpus_pipeline.STAGES]
    key = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    gone = [("1", twice), ("None", other), ("None", other)]
    want = sorted(set((str(i), t) for i, t in rows) - set(gone))
    assert key(exact(spark, docs, SF)) == want
    left = key(similar(spark, docs, SF))
    assert len([x for x in left if x[1].startswith(near)]) == 1 and ("1", alone) in left
    assert key(contaminated(spark, docs, SF)) == sorted((str(i), t) for i, t in rows if passage not in t)


def test_stages_leave_other_tables_alone(spark):
    from quarry.llm.exact_dedup import exact_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    unread = exact_dedup(docs)
    corpus_pipeline.drop_exact_copies(spark, docs, SF)
    corpus_pipeline.encode(spark, docs, SF)
    assert unread.count() == docs.count()
