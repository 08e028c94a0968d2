import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import chunking as K
from quarry.operators import lifecycle as L
from quarry.operators import neardup as N
from quarry.operators import relational as R
from quarry.operators import retrieval as V
from quarry.sources import sinks, tables
from quarry.streaming import events as S


def reasons(spark, texts, tabular=False):
    t = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.r for r in t.select("i", X.quality(F.col("t"), tabular)["reason"].alias("r")).orderBy("i").collect()]


def test_every_quality_gate(spark):
    texts = ["", "ab", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15", "x" * 513, "Ã© Ã¨ text", "a " + "QUJD" * 25 + " b", "word " * 50, "plain words"]
    assert reasons(spark, [None, *texts]) == [
        "empty", "empty", "too_short", "low_alphabetic_content", "oversized_token", "mojibake", "encoded_binary_text", "repetitive_machine_text", "eligible"
    ]
    formulas = "=SUM(A1) =SUM(B2) A3 B4 C5 D6 E7 F8 G9"
    assert reasons(spark, [formulas], True) == ["spreadsheet_formula_dump"] and reasons(spark, [formulas]) == ["eligible"]


def test_native_quality(spark):
    texts = ["short", "中文内容可以比较短一些没有问题", "�" * 3 + "a" * 10 + "b" * 20, "." * 30 + "abc", "ab" * 60, "abcdefghijklmnop" + "x" * 40, "a normal sentence with enough letters"]
    t = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = [r.r for r in t.select("i", X.native_quality(F.col("t"), 24)["reason"].alias("r")).orderBy("i").collect()]
    assert out == ["too_short", "usable", "suspicious_unicode_or_mojibake", "low_alphanumeric_density", "low_character_diversity", "pathological_character_run", "usable"]


def test_evidence_extraction(spark):
    t = "On 2024-03-05, 13/02/2023 and 02/13/2023; 5 de mayo de 2020. Total 123456 S/N: AB-12/x 115,50 kV, 3.0 mm; /srv/data/file.txt TC-22 deadbeefdeadbeefdead"
    r = spark.createDataFrame([(t,)], "t string").select(
        X.dates(F.col("t")).alias("d"), X.measurements(F.col("t")).alias("m"), X.exact_terms(F.col("t")).alias("e")
    ).first()
    assert r.d == ["2020-05-05", "2023-02-13", "2024-03-05"] and r.m == ["115.5 kv", "3 mm"]
    assert {(x.kind, x.term) for x in r.e} >= {("path", "/srv/data/file.txt"), ("identifier", "TC-22"), ("hash", "deadbeefdeadbeefdead")}


def test_excel_serials(spark):
    r = spark.range(1).select(X.excel_date(F.lit(59)).alias("a"), X.excel_date(F.lit(61)).alias("b"), X.excel_date(F.lit(1), True).alias("c")).first()
    assert [str(x) for x in r] == ["1900-02-28", "1900-03-01", "1904-01-02"]


def test_windows_cover_the_text_and_keep_their_limits():
    rng = random.Random(1)
    limits = K.Windows(chars=200, terms=30, overlap_chars=40, overlap_terms=6, least=50)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "a ", "longerword ", "\n", "\n\n", "end. ", "x" * 300, "。"]) for _ in range(rng.randint(0, 80)))
        places = list(K.windows(text, limits))
        covered = set()
        for (a, b), later in zip(places, [*places[1:], None]):
            assert 0 < b - a <= 200 and len(text[a:b].split()) <= 30
            covered.update(range(a, b))
            assert later is None or a < later[0] <= b + 1 or text[b : later[0]].isspace()
        assert all(i in covered or c.isspace() for i, c in enumerate(text))
    exact = list(K.windows("one two three four five six", limits, tokens=lambda t: len(t.split()), budget=3))
    assert all(len("one two three four five six"[a:b].split()) <= 3 for a, b in exact)


def test_simhash_by_definition(spark):
    import hashlib

    text = "a b c d e f a b"
    w = text.split()
    features = [("token:" + x, 1) for x in w] + [("shingle:" + "\x1f".join(w[i : i + 5]), 2) for i in range(len(w) - 4)]
    counters = [0] * 64
    for f, weight in features:
        h = int.from_bytes(hashlib.sha256(f.encode()).digest()[:8], "big")
        for i in range(64):
            counters[i] += weight if h >> i & 1 else -weight
    want = sum(1 << i for i, c in enumerate(counters) if c >= 0)
    out = N.signatures(spark.createDataFrame([(1, text), (2, " . "), (3, None)], "k int, t string"), "k", "t").collect()
    assert [(r.k, r.simhash & (2**64 - 1)) for r in out] == [(1, want)]


def test_overlaps_packing_and_frames(spark):
    rows = [(1, "r", "v", "s", "a", 0, 10, 0.9), (1, "r", "v", "s", "b", 12, 20, 0.5), (1, "r", "v", "s", "c", 40, 50, 0.4)]
    t = spark.createDataFrame(rows, "query_id long, resource string, revision string, section string, evidence string, start long, end long, score double")
    out = {r.evidence: (r.merged, round(r.score, 6)) for r in V.cluster_overlaps(t, 5).collect()}
    assert out == {"a": (2, 1.4), "c": (1, 0.4)}
    hits = spark.createDataFrame([(1, 1, "a", 60), (1, 2, "b", 50), (1, 3, "c", 40)], "query_id long, rank long, evidence string, chars long")
    assert {r.evidence: r.packed for r in V.pack_context(hits, 100).collect()} == {"a": True, "b": False, "c": True}
    frames = spark.createDataFrame([(1, x) for x in (0, 200, 250, 300, 900)], "k int, at long")
    assert sorted((r.start, r.frames) for r in L.fuse_frames(frames, "k", "at", 250).collect()) == [(0, 3), (300, 1), (900, 1)]


def test_minimum_span(spark):
    t = spark.createDataFrame([(1, "b x a x x b a c"), (2, "a a a"), (3, "c b a")], "k int, t string")
    out = {r.k: (r.matched, r.phrase, r.span) for r in V.term_support(t, "k", "t", ["a", "b", "c"]).collect()}
    assert out == {1: (3, False, 3), 2: (1, False, None), 3: (3, False, 3)}


def test_evidence_aliases_count_once(spark):
    names = "query_id long, ranking string, source_rank long, resource string, revision string, evidence string, locator string, snippet string, disposition string, state string, coherent boolean, hard_mismatch boolean"
    rows = [
        (1, "a", 1, "r", "v", "e1", "p1", "Same  text", "ACTIVE", "CURRENT", False, False),
        (1, "b", 3, "r", "v", "e2", "p1", "same text", "ACTIVE", "CURRENT", False, False),
        (1, "b", 4, "r", "v", "e3", "p1", "other", "ACTIVE", "CURRENT", True, False),
        (1, "b", 5, "r", "v", "e4", None, "", "ACTIVE", "CURRENT", False, True),
        (1, "b", 6, "r2", "v", "e5", None, "", "DUPLICATE", "CURRENT", False, False),
    ]
    out = {r.evidence: round(r.score, 9) for r in V.evidence_rrf(spark.createDataFrame(rows, names)).collect()}
    assert out == {"e1": round(1 / 61 + 1 / 63, 9), "e3": round(1 / 64, 9)}


def test_publication_and_pages(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    sinks.publish_generation(a, str(tmp_path), 1)
    sinks.publish_generation(sinks.upsert(a, spark.createDataFrame([(2, "z"), (3, "w")], a.schema), ["k"]), str(tmp_path), 2)
    assert sorted(tuple(r) for r in sinks.read_published(spark, str(tmp_path)).select("k", "v").collect()) == [(1, "x"), (2, "z"), (3, "w")]
    rows = spark.range(50).selectExpr("id", "id % 3 as g")
    first = tables.keyset_page(rows, ["g", "id"], [0, 6], 3).collect()
    assert [(r.g, r.id) for r in first] == [(0, 9), (0, 12), (0, 15)]


def test_strict_json_and_overlay(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"a": 1}\n')
    (tmp_path / "bad.json").write_text('{"a": "x"}\n')
    assert tables.read_json(spark, str(tmp_path / "good.json"), "a long").first().a == 1
    with pytest.raises(Exception):
        tables.read_json(spark, str(tmp_path / "bad.json"), "a long").collect()
    (tmp_path / "o.toml").write_text('[clients]\nacme = ["acme corp", "acme"]\n')
    assert tables.overlay(spark, str(tmp_path / "o.toml"), {"clients"}).count() == 2
    with pytest.raises(ValueError):
        tables.overlay(spark, str(tmp_path / "o.toml"), {"other"})


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "p long, c long")
    out = {r.node: r.depth for r in R.closure(edges, spark.createDataFrame([(1,)], "n long"), "p", "c").collect()}
    assert out == {1: 0, 2: 1, 3: 2, 4: 3}


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)], "p long, c long")
    out = {r.node: r.depth for r in R.closure(edges, spark.createDataFrame([(0,)], "n long"), "p", "c").collect()}
    assert out == {i: i for i in range(71)}


def test_published_heads_beyond_ten_thousand(spark):
    rows = spark.range(12_500).withColumnRenamed("id", "generation")
    assert tables.published(rows, rows.filter("generation % 25 <> 0"), "generation").count() == 12_000


def test_outbox_goes_on_after_a_restart(spark, tmp_path):
    seen, data = [], spark.range(20).withColumnRenamed("id", "event_id")
    apply = lambda b: seen.extend(r.event_id for r in b.collect())
    place = str(tmp_path / "mark")
    S.Outbox("event_id", apply, place=place)(data.filter("event_id < 12"), 0)
    again = S.Outbox("event_id", apply, place=place)
    again(data, 1)
    assert sorted(seen) == list(range(20)) and again.mark == 19
    S.Outbox("event_id", apply, place=place)(data, 2)
    assert len(seen) == 20


def test_streams(spark, tmp_path):
    rows = [(i, i % 4, ["view", "error", "purchase", "signup"][i % 4], f"2024-01-01 00:{i:02d}:00") for i in range(40)]
    data = spark.createDataFrame(rows, "event_id long, run long, kind string, at string").withColumn("at", F.col("at").cast("timestamp"))
    data.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = S.watch(spark, str(tmp_path / "in"), data.schema, files_per_trigger=2)
    S.run_once(S.idempotent(stream, ["run"], "at", "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp1"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    seen = []
    outbox = S.Outbox("event_id", lambda b: seen.extend(r.event_id for r in b.collect()))
    S.run_batches(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), outbox, str(tmp_path / "cp2"))
    outbox(data, 99)
    assert sorted(seen) == list(range(40)) and outbox.mark == 39
    states = {}
    lifecycle = S.lifecycle(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), "run", "kind", "at")
    lifecycle.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp3")).foreachBatch(
        lambda b, _: states.update({r.run: (r.state, r.events) for r in b.collect()})
    ).trigger(availableNow=True).start().awaitTermination()
    assert states == {0: ("running", 10), 1: ("failed", 10), 2: ("complete", 10), 3: ("planned", 10)}


def test_vector_search_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "k long, v array<float>")
    q = t.filter("k % 100 = 0").selectExpr("k as query_id", "v")
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    for block in (2, 256):
        out = V.vector_search(t, q, "k", "v", 5, block=block).collect()
        for i in (0, 100, 200):
            want = np.argsort(-(u @ u[i]))[:5].tolist()
            assert [r.k for r in sorted((r for r in out if r.query_id == i), key=lambda r: r.rank)] == want
    pair = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    assert [r.c and round(r.c, 9) for r in pair.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [None, 1.0]
