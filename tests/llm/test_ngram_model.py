import math
import os
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ngram_model as lm
from quarry.llm.language_id import fold
from quarry.llm.queries import op5_lm_scoring
from tests.llm import brute
from tests.llm.conftest import SF


def test_scores_against_plain_kneser_ney(spark, docs):
    rows = docs.withColumn("out", fold(F.col("doc_id"), 7)).collect()
    model = brute.KneserNey([r.text for r in rows if not r.out])
    got = {r.doc_id: r for r in op5_lm_scoring(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own, words = got[r.doc_id], brute.lm_words(r.text)
        assert (own.n_tokens, own.held_out, own.train_tokens) == (len(words), r.out, sum(model.words.values()))
        assert own.n_known == sum(model.words[w] > 0 for w in words)
        assert own.base_score == pytest.approx(model.base(r.text), rel=1e-9)
        assert own.score == pytest.approx(model.score(r.text), rel=1e-9)


def test_probabilities_sum_to_one(docs):
    model = brute.KneserNey([r.text for r in docs.limit(20).collect()])
    some = sorted(model.triples, key=str)[:: len(model.triples) // 3]
    for context in [("<s>",), ("the",), ("never met",), ("never met", "the"), *[t[:2] for t in some]]:
        total = sum(model.after(context, w) for w in model.words) + model.after(context, "another word never met")
        assert total == pytest.approx(1, abs=1e-9)


def test_hard_rows_and_empty_tables(hard, empty):
    texts = [r.text for r in hard.collect()]
    plain = brute.KneserNey(texts)
    out = lm.score(hard, lm.train(hard, buckets=4)).collect()
    assert sorted(round(r.score, 6) for r in out) == sorted(round(plain.score(t), 6) for t in texts)
    nothing = lm.train(empty)
    out = lm.score(hard, nothing).collect()
    assert len(out) == len(texts) and all(r.train_tokens == 0 and r.score == 0 and math.isfinite(r.base_score) for r in out)
    assert lm.score(empty, nothing).count() == 0


def test_frequent_words_and_many_buckets(spark):
    texts = ["a b a b a b c " * 200, "a b", "b", "", None, *[f"a b w{k}" for k in range(400)], "a b w7"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = brute.KneserNey(texts)
    for buckets in (1, 32):
        model = lm.train(rows, buckets=buckets)
        assert (model.triples, model.pairs) == (len(plain.triples), len(plain.pairs))
        for r in lm.score(rows, model).collect():
            assert r.score == pytest.approx(plain.score(texts[r.doc_id]), rel=1e-9)


@pytest.mark.parametrize("most", [50_000, 100])
def test_more_files_than_may_be_open_or_mapped(spark, monkeypatch, most):
    """A large corpus has thousands of buckets, and a worker looks into all of them."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 900, 40)) for _ in range(60)]
    plain = brute.KneserNey(texts)
    reader = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), buckets=128).reader()
    monkeypatch.setattr(lm, "MOST_MAPS", most, raising=False)
    limits = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (max(map(int, os.listdir("/proc/self/fd"))) + 40, limits[1]))
    try:
        logs, _ = lm.score_tokens(reader, [lm.words_of(t) for t in texts])
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, limits)
    assert logs.sum() == pytest.approx(sum(map(plain.score, texts)), rel=1e-9)


@pytest.mark.parametrize("texts", [[None], ["", None, ""], ["one"], ["one", "one", "two"]])
def test_texts_without_longer_context(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain, model = brute.KneserNey(texts), lm.train(rows)
    assert (model.triples, model.pairs) == (len(plain.triples), len(plain.pairs))
    more = spark.createDataFrame([(0, "one two"), (1, None), (2, "three"), (3, "one one one")], "doc_id long, text string")
    for r in lm.score(more, model).collect():
        text = ["one two", None, "three", "one one one"][r.doc_id]
        assert r.score == pytest.approx(plain.score(text), rel=1e-9, abs=1e-12)


def test_training_leaves_settings_alone(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    lm.train(spark.createDataFrame([(0, "a b c")], "doc_id long, text string"))
    assert spark.conf.get(name) == before


def test_runs_survive_packing():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    counts = np.arange(4000, dtype=np.uint64).reshape(1000, 4) << np.uint64(30)
    again = lm.unpack(lm.pack(keys, counts), 4)
    assert (again[0] == keys).all() and (again[1] == counts).all()
    double = np.column_stack([keys, rng.integers(0, 2**32, 1000, dtype=np.uint64)])
    again = lm.unpack(lm.pack(double, counts[:, 0]), 1, 2)
    assert (again[0] == double).all() and (again[1] == counts[:, 0]).all()


def test_sums_of_equal_keys():
    keys = np.array([[5, 2], [5, 1], [3, 9], [5, 2], [0, 0]], np.uint64)
    found = lm.summed(keys, np.arange(1, 6, dtype=np.uint64))
    assert found[0].tolist() == [[0, 0], [3, 9], [5, 1], [5, 2]] and found[1].tolist() == [5, 3, 2, 5]
