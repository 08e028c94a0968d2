from pyspark.sql import functions as F

from quarry.llm.language_id import Labeller, fold, language_id, learn, script_of, viterbi

import numpy as np


def best_path(scores, penalty):
    """Value of the best path by trying all label sequences."""
    from itertools import product

    n, k = scores.shape
    value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
    return max(value(p) for p in product(range(k), repeat=n)), value


def test_viterbi_is_optimal():
    rng = np.random.default_rng(5)
    for n, k in [(1, 3), (6, 2), (6, 3), (7, 3)] * 20:
        scores = rng.normal(size=(n, k)) * 3
        for penalty in (0.0, 1.0, 4.0, 9.0):
            best, value = best_path(scores, penalty)
            assert abs(value(viterbi(scores, penalty).tolist()) - best) < 1e-9


def test_held_out_accuracy_and_spans(spark, docs, hard, empty):
    model = learn(docs.filter(~fold(F.col("doc_id"))), "text", "lang")
    out = language_id(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(fold(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out) > 20
    labeller = Labeller(model, 15.0)
    rows = {r.lang: r.text for r in docs.filter("n_chars > 300").collect()}
    text = rows["fr"][:300] + "\n" + rows["en"][:300]
    _, _, spans = labeller.label(text)
    assert [s[2] for s in spans] == ["fr", "en"] and abs(spans[0][1] - 300) < 25
    for r in language_id(hard, model).collect():
        assert 0 <= r.score <= 1 and (r.lang_pred in model.languages or r.lang_pred == "und")
    by_id = {r.doc_id: r for r in language_id(hard, model, whole_rows=True).collect()}
    assert by_id[0].lang_pred == by_id[1].lang_pred == by_id[10].lang_pred == "und" and by_id[0].salt == 1
    assert language_id(empty, model).count() == 0
    nothing = learn(empty, "text", "lang")
    assert {r.lang_pred for r in language_id(hard, nothing).collect()} == {"und"}


def test_scripts():
    assert [script_of(w) for w in ("été", "кот", "中文", "한국", "λόγος", "שלום")] == [
        "Latin", "Cyrillic", "Han", "Hangul", "Greek", "Hebrew"
    ]


def test_script_narrows(spark):
    rows = [(i, "кошка собака дом", "ru") for i in range(20)] + [(50 + i, "cat dog house", "en") for i in range(20)]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang")
    assert Labeller(model, 15.0).label("жук")[0] == "ru"
    assert [s[2] for s in Labeller(model, 15.0).label("cat house dog кошка дом")[2]] == ["en", "ru"]
