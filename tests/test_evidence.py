import random

import pytest
from pyspark.sql import functions as F

from quarry import api
from quarry.operators import evidence as E
from quarry.operators import state as S


def test_query_plans():
    plan = E.compile_query("Transformer oil TRANSFORMER test")
    assert plan.terms == ["transformer", "oil", "test"]
    assert [r for r, _ in plan.rungs] == ["strict_all_terms", "content_terms_any_two"] and len(plan.rungs[1][1]) == 3
    assert E.compile_query("what is the transformer oil").rungs == [("question_content_terms_all", [["transformer", "oil"]])]
    negated = E.compile_query("radiator valve sin presión")
    assert "content_terms_any_two" not in [r for r, _ in negated.rungs]
    han = E.compile_query("变压器的温度 TC-22")
    assert han.substrings[0] == "变压器温度" and "content_terms_any_two" not in [r for r, _ in han.rungs]
    for bad in ("", " ?! ", "x" * 5000):
        with pytest.raises(ValueError):
            E.compile_query(bad)


def test_intents_and_steps():
    assert E.compile_query("plain words").intents == ["lexical", "semantic"]
    assert E.compile_query("who uses TC-22 after 2019").intents == ["exact", "lexical", "semantic", "relational", "temporal"]
    steps = E.ranking_steps(E.compile_query("TC-22"), 10, 25)
    assert [r for _, r, _ in steps] == ["exact", "lexical", "semantic", "title", "catalogue"] and steps[0][2] == 25


def test_constraints_and_spans():
    kinds = [k for k, _ in E.constraints("TC-22 on 2024-03-05 at 115,5 kV order 123456")]
    assert kinds == ["identifier", "date", "measurement", "number"]
    assert E.tightest([[(0, 2), (50, 52)], [(48, 49)], [(60, 61), (5, 6)]]) == (48, 61)


def test_structured_support(spark):
    far = "TC-22 " + "x " * 800 + "115 kV"
    rows = [(0, "TC-22 at 115 kV"), (1, "TC-22 alone"), (2, far), (3, None), (4, "XTC-22 at 115 kV")]
    out = spark.createDataFrame(rows, "i int, t string").select("i", E.structured_support(F.col("t"), "TC-22 115 kV").alias("s")).collect()
    assert {r.i: (r.s.status, r.s.hard_mismatch) for r in out} == {
        0: ("coherent", False), 1: ("mismatch", True), 2: ("mismatch", False), 3: ("mismatch", True), 4: ("mismatch", True)
    }
    assert spark.createDataFrame(rows[:1], "i int, t string").select(E.structured_support(F.col("t"), "plain").alias("s")).first().s.status == "not_applicable"


def test_densest_window_against_all_starts():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["aa", "bb", "cc", " ", "x"]) for _ in range(60))
        start, cut = E.densest_window(text, ["aa", "bb", "cc"], 12)
        count = lambda s: sum(t in text[s : s + 12] for t in ("aa", "bb", "cc"))
        starts = [i for i in range(len(text)) if any(text.startswith(t, i) for t in ("aa", "bb", "cc"))]
        assert count(start) == max(map(count, starts), default=0) and cut == text[start : start + 12]


def test_references_and_stems(spark):
    r = spark.range(1).select(S.references(F.lit("ISO 9001, ISO 9001:2015 and rfc 1 RFC 2616")).alias("r"), S.stem(F.lit("A  title: x"), F.lit("report"), F.array(F.lit("TC-1"))).alias("s")).first()
    assert r.r == ["ISO 9001:2015", "RFC 2616"] and r.s == "TC-1_report_A_title"


def test_search_finds_what_a_document_says(spark):
    rows = [(i, f"src{i % 3}", f"Heading number {i}\nordinary words here {i}") for i in range(30)] + [(99, "src1", "Rare heading words\nzebra quagga okapi")]
    corpus = spark.createDataFrame(rows, "doc_id long, source string, text string")
    hits, complete = api.search(corpus, "zebra okapi", limit=3)
    assert [r.evidence for r in hits.collect()] == ["99"] and complete.first().status == "partial"
    assert api.operational_intent("list duplicate files") == "duplicates" and api.operational_intent("hello") is None


def test_grammar_words_and_exports(spark):
    assert E.compile_query("please find evidence about transformer oil").rungs[1] == ("content_terms_all", [["transformer", "oil"]])
    assert E.compile_query("cómo se mide aceite").rungs == [("question_content_terms_all", [["mide", "aceite"]])]
    import quarry

    corpus = spark.createDataFrame([(1, "s", "pump oil test " * 9), (2, "s", "pump oil"), (3, "t", "nothing")], "doc_id long, source string, text string")
    packed = quarry.context(corpus, "pump oil", chars=100).collect()
    assert packed and sum(len(r.snippet) for r in packed) <= 100
    assert [r.first_gap for r in quarry.asset_health(corpus, {"read": corpus.filter("doc_id < 3")}, "doc_id").collect()] == [None, None, "read"]
    assert set(quarry.__all__) <= set(dir(__import__("quarry.api", fromlist=["api"])))
