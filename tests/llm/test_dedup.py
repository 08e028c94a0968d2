import random
from collections import defaultdict

import pytest

from quarry.llm.components import components
from quarry.llm.exact_dedup import LOWER, UPPER, exact_dedup
from quarry.llm.jaccard_join import jaccard_join, root_splits, shingles, survival, word_list
from tests.llm import brute


def test_exact_dedup(docs, hard, empty):
    for table in (docs, hard):
        rows = [(r.doc_id, (r.text or "").translate(str.maketrans(UPPER, LOWER))) for r in table.collect()]
        own = defaultdict(list)
        for i, t in rows:
            own[t].append(i)
        want = []
        for i, t in rows:
            keep = max((x for x in own[t] if x is not None), default=None)
            want.append((str(i), str(keep), len(own[t]), i == keep))
        got = [(str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup(table).collect()]
        assert sorted(got) == sorted(want)
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_of_one_hot_text(spark):
    table = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'Hot' else concat('t', id) end as text")
    out = exact_dedup(table).where("text_sha256 = sha2('hot', 256)").collect()
    assert len(out) == 1000 and {r.keep_id for r in out} == {2997} and sum(r.kept for r in out) == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = {r.v: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_join_against_all_pairs(docs, empty):
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute.jaccard(texts)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(docs).collect()}
    assert got == want
    assert jaccard_join(empty).count() == 0


@pytest.mark.parametrize("bucket,in_task,block", [(64, 4096, 128), (4, 64, 8), (4, 8, 16)])
def test_jaccard_join_of_a_large_group(spark, bucket, in_task, block):
    """Near copies in one block or many, in buckets that a task holds or not, and copies of one of them."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        own = list(words)
        own[(7 * i) % 120] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, rows[5][1].upper()) for i in range(6)] + [(200 + i, " ".join(f"{i}y{k}" for k in range(50))) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(table, bucket=bucket, in_task=in_task, block=block).collect()}
    assert got == brute.jaccard(dict(rows))


@pytest.mark.parametrize("in_task", [4096, 16])
def test_jaccard_join_of_loose_groups(spark, in_task):
    """Chains and families on both sides of the threshold, around hubs that are near copies of some only."""
    rng = random.Random(4)
    rows = []
    for family in range(8):
        words = [f"f{family}w{i}" for i in range(150)]
        for i in range(60):
            own = list(words)
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(150)] = f"x{family}y{i}z{rng.random()}"
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(table, bucket=8, in_task=in_task, block=32).collect()}
    assert got == brute.jaccard(dict(rows))


def test_jaccard_join_of_hard_rows(hard):
    out = jaccard_join(hard).collect()
    assert len(out) == hard.count()
    got = defaultdict(set)
    for r in out:
        got[r.doc_id].add((r.class_id, r.n_links))
    assert got[None] == {(None, 0)} and got[0] == {(0, 0)} and got[1] == {(1, 0)}
    assert got[5] == got[6] == got[7] == {(5, 3)}  # row 6 is there twice


def test_recall_is_planned():
    runs = root_splits(64, 0.8, 4, 0.999)
    missed = 1.0
    for _ in runs:
        missed *= 1 - 0.8 * survival(3)
    assert missed <= 0.001
    assert len(shingles(word_list("a b c"))) == 1 and len(shingles([])) == 0
