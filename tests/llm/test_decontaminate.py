import random

import re

from quarry.llm.decontaminate import ANSWER, ANSWER_WORDS, LCS, LCS_WITH_ANSWER, STRIDE, decontaminate, lcs_length, masks_of, randomised_svd, tokens
from tests.llm import brute


def test_lcs_against_the_plain_table():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(0, 6) for _ in range(rng.randint(1, 20))]
        b = [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]
        assert lcs_length(masks_of(a), len(a), b) == brute.lcs(a, b)


def test_svd_spans_the_rows(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(list(range(i, i + 5)), rng.normal(size=5).tolist()) for i in range(12)]
    basis = randomised_svd(spark, rows, 16, 12)
    dense = np.zeros((12, 16))
    for i, (at, w) in enumerate(rows):
        dense[i, at] = w
    assert np.allclose(basis.T @ basis, np.eye(12), atol=1e-6)
    assert np.allclose(dense @ basis @ basis.T, dense, atol=1e-6)


def vary(words, rng, share):
    out = []
    for w in words:
        r = rng.random()
        if r < share / 3:
            continue
        out.append("changed" if r < 2 * share / 3 else w)
        if r > 1 - share / 3:
            out.append("added")
    return out


def test_planted_passages_are_found_and_clean_documents_are_not(spark, docs):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in "bcdfghjklmnp" for b in ("ar", "en", "il", "os", "um", "ate", "ion")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(30)) + ". The answer is " + rng.choice(vocabulary) + ".") for i in range(40)]
    clean = [r.text for r in docs.filter("n_chars > 200").limit(60).collect()]
    clean += [" ".join(rng.choice(vocabulary) for _ in range(400)) for _ in range(60)]
    rows, want = [], set()
    for i, text in enumerate(clean):
        rows.append((i, text))
    for i, (item, passage) in enumerate(items):
        host = clean[(5 * i) % len(clean)].split()
        at = rng.randrange(len(host))
        words = passage.upper().split() if i % 2 else vary(passage.split(), rng, 0.12)
        rows.append((1000 + i, " ".join(host[:at] + words + host[at:])))
        want.add((1000 + i, item))
    found = decontaminate(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert not got - want and len(want - got) <= 1


def test_hard_rows(spark, hard, empty):
    bench = spark.createDataFrame(
        [(1, "one two three four five"), (2, None), (3, ""), (4, "?!"), (1, "one two three four five"), (None, "x" * 5000)],
        "item_id long, text string",
    )
    got = {(r.doc_id, r.item_id) for r in decontaminate(hard, bench).collect()}
    assert got == {(5, 1), (6, 1), (7, 1), (9, None)}
    assert decontaminate(empty, bench).count() == 0
    assert decontaminate(hard, bench.limit(0)).count() == 0


def test_a_long_item_is_found_in_pieces(spark):
    rng = random.Random(4)
    item = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(300))
    rows = [(0, "before " * 40 + " ".join(item.split()[100:230]) + " after" * 40), (1, "before " * 80)]
    found = decontaminate(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    ).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(0, 7)]


def test_excerpts_of_a_long_item_are_found_at_every_offset(spark):
    item = [f"w{i}" for i in range(210)]
    rows = [(1000 * n + at, "before " * 40 + " ".join(item[at : at + n]) + " after" * 40) for n in (48, 64, 82) for at in range(210 - n + 1)]
    found = decontaminate(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    ).collect()
    assert sorted(r.doc_id for r in found) == [i for i, _ in rows] and {r.item_id for r in found} == {7}


def test_many_long_items_share_one_space(spark):
    rng = random.Random(5)
    items = [(i, [f"w{rng.randint(0, 20000)}" for _ in range(400)]) for i in range(30)]  # 660 pieces
    rows = [(i, "before " * 40 + " ".join(words[170:230]) + " after" * 40) for i, words in items]
    found = decontaminate(
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(words)) for i, words in items], "item_id long, text string"),
    ).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i, _ in items]


def plain(rows, items):
    """(doc, item) of all windows and items that the checks accept, without any space; items of up to 64 words."""
    found = set()
    for doc, text in rows:
        words = tokens(text)
        for item, passage in items:
            own = tokens(passage)
            answer = tokens(re.split(r"(?<=[.!?])\s+", passage.strip())[-1])
            for at in range(0, len(words), STRIDE):
                region = words[max(0, at - STRIDE) : at + 3 * STRIDE]
                share = brute.lcs(own, region) / len(own)
                told = len(answer) >= ANSWER_WORDS and brute.lcs(answer, region) >= ANSWER * len(answer)
                if share >= LCS or (share >= LCS_WITH_ANSWER and told):
                    found.add((doc, item))
    return found


def test_recall_against_all_windows_and_items(spark):
    """Paraphrases down to the checks' limits, in words and in a script without blanks, with other blanks and quotes."""
    rng = random.Random(12)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(1500)]
    common = vocabulary[:60]
    word = lambda: rng.choice(common if rng.random() < 0.5 else vocabulary)
    sentence = lambda n: " ".join(word() for _ in range(n)) + ". "
    items = [(i, sentence(rng.randint(15, 40)) + sentence(6).strip()) for i in range(80)]
    ideographs = [chr(0x4E00 + k) for k in range(300)]
    items += [(100 + i, "".join(rng.choice(ideographs) for _ in range(40))) for i in range(10)]
    rows = []
    for i, (_, passage) in enumerate(items):
        host = [word() for _ in range(rng.randint(0, 150))]
        at = rng.randrange(len(host) + 1)
        if i < 80:
            words = vary(passage.split(), rng, rng.choice([0, 0.1, 0.2, 0.3]))
            blank = rng.choice([" ", "\u00a0", " \u00ab"])
            rows.append((i, " ".join(host[:at]) + " " + blank.join(words) + " " + " ".join(host[at:])))
        else:
            rows.append((i, "".join(rng.choice(ideographs) for _ in range(60)) + passage + "".join(rng.choice(ideographs) for _ in range(60))))
    rows += [(1000 + i, sentence(300)) for i in range(40)]
    found = decontaminate(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    got, want = {(r.doc_id, r.item_id) for r in found}, plain(rows, items)
    assert len(want) >= 60 and not got - want and len(got) >= 0.95 * len(want)
    assert all(-1.001 <= r.cosine <= 1.001 for r in found)
