import hashlib
import os
import random
import re

from pyspark.sql import functions as F

from quarry.llm import line_dedup
from quarry.llm.line_dedup import COUNTED, COUNTERS, LANES, SIMILARITY, WIDTH, dedup_lines, kind_of, line_key, near_lines, similar, simhash
from quarry.llm.scratch import noted
from tests.llm import brute


def near(a: str, b: str) -> bool:
    return brute.levenshtein(a, b) <= int(max(len(a), len(b)) * (1 - SIMILARITY) + 1e-9)


def plain(texts: dict):
    """Per id: the text without dropped lines, by comparing all pairs of lines."""
    words = lambda line: re.findall(r"[^\W_]+", line.lower())
    lines = sorted((i, k, line) for i, t in texts.items() for k, line in enumerate((t or "").split("\n")) if words(line))
    norm = {(i, k): " ".join(words(line)) for i, k, line in lines}
    distinct = sorted(set(norm.values()))
    links = {x: set() for x in distinct}
    for n, a in enumerate(distinct):
        for b in distinct[n + 1 :]:
            if abs(len(a) - len(b)) <= max(len(a), len(b)) * (1 - SIMILARITY) and near(a, b):
                links[a].add(b)
                links[b].add(a)
    group, seen, gone = brute.groups(links), set(), set()
    for i, k, _ in lines:
        g = group[norm[i, k]]
        if g in seen:
            gone.add((i, k))
        seen.add(g)
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone) for i, t in texts.items()}


def test_simhash_is_a_majority_of_bits(spark):
    rng = random.Random(6)
    rows = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 3, 30, 62, 63, 64, 65, 126, COUNTED)]
    table = spark.createDataFrame(list(enumerate(rows)), "i int, h array<long>")
    got = {r.i: r.s for r in table.select("i", simhash(F.col("h")).alias("s")).collect()}
    for i, hashes in enumerate(rows):
        want = 0
        for bit in [WIDTH * c + k for c in range(COUNTERS) for k in range(LANES)]:
            want |= (2 * sum(h >> bit & 1 for h in hashes) >= len(hashes)) << bit
        assert got[i] == want


def test_kinds_of_lines(spark):
    sizes = [1, 5, 6, 15, 16, 47, 48, 143, 144, 431, 432]
    out = spark.createDataFrame([(n,) for n in sizes], "n int").select("n", kind_of(F.col("n")).alias("k")).collect()
    assert [r.k for r in sorted(out)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5]


def test_edit_similarity_without_what_both_share(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(1500):
        a = [rng.choice(["a", "bb", "ccc", "dd", "abc"]) for _ in range(rng.randint(1, 12))]
        b = list(a) if rng.random() < 0.7 else [rng.choice(["a", "bb"]) for _ in range(rng.randint(1, 12))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice(["x", "bb", "abd"])] * rng.randint(0, 2)
            b = b or ["z"]
        rows.append((a, b))
    out = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for threshold in (0.5, 0.8, 0.9):
        got = [r.s for r in out.select(similar(F.col("a"), F.col("b"), threshold).alias("s")).collect()]
        for (a, b), s in zip(rows, got, strict=True):
            x, y = " ".join(a), " ".join(b)
            assert s == (brute.levenshtein(x, y) <= int(max(len(x), len(y)) * (1 - threshold) + 1e-9)), (x, y)


def letter_added(rng, words):
    own = list(words)
    at = rng.randrange(len(own))
    own[at] += rng.choice("xyz")
    return own


def words_exchanged(rng, words):
    """One word in twenty exchanged for another, one at least."""
    own = list(words)
    for at in rng.sample(range(len(own)), max(1, len(own) // 20)):
        own[at] = f"q{rng.randint(0, 9)}{own[at][1:]}"
    return own


def word_dropped(rng, words):
    own = list(words)
    del own[rng.randrange(len(own))]
    return own


def test_recall_of_pairs_of_every_length(spark):
    """Of pairs of lines that edit similarity links, at least nine in ten lose one line, whatever their length and change."""
    rng, rows, linked = random.Random(9), [], {}
    for change in (letter_added, words_exchanged, word_dropped):
        for length in (4, 6, 9, 12, 20, 40, 80, 160, 400):
            for _ in range(60 if length < 160 else 12):
                words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(length)]
                own = change(rng, words)
                if near(" ".join(words), " ".join(own)):
                    linked.setdefault((change, length), []).append(len(rows) + 1)
                rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(own))]
    got = {r.doc_id: r.n_dropped for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {k: sum(got[i] for i in ids) / len(ids) for k, ids in linked.items() if len(ids) >= 10}
    assert min(recall.values()) >= 0.9, {(k[0].__name__, k[1]): r for k, r in recall.items()}
    assert sum(got.values()) <= sum(map(len, linked.values()))


def test_against_all_pairs(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randint(0, 900)}" for _ in range(rng.randint(1, 90))) for _ in range(60)]
    texts = {}
    for i in range(60):
        own = []
        for _ in range(6):
            line = rng.choice(base)
            if rng.random() < 0.5:
                words = line.split()
                words[rng.randrange(len(words))] += rng.choice("xyz")
                line = " ".join(words)
            own.append(rng.choice([line, line.upper(), "  " + line + "!", " | ".join(line.split()), "", "---"]))
        texts[i] = "\n".join(own)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(table).collect()}
    want = plain(texts)
    count = lambda kept: sum(map(len, map(str.split, kept.values())))
    assert {i: t for i, t in got.items() if t != want[i]} == {} or count(got) - count(want) <= 0.01 * count(texts)
    assert sum(len(t) for t in want.values()) < sum(len(t) for t in texts.values())


def test_one_hot_block(spark):
    """Hundreds of lines that share half their words, most of them not similar: those that are similar are found."""
    rng = random.Random(10)
    same = [f"same{i}" for i in range(12)]
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    rows = [(i, " ".join(same + [word() for _ in range(12)])) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + "s") for i in range(0, 300, 10)]
    rng.shuffle(rows)
    got = {r.doc_id: r.n_dropped for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), few=8).collect()}
    assert {i for i, n in got.items() if n} == {1000 + i for i in range(0, 300, 10)}


def test_links_by_one_block(spark):
    """Lines that agree on one block alone, of few lines or of many, and not with its hub: each that is similar is linked."""
    block = {h: 1 if h < 6 else 2 for h in [*range(1, 6), *range(10, 110)]}
    text = lambda h: "".join(random.Random(h).choices("abcdefghijklmnopqrst", k=100))
    lines = {h: text(h) for h in block}
    for a, b in ((4, 5), (108, 109)):
        lines[b] = lines[a][:-1] + "\u00e9"
    docs = spark.createDataFrame(sorted(lines.items()), "doc_id long, text string")
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), line_key(F.col("text")).alias("key")).collect()
    hashed = {r.doc_id: r for r in hashed}
    letters = lambda t: [sum(t.count(c) for c in x) for x in getattr(line_dedup, "LETTERS", [])]
    signed = spark.createDataFrame(
        [(i, 0, bytes(r.key), r.h, 100, letters(lines[i]), True, True, [block[i]]) for i, r in hashed.items()],
        "doc_id long, pos int, key binary, h long, len int, letters array<int>, main boolean, single boolean, blocks array<long>",
    )
    distinct = signed.select("key", "h", "len", F.lit(1).alias("n"), "doc_id", "pos")
    place = {bytes(r.key): i for i, r in hashed.items()}
    found = near_lines(signed, distinct, docs, "doc_id", "text", SIMILARITY).collect()
    got = {tuple(sorted((place[bytes(r.a)], place[bytes(r.b)]))) for r in found}
    assert got == {(a, b) for a in lines for b in lines if a < b and near(lines[a], lines[b])} >= {(4, 5), (108, 109)}


def test_lines_that_letters_tell_apart(spark, monkeypatch):
    """Of lines that share half their words, texts are compared only where the counts of all letters allow it."""
    rng, fetched, real = random.Random(11), [], line_dedup._verified
    same = [f"same{i}" for i in range(12)]

    def line():
        own = rng.sample("cdfghlmpuy", 3)
        return " ".join(same + ["".join(rng.choice(own) for _ in range(8)) for _ in range(12)])

    rows = [(i, line()) for i in range(60)]
    rows += [(100 + i, rows[i][1] + "s") for i in range(0, 60, 10)]
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *rest: fetched.append(pairs.distinct().count()) or real(pairs, *rest))
    got = {r.doc_id: r.n_dropped for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, n in got.items() if n} == {100 + i for i in range(0, 60, 10)}
    assert sum(fetched) <= 200


def test_similar_lines_pass_the_counts_of_letters(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        a = [rng.choice("abcdefgh 0123é漢") for _ in range(rng.choice((8, 40, 120)))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 10)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice("aé漢z9")] * rng.randint(0, 1)
        rows.append((i, "".join(a) + "x", "".join(b) + "x"))
    docs = spark.createDataFrame(rows, "i long, x string, y string")
    signed = line_dedup.signed_lines(docs.selectExpr("stack(2, 2 * i, x, 2 * i + 1, y) as (doc_id, text)"), "doc_id", "text").filter("main")
    shapes = line_dedup.shapes_of(signed, signed)
    marks = [c for c in shapes.columns if c not in ("h", "len")]
    of = {r.doc_id: r for r in signed.select("doc_id", "h").join(shapes, "h").collect()}
    norm = {r.doc_id: r.norm for r in docs.selectExpr("stack(2, 2 * i, x, 2 * i + 1, y) as (doc_id, text)").select("doc_id", line_dedup.normalised(F.col("text")).alias("norm")).collect()}
    pairs = spark.createDataFrame(
        [(i, {c: of[2 * i][c] for c in ("len", *marks)}, {c: of[2 * i + 1][c] for c in ("len", *marks)}) for i in range(400)],
        "i long, x map<string, long>, y map<string, long>",
    )
    may = line_dedup.may_be_similar(lambda c: F.col("x")[c], lambda c: F.col("y")[c], marks, SIMILARITY)
    got = {r.i: r.may for r in pairs.select("i", may.alias("may")).collect()}
    alike = [i for i in got if near(norm[2 * i], norm[2 * i + 1])]
    assert len(alike) > 200 and all(got[i] for i in alike)


def test_codes_of_counts(spark):
    pairs = [(a, b) for a in range(40) for b in range(40)]
    code = lambda c: line_dedup.coded([F.col(c)])[0]
    table = spark.createDataFrame(pairs, "a int, b int").select("a", "b", F.bit_count(code("a").bitwiseXOR(code("b"))).alias("n"))
    assert all(r.n == abs(r.a - r.b) if abs(r.a - r.b) <= 8 else r.n <= 8 for r in table.collect())


def test_only_the_dropped_lines_are_kept(spark):
    """Of all tables that are stored on the way, only the one that the result reads is left."""
    rows = [(i, f"one line of some words {i % 3}\nand a second line") for i in range(9)]
    places = []
    with noted(places):
        out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    left = [p for p in places if os.path.exists(p.removeprefix("file://"))]
    assert len(places) > 9 and [p.rsplit("-", 1)[1] for p in left] == ["dropped"]
    assert out.count() == 9


def test_hard_rows(hard, empty):
    rows = {r.doc_id: r for r in dedup_lines(hard).collect()}
    assert len(dedup_lines(hard).collect()) == hard.count()
    assert rows[0].text == rows[1].text == "" and rows[0].n_lines == 1
    assert rows[5].n_dropped == 0 and rows[6].n_dropped == 1 and rows[7].text == ""
    assert rows[11].text == "line one\nline two\n\n" and rows[11].n_dropped == 1
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.text_sha256 for r in rows.values())
    assert dedup_lines(empty).count() == 0


def test_simhash_of_slices(spark):
    """What compiled code counts, and what a loop counts where a block has more words, is the SimHash of each slice."""
    rng = random.Random(13)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(140)]
    sizes = [0, 1, 2, 3, line_dedup.UNROLLED - 1, line_dedup.UNROLLED, line_dedup.UNROLLED + 1, COUNTED, COUNTED + 5]
    rows = [(start, n, hashes) for start in (1, 5) for n in sizes]
    table = spark.createDataFrame(rows, "start int, n int, f array<long>")
    out = line_dedup.simhash_of_slices(table, "f", "start", "n", "bits").filter("n > 0")
    got = out.select("bits", simhash(F.slice("f", F.col("start"), F.least(F.lit(COUNTED), F.col("n")))).alias("want")).collect()
    assert len(got) == 2 * len(sizes) - 2 and all(r.bits == r.want for r in got)


def test_texts_are_fetched_once_and_letters_counted_late(spark, monkeypatch):
    """Letters are counted in lines that agree with others alone, and one table of texts serves both comparisons."""
    tables, real = [], line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, tag: tables.append((tag, df.columns)) or real(df, tag))
    rows = [(i, f"some words of a line that stands {i // 2} times here\nother{i} words{i} alone{i}") for i in range(6)]
    assert dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).count() == 6
    assert [tag for tag, _ in tables].count("line-texts") == 1
    assert all("letters" not in columns for tag, columns in tables if tag == "signed")


def test_counts_of_letters_beyond_their_codes(spark):
    """Long lines whose counts differ by more than the codes tell are told apart before their edits are counted."""
    letters = lambda t: [t.count(c) for c in line_dedup.LETTERS]
    pairs = [("ab " * 200 + "a", "ab " * 150 + "cd " * 50 + "a"), ("ab " * 200 + "a", "ab " * 195 + "cd " * 5 + "a")]
    rows = [(i, a.split(), b.split(), letters(a), letters(b)) for i, (a, b) in enumerate(pairs)]
    table = spark.createDataFrame(rows, "i int, x array<string>, y array<string>, of_x array<int>, of_y array<int>")
    allow = line_dedup.letters_allow(F.col("of_x"), F.col("of_y"), F.col("x"), F.col("y"), SIMILARITY)
    assert [r.a for r in table.select("i", allow.alias("a")).sort("i").collect()] == [False, True]


def test_blocks_of_rare_words(spark):
    """Lines that share their common words alone agree on no block; lines that differ by one word do, whatever their length."""
    rng = random.Random(14)
    common = ["the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on"]
    rare = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(8, 11)))
    rows = []
    for length in (8, 15, 16, 40, 120):
        for i in range(40):
            words = [rng.choice(common) if k % 2 else rare() for k in range(length)]
            own = list(words)
            own[rng.randrange(length)] = rare()
            rows += [(len(rows), length, " ".join(words)), (len(rows) + 1, length, " ".join(own))]
    signed = line_dedup.signed_lines(spark.createDataFrame(rows, "doc_id long, n int, text string"), "doc_id", "text")
    of = {}
    for r in signed.select("doc_id", F.explode("blocks").alias("k")).collect():
        of.setdefault(r.k, set()).add(r.doc_id // 2)
    assert all(len(pairs) == 1 for pairs in of.values())
    got = {r.doc_id: set(r.blocks) for r in signed.select("doc_id", "blocks").collect()}
    assert all(len(b) <= 8 for b in got.values())
    assert sum(bool(got[i] & got[i + 1]) for i in range(0, len(rows), 2)) >= 0.98 * len(rows) / 2


def test_words_taken_out_in_one_place_bound_the_edits(spark):
    """The bound is never below the edits, and is what a gap costs where nothing else differs."""
    rng, rows = random.Random(15), []
    for i in range(300):
        y = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 14))]
        at, n = rng.randrange(len(y)), rng.randint(1, line_dedup.GAP)
        x = y[:at] + y[at + n :]
        plain = len(" ".join(y)) - len(" ".join(x)) if 0 < len(x) else None
        if i % 2 and x:
            x[rng.randrange(len(x))], plain = "abca", None
        if x:
            rows.append((i, x, y, plain))
    table = spark.createDataFrame(rows, "i int, x array<string>, y array<string>, plain int")
    for r in table.withColumn("bound", line_dedup.with_gap(F.col("x"), F.col("y"))).collect():
        assert r.bound >= brute.levenshtein(" ".join(r.x), " ".join(r.y))
        assert r.plain is None or r.bound == r.plain
