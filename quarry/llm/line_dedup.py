"""Fuzzy line deduplication in DataFrame operations only.

Lines are normalised to lower-cased words of letters and digits, and equal lines are combined.  The blocks of a
line are SimHashes of three of its rarest words, the long ones: each three of the four rarest, or in lines of
48 words or more three of each class of words, which their hashes tell.  A changed word spoils few blocks, and
near lines agree on some block whatever their other blocks are (pigeonhole).  In lines of fewer than six words
a block is a pair of classes of three letters.

Lines that agree on a block are compared: first with the smallest of them alone, which connects what is
dense with one pair a line, then with four more, then all that are not connected yet, however many agree on the block.  Lengths
and counts of every letter first rule out pairs that too many edits lie between, before a text is fetched.
Pairs are verified by edit similarity, connected lines form a group, and of all occurrences of a group's
lines the first one (by document and position) stays.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.scratch import delete, noted, shuffles_released, sized, stored

SIMILARITY = 0.9
#: Lines up to which those that agree on a block meet in one place; where there are more, they meet by their lengths.
FEW = 64
#: Distances that are tried before one that is allowed and more than twice as far, the widest first.
BANDS = (64, 16)
#: Words up to which one line has more than the other where taking them out in one place is tried.
GAP = 3
#: Lines beyond which a block that is not all connected is compared with four more of its lines before all pairs.
HUBS_FROM = 8
#: Rows of three numbers that are broadcast to fetch lines.
WANTED = 1_200_000
#: Characters that are counted, frequent ones first; all others are counted together.
LETTERS = tuple(" etaoinsrhldcumfpgwybvkxjqz0123456789")
#: Bits of a count's code.
BITS = 8

#: Words from which words are the features, and from which a block is one class.
WORDS_FROM, SINGLE_FROM = 6, 16
#: Classes of letters and of words.
LETTER_CLASSES, CLASSES = 8, 4
#: A word's number: the bits of its hash, then of its rank by length, then of its class; bytes from which words rank alike.
HASH_BITS, CLASS_AT = 55, 61
HASHES, RARE = (1 << HASH_BITS) - 1, 7
#: Kind of lines from which blocks are classes of words: those of 48 words or more; before it, of the line's four rarest words.
LONG_KIND = 3
#: Words from which the next three rarest words of each class are blocks too.
TWICE_FROM = 144
#: Share of further words at which a line is signed for the next kind too.
MARGIN = 0.12

#: Lanes of packed counters: WIDTH bits a counter, so many counters a lane.
LANES, WIDTH, COUNTERS = 4, 8, 7
ONES = sum(1 << (WIDTH * i) for i in range(COUNTERS))
#: Words that a block counts: the smallest by hash, if it ever has more.
COUNTED = (1 << (WIDTH - 1)) - 1
#: Words of a block up to which they are counted without a loop over an array.
UNROLLED = 24


def normalised(line: Column) -> Column:
    """Lower-cased runs of letters and digits, one blank between; empty for a line of marks alone."""
    # a single blank stays as it is: no match and no replacement at most words
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N} ][^\p{L}\p{N}]*| [^\p{L}\p{N}]+", " "))


def line_key(norm: Column) -> Column:
    """128 bits of the SHA-256: what makes lines equal."""
    return F.substring(F.unhex(F.sha2(norm, 256)), 1, 16)


def kind_of(n: Column) -> Column:
    """0: letters, 1: pairs of classes, 2 and up: single classes, one more for every three times as many words."""
    grown = 2 + F.floor(F.log(F.greatest(n, F.lit(SINGLE_FROM)) / SINGLE_FROM) / F.log(F.lit(3.0)) + 1e-9)
    return F.when(n < WORDS_FROM, 0).when(n < SINGLE_FROM, 1).otherwise(grown).cast("int")


def simhash(hashes: Column) -> Column:
    """SimHash of up to COUNTED hashes: a bit is set if at least half of the hashes have it set."""
    half = F.floor((F.size(hashes) + 1) / 2)

    def lane(k: int) -> Column:
        votes = lambda h: F.shiftrightunsigned(h, k).bitwiseAND(F.lit(ONES))
        counted = F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + votes(h))
        # a counter's top bit tells whether it reaches the half
        reached = F.shiftrightunsigned(counted + (F.lit(COUNTED + 1) - half) * F.lit(ONES), WIDTH - 1)
        return F.shiftleft(reached.bitwiseAND(F.lit(ONES)), k)

    return reduce(lambda a, b: a.bitwiseOR(b), [lane(k) for k in range(LANES)])


def simhash_of_slices(rows: DataFrame, hashes: str, start: str, count: str, name: str) -> DataFrame:
    """rows with the simhash of count hashes from start on, which compiled code finds for up to UNROLLED of them."""
    one = lambda i: F.when(F.col(count) > i, F.get(hashes, F.col(start) + (i - 1)))
    own = [f"hash {i}" for i in range(UNROLLED)]
    rows = rows.select("*", *[F.coalesce(one(i), F.lit(0).cast("long")).alias(c) for i, c in enumerate(own)])
    half = F.shiftright(F.col(count) + 1, 1)

    def lane(k: int) -> Column:
        votes = [F.shiftrightunsigned(F.col(c), k).bitwiseAND(F.lit(ONES)) for c in own]
        reached = F.shiftrightunsigned(reduce(lambda a, b: a + b, votes) + (F.lit(COUNTED + 1) - half) * F.lit(ONES), WIDTH - 1)
        return F.shiftleft(reached.bitwiseAND(F.lit(ONES)), k)

    rows = rows.select("*", *[lane(k).alias(f"lane {k}") for k in range(LANES)]).drop(*own)
    lanes = reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"lane {k}") for k in range(LANES)])
    many = simhash(F.slice(hashes, F.col(start), F.least(F.lit(COUNTED), F.col(count))))
    return rows.withColumn(name, F.when(F.col(count) > UNROLLED, many).otherwise(lanes)).drop(*[f"lane {k}" for k in range(LANES)])


def with_letters(lines: DataFrame) -> DataFrame:
    """lines with letters, the count of each of LETTERS in norm."""
    rest = ["norm"]
    for i, x in enumerate(LETTERS):  # each is counted in what the ones before leave
        lines = lines.withColumn(f"without {i}", F.replace(F.col(rest[-1]), F.lit(x), F.lit("")))
        rest.append(f"without {i}")
    counts = [F.octet_length(a) - F.octet_length(b) for a, b in zip(rest, rest[1:], strict=False)]
    return lines.withColumn("letters", F.array(*counts)).drop(*rest[1:])


def coded(counts: list[Column]) -> list[Column]:
    """Numbers that hold the codes of 64 / BITS counts each: codes differ in no more bits than counts differ by, and in as many up to BITS."""
    ones = F.lit((1 << BITS) - 1)
    code = lambda c: F.shiftrightunsigned(F.call_function("shiftleft", ones, c.bitwiseAND(F.lit(2 * BITS - 1))), BITS)
    codes = [code(c.cast("int")).bitwiseAND(ones).cast("long") for c in counts]
    parts = [codes[i : i + 64 // BITS] for i in range(0, len(codes), 64 // BITS)]
    return [reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(c, BITS * i) for i, c in enumerate(part)]) for part in parts]


def majority(a: Column, b: Column, c: Column) -> Column:
    """SimHash of three hashes in all their bits."""
    return a.bitwiseAND(b).bitwiseOR(a.bitwiseAND(c)).bitwiseOR(b.bitwiseAND(c))


def words_coded(words: Column, mask: int) -> Column:
    """Different words as numbers in order: by class if the mask has its bits, then longer words first, up to RARE bytes, then by hash.

    Long words are rare ones.
    """
    ranks = lambda w: F.shiftleft((F.lit(RARE) - F.least(F.octet_length(w), F.lit(RARE))).cast("long"), HASH_BITS)
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(mask)).bitwiseOR(ranks(w)))))


def short_blocks(codes: Column, m: Column) -> Column:
    """Of the four rarest of m words, each three: lines that differ by one word agree on one of them."""
    word = [F.get(codes, F.lit(i) % m) for i in range(4)]
    return F.array(*[F.xxhash64(F.lit(1), majority(*[word[i] for i in range(4) if i != out])) for out in range(4)])


def long_blocks(codes: Column, starts: list[Column], m: Column, skipped: int = 0) -> Column:
    """The three rarest words of each class, or the next three; where a class has fewer, those of the next one follow."""
    at = lambda start, i: F.get(codes, (start + (skipped + i)) % m)
    return F.array(*[F.xxhash64(F.lit(2 + skipped), F.lit(c), majority(*[at(x, i) for i in range(3)])) for c, x in enumerate(starts)])


def signed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, pos, key, h, len, letters, main, single, blocks of every line that has words.

    key is that of the normalised line, h a shorter hash for joins, len its length, and blocks holds a hash of each block's place and bits.
    A line that is near the next kind has that kind's blocks too.
    """
    lines = (
        docs.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
        .filter(F.col("line").rlike(r"[\p{L}\p{N}]"))
        .select("doc_id", "pos", normalised(F.col("line")).alias("norm"))
    )
    words = with_letters(lines).withColumn("words", F.split("norm", " ")).withColumn("n", F.size("words"))
    words = words.withColumn("own", kind_of(F.col("n"))).withColumn("next", kind_of(F.ceil(F.col("n") * (1 + MARGIN))))
    letters = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("norm") - 2, F.lit(1))), lambda i: F.substring("norm", i, F.lit(3))
    )
    cls = lambda h: F.shiftright((F.shiftright(h, 32) + F.lit(1 << 31)) * LETTER_CLASSES, 32).cast("int")
    short, long = (F.col("next") > 0) & (F.col("own") < LONG_KIND), F.col("next") >= LONG_KIND
    bounds = F.array(*[F.lit(c << CLASS_AT).cast("long") for c in range(CLASSES)])
    features = (
        words.withColumn("f", F.when(F.col("own") == 0, F.sort_array(F.transform(F.array_distinct(letters), lambda w: F.xxhash64(w)))))
        .withColumn("short", F.when(short, words_coded(F.col("words"), HASHES)))
        .withColumn("long", F.when(long, words_coded(F.col("words"), HASHES | (CLASSES - 1) << CLASS_AT)))
        .withColumn("cls", F.transform("f", cls))  # hashes in order: those of a class stand together
        .withColumn("bounded", F.sort_array(F.concat("long", bounds)))
    )
    # of what stands before a bound, so many are bounds
    starts = [(F.array_position("bounded", F.lit(c << CLASS_AT).cast("long")) - (1 + c)).cast("int") for c in range(CLASSES)]
    features = features.select("*", *[x.alias(f"start {c}") for c, x in enumerate(starts)]).drop("bounded")
    none, starts = F.lit([]).cast("array<bigint>"), [F.col(f"start {c}") for c in range(CLASSES)]
    blocks = F.concat(
        F.when(F.col("own") == 0, _pairs_of_classes()).otherwise(none),
        F.when(short, short_blocks(F.col("short"), F.size("short"))).otherwise(none),
        F.when(long, long_blocks(F.col("long"), starts, F.size("long"))).otherwise(none),
        F.when(F.col("n") >= TWICE_FROM, long_blocks(F.col("long"), starts, F.size("long"), 3)).otherwise(none),
    )
    return features.select(
        "doc_id",
        "pos",
        line_key(F.col("norm")).alias("key"),
        F.xxhash64("norm").alias("h"),
        F.length("norm").alias("len"),
        "letters",
        F.lit(True).alias("main"),
        (F.col("own") >= LONG_KIND).alias("single"),
        blocks.alias("blocks"),
    )


def _pairs_of_classes() -> Column:
    """A hash of each two classes of letters, by f and cls."""
    present = F.array_distinct("cls")
    starts = F.transform(present, lambda c: F.array_position(F.col("cls"), c).cast("int"))
    # evaluated once, as a lambda's variable
    of = F.transform(F.array(F.struct(present.alias("present"), starts.alias("starts"))), lambda s: F.struct(
        s["present"].alias("present"),
        F.transform(
            s["starts"],
            lambda start, i: simhash(F.slice("f", start, F.least(F.lit(COUNTED), F.coalesce(F.get(s["starts"], i + 1), F.size("f") + 1) - start))),
        ).alias("bits"),
    ))
    # a class without words counts as a block too, but two of them say nothing
    every = F.transform(
        of,
        lambda s: F.transform(
            F.sequence(F.lit(0), F.lit(LETTER_CLASSES - 1)),
            lambda c: F.when(
                F.array_contains(s["present"], c),
                F.xxhash64(F.lit(0), c, F.get(s["bits"], F.array_position(s["present"], c).cast("int") - 1)),
            ),
        ),
    )
    pairs = F.transform(
        every,
        lambda e: F.flatten(
            F.transform(
                e,
                lambda b, i: F.transform(
                    F.slice(e, i + 2, F.size(e)), lambda c: F.when(b.isNotNull() | c.isNotNull(), F.xxhash64(b, c))
                ),
            )
        ),
    )
    return F.array_distinct(F.array_compact(F.get(pairs, F.lit(0))))


def agreeing(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members, sizes: lines h that agree on a block k with another line, and k, n, hub of each such block."""
    keyed = signed.select("h", F.explode("blocks").alias("k"))
    shared = keyed.groupBy("k").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("k")
    members = stored(keyed.join(sized(stored(shared, "shared")), "k").distinct(), "members")
    return members, stored(members.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("hub")), "sizes")


def open_members(members: DataFrame, sizes: DataFrame, edges: DataFrame) -> DataFrame:
    """members of the blocks in sizes whose lines the edges don't all connect, with n and comp, the component."""
    dense = components(edges).withColumnRenamed("v", "h")
    own = members.join(sized(sizes), "k").join(sized(dense), "h", "left").withColumn("comp", F.coalesce("comp", "h"))
    open_keys = own.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("k")
    return stored(own.join(sized(stored(open_keys, "open")), "k"), "open-lines")


def near_lines(signed: DataFrame, distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float, few: int = FEW) -> DataFrame:
    """Edges (a, b) between keys of verified lines that connect all similar lines that agree on a block."""
    members, sizes = agreeing(signed)
    texts = texts_of(members, distinct, docs, id_col, text_col)
    shapes = shapes_of(members, texts)
    marks = [c for c in shapes.columns if c not in ("h", "len")]
    sides = [shapes.select(F.col("h").alias(x), F.struct("len", *marks).alias(f"of_{x}")) for x in ("a", "b")]
    # a hub is one row a key
    stars = members.join(sized(sizes), "k").filter("h <> hub").select(F.col("hub").alias("a"), F.col("h").alias("b")).distinct()
    stars = stars.join(sides[0], "a").join(sides[1], "b")
    stars = stars.filter(may_be_similar(lambda c: F.col(f"of_a.{c}"), lambda c: F.col(f"of_b.{c}"), marks, similarity)).select("a", "b")
    first = _verified(stars, texts, similarity)
    some = sizes.filter("n > 2").select("k", "n")
    own = open_members(members, some, first)
    # where many lines are open, any four of them connect most of what one left
    picked = [f("h", F.xxhash64(F.lit(i), "h")) for i in range(2) for f in (F.min_by, F.max_by)]
    hubs = own.filter(F.col("n") > HUBS_FROM).groupBy("k").agg(F.array(*picked).alias("hubs"))
    hubs = stored(hubs.select("k", F.explode(F.array_distinct("hubs")).alias("hub")), "hubs")
    of_hubs = own.select("k", F.col("h").alias("hub"), F.col("comp").alias("of")).join(sized(hubs), ["k", "hub"])
    stars = own.join(sized(stored(of_hubs, "hub-lines")), "k").filter("comp <> of")
    stars = stars.select(F.least("h", "hub").alias("a"), F.greatest("h", "hub").alias("b")).distinct()
    stars = stars.join(sides[0], "a").join(sides[1], "b")
    stars = stars.filter(may_be_similar(lambda c: F.col(f"of_a.{c}"), lambda c: F.col(f"of_b.{c}"), marks, similarity)).select("a", "b")
    first = first.unionByName(_verified(stars, texts, similarity))
    own = open_members(members, some, first)
    # lengths of similar lines lie in one band or in neighbouring ones
    width = -math.log(max(similarity - 0.01, 1e-6))
    band = F.when(F.col("n") > few, F.floor(F.log("len") / width)).otherwise(0)
    own = stored(own.join(shapes, "h").withColumn("band", band.cast("int")), "open-members")
    bands = F.when(F.col("n") > few, F.array("band", F.col("band") - 1)).otherwise(F.array("band"))
    left, right = own.alias("l"), own.withColumn("band", F.explode(bands)).alias("r")
    shorter = (F.col("l.len") < F.col("r.len")) | ((F.col("l.len") == F.col("r.len")) & (F.col("l.h") < F.col("r.h")))
    near = may_be_similar(lambda c: F.col(f"l.{c}"), lambda c: F.col(f"r.{c}"), marks, similarity)
    fits = shorter & (F.col("l.comp") != F.col("r.comp")) & near
    pairs = left.join(right, (F.col("l.k") == F.col("r.k")) & (F.col("l.band") == F.col("r.band")) & fits)
    pairs = pairs.select(F.least("l.h", "r.h").alias("a"), F.greatest("l.h", "r.h").alias("b"))
    rest = _verified(pairs, texts, similarity)
    return first.unionByName(rest).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


def texts_of(members: DataFrame, distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """h, key, len, letters, words of the lines in members.

    Different lines that share a short hash are all there.
    """
    ends = stored(members.select("h").distinct(), "member-lines")
    wanted = stored(distinct.join(sized(ends), "h").select("h", "doc_id", "pos"), "wanted")
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    # three numbers a row: a broadcast of WANTED rows spares a shuffle of all texts
    some = F.broadcast(wanted) if wanted.count() <= WANTED else wanted
    norm = lines.join(some, ["doc_id", "pos"]).select("h", normalised(F.col("line")).alias("norm"))
    norm = with_letters(norm.filter(F.xxhash64("norm") == F.col("h")))  # rows may share an id
    found = norm.select("h", line_key(F.col("norm")).alias("key"), F.length("norm").alias("len"), "letters", F.split("norm", " ").alias("words"))
    return stored(found, "line-texts")


def shapes_of(members: DataFrame, lines: DataFrame) -> DataFrame:
    """h, len, m0, m1 and so on of the lines in members, with the codes of their counts of letters.

    Different lines that share a short hash are rare: each of their shapes stands.
    """
    ends = members.select("h").distinct()
    counts = [F.col("letters")[i] for i in range(len(LETTERS))]
    others = F.col("len") - reduce(lambda a, b: a + b, counts)
    marks = [m.alias(f"m{i}") for i, m in enumerate(coded([*counts, others]))]
    return stored(lines.select("h", "len", *marks).join(ends, "h", "left_semi").distinct(), "shapes")


def may_be_similar(x: Callable[[str], Column], y: Callable[[str], Column], marks: list[str], similarity: float) -> Column:
    """False only for lines that lengths or counts of letters tell apart; x and y give a column of each shape by name.

    An edit takes one letter at most and adds one at most, so that what one line has more than the other is
    no more than the edits: half the sum of the counts' differences and the lengths' difference.
    """
    most = F.floor(F.greatest(x("len"), y("len")) * (1 - similarity) + 1e-9)
    longer = F.abs(x("len") - y("len"))
    differ = reduce(lambda a, b: a + b, [F.bit_count(x(c).bitwiseXOR(y(c))) for c in marks])
    return (longer <= most) & (differ + longer <= 2 * most)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a, b, key_a, key_b of the pairs whose lines are similar.

    Different lines that share a short hash are all compared.
    """
    places: list[str] = []
    with noted(places):
        pairs = stored(pairs.distinct(), "line-pairs")

        def side(end: str, words: str) -> DataFrame:
            """Texts of the lines at this end of the pairs alone: all others would be shuffled too."""
            ends = stored(pairs.select(F.col(end).alias("h")).distinct(), "line-ends")
            own = texts.join(F.broadcast(ends) if ends.count() <= WANTED else ends, "h", "left_semi")
            return own.select(F.col("h").alias(end), F.col("key").alias(f"key_{end}"), F.col("letters").alias(f"of_{end}"), F.col("words").alias(words))

        one, two = side("a", "x"), side("b", "y")
    both = pairs.join(one, "a").join(two, "b").filter(letters_allow(F.col("of_a"), F.col("of_b"), F.col("x"), F.col("y"), similarity))
    found = stored(both.filter(similar(F.col("x"), F.col("y"), similarity)).select("a", "b", "key_a", "key_b"), "line-edges")
    delete(texts.sparkSession, places)
    return found


def letters_allow(of_x: Column, of_y: Column, x: Column, y: Column, similarity: float) -> Column:
    """As may_be_similar, by the counts themselves and not by their codes: these end at BITS more."""
    size = lambda words: F.length(F.array_join(words, " "))
    most = F.floor(F.greatest(size(x), size(y)) * (1 - similarity) + 1e-9)
    differ = F.aggregate(F.zip_with(of_x, of_y, lambda p, q: F.abs(p - q)), F.lit(0), lambda a, n: a + n)
    return differ + F.abs(size(x) - size(y)) <= 2 * most


def with_gap(x: Column, y: Column) -> Column:
    """Edits that suffice if y has more words: some of it that stand together are taken out, all others exchanged in place."""
    more = F.size(y) - F.size(x)
    cost = lambda p, q: F.when(p == q, 0).otherwise(F.greatest(F.length(p), F.length(q)))
    before, after = F.zip_with(x, F.slice(y, F.lit(1), F.size(x)), cost), F.zip_with(x, F.slice(y, more + 1, F.size(x)), cost)
    taken = F.transform(F.sequence(F.lit(1), F.size(x) + 1), lambda i: F.length(F.array_join(F.slice(y, i, more), " ")) + 1)
    state = lambda pre, post, best: F.struct(pre.alias("pre"), post.alias("post"), best.alias("best"))
    # the place where the words are taken out moves on: what is before it counts as before, the rest as after
    moved = F.aggregate(
        F.arrays_zip(before.alias("b"), after.alias("a"), taken.alias("t")),
        state(F.lit(0), F.lit(0), F.lit(1 << 30)),
        lambda s, w: state(
            s["pre"] + F.coalesce(w["b"], F.lit(0)), s["post"] + F.coalesce(w["a"], F.lit(0)), F.least(s["best"], s["pre"] - s["post"] + w["t"])
        ),
        lambda s: s["post"] + s["best"],
    )
    return moved


def similar(x: Column, y: Column, similarity: float) -> Column:
    """Whether two lines, given as words, have an edit similarity of at least the threshold.

    Lines of as many words that differ in few are similar without a table of edits: exchanging the words
    bounds the distance, and so does taking out words that one line has more, in one place.  Else what is left is compared when the words that both begin and end with are taken
    off; each word stands with the blank that follows it.
    """
    line = lambda words: F.array_join(words, " ")
    size = lambda words: F.length(line(words))
    longest = F.greatest(size(x), size(y))
    most = F.floor(longest * (1 - similarity) + 1e-9).cast("int")

    def shared(a: Column, b: Column) -> Column:
        """Number of words that both begin with."""
        same = F.zip_with(a, b, lambda p, q: F.coalesce(p == q, F.lit(False)))
        first = F.array_position(same, False)
        return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")

    ends = F.transform(
        F.array(F.struct(x.alias("x"), y.alias("y"), shared(x, y).alias("head"), most.alias("most"))),
        lambda s: F.struct(
            s["x"].alias("x"),
            s["y"].alias("y"),
            s["head"].alias("head"),
            s["most"].alias("most"),
            F.least(shared(F.reverse(s["x"]), F.reverse(s["y"])), F.size(s["x"]) - s["head"], F.size(s["y"]) - s["head"]).alias("tail"),
        ),
    )

    def middle(s: Column, side: str) -> Column:
        own = F.greatest(F.size(s[side]) - s["head"] - s["tail"], F.lit(0))
        return F.concat(line(F.slice(s[side], s["head"] + 1, own)), F.when(own > 0, " ").otherwise(""))

    cost = lambda p, q: F.when(p == q, 0).otherwise(F.levenshtein(p, q))
    exchanged = F.aggregate(F.zip_with(x, y, cost), F.lit(0), lambda a, n: a + n)
    fewer, more = F.when(F.size(x) < F.size(y), x).otherwise(y), F.when(F.size(x) < F.size(y), y).otherwise(x)
    # the table is a band as wide as the distance allowed: in long ones a narrow one suffices for most
    middles = F.transform(ends, lambda s: F.struct(middle(s, "x").alias("x"), middle(s, "y").alias("y"), s["most"].alias("most")))

    def within(s: Column, bound: Column) -> Column:
        return F.call_function("levenshtein", s["x"], s["y"], bound) >= 0

    def decided(s: Column) -> Column:
        found = within(s, s["most"])
        for band in BANDS:
            found = F.when(s["most"] > 2 * band, F.when(within(s, F.lit(band)), True).otherwise(found)).otherwise(found)
        return found

    near = F.transform(middles, decided)[0]
    return (
        F.when(F.abs(size(x) - size(y)) > most, False)
        .when((F.size(x) == F.size(y)) & (exchanged <= most), True)
        .when((F.size(more) - F.size(fewer)).between(1, GAP) & (with_gap(fewer, more) <= most), True)
        .otherwise(near)
    )


def _dropped(docs: DataFrame, id_col: str, text_col: str, similarity: float, few: int) -> DataFrame:
    """doc_id and gone, the positions of the lines that are dropped, of each document that loses any."""
    spark, near = docs.sparkSession, []
    # letters are counted once lines are known to agree with others
    signed = stored(signed_lines(docs, id_col, text_col).drop("letters"), "signed")
    lines = signed.filter("main")
    distinct = stored(
        lines.groupBy("key")
        .agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.count(F.lit(1)).alias("n"), F.min("h").alias("h"))
        .select("key", "h", "n", "at.doc_id", "at.pos"),
        "lines",
    )
    with noted(near):
        edges = near_lines(signed, distinct, docs, id_col, text_col, similarity, few)
    groups = components(edges)
    delete(spark, near)
    joined = distinct.join(sized(groups.withColumnRenamed("v", "key")), "key")
    first = stored(joined.groupBy("comp").agg(F.min(F.struct("doc_id", "pos")).alias("keep")), "keepers")
    fuzzy = joined.join(sized(first), "comp").select("key", "keep")
    alone = distinct.filter("n > 1").join(sized(groups.select(F.col("v").alias("key"))), "key", "left_anti")
    decided = stored(fuzzy.unionByName(alone.select("key", F.struct("doc_id", "pos").alias("keep"))), "decided")
    occurrences = lines.select("doc_id", "pos", "key").join(sized(decided), "key")
    gone = occurrences.filter((F.col("keep.doc_id") != F.col("doc_id")) | (F.col("keep.pos") != F.col("pos")))
    return gone.groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    few: int = FEW,
) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, text_sha256 and text without the dropped lines.

    Lines end at a line feed; lines without a letter or digit are never dropped.  Of a group of equal or nearly equal lines the
    occurrence with the smallest (doc_id, position) stays.  Null texts count as empty: one blank line.  A
    row with a null id is left as it is and takes no part; rows that share an id are one document.  Empty
    tables give empty results; other columns are ignored.
    """
    spark, places = docs.sparkSession, []
    with shuffles_released(spark):
        with noted(places):
            gone = _dropped(docs, id_col, text_col, similarity, few)
        dropped = stored(gone, "dropped")
        delete(spark, places)
    weight = dropped.agg(F.count(F.lit(1)), F.sum(F.size("gone"))).first()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(sized(dropped, max(weight[0], (weight[1] or 0) // 8)), "doc_id", "left")
    split = F.split("text", "\n")
    kept = F.filter(split, lambda x, i: ~F.array_contains(F.col("gone"), i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.select(
        "doc_id",
        F.size(split).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.sha2(text, 256).alias("text_sha256"),
        text.alias("text"),
    )
