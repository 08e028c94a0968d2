"""SimHash near duplicates and layout similarity.

Signatures: every word counts once and every run of five words twice, each occurrence; a feature's hash
is the first 8 bytes of SHA-256, and a bit is set when its signed counter is not negative.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import sha_long, sha_prefix, signature_words
from quarry.plans.shared import checkpointed

SHINGLE, BANDS = 5, 8
#: Fixed value: signatures this similar are near duplicates (at most 5 of 64 bits differ).
THRESHOLD = 0.92


def _features(words: Column) -> Column:
    tokens = F.transform(words, lambda w: F.struct(F.concat(F.lit("token:"), w).alias("f"), F.lit(1).alias("w")))
    starts = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(
        starts, lambda i: F.struct(F.concat(F.lit("shingle:"), F.array_join(F.slice(words, i, SHINGLE), "\x1f")).alias("f"), F.lit(2).alias("w"))
    )
    return F.concat(tokens, runs)


def _pack(bits: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(c >= 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(bits)])


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, simhash, n_tokens; a text without words has no signature.

    The weights of the features that have a bit set are summed, two counters of 32 bits a long; with the sum
    of all weights they give the signed counters.  The sums are partial on the map side, so a document is
    one row in the shuffle.
    """
    rows = docs.select(key, signature_words(F.col(text)).alias("words")).filter(F.size("words") > 0)
    features = rows.select(key, F.size("words").alias("n_tokens"), F.explode(_features(F.col("words"))).alias("x"))
    hashed = features.select(key, "n_tokens", "x.w", sha_long(F.col("x.f")).alias("h"))
    lanes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1 << 32 | 1)) * F.col("w")).alias(f"c{i}") for i in range(32)]
    summed = hashed.groupBy(key, "n_tokens").agg(F.sum("w").alias("all"), *lanes)
    low = [2 * F.col(f"c{i}").bitwiseAND(F.lit((1 << 32) - 1)) - F.col("all") for i in range(32)]
    high = [2 * F.shiftrightunsigned(f"c{i}", 32) - F.col("all") for i in range(32)]
    return summed.select(key, F.col("n_tokens").cast("long"), _pack(low + high).alias("simhash"))


def similarity(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def near_pairs(signed: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, score of every pair at the threshold, a < b.

    With fewer differing bits than bands at least bands - d bands agree; a pair is joined on every choice
    of as many bands as must agree, up to three, so rare keys are compared and nothing needs a cap.
    """
    from itertools import combinations

    differing = int((1 - threshold) * 64 + 1e-9)
    agree = BANDS - differing
    if agree < 1:
        raise ValueError("threshold is too low for the bands")
    band = lambda i: F.shiftrightunsigned("simhash", 8 * i).bitwiseAND(F.lit(255))
    keys = [
        F.struct(F.lit(n).alias("choice"), reduce(lambda a, b: a * 256 + b, [band(i) for i in choice]).alias("value"))
        for n, choice in enumerate(combinations(range(BANDS), min(agree, 3)))
    ]
    rows = signed.select(F.col(key).alias("k"), "simhash", F.explode(F.array(*keys)).alias("x")).select("k", "simhash", "x.choice", "x.value")
    l, r = rows.alias("l"), rows.alias("r")
    on = (F.col("l.choice") == F.col("r.choice")) & (F.col("l.value") == F.col("r.value")) & (F.col("l.k") < F.col("r.k"))
    score = similarity(F.col("l.simhash"), F.col("r.simhash"))
    return l.join(r, on & (score >= threshold)).select(F.col("l.k").alias("a"), F.col("r.k").alias("b"), score.alias("score")).distinct()


def groups(pairs: DataFrame) -> DataFrame:
    """Connected components of pairs: member, component (smallest member), degree.

    Each round hands on the least label among a vertex's neighbours and then jumps to the label's own.
    """
    both = checkpointed(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")).withColumnRenamed("a", "member"))
    while True:
        near = both.join(labels.withColumnRenamed("member", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
        new = labels.join(near.withColumnRenamed("a", "member"), "member").select("member", F.least("c", "m").alias("n"), F.col("c").alias("old"))
        jump = labels.select(F.col("member").alias("n"), F.col("c").alias("far"))
        moved = checkpointed(new.join(jump, "n").select("member", F.least("n", "far").alias("c"), "old"))
        labels = moved.select("member", "c")
        if moved.filter("c <> old").isEmpty():
            break
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "member")
    return labels.join(degree, "member").select("member", F.col("c").alias("component"), "degree")


def group_summary(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """component, members, representative (most links, then smallest), group_key, least score of a link."""
    scores = pairs.join(members.select(F.col("member").alias("a"), "component"), "a").groupBy("component").agg(F.min("score").alias("min_score"))
    found = members.groupBy("component").agg(
        F.count(F.lit(1)).alias("members"),
        F.min(F.struct((-F.col("degree")).alias("d"), "member"))["member"].alias("representative"),
        sha_prefix(F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda x: x.cast("string")), "\x1f"), 128).alias("group_key"),
    )
    return found.join(scores, "component")


def document_rollup(pages: DataFrame, key: str, weight: str, signature: str) -> DataFrame:
    """One signature a document: the weighted vote of its pages' bits."""
    votes = [F.sum(F.when(F.getbit(signature, F.lit(i)) == 1, F.col(weight)).otherwise(-F.col(weight))).alias(f"c{i}") for i in range(64)]
    return pages.groupBy(key).agg(*votes).select(key, _pack([F.col(f"c{i}") for i in range(64)]).alias(signature))


def layout_score(a: dict[str, Column], b: dict[str, Column], same_sequence: Column) -> Column:
    """struct(score, match_types) of two page layouts.

    a and b: geometry, visual, header, footer signatures and header_ink, footer_ink; ink gates say whether
    a header or footer is there to be compared at all.
    """
    # fixed values: weights of the page score and of the letterhead score, and the ink gates
    geometry, visual = similarity(a["geometry"], b["geometry"]), similarity(a["visual"], b["visual"])
    inked = lambda part, least: (a[f"{part}_ink"] >= least) & (b[f"{part}_ink"] >= least)
    header = F.when(inked("header", 5), similarity(a["header"], b["header"])).otherwise(0.0)
    footer = F.when(inked("footer", 3), similarity(a["footer"], b["footer"])).otherwise(0.0)
    page = 0.45 * geometry + 0.25 * visual + 0.20 * header + 0.05 * footer + 0.05 * same_sequence.cast("double")
    letterhead = F.when(inked("header", 5), 0.72 * header + 0.28 * geometry).otherwise(0.0)
    types = F.array_compact(F.array(F.when(page >= 0.8, "page"), F.when(letterhead >= 0.8, "letterhead")))
    return F.struct(F.greatest(page, letterhead).alias("score"), types.alias("match_types"))
