"""Secret scan in DataFrame operations only.

Three base patterns report spans as they are.  Beside them every long run of key-like characters that
mixes letters and digits, or has very many letters, is put to a battery of randomness tests under the encoding its alphabet implies:
uniformity of the alphabet (chi-squared), runs above and below the alphabet's middle, and serial
correlation.  Their p-values combine by Fisher's method into one, near 0 for strings that are not random
and uniform on 0..1 for random ones.  The cut for each encoding and length comes from the whole corpus:
it is the lowest at which the expected share of false discoveries stays under a bound.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import stored

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
KINDS = ["assign", "access", "hex", "random"]
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: A run that is too short holds no shorter match that isn't, so these two are searched for at full length;
#: a failing assignment can hide a longer one in itself and must be matched before it is dropped.
LONG_ACCESS, LONG_HEX = rf"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}", rf"[0-9a-f]{{{MIN_HEX},}}"

#: Runs that the battery looks at: whole ones of a least length, padding included.  An equals sign within a run
#: parts it, as a name from its value; only one that no symbol follows is padding.
MIN_CANDIDATE = 16
SYMBOL = "[A-Za-z0-9+/_-]"
CANDIDATE = rf"(?<!{SYMBOL})(?=[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE}}}){SYMBOL}+(?:=++(?!{SYMBOL}))?"
#: Symbols of each encoding, in the order of their values.
ALPHABETS = {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}

#: Letters alone are a key only at this length: shorter compounds of words are told apart too badly.
MIN_LETTERS = 32
#: With fewer candidates of an encoding and length no share can be estimated: there so high a p-value is reported.
FEW, FEW_P = 20, 0.1
#: Expected share of strings that are not random among those reported, and bins of the combined p-value.
FALSE_DISCOVERIES, BINS = 0.1, 50
#: No string with a lower combined p-value is reported, whatever the corpus holds.
LEAST_P = 0.01


def _spans(text: Column, pattern: str, least: int, kind: str, group: int = 0) -> Column:
    """Array of (start, end, kind, token) of a pattern's non-overlapping matches whose group is long enough.

    Places are sums of the lengths of what lies between the matches and of the matches themselves.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    token = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("size"))
    none = F.lit(0).cast("int")
    walked = F.aggregate(
        F.slice(steps, 1, F.size(whole)),
        F.struct(none.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(
                acc["found"],
                F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("end"))),
            ).alias("found"),
        ),
    )["found"]
    zipped = F.zip_with(
        walked,
        token,
        lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), t.alias("token")),
    )
    kept = F.filter(zipped, lambda x: F.length(x["token"]) >= least)
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,token:string>>")
    # most texts have no match: one quick look spares them the rest
    return F.when(F.regexp_like(text, F.lit(KEYWORD if kind == "assign" else pattern)), kept).otherwise(empty)


def _encoding(token: Column) -> Column:
    """The narrowest encoding whose alphabet holds the token's characters, padding aside.

    Null for digits alone, for letters alone below MIN_LETTERS, and for words between marks.
    """
    letters = F.length(token) >= MIN_LETTERS
    mixed = F.regexp_like(token, F.lit("[0-9]")) & F.regexp_like(token, F.lit("[A-Za-z]"))
    is_in = lambda p: F.regexp_like(token, F.lit(f"^{p}$"))
    return (
        F.when(letters & is_in("[a-z]+"), "lower")
        .when(letters & is_in("[A-Z]+"), "upper")
        .when(letters & is_in("[A-Za-z]+"), "letters")
        .when(~mixed, F.lit(None))
        .when(is_in("[0-9a-f]+"), "hex")
        .when(is_in("[0-9A-F]+"), "HEX")
        .when(is_in("[A-Z2-7]+"), "base32")
        .when(is_in("[0-9a-z]+"), "base36")
        .when(is_in("[A-Za-z0-9]+"), "base62")
        .when(is_in("[A-Za-z0-9+/]+"), "base64")
        .when(is_in("[A-Za-z0-9_-]+"), "base64url")
    )


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution; the logistic form errs by less than 0.0002."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), z * 1.5976 + z * z * z * 0.070565992)))


def battery(token: Column, encoding: Column) -> Column:
    """Combined p-value of the three tests under the hypothesis that the token is random."""
    alphabet = F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), encoding)
    k = F.length(alphabet).cast("double")
    body = F.regexp_replace(token, "=+$", "")
    n = F.length(body).cast("double")
    # one value a symbol; the three sums below read them as one array
    return F.transform(
        F.array(F.struct(body.alias("body"), alphabet.alias("alphabet"), k.alias("k"), n.alias("n"))), _combined
    )[0]


def _combined(s: Column) -> Column:
    k, n = s["k"], s["n"]
    values = F.transform(F.split(s["body"], ""), lambda c: F.instr(s["alphabet"], c).cast("double") - 1)
    squares = F.aggregate(
        F.transform(F.split(s["alphabet"], ""), lambda c: (n - F.length(F.replace(s["body"], c, F.lit(""))))),
        F.lit(0.0),
        lambda a, count: a + count * count,
    )
    chi = squares * k / n - n
    z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    middle = (k - 1) / 2
    walk = F.aggregate(
        values,
        F.struct(
            F.lit(-1.0).alias("before"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("high"), F.lit(0.0).alias("lag")
        ),
        lambda a, v: F.struct(
            v.alias("before"),
            (a["runs"] + F.when((a["before"] < 0) | ((a["before"] > middle) != (v > middle)), 1.0).otherwise(0.0)).alias("runs"),
            (a["high"] + F.when(v > middle, 1.0).otherwise(0.0)).alias("high"),
            (a["lag"] + F.when(a["before"] < 0, 0.0).otherwise((a["before"] - middle) * (v - middle))).alias("lag"),
        ),
    )
    return F.transform(
        F.array(F.struct(z_chi.alias("z"), walk.alias("w"))),
        lambda t: _fisher(t["z"], t["w"], k, n),
    )[0]


def _fisher(z_chi: Column, walk: Column, k: Column, n: Column) -> Column:
    # of a fair alphabet, half the symbols are high and a run ends at every second step
    z_runs = (walk["runs"] - 1 - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    variance = (k * k - 1) / 12
    z_lag = walk["lag"] / (variance * F.sqrt(n - 1))
    tails = [normal_tail(z_chi), 2 * normal_tail(F.abs(z_runs)), 2 * normal_tail(F.abs(z_lag))]
    half = -sum(F.log(F.greatest(F.lit(1e-300), F.least(F.lit(1.0), p))) for p in tails)
    return F.exp(-half) * (1 + half + half * half / 2)


def length_class(token: Column) -> Column:
    """Half-octaves of length: randomness is told apart more surely the longer a string is."""
    return F.floor(F.log2(F.length(token).cast("double")) * 2).cast("int")


def cuts(candidates: DataFrame) -> list[tuple[str, int, float]]:
    """(encoding, length class, least p-value to report) from the p-values of all candidates; FEW_P if they are few.

    Random strings' p-values are uniform, so those over a half tell how many random strings there are in
    all, with one standard deviation allowed for chance; what a range of p-values holds beyond their share is not random.  candidates: encoding, class, p.
    """
    bins = candidates.withColumn("bin", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int"))
    counts = bins.groupBy("encoding", "class", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    table: dict[tuple[str, int], list[int]] = {}
    for row in counts:  # at most encodings x classes x BINS rows
        table.setdefault((row["encoding"], row["class"]), [0] * BINS)[row["bin"]] += row["n"]
    out = []
    for (encoding, length), n in sorted(table.items()):
        if sum(n) < FEW:
            out.append((encoding, length, FEW_P))
            continue
        high = sum(n[BINS // 2 :])
        random = 2 * (high + math.sqrt(high))
        best = None
        for b in range(BINS):
            found = sum(n[b:])
            expected = random * (BINS - b) / BINS
            if found and (found - expected) / found <= FALSE_DISCOVERIES:
                best = max(b / BINS, LEAST_P)
                break
        if best is not None:
            out.append((encoding, length, best))
    return out


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def _in_order(spans: Column) -> Column:
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(
        spans,
        lambda x: F.struct(
            x["start"].alias("start"), F.element_at(order, x["kind"]).alias("order"), x["end"].alias("end"), x["kind"].alias("kind")
        ),
    )
    return F.array_sort(keyed)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found.

    spans lists all spans as kind:start:end by start and then kind (assign, access, hex, random), places in
    code points, ends exclusive; found has them as an array.  Base spans cover the whole match.  A random
    span that lies within a base span is not listed again.  Null and empty texts have no spans (an empty
    list and the digest of the empty text).  Whole texts are scanned; repeated rows give repeated results,
    an empty table an empty one; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.concat(
            _spans(text, ASSIGN, MIN_ASSIGN, "assign", 1),
            _spans(text, LONG_ACCESS, MIN_ACCESS, "access"),
            _spans(text, LONG_HEX, MIN_HEX, "hex"),
        ).alias("base"),
        _spans(text, CANDIDATE, MIN_CANDIDATE, "random").alias("runs"),
    )
    outside = F.filter(
        F.col("runs"),
        lambda r: _encoding(F.regexp_replace(r["token"], "=+$", "")).isNotNull()
        & ~F.exists(F.col("base"), lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"])),
    )
    judged = F.transform(
        outside,
        lambda r: F.struct(
            r["start"].alias("start"),
            r["end"].alias("end"),
            r["kind"].alias("kind"),
            _encoding(F.regexp_replace(r["token"], "=+$", "")).alias("encoding"),
            length_class(r["token"]).alias("class"),
            battery(r["token"], _encoding(F.regexp_replace(r["token"], "=+$", ""))).alias("p"),
        ),
    )
    base = F.transform(
        F.col("base"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
    )
    scanned = stored(rows.select("doc_id", base.alias("base"), judged.alias("runs")), "secrets")
    limits = cuts(
        scanned.filter(F.size("runs") > 0).select(F.explode("runs").alias("r")).select("r.encoding", "r.class", "r.p")
    )
    if limits:
        least = F.create_map(*[F.lit(x) for e, c, p in limits for x in (f"{e}:{c}", p)])
        cut = lambda r: F.element_at(least, F.concat_ws(":", r["encoding"], r["class"].cast("string")))
        random = F.filter(F.col("runs"), lambda r: F.coalesce(r["p"] >= cut(r), F.lit(False)))
    else:
        random = F.filter(F.col("runs"), lambda r: F.lit(False))
    random = F.transform(random, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    count = lambda k: F.size(F.filter(F.col("base"), lambda x: x["kind"] == k)).cast("long")
    everything = _in_order(F.concat(F.col("base"), random))
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_listed(_in_order(F.col("base"))), 256).alias("base_sha256"),
        _listed(everything).alias("spans"),
        everything.alias("found"),
    )
