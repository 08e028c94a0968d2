"""Chat formatting by quotation linking, in DataFrame operations only.

Every message is parsed into lines with a quote level.  Quoted lines are normalised and hashed, and each is
joined to the message of its conversation that first said it in its own words.  A message replies to the
earlier message that most of its outermost quoted lines come from.  Replies are followed up to the message
that began the thread, and conversations are put together thread by thread without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import sized, stored

#: A line that introduces a quote in mail clients' usual forms, in four languages.
ATTRIBUTION = r"^\s*(on .{1,200} wrote|am .{1,200} schrieb.{0,100}|le .{1,200} a écrit|el .{1,200} escribió)\s*:\s*$"
#: Turns of one conversation that a row holds at most, and rows of one turn.
BLOCK = 256


def quote_level(line: Column) -> Column:
    """Number of > marks that begin a line, blanks between them aside."""
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^((?:\s{0,3}>)*)", 1), r"\s", ""))


def quote_body(line: Column) -> Column:
    return F.regexp_replace(line, r"^(?:\s{0,3}>)+ ?", "")


def passage_key(line: Column) -> Column:
    """Digest of a line's lower-cased words; null for a line without any."""
    norm = F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))
    return F.when(norm != "", F.unhex(F.sha2(norm, 256)))


def parse_messages(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, lines (array of level, body, own) of the distinct messages."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r?\n")
    parsed = F.transform(lines, lambda x: F.struct(quote_level(x).alias("level"), quote_body(x).alias("body")))
    rows = messages.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        parsed.alias("parsed"),
    ).distinct()
    # an attribution right before a quote belongs to the quote
    own = F.transform(
        "parsed",
        lambda x, i: F.struct(
            x["level"].alias("level"),
            x["body"].alias("body"),
            (
                (x["level"] == 0)
                & ~(
                    F.regexp_like(F.lower(x["body"]), F.lit(ATTRIBUTION))
                    & F.coalesce(F.get(F.col("parsed"), i + 1)["level"] > 0, F.lit(False))
                )
            ).alias("own"),
        ),
    )
    return rows.select("conv_id", "turn", "role", own.alias("lines"))


def link_replies(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, n_linked: per message with quotes that were found, where it replies to.

    A quoted line's origin is the earliest message of the conversation that has the line as its own: one
    per line, however often it was said, so a common line in a large conversation makes no pairs.
    """
    exploded = parsed.select("conv_id", "turn", F.explode("lines").alias("x"))
    keyed = exploded.select("conv_id", "turn", "x.own", "x.level", passage_key(F.col("x.body")).alias("key")).filter(
        "key is not null"
    )
    origins = keyed.filter("own").groupBy("conv_id", "key").agg(F.min("turn").alias("origin"))
    quoted = keyed.filter("level > 0").groupBy("conv_id", "turn", "level", "key").agg(F.count(F.lit(1)).alias("n"))
    linked = quoted.join(origins, ["conv_id", "key"]).filter("origin < turn")
    votes = linked.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("n").alias("n"))
    best = F.min(F.struct(F.col("level"), (-F.col("n")).alias("votes"), (-F.col("origin")).alias("later")))
    return votes.groupBy("conv_id", "turn").agg((-best["later"]).alias("reply_to"), F.sum("n").alias("n_linked"))


def threads(parsed: DataFrame, replies: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, n_linked, thread_root, depth of every message that replies.

    Pointers double each round: the rounds grow with the logarithm of the longest chain of replies.
    """
    links = stored(
        replies.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth"), "reply_to", "n_linked"),
        "replies",
    )
    while True:
        above = links.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        moved = stored(
            links.join(above, ["conv_id", "up"], "left").select(
                "conv_id",
                "turn",
                F.coalesce("further", "up").alias("up"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                "reply_to",
                "n_linked",
                F.col("further").isNotNull().alias("moved"),
            ),
            "replies",
        )
        links = moved.drop("moved")
        if not moved.filter("moved").count():
            return links.withColumnRenamed("up", "thread_root")


def placed(rows: DataFrame, block: int) -> DataFrame:
    """rows with first_root, tail, turn_block and spread: the place of a message, in thread order within a conversation.

    A thread that goes on after the ``block`` turns in which it began has rows of its own, cut by its
    messages' turns.  The other threads that began in these turns stand together, cut where such a long
    thread began: they come after it.
    """
    root_block, turn_block = F.floor(F.col("thread_root") / block), F.floor(F.col("turn") / block)
    known = rows.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    long = known.filter(turn_block > root_block).select("conv_id", "thread_root").distinct()
    # as many roots as turns at most
    long = stored(long.groupBy("conv_id", root_block.alias("root_block")).agg(F.collect_list("thread_root").alias("long")), "long-threads")
    crowded = known.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    crowded = stored(crowded.select("conv_id", "turn", F.ceil(F.col("n") / block).alias("shares")), "crowded-turns")
    rows = rows.withColumn("root_block", root_block).join(sized(long), ["conv_id", "root_block"], "left")
    rows = rows.join(sized(crowded), ["conv_id", "turn"], "left")
    own = F.coalesce(F.array_contains("long", F.col("thread_root")), F.lit(False))
    before = F.array_max(F.filter("long", lambda x: x < F.col("thread_root")))
    hashed = F.xxhash64("role", "lines")
    return (
        rows.withColumn("tail", ~own)
        .withColumn("first_root", F.when(own, F.col("thread_root")).otherwise(F.coalesce(before, F.col("root_block") * block)))
        .withColumn("turn_block", F.when(own, turn_block).otherwise(F.col("root_block")))
        .withColumn(
            "spread",
            F.when(F.col("turn").isNull() | F.col("conv_id").isNull(), F.pmod(hashed, F.lit(65536)))
            .when(F.col("shares").isNotNull(), F.pmod(hashed, F.col("shares")))
            .otherwise(0)
            .cast("int"),
        )
        .drop("long", "shares", "root_block")
    )


def format_chat(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """Reply-ordered conversations: conv_id, first_root, tail, turn_block, spread, n_messages, n_quoted, n_linked,
    messages (turn, role, reply_to, depth, text) and chat.

    A message without a linked quote begins a thread; its replies follow it in turn order.  A conversation
    is cut into rows of at most ``block`` turns, so that no row grows with it; sorted by conv_id, first_root,
    tail and turn_block they give it in thread order.  Of a turn with more than ``block`` different rows the
    rows are dealt over several, told apart by spread.  chat has one paragraph a message: the role in angle
    brackets and bars, then the text without quotes.  Equal rows count once; of different rows of one turn all
    are kept, in order of role and text.  A null text is empty, a null role is written as unknown; rows with a
    null conversation or turn can't be ordered and form rows with null places, by role and text.  Empty tables
    give empty results; other columns are ignored.
    """
    parsed = stored(parse_messages(messages, conv_col, turn_col, role_col, text_col), "messages")
    linked = threads(parsed, link_replies(parsed))
    rows = parsed.join(linked, ["conv_id", "turn"], "left").withColumn("thread_root", F.coalesce("thread_root", "turn"))
    own = F.transform(F.filter("lines", lambda x: x["own"]), lambda x: x["body"])
    text = F.regexp_replace(F.regexp_replace(F.array_join(own, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    quoted = F.size(F.filter("lines", lambda x: x["level"] > 0))
    message = F.struct(
        F.col("thread_root"),
        F.col("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.col("reply_to"),
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        text.alias("text"),
    )
    blocks = placed(rows, block).groupBy(
        "conv_id", "first_root", "tail", "turn_block", "spread"
    ).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(quoted).alias("n_quoted"),
        F.sum(F.coalesce("n_linked", F.lit(0))).alias("n_linked"),
        F.sort_array(F.collect_list(message)).alias("messages"),
    )
    said = F.transform("messages", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"]))
    return blocks.select(
        "conv_id",
        "first_root",
        "tail",
        "turn_block",
        "spread",
        "n_messages",
        "n_quoted",
        "n_linked",
        "messages",
        F.array_join(said, "\n\n").alias("chat"),
    )
