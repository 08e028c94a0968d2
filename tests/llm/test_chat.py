from quarry.llm.chat import format_chat

NAMES = "conv_id long, turn long, role string, text string, level int, key string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], NAMES)


def test_replies_are_linked_and_quotes_removed(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nThanks a lot"),
        (1, 1, "assistant", "Use sorted()."),
        (1, 2, "user", "On Monday, A wrote:\n> How do I  SORT?\nSame question here"),
        (1, 3, "user", "> > How do I sort?\n> Same question here\nAnd me"),
        (1, 4, "user", "> Use sorted().\n> nobody said this\nIt works"),
        (2, 0, "user", "> How do I sort?\nelsewhere"),
    ]
    out = {r.conv_id: r for r in format_chat(table(spark, rows)).collect()}
    got = [(m.turn, m.reply_to, m.thread_root, m.depth, m.text) for m in out[1].messages]
    assert got == [
        (0, None, 0, 0, "How do I sort?\nThanks a lot"),
        (2, 0, 0, 1, "Same question here"),
        (3, 2, 0, 2, "And me"),
        (1, None, 1, 0, "Use sorted()."),
        (4, 1, 1, 1, "It works"),
    ]
    assert (out[1].n_messages, out[1].n_quoted, out[1].n_linked) == (5, 5, 4)
    assert out[1].chat.startswith("<|user|>\nHow do I sort?\nThanks a lot\n\n<|user|>\nSame question here")
    assert out[2].n_quoted == 1 and out[2].n_linked == 0 and out[2].messages[0].text == "elsewhere"


def test_a_long_chain_of_replies(spark):
    rows = [(1, 0, "user", "line 0")] + [(1, i, "user", f"> line {i - 1}\nline {i}") for i in range(1, 300)]
    out = format_chat(table(spark, rows), block=64).orderBy("first_root", "tail", "turn_block").collect()
    assert [r.n_messages for r in out] == [64, 64, 64, 64, 44]
    assert [(m.turn, m.depth, m.thread_root) for r in out for m in r.messages] == [(i, i, 0) for i in range(300)]


def test_a_common_line_links_to_its_first_message(spark):
    rows = [(1, i, "user", "yes") for i in range(50)] + [(1, i, "user", "> yes\nok") for i in range(50, 90)]
    (out,) = format_chat(table(spark, rows)).collect()
    assert {m.reply_to for m in out.messages if m.turn >= 50} == {0}


def test_hard_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, 1, "user", ""), (1, 1, "user", "b"), (1, 2, "user", ">"), (1, 3, "user", "x" * 50000)]
    rows += [(None, 1, "user", "lost"), (2, None, "user", "unordered"), (None, None, None, None)]
    out = format_chat(table(spark, rows)).collect()
    first = next(r for r in out if r.conv_id == 1)
    assert [(m.turn, m.role, m.text[:5]) for m in first.messages] == [
        (0, "unknown", ""), (1, "user", ""), (1, "user", "b"), (2, "user", ""), (3, "user", "xxxxx")
    ]
    assert sum(r.n_messages for r in out) == 8
    assert format_chat(table(spark, rows).limit(0)).count() == 0


def test_thread_order_of_a_long_conversation(spark):
    """Many threads, some of which go on for hundreds of turns: rows in order give thread after thread."""
    rows, thread = [], {}
    for i in range(600):
        begin = i % 7 if i >= 7 and i % 3 else i  # every third message begins a thread, the others go on with one of seven
        thread[i] = begin
        rows.append((1, i, "user", f"line {i} here" if begin == i else f"> line {begin} here\nreply {i}"))
    for block in (256, 32):
        out = format_chat(table(spark, rows), block=block).orderBy("first_root", "tail", "turn_block", "spread").collect()
        got = [(m.thread_root, m.turn) for r in out for m in r.messages]
        assert got == sorted((thread[i], i) for i in range(600))
        assert all(len({m.turn for m in r.messages}) <= block for r in out)


def test_a_crowded_turn_is_dealt_over_rows(spark):
    rows = [(1, 0, "user", f"said {i}") for i in range(200)] + [(1, 1, "user", "> said 7\nyes")]
    out = format_chat(table(spark, rows), block=16).collect()
    assert sum(r.n_messages for r in out) == 201 and max(r.n_messages for r in out) < 64 and sum(r.n_linked for r in out) == 1
