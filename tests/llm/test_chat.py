import random

from test_sql import SQL, assert_same, odd_connection

from weftgraph.llm import chat, queries


def links(spark, rows):
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    return {(r.conv_id, r.turn): r for r in chat.linked(df).collect()}


def test_origin_in_another_conversation_than_the_least(spark):
    said = "shared words of a length that counts"
    rows = [("a", 1, "u", f"> {said}"), ("a", 2, "u", said), ("b", 4, "u", said), ("b", 3, "u", said), ("c", 1, "u", said), ("d", 5, "u", f"> {said}"), ("e", 1, "u", f"> only here and nowhere else\nonly here and nowhere else")]
    got = {k: (r.n_linked, r.reply_conv, r.reply_turn) for k, r in links(spark, rows).items()}
    assert got["a", 1] == (1, "b", 3) and got["d", 5] == (1, "a", 2) and got["e", 1] == (0, None, None)


def test_short_passages_link_at_home_only(spark):
    got = links(spark, [("a", 0, "u", "Thanks"), ("b", 0, "u", "Thanks."), ("b", 1, "u", "other"), ("b", 2, "u", "> Thanks\nWelcome"), ("c", 0, "u", "> Thanks\nWelcome")])
    assert (got["b", 2].reply_conv, got["b", 2].reply_turn, got["b", 2].n_linked) == ("b", 0, 1)
    assert got["c", 0].n_linked == 0 and got["c", 0].reply_conv is None


def test_wrapped_and_shortened_passages(spark):
    said = "The first point is about the weather in spring. The second point is about trains! And the last one is open"
    quotes = ["> The first point is about the weather\n> in spring. The second point is about\n> trains! And the last one is open", "> The second point is\n> about trains!", "> the FIRST point, is about the weather in spring.", ">> The second point is about trains!\n> An answer in between", "> The second"]
    rows = [("a", 0, "u", said), *(("a", k + 1, "v", f"{q}\nSo it is {k}.") for k, q in enumerate(quotes))]
    got = links(spark, rows)
    assert [got["a", k + 1].n_linked for k in range(5)] == [1, 1, 1, 1, 0]
    assert [got["a", k + 1].reply_turn for k in range(4)] == [0] * 4 and got["a", 4].quote_levels == 2 and got["a", 2].reply_text == "So it is 1."
    # Lines that one side wrote as one.
    got = links(spark, [("a", 0, "u", "one\ntwo three\nfour"), ("a", 1, "v", "none"), ("a", 2, "v", "> two three\nyes")])
    assert got["a", 2].reply_turn == 0


def test_longest_part_counts(spark):
    rows = [("a", 0, "u", "Fine."), ("a", 1, "u", "It was a long day of work. Fine."), ("a", 2, "v", "> It was a long day of work. Fine.\nGood.")]
    assert links(spark, rows)["a", 2].reply_turn == 1


def test_reply_order(spark):
    rows = [("a", 0, "u", "Question of the first kind"), ("a", 2, "v", "A thread of its own, as turn one is missing"), ("a", 3, "w", "> Question of the first kind\nAn answer"), ("a", 4, "w", "> A thread of its own, as turn one is missing\nIndeed"), ("a", 5, "u", "more")]
    got = links(spark, rows)
    assert {k[1]: (r.reply_turn, r.thread, r.depth, r.place) for k, r in got.items()} == {0: (None, 0, 0, 0), 3: (0, 0, 1, 1), 2: (None, 2, 0, 2), 4: (2, 2, 1, 3), 5: (4, 2, 2, 4)}


def test_deep_threads(spark):
    """A chain of 300 turns takes few rounds and keeps its depths."""
    got = links(spark, [("a", k, "u", f"say {k}") for k in range(300)])
    assert all((r.thread, r.depth, r.place) == (0, k, k) for (_, k), r in got.items())


def test_mail_against_sql(spark, tmp_path):
    """1000 messages with nested, wrapped, shortened, common and unknown quotes."""
    rng = random.Random(17)
    words = "the train leaves at noon and comes back with rain on its roof while nobody waits for it any more".split()
    rows, said = [], {}
    for k in range(1000):
        conv, turn = (0, k) if k % 3 == 0 else (rng.randrange(1, 60), rng.randrange(12))
        lines = []
        for _ in range(rng.randrange(3)):
            source = rng.choice(["Thanks", "Yes, of course we do."]) if rng.random() < 0.3 or not said else rng.choice(said.get(conv) or rng.choice(list(said.values())))
            level = "> " * rng.randrange(1, 4)
            part = source.split()
            if len(part) > 12 and rng.random() < 0.4:
                part = rng.choice([x for x in source.replace("!", ".").split(".") if x.strip()] or [source]).split() + ["."]
            width = rng.choice([4, 7, 100])
            lines += [level + " ".join(part[i : i + width]) for i in range(0, len(part), width)]
            lines += rng.choice([[], [""], ["Bob wrote:"]])
        own = rng.choice(["Thanks", "Yes, of course we do.", " ".join(rng.choices(words, k=rng.randrange(2, 9))) + rng.choice([". ", "! ", "\n"]) + " ".join(rng.choices(words, k=rng.randrange(1, 14))) + "."])
        said.setdefault(conv, []).append(own.replace("\n", " "))
        lines.insert(rng.choice([0, len(lines)]), own)
        rows.append((conv, turn, rng.choice(["user", "assistant", None]), "\n".join(lines)))
    rows += [(None, 1, "user", "> Thanks"), (3, None, "user", "Thanks"), (5, 1, None, None), (5, 1, None, ""), (9, 2, "user", "\u0001odd\u0002 > marks\n> Thanks")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op9_chat_quotes(spark, str(tmp_path))
    assert_same(got, odd_connection(df, "conversations"), SQL["op9_chat_quotes"])
    held = got.collect()
    assert sum(r.n_linked > 0 for r in held) > 200 and sum(r.reply_conv != r.conv_id for r in held if r.reply_conv is not None and r.conv_id is not None) > 20
