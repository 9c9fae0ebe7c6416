"""Chat formatting by quotation linking, in DataFrame expressions.

Method: a line's quote level is the number of ``>`` marks before its text. Neighbouring lines of one level are a passage.
A passage is normalised (letters and digits in lower case, single blanks) and hashed as a whole, by its sentences across
line ends, and by its lines; so is what a message says itself, so passages that were wrapped anew or shortened still meet
what they quote. A passage belongs to the message that said the longest of these parts: the first of its own conversation
that did so in an earlier turn; else, for parts of at least ``FAR_WORDS`` words, as shorter ones are everyone's, the first
of all other conversations. First sayings are found by map-side-combined minima, so each part joins at most one row.

A message replies to the latest turn of its own conversation that its outermost quotes link to, else to the other
conversation's, else to the turn before it if there is one. Inside a conversation the replies make threads: the thread's
first turn, the depth below it, and the place of the message when threads follow each other and turns do inside a thread,
so that what is replied to stands before its reply. Threads are followed by pointer jumps, in rounds that are logarithmic
in their depth. The reply text is what a message says itself, without quotes and without a line that introduces a quote (``... wrote:``).

Defined results: null texts are empty; messages with a null conversation or turn are kept without links and place; rows that repeat
a conversation and turn are messages of their own, which share their thread's place below the least turn that any of
them replies to, and stand in the order of their texts' hashes and their roles; of equal first sayings in one turn it does not matter which is meant; very long
texts are read whole; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import if_small, ranked, table

MARKS = r"^((?:[ \t]*>)+)"
INTRODUCES = r"^[ \t]*[^>].*(wrote|schrieb|écrit|escribió)[ \t]*:[ \t\r]*$"
#: Where a sentence ends.
SENTENCE = "([.!?…]+)[ \\t\\r\\n]+"
#: Words of the shortest part that links to another conversation.
FAR_WORDS = 5
#: Marks of a passage's start and of its level's end; texts lose theirs.
START, LEVEL = "\u0001", "\u0002"


def _normal(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def _parts(text: Column) -> Column:
    """Distinct normalised parts of a passage: the whole, its sentences, its lines."""
    sentences = F.split(F.regexp_replace(text, SENTENCE, f"$1{START}"), START)
    every = F.concat(F.array(text), sentences, F.split(text, "\n"))
    return F.filter(F.array_distinct(F.transform(every, _normal)), lambda x: x != "")


def parsed(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, turn, role, m, said, sayings, quotes): hash of the text, own text, hashes of own parts; of each quoted passage its level, hash, and parts (hash, words)."""
    df = messages.select(
        F.col(f"`{conversation}`").alias("c"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"),
        F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), START + LEVEL, "  ").alias("t"))
    lines = F.transform(F.split("t", "\n"), lambda x: F.struct(F.regexp_count(F.regexp_extract(x, MARKS, 1), F.lit(">")).alias("level"), x.alias("raw")))
    df = df.withColumn("lines", lines)
    after = F.slice("lines", F.lit(2), F.size("lines"))
    introduces = lambda x, y: (x["level"] == 0) & F.coalesce(y["level"] > 0, F.lit(False)) & F.coalesce(x["raw"].rlike(INTRODUCES), F.lit(False))
    df = df.withColumn("lines", F.zip_with("lines", after, lambda x, y: F.struct(F.when(introduces(x, y), -1).otherwise(x["level"]).alias("level"), x["raw"].alias("raw"))))
    before = F.concat(F.array(F.lit(None).cast("int")), F.transform(F.slice("lines", F.lit(1), F.size("lines") - 1), lambda x: x["level"]))
    body = lambda x: F.regexp_replace(x["raw"], MARKS, "")
    tagged = F.zip_with("lines", before, lambda x, b: F.when(x["level"].eqNullSafe(b), F.concat(F.lit("\n"), body(x))).otherwise(F.concat(F.lit(START), x["level"].cast("string"), F.lit(LEVEL), body(x))))
    cut = F.transform(F.slice(F.split(F.array_join(tagged, ""), START), F.lit(2), 1 << 30), lambda x: F.split(x, LEVEL))
    df = df.withColumn("blocks", F.transform(cut, lambda x: F.struct(x[0].cast("int").alias("level"), x[1].alias("text"))))
    own = F.filter("blocks", lambda x: x["level"] == 0)
    quoted = F.filter("blocks", lambda x: (x["level"] > 0) & (_normal(x["text"]) != ""))
    part = lambda x: F.struct(F.md5(x).alias("h"), F.size(F.split(x, " ")).alias("n"))
    return df.select(
        "c", "turn", "role", F.md5("t").alias("m"),
        F.trim(F.array_join(F.transform(own, lambda x: x["text"]), "\n")).alias("said"),
        F.array_distinct(F.flatten(F.transform(own, lambda x: F.transform(_parts(x["text"]), F.md5)))).alias("sayings"),
        F.array_distinct(F.transform(quoted, lambda x: F.struct(x["level"].alias("level"), F.md5(_normal(x["text"])).alias("whole"), F.transform(_parts(x["text"]), part).alias("parts")))).alias("quotes"),
    )


def origins(df: DataFrame) -> DataFrame:
    """parsed messages -> (c, turn, m, level, whole, near, far): of each passage the earlier turn of its own conversation, or else the (conversation, turn) of another, that said it."""
    placed = df.filter("c IS NOT NULL AND turn IS NOT NULL")
    quote = placed.select("c", "turn", "m", F.explode("quotes").alias("q")).select("c", "turn", "m", "q.level", "q.whole", F.explode("q.parts").alias("p"))
    quote = table(quote.select("c", "turn", "m", "level", "whole", "p.h", "p.n").distinct(), "quotes")
    asked = table(quote.groupBy("h").agg(F.max("n").alias("words")), "asked")
    # Only parts that someone quotes need an origin.
    say = placed.select("c", "turn", F.explode("sayings").alias("h")).join(if_small(asked, asked.count()), "h")
    inside = table(say.groupBy("c", "h", "words").agg(F.min("turn").alias("here")), "sayings")
    wide = inside.filter(F.col("words") >= FAR_WORDS).select("h", F.struct("c", F.col("here").alias("turn")).alias("at"))
    first = table(wide.groupBy("h").agg(F.min("at").alias("first")), "first")
    n = first.count()
    # The first saying in a second conversation: one of the two is not the quoting one.
    second = wide.join(if_small(first, n), "h").filter("at.c <> first.c").groupBy("h").agg(F.min("at").alias("second"))
    anywhere = first.join(second, "h", "left")
    found = quote.join(if_small(inside.drop("words"), inside.count()), ["c", "h"], "left").join(if_small(anywhere, n), "h", "left")
    other = F.when(F.col("first.c") != F.col("c"), F.col("first")).otherwise(F.col("second"))
    best = found.groupBy("c", "turn", "m", "level", "whole").agg(
        F.max(F.when(F.col("here") < F.col("turn"), F.struct("n", (-F.col("here")).alias("t")))).alias("near"),
        F.min(F.when(other.isNotNull(), F.struct((-F.col("n")).alias("n"), other.alias("at")))).alias("far"),
    )
    return best.select("c", "turn", "m", "level", "whole", (-F.col("near.t")).alias("near"), F.when(F.col("near").isNull(), F.col("far.at")).alias("far"))


def threads(nodes: DataFrame) -> DataFrame:
    """nodes: (c, turn, parent), a row per turn; parent is an earlier turn of nodes or null -> (c, turn, thread, depth). Rounds are logarithmic in the depth."""
    state = table(nodes.select("c", "turn", F.coalesce("parent", "turn").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("hops")), "threads")
    done, n = state.filter("hops = 0"), state.count()
    every, live = if_small(state, n), state.filter("hops > 0")
    while not live.isEmpty():
        top = every.select(F.col("c").alias("_c"), F.col("turn").alias("_t"), F.col("up").alias("_up"), F.col("hops").alias("_hops"))
        moved = live.join(top, (F.col("c") == F.col("_c")) & (F.col("up") == F.col("_t")))
        moved = table(moved.select("c", "turn", F.col("_up").alias("up"), (F.col("hops") + F.col("_hops")).alias("hops"), (F.col("_hops") == 0).alias("_end")), "threads")
        done = done.unionByName(moved.filter("_end").drop("_end"))
        live = moved.filter("NOT _end").drop("_end")
        every = if_small(table(done.unionByName(live), "threads"), n)
    return done.select("c", "turn", F.col("up").alias("thread"), F.col("hops").alias("depth"))


def linked(messages: DataFrame, **columns: str) -> DataFrame:
    """A row per message: (conv_id, turn, role, quote_levels, n_quotes, n_linked, reply_conv, reply_turn, reply_text, thread, depth, place)."""
    df = table(parsed(messages, **columns), "parsed")
    per = origins(df).groupBy("c", "turn", "m").agg(
        F.count_if(F.col("near").isNotNull() | F.col("far").isNotNull()).alias("n_linked"),
        F.max(F.when(F.col("near").isNotNull(), F.struct((-F.col("level")).alias("l"), F.col("near").alias("turn")))).alias("to"),
        F.min(F.when(F.col("far").isNotNull(), F.struct("level", F.col("far.c").alias("c"), F.col("far.turn").alias("turn")))).alias("other"),
    )
    per = table(per, "links")
    turns = table(df.filter("c IS NOT NULL AND turn IS NOT NULL").select("c", "turn").distinct(), "turns")
    n = turns.count()
    before = if_small(turns.select("c", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("has")), n)
    out = df.select("c", "turn", "role", "m", "said", F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).alias("levels"), F.size("quotes").alias("n"))
    out = out.join(if_small(per, per.count()), ["c", "turn", "m"], "left").join(before, ["c", "turn"], "left")
    inner = F.coalesce("to.turn", F.when(F.col("has"), F.col("turn") - 1))
    outside = F.col("to").isNull() & F.col("other").isNotNull()
    out = out.select(
        "c", "turn", "role", "m", F.col("levels").cast("bigint").alias("quote_levels"), F.col("n").cast("bigint").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        F.when(outside, F.col("other.c")).when(inner.isNotNull(), F.col("c")).alias("reply_conv"), F.when(outside, F.col("other.turn")).otherwise(inner).alias("reply_turn"),
        F.col("said").alias("reply_text"), inner.alias("_parent"))
    out = table(out, "replies")
    placed = out.filter("c IS NOT NULL AND turn IS NOT NULL")
    where = table(threads(placed.groupBy("c", "turn").agg(F.min("_parent").alias("parent"))), "threads")
    joined = placed.join(if_small(where, n), ["c", "turn"])
    order = ranked(joined, "c", "thread", "turn", "m", "role")
    start = table(order.groupBy("c").agg(F.min("rank").alias("_start")), "starts")
    order = order.join(if_small(start, start.count()), "c").withColumn("place", F.col("rank") - F.col("_start"))
    lost = out.filter("c IS NULL OR turn IS NULL").withColumns({x: F.lit(None).cast(order.schema[x].dataType) for x in ("thread", "depth", "place")})
    return order.select(*lost.columns).unionByName(lost).drop("m", "_parent").withColumnRenamed("c", "conv_id")
