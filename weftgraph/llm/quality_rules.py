"""Quality rules, line first, in built-in Spark expressions only.

Method: every line that has a word is judged alone. It fails when it lacks terminal punctuation or stacks it
(punctuation rule), when it is a menu or is dense in symbols (navigation rule), when it holds boilerplate wording,
or when it repeats an earlier line of the text. Failing lines are removed; a document that loses more than
``MAX_LOST_PERCENT`` of its word characters is rejected. Before that come two rules on the whole text: too few
words, and too many words inside repeated 3-word windows.

Repeated windows are found per row: windows are zipped out of the word array, sorted with their positions, and
neighbours compared, so the cost is n log n in the words of one text and nothing is shuffled.

Defined results: a null text counts as an empty one, which fails the base rules; lines without a word are neither
judged nor counted; of equal lines the first is judged and the rest are repeats; very long texts are judged whole;
repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WORD_SPLIT

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOL = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 40
MAX_SYMBOL_PERCENT = 8
#: A line is boilerplate when such wording makes up this much of its characters.
MIN_BOILERPLATE_PERCENT = 10
#: Patterns that Java and RE2 read alike. A line fails the punctuation rule if END does not match or STACKED does.
END = "[.!?:;…\"'”’»)\\]][\\x20\\x09-\\x0D]*$"
STACKED = "[!?]{2,}([\\x20\\x09-\\x0D]+[^\\x20\\x09-\\x0D]+)?[\\x20\\x09-\\x0D]*$"
MENU = "[|>»•·]([^|>»•·]*[|>»•·]){2}"
#: Fixed wordings, grouped by their first letters: each is tried only where one may begin.
BOILERPLATE = (
    "a(ll rights reserved)|l(icensed under|og in)|r(eleased under the|ead more)|t(his work is licensed|erms of (use|service))|p(rivacy policy|owered by)"
    "|c(ookies?|lick here)|j(avascript)|s(ign (in|up)|ubscribe|kip to (content|main)|hare this)"
)
BOILERPLATE = f"(^|[^a-z])({BOILERPLATE})"


def _chars(x: Column) -> Column:
    """Code points other than spaces."""
    return (F.char_length(x) - F.coalesce(F.regexp_count(x, F.lit(SPACE)), F.lit(0))).cast("bigint")


def _symbols(x: Column) -> Column:
    return F.coalesce(F.regexp_count(x, F.lit(SYMBOL)), F.lit(0)).cast("bigint")


def _boilerplate(line: Column) -> Column:
    low = F.lower(line)
    rest = F.char_length(F.regexp_replace(low, BOILERPLATE, ""))
    return low.rlike(BOILERPLATE) & ((F.char_length(low) - rest) * 100 >= F.char_length(low) * MIN_BOILERPLATE_PERCENT)


def line_passes(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules on one line."""
    return (
        line.rlike(END)
        & ~line.rlike(STACKED)
        & ~line.rlike(MENU)
        & (~line.rlike(SYMBOL) | (_symbols(line) * 100 <= _chars(line) * MAX_SYMBOL_PERCENT))
        & ~_boilerplate(line)
    )


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs -> (_doc struct of all its columns, the base figures, base_failed, kept, clean_text)."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")).withColumn("_t", F.coalesce(F.col(f"_doc.`{text}`"), F.lit("")))
    df = df.withColumn("_w", F.array_remove(F.split("_t", WORD_SPLIT), ""))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("bigint"))
    df = df.withColumn("n_words", F.size("_w").cast("bigint")).withColumn("_first", F.array_distinct("_lines"))
    m = F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")
    windows = F.arrays_zip(
        F.slice("_w", F.lit(1), m).alias("a"), F.slice("_w", F.lit(2), m).alias("b"), F.slice("_w", F.lit(3), m).alias("c"),
        F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")).alias("p"),
    )
    df = df.withColumn("_sorted", F.sort_array(windows)).drop("_w")
    one_less = F.greatest(F.size("_sorted") - 1, F.lit(0))
    df = df.withColumn("_pairs", F.zip_with(
        F.slice("_sorted", F.lit(1), one_less), F.slice("_sorted", F.lit(2), one_less),
        lambda x, y: F.when((x["c"] == y["c"]) & (x["b"] == y["b"]) & (x["a"] == y["a"]), F.array(x["p"], y["p"])),
    )).drop("_sorted")
    df = df.withColumn("_at", F.array_sort(F.array_distinct(F.flatten(F.array_compact("_pairs"))))).drop("_pairs")
    gaps = F.greatest(F.size("_at") - 1, F.lit(0))
    covered = F.aggregate(
        F.zip_with(F.slice("_at", F.lit(1), gaps), F.slice("_at", F.lit(2), gaps), lambda x, y: F.least(y - x, F.lit(3))),
        F.lit(0).cast("bigint"), lambda acc, x: acc + x,
    )
    df = df.withColumn("n_repeat_words", F.when(F.size("_at") > 0, covered + 3).otherwise(F.lit(0).cast("bigint"))).drop("_at")
    df = (
        df.withColumn("n_symbols", _symbols(F.col("_t")))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size("_first")).cast("bigint"))
        .withColumn("_good", F.array_join(F.filter("_first", line_passes), "\n"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    )
    lost = F.col("word_chars") - _chars(F.col("_good"))
    return df.select(
        "_doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (lost * 100 <= F.col("word_chars") * MAX_LOST_PERCENT)).alias("kept"), F.col("_good").alias("clean_text"),
    )


def clean(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """Kept documents with their failing lines removed; a length column, if there is one, follows the new text."""
    # Pushed below the projections, the predicate would repeat their expressions wherever it names them. A projection with a
    # nondeterministic column that the filter reads keeps it above.
    df = judged(docs, text).withColumn("_part", F.spark_partition_id()).filter("kept AND _part >= 0")
    cols = []
    for c in docs.columns:
        cols.append(F.col("clean_text").alias(c) if c == text else F.char_length("clean_text").cast(docs.schema[c].dataType).alias(c) if c == length else F.col(f"_doc.`{c}`").alias(c))
    return df.select(*cols)
