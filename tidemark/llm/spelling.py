"""Spelling variants of words, found among sorted permuterm rotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import let
from tidemark.llm.shared import columns_of, written

#: What a word is made of; upper-case letters outside A to Z stay as they are.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends a word in its rotations; no letter.
END = "$"
LEAST_CHARS = 6
LEAST_TIMES = 5
#: How many times more frequent a form is than its variants.
RATIO = 5


def runs_of(text: Column) -> Column:
    """Maximal runs of letters of a text, A to Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(LETTERS), F.lit(0))


def words_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word``, one row per run of letters of the whole texts."""
    return columns_of(docs, text=text_col).select(F.explode(runs_of(F.col("text"))).alias("word"))


def counted(words: DataFrame, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES) -> DataFrame:
    """``word`` and ``n`` of words that are long and frequent enough, added up before the shuffle."""
    long_words = words.filter(F.length("word") >= least_chars)
    return long_words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_times)


def rotations(vocabulary: DataFrame) -> DataFrame:
    """Rotations of the words with their terminator: ``prefix``, ``word``, ``n``, ``cut``, ``last``.

    A rotation that ends in a letter is taken up to that letter: its prefix is the same for every
    word that differs there alone (``cut``). Whole rotations are prefixes too: one stands beside
    the words with one letter more. ``last`` marks the last of equal neighbouring letters, so that
    a pair of words one letter apart in length meets under one prefix and not under several.
    """
    place = F.sequence(F.lit(0), F.length("word"))

    def rotated(i: Column) -> Column:
        return F.concat(F.col("word").substr(i + 1, F.length("word")), F.lit(END), F.col("word").substr(F.lit(1), i))

    def without(i: Column) -> Column:
        return F.concat(F.col("word").substr(i + 2, F.length("word")), F.lit(END), F.col("word").substr(F.lit(1), i))

    def letter(i: Column) -> Column:
        return F.col("word").substr(i + 1, F.lit(1))

    whole = F.transform(place, lambda i: F.struct(rotated(i).alias("prefix"), F.lit(False).alias("cut"), F.lit(True).alias("last")))
    cut = F.transform(
        F.slice(place, F.lit(1), F.length("word")),
        lambda i: F.struct(without(i).alias("prefix"), F.lit(True).alias("cut"), (letter(i) != letter(i + 1)).alias("last")),
    )
    return vocabulary.select("word", "n", F.inline(F.concat(whole, cut)))


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (the near word of largest n, least in code points first).

    Rotations are brought together and sorted by prefix, and each range of equal prefixes is
    scanned once. A range holds at most one word per letter and one whole word, so it is small
    however frequent its words are, and each of its words gives one row: how many of the others
    are near it, and the best of them.
    """
    member = F.struct((-F.col("n")).alias("rank"), "word", "cut", "last")
    ranges = (
        rotations(vocabulary)
        .repartition("prefix")
        .sortWithinPartitions("prefix")
        .groupBy("prefix")
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
        .filter("size(members) > 1")
    )

    def near(one: Column) -> Column:
        return F.filter(
            F.col("members"),
            lambda other: F.when(~one["cut"], other["cut"] & other["last"])
            .otherwise((other["cut"] | one["last"]) & (other["word"] != one["word"])),
        )

    scanned = F.transform(
        "members",
        lambda one: let(
            near(one),
            lambda others: F.struct(one["word"].alias("word"), F.size(others).cast("long").alias("n_near"), F.get(others, F.lit(0)).alias("best")),
        ),
    )
    each = ranges.select(F.inline(scanned)).filter("n_near > 0")
    best = F.struct(F.col("best.rank").alias("rank"), F.col("best.word").alias("word"))
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of the chain of forms, of (``word``, ``form``) rows.

    Every form is at least ``RATIO`` times as frequent as its word, so a 64-bit count allows
    chains of 27 steps at most, and each round doubles the steps taken: five rounds are enough.
    """
    steps = written(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(5):
        further = steps.select(F.col("word").alias("from_word"), F.col("root").alias("next_root"))
        moved = steps.join(further, F.col("root") == F.col("from_word"), "left").select(
            "word", F.coalesce("next_root", "root").alias("root"), F.col("next_root").isNotNull().alias("moved")
        )
        moved = written(moved, "forms")
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return steps


def variants(words: DataFrame, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every frequent word.

    ``words`` has a row per occurrence (column ``word``); null words and those that are too short
    or rare are left out. Two words are near if one inserted, deleted or replaced code point turns
    one into the other. A word's form is its near word of largest ``n`` (ties: the least in code
    points), if that is at least ``ratio`` times its own; a word without one is its own root.
    Repeated rows count each; other columns are ignored; an empty table gives no rows.
    """
    vocabulary = written(counted(words.select("word"), least_chars, least_times), "vocabulary")
    near = neighbours(vocabulary).withColumnRenamed("word", "of_word")
    found = -F.col("best.rank") >= ratio * F.col("n")
    told = written(
        vocabulary.join(near, F.col("word") == F.col("of_word"), "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(found, F.col("best.word")).alias("form"), F.when(found, -F.col("best.rank")).alias("form_n"),
        ),
        "neighbours",
    )
    ends = roots(told.filter("form IS NOT NULL")).select(F.col("word").alias("of_word"), "root")
    return told.join(ends, F.col("word") == F.col("of_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
