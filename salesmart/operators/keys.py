"""Sets of whole-number keys as words of bits, small enough to tell every task.

64 neighbouring numbers make a word, and its bits tell which of them are keys. Numbers drawn one after the
other fill their words, so a set takes a sixty-fourth of its rows; numbers far apart take a row each, and
whether a set is told is decided by its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLD_WORDS = 500_000  # some 60 MB where they are built, the driver included
WHOLE = ("tinyint", "smallint", "int", "bigint")


def word_of(key: str | Column) -> Column:
    """The word of a number; negative ones have words of their own."""
    return F.shiftright(F.col(key).cast("bigint") if isinstance(key, str) else key.cast("bigint"), 6)


def place_of(key: str | Column) -> Column:
    """Where in its word a number stands."""
    number = F.col(key).cast("bigint") if isinstance(key, str) else key.cast("bigint")
    return number.bitwiseAND(F.lit(63).cast("bigint")).cast("int")


def bit_of(key: str | Column) -> Column:
    """The number's bit in its word."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place_of(key))


def key_words(keys: DataFrame, key: str) -> DataFrame:
    """``_word`` and ``_bits``, a row for each word that has a key; null is none."""
    return keys.where(F.col(key).isNotNull()).groupBy(word_of(key).alias("_word")).agg(F.bit_or(bit_of(key)).alias("_bits"))


def told_words(keys: DataFrame, key: str, most: int, most_words: int = TOLD_WORDS) -> DataFrame | None:
    """The words of up to ``most`` keys in up to ``most_words`` words; None of more, which are too many to tell every task."""
    words = key_words(keys, key)
    number, held = words.agg(F.count("*"), F.coalesce(F.sum(F.bit_count("_bits")), F.lit(0))).first()
    return words if number <= most_words and held <= most else None


def among(rows: DataFrame, words: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows whose key is in the words (``left_semi``) or isn't (``left_anti``); the words go to every task."""
    held = (word_of(key) == F.col("_word")) & (F.col("_bits").bitwiseAND(bit_of(key)) != 0)
    return rows.join(F.broadcast(words), held, how)


def keep_keys(rows: DataFrame, keys: DataFrame, key: str, most: int) -> DataFrame:
    """Semi join with a table of keys.

    Whole numbers are sent to every task if their words are few, so that ``rows`` aren't shuffled. More of them
    are sort-merged: the planner would go by the size of files, and broadcast millions of keys that compress well.
    """
    if dict(keys.dtypes)[key] not in WHOLE or dict(rows.dtypes)[key] not in WHOLE:
        return rows.join(keys, key, "left_semi")
    words = told_words(keys, key, most)
    return rows.join(keys.hint("merge"), key, "left_semi") if words is None else among(rows, words, key)
