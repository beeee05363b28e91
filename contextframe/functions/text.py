"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of characters without the Unicode property White_Space.
WORD = r"[^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(WORD))


def estimate_tokens(text: Column) -> Column:
    """Tokens of a text: 0 if empty, else the largest of 1, code points / 4 and words * 4 / 3, rounded up. Null stays null."""
    chars, words = F.length(text), word_count(text).cast("bigint")
    return F.when(chars == 0, F.lit(0).cast("bigint")).otherwise(
        F.greatest(F.lit(1).cast("bigint"), F.floor((chars + 3) / 4), F.floor((words * 4 + 2) / 3))
    )


def tokens_over(text: Column, limit: int) -> Column:
    """Whether a text has more tokens than ``limit``; counts words only where their number can matter."""
    chars = F.length(text)
    most_words = limit * 3 // 4
    return F.when(chars > 4 * limit, True).when(chars <= 2 * most_words, False).otherwise(word_count(text) > most_words)


#: White space and the punctuation of ASCII.
MARK = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}!-/:-@\[-`{-~]"


def estimate_tokens_marks(text: Column) -> Column:
    """Tokens by code points / 4 and by white space and punctuation / 12, each rounded down; 1 at least."""
    marks = F.floor(F.regexp_count(text, F.lit(MARK)) / 12)
    return F.when(text.isNotNull(), F.greatest(F.lit(1).cast("bigint"), F.floor(F.length(text) / 4) + marks))


def estimate_tokens_bytes(text: Column) -> Column:
    """Tokens by bytes / 4, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("bigint")
