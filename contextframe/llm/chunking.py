"""Splitting oversized items at natural boundaries, by content-defined chunking.

A rolling hash over the last ``WINDOW`` characters marks landmarks, and each landmark snaps to
the nearest natural boundary (blank line, line or sentence, else word). A stretch that is too
long is cut at its landmark of the least hash that leaves enough on either side, and the
parts again, until all are within the largest size. Which landmark is the least hangs on the
text around it and on no earlier cut, so an edit moves the cuts next to it and no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextframe.functions.text import estimate_tokens, tokens_over

#: Characters that the rolling hash sees.
WINDOW = 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: The characters with the Unicode property White_Space, and those that end a sentence.
_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_STOP = [ord(c) for c in ".!?。！？…"]
_WIDE_STOP = [ord(c) for c in "。！？"]

PIECES = "array<struct<begin:int,core:int,end:int,piece:string>>"


@dataclass(frozen=True)
class Sizes:
    """``limit`` tokens at most in a piece, of which about ``overlap`` repeat the piece before; a landmark about every ``spacing`` characters."""

    limit: int = 512
    overlap: int = 48
    spacing: int = 256
    #: The least size of a part that a cut leaves, as a share of the largest.
    least: float = 0.3
    #: How far a landmark looks for a boundary other than a word's.
    reach: int = 240


def rolling_hash(codes: np.ndarray) -> np.ndarray:
    """For each position from 0 to the length, the hash of the WINDOW characters before it; the largest number where there are fewer."""
    hashes = np.full(len(codes) + 1, np.iinfo(np.uint64).max, np.uint64)
    if len(codes) < WINDOW:
        return hashes
    with np.errstate(over="ignore"):
        rolled, factor, width = codes.astype(np.uint64) + np.uint64(1), _FACTOR, 1
        while width < WINDOW:  # the hash of twice the width is made of two of this width
            rolled = rolled[width:] + rolled[:-width] * factor
            factor, width = factor * factor, 2 * width
        rolled ^= rolled >> np.uint64(33)
        rolled *= np.uint64(0xFF51AFD7ED558CCD)
    hashes[WINDOW:] = rolled
    return hashes


def landmarks(hashes: np.ndarray, spacing: int) -> np.ndarray:
    """Positions whose hash is among the least, one in ``spacing`` on average."""
    bits = max(1, int(spacing).bit_length() - 1)
    return np.flatnonzero((hashes >> np.uint64(64 - bits)) == 0)


def boundaries(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position from 0 to the length: words begun before it, and the class of a cut there.

    Classes: 3 after a blank line, 2 after a line, 1 after a sentence, 0 before a word, -1 inside one.
    """
    n = len(codes)
    space = np.isin(codes, _SPACE)
    before = np.concatenate([[True], space[:-1]])
    starts = ~space & before
    words = np.concatenate([[0], np.cumsum(starts)])
    kinds = np.full(n + 1, -1, np.int8)
    kinds[:-1][starts] = 0
    last = np.maximum.accumulate(np.where(~space, np.arange(n), -1))  # the last visible character so far
    ends = np.flatnonzero(starts[1:]) + 1
    seen = last[ends - 1]
    ends, seen = ends[seen >= 0], seen[seen >= 0]
    kinds[ends[np.isin(codes[seen], _STOP)]] = 1
    kinds[1:][np.isin(codes, _WIDE_STOP)] = 1
    breaks = np.flatnonzero(codes == 10)
    kinds[breaks + 1] = 2
    if len(breaks) > 1:
        blank = last[breaks[1:]] < breaks[:-1]
        kinds[breaks[1:][blank] + 1] = 3
    kinds[n] = 3
    return words, kinds


def _nearest(places: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The place nearest to each mark, the one before it where two are; there must be one."""
    at = np.searchsorted(places, marks)
    after, before = places[np.minimum(at, len(places) - 1)], places[np.maximum(at - 1, 0)]
    return np.where(np.abs(after - marks) < np.abs(marks - before), after, before)


def snapped(marks: np.ndarray, kinds: np.ndarray, reach: int) -> np.ndarray:
    """Each landmark at the nearest end of a sentence, line or block within ``reach``, else at the nearest word there, else where it is."""
    result = marks
    for least in (0, 1):
        places = np.flatnonzero(kinds >= least)
        if len(places) and len(marks):
            near = _nearest(places, marks)
            result = np.where(np.abs(near - marks) <= reach, near, result)
    return result


def spans(text: str, sizes: Sizes = Sizes()) -> list[tuple[int, int, int]]:
    """(begin, core, end) of each piece; text[core:end] of all pieces put together is the text, and text[begin:core] repeats the piece before."""
    n = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    words, kinds = boundaries(codes)
    over_chars, over_words = sizes.overlap * 4, sizes.overlap * 3 // 4
    # what is not the overlap; a word that a cut goes through counts on both sides
    most_chars, most_words = sizes.limit * 4 - over_chars, sizes.limit * 3 // 4 - over_words - 1
    hashes = rolling_hash(codes)
    marks = landmarks(hashes, sizes.spacing)
    levels = [(snapped(marks, kinds, sizes.reach), hashes[marks])]
    levels += [(places, hashes[places]) for least in (1, 0) if len(places := np.flatnonzero(kinds >= least))]
    levels.append((np.arange(n + 1), hashes))
    order = np.argsort(levels[0][0], kind="stable")
    levels[0] = levels[0][0][order], levels[0][1][order]
    least_chars, least_words = max(1, int(most_chars * sizes.least)), max(1, int(most_words * sizes.least))
    cuts, todo = [], [(0, n)]
    while todo:
        begin, end = todo.pop()
        if end - begin <= most_chars and words[end] - words[begin] <= most_words:
            continue
        low = min(begin + least_chars, int(np.searchsorted(words, words[begin] + least_words, "left")))
        high = max(end - least_chars, int(np.searchsorted(words, words[end] - least_words, "right")) - 1)
        low = min(max(low, begin + 1), end - 1)
        high = max(min(high, end - 1), low)
        for places, ranks in levels:
            first, last = int(np.searchsorted(places, low)), int(np.searchsorted(places, high, "right"))
            if first < last:
                here, rank = places[first:last], ranks[first:last]
                ties = np.flatnonzero(rank == rank.min())  # the same text over and over: near the middle
                cut = int(here[ties[np.argmin(np.abs(here[ties] - (begin + end) // 2))]])
                break
        cuts.append(cut)
        todo += [(begin, cut), (cut, end)]
    pieces, begin, core = [], 0, 0
    for cut in sorted(cuts):
        pieces.append((begin, core, cut))
        core = cut
        begin = max(cut - over_chars, int(np.searchsorted(words, words[cut] - over_words, "left")))
        starts = np.flatnonzero(kinds[begin:cut] >= 0)
        begin = begin + int(starts[0]) if len(starts) else max(begin, cut - over_chars)
        begin = min(begin, cut)
    pieces.append((begin, core, n))
    return pieces


def _pieces(text: Column, sizes: Sizes) -> Column:
    @F.pandas_udf(PIECES)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda text: [{"begin": b, "core": c, "end": e, "piece": text[b:e]} for b, c, e in spans(text, sizes)])

    return cut(text)


def split_oversized(df: DataFrame, key: str, text: str, sizes: Sizes = Sizes()) -> DataFrame:
    """(item_id, piece_no, piece, tokens, overlap_chars, begin, end) of each item over the limit.

    ``piece`` without its first ``overlap_chars`` characters, put together in order of
    ``piece_no``, is the item's text. Items within the limit, empty and null texts have no
    rows. Rows with the same key are cut each on its own; other columns are not read.
    """
    return (
        df.select(F.col(key).alias("item_id"), F.col(text).alias("_text"))
        .where(tokens_over(F.col("_text"), sizes.limit))
        .select("item_id", F.posexplode(_pieces(F.col("_text"), sizes)).alias("_no", "_s"))
        .select("item_id", (F.col("_no") + 1).cast("bigint").alias("piece_no"), F.col("_s.piece").alias("piece"), (F.col("_s.core") - F.col("_s.begin")).cast("bigint").alias("overlap_chars"), F.col("_s.begin").cast("bigint").alias("begin"), F.col("_s.end").cast("bigint").alias("end"))
        .withColumn("tokens", estimate_tokens(F.col("piece")))
    )


def whole_again(pieces: DataFrame, items: DataFrame, key: str, text: str, sizes: Sizes = Sizes()) -> DataFrame:
    """(item_id, whole, within, linked): whether an item's pieces, without their overlaps, are its text; are within the limit; and each begins with the end of the one before.

    The pieces of one item come together, not more than its text. Keys of ``items`` must be unique.
    """
    own = F.expr("substring(piece, CAST(overlap_chars AS INT) + 1)")
    one = F.struct("piece_no", own.alias("own"), "begin", (F.col("end") - F.length(own)).alias("core"), "end", (F.length("piece") == F.col("end") - F.col("begin")).alias("long"))
    together = pieces.groupBy("item_id").agg(F.array_sort(F.collect_list(one)).alias("p"), F.max("tokens").alias("most"))
    following = F.forall(
        F.sequence(F.lit(1), F.size("p")),
        lambda k: (F.element_at("p", k)["piece_no"] == k)
        & F.element_at("p", k)["long"]
        & F.when(k == 1, F.element_at("p", k)["begin"] == 0).otherwise((F.element_at("p", F.greatest(k - 1, F.lit(1)))["end"] == F.element_at("p", k)["core"]) & (F.element_at("p", k)["begin"] >= F.element_at("p", F.greatest(k - 1, F.lit(1)))["core"])),
    )
    joined = F.array_join(F.transform("p", lambda x: x["own"]), "")
    return (
        together.join(items.select(F.col(key).alias("item_id"), F.col(text).alias("_text")), "item_id")
        .select("item_id", (joined == F.col("_text")).alias("whole"), (F.col("most") <= sizes.limit).alias("within"), following.alias("linked"))
    )
