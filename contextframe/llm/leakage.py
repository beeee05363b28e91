"""Evaluation texts leaking into a corpus.

One Aho-Corasick automaton holds the normalised words of all evaluation items, as pieces of
consecutive words that lie so that every run of ``least`` words of an item holds a whole
piece. A document's words are scanned once for each of its readings; where a piece is hit,
the words around it are compared with the item's in both directions, and the longest common
run is the passage. Words keep their offsets, so a passage is a place in the original text.

A text is read in two layouts: as it is, and without mark-up and what is put before its
lines (numbers, quote and list marks). Either may match.

A word is a pair of letters of two alphabets that have no letter in common, each as large as
the root of the vocabulary: a node has few children, and a match begins and ends with words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from contextframe.sources.tables import cut_lineage

_WORDS = re.compile(r"[^\W_]+")
#: Numbers and marks before a line, and mark-up within it.
_BEFORE = re.compile(r"^[^\S\n]*+(?:(?:\d++[^\S\n]*+[|:.)\]]|[>#*+|•–%;$-]+|//+|\d++(?=[^\S\n]))[^\S\n]*+)+", re.M)
_MARKUP = re.compile(r"<[^<>\n]*+>|&(?:[a-zA-Z]++\d*+|#\d++|#x[0-9a-f]++);|\]\([^()\s]*+\)|[​‌­]")
_MAY = re.compile(r"[<&(]|(?m:^[^\S\n]*+[\d>#*+|•–%;$/-])|[​‌­]")
#: Characters of evaluation text that one automaton holds; a larger set is scanned in blocks of this many, one after the other.
BLOCK = 32_000_000
#: The first letters of the two alphabets.
_LEAD, _TAIL = 0x100, 0x6C00

SPANS = "item_id bigint, begin bigint, end bigint, words bigint"


def _blank(match: re.Match[str]) -> str:
    return " " * len(match[0])


def plain(text: str) -> str:
    """The text in the second layout, at unchanged offsets."""
    return _BEFORE.sub(_blank, _MARKUP.sub(_blank, text))


def readings(text: str) -> list[str]:
    """The layouts of a text that can differ in words, lower-cased without a change of length."""
    folded = text.lower()
    if len(folded) != len(text):
        folded = "".join(low if len(low := c.lower()) == 1 else c for c in text)
    if _MAY.search(folded):
        other = plain(folded)
        if other != folded:
            return [folded, other]
    return [folded]


class Passages:
    """The automaton of the items' pieces, for runs of ``least`` words."""

    def __init__(self, items: list[tuple[int, str | None]], least: int) -> None:
        self.least, self.piece = least, max(1, least // 4)
        numbers: dict[str, int] = {}
        held: list[list[int]] = []
        owner: list[int] = []
        for item, text in items:
            for reading in readings(text or ""):
                words = [numbers.setdefault(word, len(numbers)) for word in _WORDS.findall(reading)]
                if len(words) >= least:
                    held.append(words)
                    owner.append(item)
        side = math.isqrt(len(numbers)) + 1
        letters = [chr(_LEAD + k // side) + chr(_TAIL + k % side) for k in range(len(numbers))]
        self.letters = dict(zip(numbers, letters, strict=True))
        self.items_of = owner
        self.texts = ["".join([letters[k] for k in words]) for words in held]
        often = np.bincount(np.fromiter((k for words in held for k in words), np.int64), minlength=len(numbers)).tolist()
        found: dict[str, list[tuple[int, int]]] = {}
        for number, words in enumerate(held):
            rare = [often[k] for k in words]
            for at in self._cuts(rare):
                found.setdefault(self.texts[number][2 * at : 2 * (at + self.piece)], []).append((number, at))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.places_of: list[list[tuple[int, int]]] = list(found.values())
        for k, piece in enumerate(found):
            self.automaton.add_word(piece, k)
        if found:
            self.automaton.make_automaton()

    def _cuts(self, often: list[int]) -> list[int]:
        """Where pieces begin, the rarest of each reach: every run of ``least`` words holds one."""
        reach, last = self.least - self.piece + 1, len(often) - self.least
        at = -1
        cuts: list[int] = []
        while at < last:
            low, high = (0, reach - 1) if at < 0 else (at + reach // 2 + 1, at + reach)
            high = min(high, len(often) - self.piece)
            at = min(range(min(low, high), high + 1), key=lambda k: (min(often[k : k + self.piece]), -k))
            cuts.append(at)
        return cuts

    def runs(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(item, first word, last word) of each common run of a document's words with an item's."""
        if not self.places_of or len(words) < self.least:
            return
        letter = self.letters.get
        begin = 0
        for part in "".join([letter(word, "\n") for word in words]).split("\n"):
            if len(part) >= 2 * self.least:
                yield from self._runs(part, begin)
            begin += len(part) // 2 + 1

    def _runs(self, part: str, begin: int) -> Iterator[tuple[int, int, int]]:
        done: dict[tuple[int, int], int] = {}  # item text and shift -> where its last run ends
        total = len(part)
        for last, k in self.automaton.iter(part):
            at = last + 1 - 2 * self.piece
            for number, place in self.places_of[k]:
                place *= 2
                line = number, at - place
                if done.get(line, 0) > at:
                    continue
                text = self.texts[number]
                left = 0
                while left < min(at, place) and part[at - left - 2 : at - left] == text[place - left - 2 : place - left]:
                    left += 2
                right, most = 2 * self.piece, min(total - at, len(text) - place)
                while right < most and part[at + right : at + right + 2] == text[place + right : place + right + 2]:
                    right += 2
                done[line] = at + right
                if left + right >= 2 * self.least:
                    yield self.items_of[number], begin + (at - left) // 2, begin + (at + right) // 2 - 1

    def items(self, text: str) -> set[int]:
        """The items with a run of words in the text."""
        return {item for reading in readings(text) for item, _, _ in self.runs(_WORDS.findall(reading))}

    def places(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, begin, end, words) of each passage in the original text that no other of its item holds."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for reading in readings(text):
            matches = list(_WORDS.finditer(reading))
            for item, first, last in self.runs([match[0] for match in matches]):
                key = item, matches[first].start()
                best[key] = max(best.get(key, (0, 0)), (matches[last].end(), last - first + 1))
        kept: list[tuple[int, int, int, int]] = []
        for (item, begin), (end, words) in sorted(best.items()):
            if not (kept and kept[-1][0] == item and end <= kept[-1][2]):
                kept.append((item, begin, end, words))
        return kept


def _scan(documents: DataFrame, key: str, text: str, items: list[tuple[int, str | None]], least: int, places: bool, alone: bool) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(Passages(items, least))

    def leaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = shared.value
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            for k, value in enumerate(batch.column(1)):
                value = value.as_py()
                if value:
                    rows += [(keys[k], *place) for place in passages.places(value)] if places else [(keys[k], item) for item in sorted(passages.items(value))]
            names = [key, "item_id", "begin", "end", "words"] if places else [key, "item_id"]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            kinds = [batch.schema.field(0).type, *[pa.int64()] * (len(names) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    kind = documents.schema[key].dataType.simpleString()
    found = documents.select(key, text).mapInArrow(leaks, f"`{key}` {kind}, " + (SPANS if places else "item_id bigint"))
    if not alone:
        found = cut_lineage(found)
        shared.destroy()
    return found


def find_leaks(documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = 16, places: bool = False, block: int = BLOCK) -> DataFrame:
    """(key, item_id) of each document that holds ``least`` consecutive words of an item; with ``places`` a row for each passage with its offsets.

    The items come to the driver, which builds an automaton of at most ``block`` characters
    of them, an item more than that alone; a larger set is scanned block by block, each
    result written before the next automaton is built, so that an executor holds one at a
    time. Null and empty texts, and items of fewer than ``least`` words, match nothing.
    Repeated documents and items give one row for each pair of keys. Other columns are not read.
    """
    chosen = items.select(item_key, item_text).where(items[item_text].isNotNull())
    parts: list[DataFrame] = []
    held, size = [], 0
    for row in chosen.toLocalIterator():
        if held and size + len(row[1]) > block:
            parts.append(_scan(documents, key, text, held, least, places, False))
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    if held or not parts:
        parts.append(_scan(documents, key, text, held, least, places, not parts))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result.distinct()
