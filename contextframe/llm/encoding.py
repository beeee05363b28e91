"""Encoding of a corpus with a public byte-level BPE vocabulary.

The words of a batch that were not seen before are laid out as one run of byte symbols. A
pair occurrence index maps each mergeable pair to all its positions in that run. The active
ranks are applied in ascending order: each merges every position of its pair at once and
adds the two new pairs around it to their lists. A merge makes a symbol that only pairs of
higher rank use, so the ascending order over the whole run gives each word exactly what the
word on its own would get.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the public pattern that cuts a text into words before byte pairs are merged.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts of ASCII alone, where the standard library's engine is faster.
ASCII_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Words kept with their ids in a Python worker, and characters encoded at once.
KEPT_WORDS, SLICE_CHARS = 600_000, 2_000_000


def default_path() -> str:
    """The installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte in the vocabulary file.

    Printable bytes stand for themselves, the others for the letters from 256 on, in order.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(byte if byte in printable else next(hidden)) for byte in range(256)]


class Vocabulary:
    """Byte ids and merges of a vocabulary file; about 50,000 merges, so small enough to broadcast."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        self.bytes = np.array([ids[letter] for letter in byte_letters()], np.int64)
        self.left, self.right, self.made = [], [], []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.left.append(ids[a])
            self.right.append(ids[b])
            self.made.append(ids[a + b])

    def __len__(self) -> int:
        return len(self.made)


class Encoder:
    """Words to ids, with the ids of words seen before kept."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.left, self.right, self.made = vocabulary.left, vocabulary.right, vocabulary.made
        self.bytes = vocabulary.bytes
        self.rank = {(a << 20) | b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        of_id = {int(x): k for k, x in enumerate(self.bytes)}
        self.first = np.full((256, 256), -1, np.int32)
        for r, (a, b) in enumerate(zip(self.left, self.right, strict=True)):
            if a in of_id and b in of_id:
                self.first[of_id[a], of_id[b]] = r
        self.find, self.find_ascii = regex.compile(WORDS).findall, re.compile(ASCII_WORDS).findall
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.begin, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many belong to each."""
        raw = [word.encode("utf-8", "surrogatepass") for word in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(data)
        ends = np.cumsum(sizes)
        ranks = np.full(n, -1, np.int64)
        ranks[:-1] = self.first[data[:-1], data[1:]]
        ranks[ends - 1] = -1  # no pair crosses words
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        ahead = np.arange(-1, n - 1)
        ahead[ends - sizes] = -1
        places = np.flatnonzero(ranks >= 0)
        places = places[np.argsort(ranks[places], kind="stable")]
        active, cuts = np.unique(ranks[places], return_index=True)
        occurrences: dict[int, list[int]] = {r: part.tolist() for r, part in zip(active.tolist(), np.split(places, cuts[1:]), strict=True)} if len(active) else {}
        symbols, after, ahead = self.bytes[data].tolist(), after.tolist(), ahead.tolist()
        heap = list(occurrences)
        heapify(heap)
        rank, left, right, made = self.rank.get, self.left, self.right, self.made
        while heap:
            r = heappop(heap)
            a, b, new = left[r], right[r], made[r]
            at = occurrences.pop(r)
            if a == b:
                at.sort()  # runs of one symbol merge from the left
            high = new << 20
            for p in at:
                q = after[p]
                if q < 0 or symbols[p] != a or symbols[q] != b:
                    continue
                symbols[p], symbols[q] = new, -1
                follow, lead = after[q], ahead[p]
                after[p] = follow
                if follow >= 0:
                    ahead[follow] = p
                    more = rank(high | symbols[follow])
                    if more is not None:
                        if more in occurrences:
                            occurrences[more].append(p)
                        else:
                            occurrences[more] = [p]
                            heappush(heap, more)
                if lead >= 0:
                    more = rank(symbols[lead] << 20 | new)
                    if more is not None:
                        if more in occurrences:
                            occurrences[more].append(lead)
                        else:
                            occurrences[more] = [lead]
                            heappush(heap, more)
        left_over = np.array(symbols, np.int32)
        alive = left_over >= 0
        counts = np.bincount(np.repeat(np.arange(len(words)), sizes)[alive], minlength=len(words))
        return left_over[alive], counts

    def learn(self, words: Iterable[str]) -> None:
        new = list(words)
        if not new:
            return
        ids, counts = self.merged(new)
        base = len(self.begin)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(counts) - counts])
        self.length = np.concatenate([self.length, counts])
        self.flat = np.concatenate([self.flat, ids])
        self.index.update(zip(new, range(base, base + len(new)), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many belong to each; null and empty texts have none."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                found = self.find_ascii(text) if text.isascii() else self.find(text)
                counts[k] = len(found)
                words += found
        if not words:
            return np.empty(0, np.int32), counts
        if len(self.index) > KEPT_WORDS:
            self.forget()
        self.learn(set(words).difference(self.index))
        which = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        lengths = self.length[which]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.begin[which] - (ends - lengths), lengths) + np.arange(ends[-1])]
        stops = np.concatenate([[0], ends])[np.cumsum(counts)]
        return ids, np.diff(stops, prepend=0)


_ENCODERS: dict[str, Encoder] = {}


def encode_corpus(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids) of every row, ids being the list of token ids without special tokens.

    Null and empty texts give an empty list. No text is trimmed or normalised, and strings
    of special tokens are ordinary text. Rows with the same key give a row each.
    """
    path = path or default_path()
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path)
        if encoder is None:
            encoder = _ENCODERS[path] = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(1)
            chars = np.cumsum(pa.compute.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
            # a slice ends with the row in which it reaches its share of characters, the last with the batch
            ends = np.searchsorted(chars, np.arange(SLICE_CHARS, chars[-1], SLICE_CHARS), "left") + 1 if len(chars) else []
            cuts = np.unique([*ends, len(texts)])
            begin = 0
            for cut in cuts.tolist():
                ids, counts = encoder.encode(texts.slice(begin, cut - begin).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, cut - begin), lists], [key, "ids"])
                begin = cut

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(encoded, f"`{key}` {kind}, ids array<int>")
