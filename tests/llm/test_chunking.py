"""Pieces put together again, their sizes, and how far an edit reaches."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from contextframe.llm.chunking import Sizes, snapped, spans, split_oversized, whole_again


def tokens(text):
    return max(1, math.ceil(len(text) / 4), math.ceil(len(text.split()) * 4 / 3)) if text else 0


def check(text, limit=512, overlap=48):
    found = spans(text, Sizes(limit, overlap))
    assert "".join(text[core:end] for _, core, end in found) == text
    for k, (begin, core, end) in enumerate(found):
        assert tokens(text[begin:end]) <= limit
        assert core < end or not text
        if k:
            assert found[k - 1][1] <= begin <= core == found[k - 1][2]
            assert tokens(text[begin:core]) <= overlap + 2
    return found


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n中é\r!", max_size=60), st.integers(1, 200))
def test_round_trip(text, times):
    check(text * times, 64, 8)


def test_texts_without_boundaries():
    for text in ("x" * 9_999, "中" * 9_999, " " * 9_999, "\r\n" * 5_000, "a " * 5_000, ""):
        check(text)


def test_overlap_is_about_as_asked():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(5_000))
    found = check(text)
    assert all(40 <= tokens(text[begin:core]) <= 48 for begin, core, _ in found[1:])


def test_cuts_are_natural():
    rng = random.Random(2)
    text = "".join(("Words " * rng.randint(5, 20)).strip() + (".\n\n" if k % 4 == 0 else ". ") for k in range(200))
    found = check(text)
    assert all(text[end - 1] in "\n " for _, _, end in found[:-1])


def _changed(text, edited):
    before, after = ([t[c:e] for _, c, e in spans(t)] for t in (text, edited))
    return len(Counter(before) - Counter(after)), len(Counter(after) - Counter(before))


def test_an_edit_alters_only_neighbours():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    prose = " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(20_000))
    lines = "\n".join(",".join(word() for _ in range(6)) for _ in range(4_000))
    for text in (prose, lines):
        most = []
        for _ in range(60):
            at = rng.randrange(len(text))
            for edited in (text[:at] + " some inserted words " + text[at:], text[:at] + text[at + 15 :], text[:at] + word() + text[at + 8 :]):
                most.append(max(_changed(text, edited)))
        assert sum(n > 2 for n in most) <= len(most) // 20 and max(most) <= 5, Counter(most)


def test_landmarks_snap_to_the_nearest_boundary():
    kinds = np.full(1_001, -1, np.int8)
    kinds[::10] = 0
    kinds[[100, 180, 700]] = [3, 1, 2]
    assert snapped(np.array([132, 150, 445, 999]), kinds, 240).tolist() == [100, 180, 440, 1000]
    assert snapped(np.array([5]), np.full(11, -1, np.int8), 240).tolist() == [5]


def test_long_texts_take_time_in_proportion():
    took = []
    for n in (300_000, 1_200_000):
        text = "some words and then more of them. " * (n // 34)
        began = time.perf_counter()
        spans(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 1


def test_table(spark):
    rows = [(1, "short"), (2, None), (3, ""), (4, "word " * 2_000), (4, "word " * 2_000)]
    df = spark.createDataFrame(rows, "id bigint, t string").selectExpr("*", "'x' AS piece", "1 AS begin")
    found = split_oversized(df, "id", "t").collect()
    assert {r.item_id for r in found} == {4}
    own = sorted({(r.piece_no, r.piece, r.overlap_chars) for r in found})
    assert "".join(piece[skip:] for _, piece, skip in own) == "word " * 2_000
    assert all(r.tokens == tokens(r.piece) <= 512 for r in found)
    assert split_oversized(df.limit(0), "id", "t").count() == 0
    assert [tuple(r) for r in whole_again(split_oversized(df.distinct(), "id", "t"), df.distinct(), "id", "t").collect()] == [(4, True, True, True)]
