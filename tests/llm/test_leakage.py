"""Leaks in any layout, against windows compared one by one."""

from __future__ import annotations

import random
import re

import pytest

from contextframe.llm.leakage import Passages, find_leaks, plain, readings

ITEM = " ".join(f"word{k}" for k in range(20)) + ". Which 3 names?"
FIRST = [f"word{k}" for k in range(16)]


def leaked(text):
    return Passages([(7, ITEM)], 16).items(text) == {7}


@pytest.mark.parametrize(
    "text",
    [
        "x " + " ".join(FIRST) + " y",
        " ".join(FIRST).upper(),
        "-- ".join(FIRST),
        "\n".join("> " + w for w in FIRST),
        "\n".join(f"  {k + 9} | {w}" for k, w in enumerate(FIRST)),
        "\n".join(f"{k + 9}. {w}" for k, w in enumerate(FIRST)),
        "\n".join(f"{k + 9}\t{w}" for k, w in enumerate(FIRST)),
        " ".join(f"**{w}**" for w in FIRST),
        " ".join(f"<b>{w}</b>&nbsp;" for w in FIRST),
        "\r\n".join("// " + w for w in FIRST),
        " ".join(FIRST[:8]) + f'<a href="{"x" * 400}">' + " ".join(FIRST[8:]),
        "[" + " ".join(FIRST[:8]) + "](" + "y" * 500 + ") " + " ".join(FIRST[8:]),
        "\n".join(f"{k + 1234567890} | {w}" for k, w in enumerate(FIRST)),
    ],
)
def test_layouts(text):
    assert leaked(text)


@pytest.mark.parametrize("text", ["", " ".join(FIRST[:15]), " ".join(FIRST[:8] + ["other"] + FIRST[8:]), " ".join(FIRST[::-1]), " ".join(FIRST[:15] + ["word15x"])])
def test_no_leak(text):
    assert not leaked(text)


def test_against_windows():
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(6)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for k in range(30)]
    passages = Passages(items, 5)
    for _ in range(200):
        words = rng.choices(vocabulary, k=rng.randint(0, 40))
        here = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        expected = {i for i, t in items if any(tuple(t.split()[k : k + 5]) in here for k in range(len(t.split()) - 4))}
        assert passages.items(" ".join(words)) == expected


def test_places_are_in_the_original():
    text = "İntro\n" + "\n".join(f"{k:>3} | {w}" for k, w in enumerate(FIRST)) + "\nEnd"
    (item, begin, end, words), = Passages([(7, ITEM)], 16).places(text)
    assert item == 7 and words == 16 and text[begin:end].startswith("word0") and text[begin:end].endswith("word15")
    assert len(plain(text)) == len(text) and all(len(r) == len(text) for r in readings(text))


def test_table(spark):
    docs = spark.createDataFrame([(1, " ".join(FIRST)), (1, " ".join(FIRST)), (2, None), (3, ""), (4, "filler " * 200_000 + " ".join(FIRST))], "doc_id bigint, text string").selectExpr("*", "5 AS item_id")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (7, ITEM), (10, ITEM)], "item_id bigint, text string")
    for block in (1, 100):
        assert sorted(tuple(r) for r in find_leaks(docs, items, block=block).collect()) == [(1, 7), (1, 10), (4, 7), (4, 10)]
    assert find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs.limit(0), items).count() == 0
    assert re.match("word0", " ".join(FIRST))


def test_automaton_of_many_items():
    import time

    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(20_000)]
    text = " ".join(rng.choices(vocabulary, k=50_000))
    took = []
    for n in (500, 5_000):
        items = [(k, " ".join(rng.choices(vocabulary, k=200))) for k in range(n)]
        began = time.perf_counter()
        passages = Passages(items, 16)
        built = time.perf_counter() - began
        assert built < 10
        began = time.perf_counter()
        assert passages.items(text + " " + " ".join(items[7][1].split()[90:106])) == {7}
        took.append(time.perf_counter() - began)
    assert took[1] < 4 * took[0] + 0.2


def test_a_run_over_and_over():
    text = " ".join(["same"] * 4_000)
    passages = Passages([(1, " ".join(["same"] * 100)), (2, " ".join(["same"] * 15))], 16)
    assert passages.items(text) == {1}
