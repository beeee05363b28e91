"""Which of many needles a text contains, without a join on ``contains``.

The needles come to the driver block by block, where each block becomes one automaton that is
built once and sent out; every text is scanned once for a block, however many needles it
holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of the needles in one automaton; more are scanned in several passes.
BLOCK = 2_000_000


def _pass(texts: DataFrame, key: str, text: str, needles: list[str]) -> DataFrame:
    built = ahocorasick.Automaton()
    for needle in needles:
        built.add_word(needle, needle)
    if needles:
        built.make_automaton()
    shared = texts.sparkSession.sparkContext.broadcast(built)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            keys, hits = [], []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if value and len(found):
                    own = {needle for _, needle in found.iter(value)}
                    keys += [k] * len(own)
                    hits += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(hits, pa.string())], ["key", "needle"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(scan, f"key {kind}, needle string")


def contained(texts: DataFrame, key: str, text: str, needles: DataFrame, needle: str, block: int = BLOCK) -> DataFrame:
    """(key, needle): every text with every needle in it. Null and empty needles and texts match nothing.

    An automaton holds needles of at most ``block`` characters together, or one longer needle.
    """
    result, held, size = None, [], 0
    for row in needles.select(needle).where(needles[needle] != "").distinct().toLocalIterator():
        if held and size + len(row[0]) > block:
            part = _pass(texts, key, text, held)
            result = part if result is None else result.unionAll(part)
            held, size = [], 0
        held.append(row[0])
        size += len(row[0])
    if held or result is None:
        part = _pass(texts, key, text, held)
        result = part if result is None else result.unionAll(part)
    return result
