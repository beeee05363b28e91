"""Near-duplicate records by an exact join of word multisets.

Two texts are near-duplicates if the words they have in common, each counted as often as it
occurs in both, are at least ``SHARE`` of the longer one. One minus that share is a metric
of the Jaccard family; a text within the threshold of A lacks at most ``(1 - SHARE)`` of the
longer one's words. The join goes through regions, level by level:

- The first level is prefix filtering: words have one order, the rarest first, and a text
  lies in the region of each of its first words, one more than a near-duplicate can lack.
  Two near-duplicates share the first word that both have, and meet in its region.
- A region with more than ``LEAF`` texts is split around pivots, texts of the region: a text
  goes to the nearest pivot and, as a visitor, to each pivot whose distance is larger by no
  more than twice the threshold (the triangle inequality). Distances are those of bit maps of
  the words, which are never larger than those of the texts.
- Where that does not halve the comparisons, the region is split by a second shared word,
  then a third and so on: texts within the threshold that share many words have the first of
  them among as many more of their rarest words.
- What no level splits are texts that share many words and lie near each other; these are
  cut into blocks that meet pairwise.
- Within a region, texts are compared in order of their length, and of the pairs that bit
  maps leave, the words are counted exactly.

Copies of a text form one class, which takes part in the join once; a class of very many
copies is cut into blocks where pairs of rows are asked for.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextframe.sources.tables import cut_lineage, drop_cut

#: Least share of the longer text, in tenths, so that comparisons are exact.
TENTHS = 8
#: Texts in a region before it is split, and pivots of a split.
LEAF, PIVOTS = 20_000, 8
#: Copies of a text that meet in one task, and tasks that number the copies of a text.
COPIES, SALT = 1_000, 64
#: Counters of the sketch of word frequencies: its size is what is broadcast, 4 MB.
COUNTERS = 1 << 20
_WORDS = re.compile(r"\w+")
#: Numbers of words that a worker keeps.
KEPT = 300_000
_NUMBERS: dict[str, int] = {}
#: Bits of a word map in regions, and of the one that candidates are asked again by.
_BITS, _WIDE = 256, 1024


def _number(word: str) -> int:
    """The 64-bit number of a word; those of words seen before are kept, up to KEPT of them."""
    known = _NUMBERS.get(word)
    if known is None:
        if len(_NUMBERS) >= KEPT:
            _NUMBERS.clear()
        known = _NUMBERS[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return known


def elements(text: str) -> np.ndarray:
    """The words of a text as sorted 64-bit numbers, the n-th occurrence of a word with a number of its own."""
    found = []
    for word, n in Counter(_WORDS.findall(text.lower())).items():
        found.append(_number(word))
        # the occurrence goes into the bytes: seeds of this hash make short words collide
        found += [_number(f"{word} {k}") for k in range(1, n)]
    return np.sort(np.array(found, np.uint64).view(np.int64))


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, class, text) of every row with a word in it; rows of the same text have the same class."""
    own = F.col(text)
    return df.select(F.col(key).alias("id"), F.substring(F.unhex(F.sha2(own, 256)), 1, 16).alias("class"), own.alias("text")).where(F.regexp_like("text", F.lit(r"[\p{L}\p{N}_]")))


def bags(texts: DataFrame) -> DataFrame:
    """(class, elements) of every text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [elements(value) for value in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(words) for words in found])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["class", "elements"])

    return texts.select("class", "text").mapInArrow(read, "class binary, elements array<bigint>").where("size(elements) > 0")


def frequencies(distinct: DataFrame) -> np.ndarray:
    """How many bags have a word, by COUNTERS counters that several words may share; never too small."""
    counts = distinct.select(F.explode("elements").alias("e")).groupBy(F.pmod("e", F.lit(COUNTERS)).cast("int").alias("slot")).agg(F.least(F.count("*"), F.lit(2**31 - 1)).cast("int").alias("n"))
    rows = counts.toArrow()
    sketch = np.zeros(COUNTERS, np.int32)
    sketch[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return sketch


def bitmap(words: np.ndarray, bits: int = _BITS) -> np.ndarray:
    """The words' bits; the bits in which two maps differ are at most as many as the words in which the bags do."""
    counts = np.bincount((words.view(np.uint64) >> np.uint64(24)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def rarest(words: np.ndarray, count: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """The words, rarest first, among which a near-duplicate has the first ``shared`` words in common, as far as another bag has them; and their places."""
    n = len(words)
    often = count[words % COUNTERS]
    order = np.lexsort((words, often))[: n - -(-TENTHS * n // 10) + shared]
    places = np.flatnonzero(often[order] > 1)  # a word that no other bag has leads to none
    return words[order[places]], places


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])


_MAPS = [f"b{b}" for b in range(_BITS // 64)]
_REGION = "region bigint, no bigint, n int, rank int, often int, " + ", ".join(f"{b} bigint" for b in _MAPS)


def regions(distinct: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(region, no, n, rank, often, b0, ...): every bag in the region of each of its rarest words that a near-duplicate may lack, and one more.

    ``often`` is at least the size of the region.
    """
    shared = distinct.sparkSession.sparkContext.broadcast(sketch)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        for batch in batches:
            numbers = batch.column(0)
            values, offsets = _lists(batch.column(1))
            region, ranks, sizes, maps = [], [], [], []
            for k in range(len(numbers)):
                words = values[offsets[k] : offsets[k + 1]]
                first, places = rarest(words, count, 1)
                region.append(first)
                ranks.append(places)
                sizes.append(len(words))
                maps.append(bitmap(words))
            if not region:
                continue
            which = np.repeat(np.arange(len(region)), [len(r) for r in region])
            bits = np.stack(maps)[which]
            words = np.concatenate(region)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words), numbers.take(pa.array(which)), pa.array(np.array(sizes, np.int32)[which]), pa.array(np.concatenate(ranks).astype(np.int32)), pa.array(count[words % COUNTERS]), *(pa.array(np.ascontiguousarray(bits[:, b])) for b in range(len(_MAPS)))],
                ["region", "no", "n", "rank", "often", *_MAPS],
            )

    return distinct.select("no", "elements").mapInArrow(spread, _REGION)


def _deeper(hot: DataFrame, distinct: DataFrame, sketch: np.ndarray) -> DataFrame:
    """Rows of large regions in the regions of one more shared word; ``parent`` is the region they come from.

    Bags too short to share so many words with a near-duplicate of their length stay together as well.
    """
    shared = distinct.sparkSession.sparkContext.broadcast(sketch)
    names = ["parent", "no", "n", "rank", *_MAPS, "home", "depth"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        for batch in batches:
            get = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            values, offsets = _lists(get["elements"])
            which, word, rank = [], [], []
            for k, (own, depth) in enumerate(zip(get["rank"].to_pylist(), get["depth"].to_pylist(), strict=True)):
                words = values[offsets[k] : offsets[k + 1]]
                further, places = rarest(words, count, depth + 1)
                later = places > own
                which.append(np.full(int(later.sum()), k))
                word.append(further[later])
                rank.append(places[later])
                if -(-TENTHS * len(words) // 10) <= depth:
                    which.append(np.array([k]))
                    word.append(np.array([0]))
                    rank.append(np.array([own]))
            if not which:
                continue
            at = np.concatenate(which).astype(np.int64)
            take = pa.array(at)
            columns = {name: get[name].take(take) for name in names}
            columns["rank"] = pa.array(np.concatenate(rank).astype(np.int32))
            columns["depth"] = pa.array(columns["depth"].to_numpy() + np.int32(1), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(word).astype(np.int64)), *columns.values()], ["word", *names])

    schema = "word bigint, parent bigint, no bigint, n int, rank int, " + ", ".join(f"{b} bigint" for b in _MAPS) + ", home boolean, depth int"
    rows = hot.withColumnRenamed("region", "parent").select(*names).join(distinct.select("no", "elements"), "no")
    return rows.select(*names, "elements").mapInArrow(spread, schema).withColumn("region", F.xxhash64("parent", "word", "depth")).drop("word")


def split(found: DataFrame, distinct: DataFrame, sketch: np.ndarray, leaf: int = LEAF, pivots: int = PIVOTS) -> DataFrame:
    """Regions of more than ``leaf`` bags split level by level until none is left; adds ``home`` and ``block``.

    Two bags of a region meet if at least one is at home and, in a pair of blocks, they are
    not both of the same block. A split counts if it leaves at most half of the comparisons,
    so its largest part is smaller by a third and the levels end. ``late`` is how many words of
    a bag no other bag of the region can have in common with it.
    """
    late = (F.col("rank") - F.col("depth") + 1).alias("late")
    kept = ["region", "no", "n", late, *_MAPS, "home"]
    done = []
    here = found.withColumn("home", F.lit(True)).withColumn("depth", F.lit(1))
    level = 0
    while True:
        # words of no more bags than a leaf have no large region
        large = None if level == 0 and sketch.max(initial=0) <= leaf else cut_lineage((here.where(F.col("often") > leaf) if level == 0 else here).groupBy("region").agg(F.count("*").alias("size")).where(F.col("size") > leaf))
        if large is None or large.isEmpty():
            done.append(here.select(*kept, F.lit(-1).alias("block")))
            break
        done.append(here.join(large, "region", "left_anti").select(*kept, F.lit(-1).alias("block")))
        hot = cut_lineage(here.join(large, "region"))
        share = F.greatest(F.lit(1), F.floor(F.col("size") / F.lit(pivots))).cast("bigint")
        chosen = (
            hot.where(F.pmod(F.xxhash64("no", F.lit(level)), share) == 0)
            .groupBy("region")
            .agg(F.slice(F.array_sort(F.collect_set(F.struct(*_MAPS))), 1, 4 * pivots).alias("pivots"))
        )
        distance = F.transform("pivots", lambda p: sum((F.bit_count(p[b].bitwiseXOR(F.col(b))) for b in _MAPS[1:]), F.bit_count(p[_MAPS[0]].bitwiseXOR(F.col(_MAPS[0])))))
        # twice the threshold: bags of n words differ from one within it in no more than 0.4 * n / 0.8 words
        near = (
            hot.join(chosen, "region", "left")
            .withColumn("d", F.coalesce(distance, F.array(F.lit(0))))
            .withColumn("least", F.array_min("d"))
            .withColumn("reach", F.col("least") + 2 * F.floor(F.col("n") * (10 - TENTHS) * 2 / TENTHS))
            .withColumn("own", F.array_position("d", F.col("least")) - 1)
        )
        copies = near.withColumn("goes", F.filter(F.transform("d", lambda d, i: F.when(d <= F.col("reach"), i)), lambda i: i.isNotNull()))
        cells = copies.select("region", F.explode("goes").alias("cell")).groupBy("region", "cell").agg(F.count("*").alias("c"))
        around = cut_lineage(_halved(cells, large, "region"))
        parts = [
            copies.join(around, "region", "left_semi")
            .select(F.explode("goes").alias("cell"), "*")
            .select(F.xxhash64("region", F.lit(level), "cell").alias("region"), "no", "n", "rank", *_MAPS, (F.col("home") & (F.col("cell") == F.col("own"))).alias("home"), "depth")
        ]
        rest = hot.join(around, "region", "left_anti")
        words = cut_lineage(_deeper(rest, distinct, sketch))
        worded = cut_lineage(_halved(words.groupBy("parent", "region").agg(F.count("*").alias("c")), large.withColumnRenamed("region", "parent"), "parent"))
        parts.append(words.join(worded, "parent", "left_semi").select("region", "no", "n", "rank", *_MAPS, "home", "depth"))
        k = F.ceil(F.col("size") / F.lit(leaf)).cast("int") + 1
        done.append(
            rest.join(worded.withColumnRenamed("parent", "region"), "region", "left_anti")
            .withColumn("k", k)
            .withColumn("own", F.pmod(F.xxhash64("no"), F.col("k")).cast("int"))
            .select(F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"), "*")
            .select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other"), F.lit("block")).alias("region"), "no", "n", late, *_MAPS, "home", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("block"))
        )
        here = cut_lineage(parts[0].unionByName(parts[1]))
        level += 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def _halved(parts: DataFrame, large: DataFrame, key: str) -> DataFrame:
    """The regions of which the parts, of ``c`` bags each, have at most half of the comparisons."""
    work = parts.groupBy(key).agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("work"))
    return work.join(large, key).where(F.col("work") <= F.col("size").cast("double") * F.col("size") / 2).select(key)


class _Sweep:
    """Rows in order of region and length, compared with those before them while they come in."""

    def __init__(self) -> None:
        self.rest: dict[str, np.ndarray] | None = None

    def take(self, part: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (classes) that end in the new rows."""
        held = 0 if self.rest is None else len(self.rest["n"])
        rows = part if not held else {k: np.concatenate([self.rest[k], v]) for k, v in part.items()}
        region, n, home, block, bits = rows["region"], rows["n"], rows["home"], rows["block"], rows["bits"]
        common = 10 * (n - rows["late"])  # at most so many tenths of words in common with a bag of the region
        total = len(n)
        left, right = [], []
        active = np.arange(total)
        step = 1
        while len(active):
            active = active[active + step < total]
            later = active + step
            fits = (region[active] == region[later]) & (common[active] >= TENTHS * n[later])
            active, later = active[fits], later[fits]
            new = (later >= held) & (home[active] | home[later]) & ((block[active] != block[later]) | (block[active] < 0))
            a, b = active[new], later[new]
            differ = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
            # with o words in common, the bags differ in n_a + n_b - 2 o words
            close = 10 * (n[a] + n[b] - differ) >= 2 * TENTHS * n[b]
            left.append(rows["no"][a[close]])
            right.append(rows["no"][b[close]])
            step += 1
        keep = np.zeros(total, bool)
        if total:
            keep = (region == region[-1]) & (common >= TENTHS * n[-1])
        self.rest = {k: v[keep] for k, v in rows.items()}
        return np.concatenate([np.empty(0, np.int64), *left]), np.concatenate([np.empty(0, np.int64), *right])


def candidates(found: DataFrame) -> DataFrame:
    """(a, b): numbers of pairs of bags that the bit maps of some region leave, a before b."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Sweep()
        for batch in batches:
            get = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            part = {
                "region": get["region"].to_numpy(),
                "n": get["n"].to_numpy().astype(np.int64),
                "late": get["late"].to_numpy().astype(np.int64),
                "home": get["home"].to_numpy(zero_copy_only=False),
                "block": get["block"].to_numpy(),
                "bits": np.stack([get[b].to_numpy() for b in _MAPS], 1).view(np.uint64),
                "no": get["no"].to_numpy(),
            }
            a, b = state.take(part)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    ordered = found.repartition("region").sortWithinPartitions("region", "n", "no").select("region", "no", "n", "late", *_MAPS, "home", "block")
    return ordered.mapInArrow(sweep, "a bigint, b bigint").where("a <> b").distinct()


def sketches(distinct: DataFrame) -> DataFrame:
    """(no, n, wide): how many words a bag has, and its wide bit map."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch.column(1))
            maps = [bitmap(values[offsets[k] : offsets[k + 1]], _WIDE) for k in range(batch.num_rows)]
            wide = pa.ListArray.from_arrays(pa.array(np.arange(len(maps) + 1) * (_WIDE // 64), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *maps])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int32)), wide], ["no", "n", "wide"])

    return distinct.select("no", "elements").mapInArrow(read, "no bigint, n int, wide array<bigint>")


def class_links(distinct: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(a, b, common, longer): every pair of classes at or over the threshold."""
    distinct = cut_lineage(distinct.withColumn("no", F.monotonically_increasing_id()))
    sketch = frequencies(distinct)
    pairs = candidates(split(regions(distinct, sketch), distinct, sketch, leaf))
    wide = sketches(distinct)
    for end in ("a", "b"):
        pairs = pairs.join(wide.select(F.col("no").alias(end), F.col("n").alias(f"n{end}"), F.col("wide").alias(f"w{end}")), end)
    differ = sum((F.bit_count(F.col("wa")[k].bitwiseXOR(F.col("wb")[k])) for k in range(1, _WIDE // 64)), F.bit_count(F.col("wa")[0].bitwiseXOR(F.col("wb")[0])))
    pairs = cut_lineage(pairs.where((F.col("na") + F.col("nb") - differ) * 10 >= F.greatest("na", "nb") * 2 * TENTHS).select("a", "b"))
    # only bags that may be in a link have their words shuffled; a slot stands for one bag or a few
    slot = lambda no: F.pmod(F.xxhash64(no), F.lit(COUNTERS)).cast("int")
    slots = pairs.select(F.explode(F.array("a", "b")).alias("no")).select(slot(F.col("no")).alias("slot")).distinct()
    linked = distinct.withColumn("slot", slot(F.col("no"))).join(F.broadcast(slots), "slot", "left_semi")
    one = linked.select(F.col("no").alias("a"), F.col("class").alias("ca"), F.col("elements").alias("ea"))
    two = linked.select(F.col("no").alias("b"), F.col("class").alias("cb"), F.col("elements").alias("eb"))
    return (
        pairs.join(one, "a")
        .join(two, "b")
        .select(F.col("ca").alias("a"), F.col("cb").alias("b"), F.size(F.array_intersect("ea", "eb")).cast("bigint").alias("common"), F.greatest(F.size("ea"), F.size("eb")).cast("bigint").alias("longer"))
        .where(F.col("common") * 10 >= F.col("longer") * TENTHS)
    )


def joined(df: DataFrame, key: str, text: str, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """Members (id, class) of every class, and the links between classes."""
    rows = keyed(df, key, text)
    members = cut_lineage(rows.select("id", "class"))
    return members, class_links(bags(rows.groupBy("class").agg(F.first("text").alias("text"))), leaf)


def near_pairs(df: DataFrame, key: str = "id", text: str = "text", leaf: int = LEAF, copies: int = COPIES) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of rows at or over the threshold, copies among them.

    Null texts and texts without words are near-duplicates of none. A key that several rows
    have counts once with each of its texts. Other columns are not read. A class of more than
    ``copies`` rows is cut into blocks of about as many, which meet pairwise, so that no task
    has more rows of a class than two blocks.
    """
    members, links = joined(df, key, text, leaf)
    members = members.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALT)))
    large = cut_lineage(
        members.groupBy("class", "_s").agg(F.count("*").alias("n")).groupBy("class").agg(F.sum("n").alias("n")).where(F.col("n") > copies).select("class", F.ceil(F.col("n") / copies).cast("int").alias("k"))
    )
    salted = large.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))).alias("_s"))
    placed = (
        members.join(salted, ["class", "_s"], "left")
        .select("id", "class", F.coalesce("k", F.lit(1)).alias("k"))
        .withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("k")).cast("int"))
    )
    meeting = placed.select("class", "id", "block", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")).select(
        "class", "id", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")
    )
    one, two = meeting.withColumnsRenamed({"id": "x", "block": "bx"}), meeting.withColumnsRenamed({"id": "y", "block": "by"})
    same = one.join(two, ["class", "first", "second"]).where((F.col("x") < F.col("y")) & ((F.col("first") == F.col("second")) | (F.col("bx") != F.col("by")))).select("x", "y")
    across = links.select("a", "b")
    for end, row in (("a", "x"), ("b", "y")):
        across = (
            across.join(large.select(F.col("class").alias(end), "k"), end, "left")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)))
            .drop("k")
            .join(placed.select(F.col("class").alias(end), "block", F.col("id").alias(row)), [end, "block"])
            .drop("block")
        )
    across = across.where("x <> y").select("x", "y")
    return same.unionByName(across).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_groups(df: DataFrame, key: str = "id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """(id, group_id, links): a row for each row with words; groups are what links connect, named by their least key.

    ``links`` counts the links of the row's class to others. Components are found by label
    propagation with shortcuts over the links between classes, in O(log n) rounds as a rule.
    """
    members, links = joined(df, key, text, leaf)
    links = cut_lineage(links.select("a", "b"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = held = cut_lineage(both.select(F.col("a").alias("v")).distinct().withColumn("label", F.col("v")))
    while True:
        lower = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("low"))
        step = labels.join(lower, "v").select("v", F.least("label", "low").alias("new"), "label")
        # the label of the label: what its own neighbourhood has found
        jump = step.select(F.col("v").alias("new"), F.col("new").alias("far"))
        after = cut_lineage(step.join(jump, "new", "left").select("v", F.least("new", F.coalesce("far", "new")).alias("label"), F.col("label").alias("old")))
        changed = not after.where("label <> old").isEmpty()
        drop_cut(held)
        held, labels = after, after.select("v", "label")
        if not changed:
            break
    degree = both.groupBy(F.col("a").alias("class")).agg(F.count("*").alias("links"))
    named = members.join(labels.withColumnRenamed("v", "class"), "class", "left").select("id", "class", F.coalesce("label", "class").alias("label"))
    names = named.groupBy("label").agg(F.min("id").alias("group_id"))
    return named.join(names, "label").join(degree, "class", "left").select("id", "group_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
