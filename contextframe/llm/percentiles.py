"""Percentiles of very large numeric columns by mergeable q-digests.

A value is quantised to one of ``2 ** LEVELS`` leaves of a dyadic tree. A digest is a set of
tree nodes with counts in which every node but a leaf counts at most ``n / k`` values, and a
node, its sibling and its parent together more than that. Two digests merge by adding the
counts node by node. The rank of a percentile taken from a digest, merged or not, is off by
at most ``LEVELS / k`` of the number of values; that bound holds for every input.

Each task makes digests of its own rows, one row a key with the arrays ``nodes`` and
``counts``. They merge in MERGES steps of at most FAN digests each, so no task holds more of
a key than FAN digests of at most ``3 * k`` nodes, however many rows the key has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Depth of the dyadic tree, and how many times the error bound's share fits a digest: ranks are off by at most LEVELS / K = 0.5 %.
LEVELS, K = 24, 4_800
#: The universe: values are linear below about FINE and logarithmic above, up to LARGEST on either side.
FINE, LARGEST = 1e-6, 1e19
_SPAN = math.asinh(LARGEST / FINE)
PERCENTILES = (0.5, 0.9, 0.95, 0.99)

#: Digests that one step of merging adds up, and steps: enough for FAN ** MERGES tasks.
FAN, MERGES = 64, 3
#: Nodes that a task holds before it compresses, and hands on what that leaves.
HELD = 2_000_000
DIGEST = "part bigint, nodes array<bigint>, counts array<bigint>"


def leaf(value: Column) -> Column:
    """The leaf of a value; null and NaN have none, values beyond the universe go to its ends."""
    value = value.cast("double")
    place = F.floor((F.asinh(value / F.lit(FINE)) / F.lit(_SPAN) + 1) * F.lit(float(2 ** (LEVELS - 1))))
    return F.when(value.isNull() | F.isnan(value), None).otherwise(F.greatest(F.lit(0), F.least(F.lit(2**LEVELS - 1), F.when(value > LARGEST, 2**LEVELS - 1).when(value < -LARGEST, 0).otherwise(place)))).cast("bigint")


def value_of(leaves: np.ndarray) -> np.ndarray:
    """The value at the middle of each leaf. Zero stands for the leaf it lies in."""
    value = np.sinh(((leaves + 0.5) / 2 ** (LEVELS - 1) - 1) * _SPAN) * FINE
    return np.where(leaves == 2 ** (LEVELS - 1), 0.0, value)


def compress(nodes: np.ndarray, counts: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The digest of node counts: from the leaves up, light families move into their parent.

    A node is numbered as in a heap: the root 1, the children of v 2v and 2v + 1.
    """
    nodes, where = np.unique(nodes, return_inverse=True)
    counts = np.bincount(where, counts).astype(np.int64) if len(where) else np.empty(0, np.int64)
    light = int(counts.sum()) // k
    if light == 0:
        return nodes, counts
    kept_nodes, kept_counts = [], []
    level = np.floor(np.log2(nodes)).astype(np.int64)
    here_nodes, here_counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for depth in range(LEVELS, 0, -1):
        own = level == depth
        here = np.concatenate([here_nodes, nodes[own]])
        here, where = np.unique(here, return_inverse=True)
        amount = np.bincount(where, np.concatenate([here_counts, counts[own]]), len(here)).astype(np.int64) if len(here) else np.empty(0, np.int64)
        parents, family = np.unique(here >> 1, return_inverse=True)
        together = np.bincount(family, amount, len(parents)).astype(np.int64) if len(here) else np.empty(0, np.int64)
        above = level == depth - 1
        if above.any() and len(parents):
            at = np.searchsorted(nodes[above], parents)
            at_safe = np.minimum(at, above.sum() - 1)
            together = together + np.where(nodes[above][at_safe] == parents, counts[above][at_safe], 0)
        moves = (together <= light)[family] if len(here) else np.empty(0, bool)
        kept_nodes.append(here[~moves])
        kept_counts.append(amount[~moves])
        up, where = np.unique(here[moves] >> 1, return_inverse=True)
        here_nodes = up
        here_counts = np.bincount(where, amount[moves], len(up)).astype(np.int64) if len(up) else np.empty(0, np.int64)
    root = level == 0
    rest = int(here_counts.sum() + counts[root].sum())
    if rest:
        kept_nodes.append(np.array([1], np.int64))
        kept_counts.append(np.array([rest], np.int64))
    return np.concatenate(kept_nodes), np.concatenate(kept_counts)


def quantile(nodes: np.ndarray, counts: np.ndarray, q: float) -> float:
    """The value at share ``q`` of a digest: nodes in the order of their right ends, small ones first."""
    level = np.floor(np.log2(nodes)).astype(np.int64)
    last = ((nodes + 1) << (LEVELS - level)) - 1 - 2**LEVELS
    order = np.lexsort((-level, last))
    reached = np.cumsum(counts[order])
    at = int(np.searchsorted(reached, max(1, math.ceil(q * int(reached[-1])))))
    return float(value_of(last[order][at : at + 1])[0])


class _Held:
    """The digests of a task's rows by key, within bounded memory."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.parts: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, keys: list[tuple], codes: np.ndarray, nodes: np.ndarray) -> None:
        """Rows with the number of their key and their leaf."""
        if not len(nodes):
            return
        both, counts = np.unique(codes.astype(np.int64) << (LEVELS + 1) | nodes, return_counts=True)
        own = both >> (LEVELS + 1)
        begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        nodes = both & ((1 << (LEVELS + 1)) - 1)
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(both)], strict=True):
            self.parts.setdefault(keys[own[begin]], []).append((nodes[begin:end], counts[begin:end].astype(np.int64)))
        self.size += len(both)

    def shrink(self) -> None:
        self.size = 0
        for key, parts in self.parts.items():
            made = compress(np.concatenate([n for n, _ in parts]), np.concatenate([c for _, c in parts]), self.k)
            self.parts[key] = [made]
            self.size += len(made[0])

    def rows(self, names: list[str]) -> pd.DataFrame:
        """All digests, which are then held no longer."""
        self.shrink()
        part = TaskContext.get().partitionId()
        rows = [(*key, part, nodes, counts) for key, ((nodes, counts),) in self.parts.items()]
        self.parts, self.size = {}, 0
        return pd.DataFrame(rows, columns=[*names, "part", "nodes", "counts"], dtype=object).astype({"part": "int64"})

    def full(self) -> bool:
        if self.size > HELD:
            self.shrink()
        return self.size > HELD // 2


def _none(value: object) -> object:
    return None if value is None or isinstance(value, float) and math.isnan(value) else value


def digests(df: DataFrame, keys: list[str], value: Column, k: int = K) -> DataFrame:
    """(keys, nodes, counts): the digest of ``value`` for each key.

    Null and NaN count nowhere; rows with a null key are a group of their own.
    """
    leaves = df.select(*keys, (leaf(value) + 2**LEVELS).alias("node")).where("node IS NOT NULL")
    schema = ", ".join([*(f"`{key}` {leaves.schema[key].dataType.simpleString()}" for key in keys), DIGEST])

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Held(k)
        for batch in batches:
            groups = batch.groupby(keys, dropna=False, sort=False)
            codes = groups.ngroup().to_numpy()
            first = np.unique(codes, return_index=True)[1]
            held.add([tuple(map(_none, row)) for row in batch[keys].iloc[first].itertuples(index=False)], codes, batch["node"].to_numpy())
            if held.full():
                yield held.rows(keys)
        yield held.rows(keys)

    return _merge(leaves.mapInPandas(local, schema), keys, k)


def merged(parts: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Digests of parts, days or files made into the digest of their union, key by key."""
    return _merge(parts.select(*keys, F.pmod(F.xxhash64("nodes", "counts"), F.lit(FAN**MERGES)).alias("part"), "nodes", "counts"), keys, k)


def _merge(parts: DataFrame, keys: list[str], k: int) -> DataFrame:
    schema = parts.select(*keys, "part", "nodes", "counts").schema

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def row() -> tuple:
            return (*last, *(held[0] if len(held) == 1 else compress(np.concatenate([n for n, _ in held]), np.concatenate([c for _, c in held]), k)))

        for batch in batches:
            rows = []
            for *key, nodes, counts in batch.itertuples(index=False, name=None):
                own = tuple(map(_none, key))
                if own != last:
                    if held:
                        rows.append(row())
                    last, held = own, []
                held.append((nodes, counts))
            if rows:
                yield pd.DataFrame(rows, columns=schema.names)
        if held:
            yield pd.DataFrame([row()], columns=schema.names)

    for step in range(MERGES):
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN) if step < MERGES - 1 else F.lit(0).cast("bigint"))
        parts = parts.repartition(*keys, "part").sortWithinPartitions(*keys, "part").mapInPandas(add, schema)
    return parts.drop("part")


def percentiles(digest: DataFrame, keys: list[str], shares: tuple[float, ...] = PERCENTILES, k: int = K) -> DataFrame:
    """(keys, n, p50, ..., rank_error): the percentiles of each digest and how many ranks they can be off; 0.999 is p99_9."""
    names = [f"p{q * 100:g}".replace(".", "_") for q in shares]

    @F.pandas_udf("struct<" + ",".join(["n:bigint", *(f"{name}:double" for name in names), "rank_error:bigint"]) + ">")
    def read(nodes: pd.Series, counts: pd.Series) -> pd.DataFrame:
        rows = []
        for node, count in zip(nodes, counts, strict=True):
            n = int(count.sum())
            rows.append([n, *(quantile(node, count, q) for q in shares), LEVELS * (n // k)])
        return pd.DataFrame(rows, columns=["n", *names, "rank_error"])

    return digest.select(*keys, read("nodes", "counts").alias("_p")).select(*keys, "_p.*")


KEYS = ["grouping", "member", "measure"]
GROUPINGS, MEASURES = ("tool", "category", "day"), ("savings_ratio", "saved_tokens")


def once(events: DataFrame) -> DataFrame:
    """(tool, category, day, savings_ratio, saved_tokens) of each event, a resent event only once.

    Resent events are whole rows with the same id, so one of them is kept: where copies
    differ, the one of the least values. A null tool or category is a group of its own, with
    a null member; an event without a time belongs to no day but to its tool and category.
    """
    fields = F.struct("tool", "category", F.to_date("created_at").alias("day"), "savings_ratio", "saved_tokens")
    known = events.where("id IS NOT NULL").groupBy("id").agg(F.min(fields).alias("e")).select("e.*")
    return known.unionByName(events.where("id IS NULL").select(F.expr("1").alias("_"), fields.alias("e")).select("e.*"))


def event_digests(events: DataFrame, k: int = K) -> DataFrame:
    """(grouping, member, measure, nodes, counts): digests of savings_ratio and saved_tokens by tool, category and day of token events."""
    leaves = once(events).select("tool", "category", F.col("day").cast("string").alias("day"), *[(leaf(F.col(name)) + 2**LEVELS).alias(name) for name in MEASURES])

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Held(k)
        for batch in batches:
            for grouping in GROUPINGS:
                codes, members = pd.factorize(batch[grouping], use_na_sentinel=False)
                members = [_none(member) for member in members]
                for measure in MEASURES:
                    here = batch[measure].notna().to_numpy()
                    if grouping == "day":
                        here &= batch[grouping].notna().to_numpy()
                    held.add([(grouping, member, measure) for member in members], codes[here], batch[measure].to_numpy()[here].astype(np.int64))
            if held.full():
                yield held.rows(KEYS)
        yield held.rows(KEYS)

    return _merge(leaves.mapInPandas(local, "grouping string, member string, measure string, " + DIGEST), KEYS, k)


def rank_checks(events: DataFrame, shares: tuple[float, ...] = PERCENTILES, k: int = K) -> DataFrame:
    """(grouping, member, measure, n, right): the values that each digest should stand for, and whether all its percentiles' true ranks are within its bound.

    A percentile comes as the middle of a leaf; its rank is anywhere among the values of that leaf.
    """
    names = [f"p{q * 100:g}".replace(".", "_") for q in shares]
    found = percentiles(event_digests(events, k), KEYS, shares, k)
    rows = once(events)
    groups = F.array(*[F.struct(F.lit(name).alias("grouping"), F.col(name).cast("string").alias("member")) for name in GROUPINGS])
    measures = F.array(*[F.struct(F.lit(name).alias("measure"), leaf(F.col(name)).alias("leaf")) for name in MEASURES])
    exact = (
        rows.select(groups.alias("_g"), F.explode(measures).alias("_m"))
        .where("_m.leaf IS NOT NULL")
        .select(F.explode("_g").alias("_g"), "_m")
        .select("_g.grouping", "_g.member", "_m.measure", "_m.leaf")
        .where("NOT (grouping = 'day' AND member IS NULL)")
    )
    counts = exact.groupBy(*KEYS, "leaf").agg(F.count("*").alias("c"))
    same = [counts[key].eqNullSafe(found[key]) for key in KEYS]
    joined = counts.join(found, same[0] & same[1] & same[2])
    under = [F.sum(F.when(F.col("leaf") < leaf(F.col(name)), F.col("c")).otherwise(0)).alias(f"_u_{name}") for name in names]
    upto = [F.sum(F.when(F.col("leaf") <= leaf(F.col(name)), F.col("c")).otherwise(0)).alias(f"_o_{name}") for name in names]
    summed = joined.groupBy(*[counts[key] for key in KEYS]).agg(F.sum("c").alias("n"), F.max(found["n"]).alias("_n"), F.max("rank_error").alias("_e"), *under, *upto)
    within = F.col("n") == F.col("_n")
    for q, name in zip(shares, names, strict=True):
        rank = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n")))
        within &= (F.col(f"_u_{name}") + 1 - F.col("_e") <= rank) & (rank <= F.col(f"_o_{name}") + F.col("_e"))
    return summed.select(*KEYS, "n", within.alias("right"))
