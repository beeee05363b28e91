"""Running values within a key whose rows may be a third of the table.

A plain window sorts all rows of a key in one task. Here the rows of a key are cut into
buckets of their order (a day, a thousand ids); each bucket is summed up first, the sums
run over the buckets, and rows only run within their own bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextframe.sources.tables import cut_lineage


def _before(per: DataFrame, key: str, column: Column) -> Column:
    return column.over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))


def running_sums(rows: DataFrame, key: str, bucket: Column, order: list[str], values: dict[str, Column]) -> DataFrame:
    """``rows`` with the sum of each value up to and with the row, by key, in order; ``bucket`` must not fall along the order."""
    marked = rows.select("*", bucket.alias("_bucket"), *[F.coalesce(value, F.lit(0)).cast("bigint").alias(f"_v_{name}") for name, value in values.items()])
    per = marked.groupBy(key, "_bucket").agg(*[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in values])
    offsets = per.select(key, "_bucket", *[F.coalesce(_before(per, key, F.sum(f"_s_{name}")), F.lit(0)).alias(f"_o_{name}") for name in values])
    here = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = marked.join(offsets, [key, "_bucket"])
    return joined.select(*rows.columns, *[(F.sum(f"_v_{name}").over(here) + F.col(f"_o_{name}")).alias(name) for name in values])


def carried(rows: DataFrame, key: str, bucket: Column, order: list[str], value: Column, name: str, *, before: bool = False) -> DataFrame:
    """``rows`` with the last value that is not null up to and with the row, or only before it, by key, in order."""
    marked = rows.select("*", bucket.alias("_bucket"), value.alias("_v"))
    per = marked.groupBy(key, "_bucket").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_last"))
    offsets = per.select(key, "_bucket", _before(per, key, F.last("_last", True)).alias("_carried"))
    here = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return marked.join(offsets, [key, "_bucket"]).select(*rows.columns, F.coalesce(F.last("_v", True).over(here), "_carried").alias(name))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` numbered from 1 in order, without a window over all of them: sorted in ranges, then numbered range by range."""
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "_range").select(*rows.columns, (place + F.col("_o")).alias(name))
