"""Windows over ordered groups of any size: a group is cut into ranges of its order, and each range carries on from the one before.

A plain window holds a whole group in one task, so a key with a third of all rows bounds the job. Here rows are
range-partitioned by (key, order); windows then run within (key, part), and what crosses a boundary - the last row, a running sum - comes from
one summary row a part. A part begins inside at most one group, so at most one summary row a partition has anything to carry and the
joined table is no longer than the number of partitions; that bound is what makes it fit to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselle.session import cut

PART = "_part"


def ranged(rows: DataFrame, key: str, order: list[Column], parts: int | None = None) -> DataFrame:
    """The rows with the number of their range in ``_part``; ranges follow (key, order). Written once, so that the numbers hold."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(max(1, n), F.col(key), *order).withColumn(PART, F.spark_partition_id()))


def within(key: str, order: list[Column]):
    """The window of one key inside one range."""
    return Window.partitionBy(key, PART).orderBy(*order)


def carried(rows: DataFrame, key: str, **ends: Column) -> DataFrame:
    """(key, _part, ends...): for each range that goes on with a key, aggregates of the key's range just before it.

    For running sums use ``carried_sum``.
    """
    last = rows.groupBy(key, PART).agg(*(c.alias(n) for n, c in ends.items()))
    w = Window.partitionBy(key).orderBy(PART)
    had = last.select(key, PART, *(F.lag(n).over(w).alias(n) for n in ends), F.row_number().over(w).alias("_k"))
    return F.broadcast(had.where("_k > 1").drop("_k"))


def carried_forward(rows: DataFrame, key: str, **latest: Column) -> DataFrame:
    """As ``carried``, but the latest value that is not null in any earlier range."""
    last = rows.groupBy(key, PART).agg(*(c.alias(n) for n, c in latest.items()))
    w = Window.partitionBy(key).orderBy(PART)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    had = last.select(key, PART, *(F.last(n, ignorenulls=True).over(before).alias(n) for n in latest), F.row_number().over(w).alias("_k"))
    return F.broadcast(had.where("_k > 1").drop("_k"))


def carried_back(rows: DataFrame, key: str, **starts: Column) -> DataFrame:
    """(key, _part, starts...): aggregates of the key's range just after, for each range whose key goes on."""
    first = rows.groupBy(key, PART).agg(*(c.alias(n) for n, c in starts.items()))
    w = Window.partitionBy(key).orderBy(PART)
    had = first.select(key, PART, *(F.lead(n).over(w).alias(n) for n in starts), F.lead(PART).over(w).alias("_n"))
    return F.broadcast(had.where("_n is not null").drop("_n"))


def carried_sum(rows: DataFrame, key: str, **sums: Column) -> DataFrame:
    """(key, _part, sums...): sums over all earlier ranges of the key, for each range that goes on with it."""
    total = rows.groupBy(key, PART).agg(*(c.alias(n) for n, c in sums.items()))
    w = Window.partitionBy(key).orderBy(PART)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    had = total.select(key, PART, *(F.sum(n).over(before).alias(n) for n in sums), F.row_number().over(w).alias("_k"))
    return F.broadcast(had.where("_k > 1").drop("_k"))
