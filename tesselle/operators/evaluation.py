"""Retrieval metrics over rankings (question, item, rank) and gold (question, item)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.operators import ordered
from tesselle.session import cut


def gold_ranks(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """(question, rank): the best rank of a gold item, null if absent; every gold question has a row."""
    hit = gold.join(rankings, ["question", "item"], "left")
    return hit.groupBy("question").agg(F.min("rank").alias("rank"))


def recall_at(ranks: DataFrame, ks: list[int]) -> DataFrame:
    """(k, recall); 0 without questions."""
    row = ranks.agg(*[F.coalesce(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), F.lit(0.0)).alias(str(k)) for k in ks])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("recall")) for k in ks])).alias("x")).select("x.*")


def mrr(ranks: DataFrame, cutoff: int) -> DataFrame:
    return ranks.agg(F.coalesce(F.avg(F.when(F.col("rank") <= cutoff, 1.0 / F.col("rank")).otherwise(0.0)), F.lit(0.0)).alias("mrr"), F.count("*").alias("questions"))


def bootstrap(values: DataFrame, column: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """(mean, low, high): 95 % interval of the mean, from ``resamples`` Poisson resamples.

    Every row enters every resample a Poisson(1) number of times; equal values draw together, a Poisson of their number, from a generator
    seeded by the value. One pass gives each partition's sums and sizes of all resamples, so only ``resamples`` rows a partition are
    merged and no value is dropped. Nulls and NaN take no part, no value gives zeros.
    """
    counts = values.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))

    def draw(batches):
        import pyarrow as pa

        total, size, whole = np.zeros(resamples), np.zeros(resamples), np.zeros(2)
        for b in batches:
            for v, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.random.default_rng([seed, int(np.float64(v).view(np.uint64))])
                times = own.poisson(n, resamples)
                total += times * v
                size += times
                whole += (v * n, n)
        if whole[1]:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, resamples), pa.int32()), pa.array([whole[0], *total]), pa.array([whole[1], *size])], names=["k", "total", "size"])

    sums = counts.mapInArrow(draw, "k int, total double, size double").groupBy("k").agg(F.sum("total").alias("t"), F.sum("size").alias("n")).where("n > 0")
    means = sums.select("k", (F.col("t") / F.col("n")).alias("m"))
    got = means.agg(F.max(F.when(F.col("k") < 0, F.col("m"))).alias("mean"), F.expr("percentile(case when k >= 0 then m end, 0.025)").alias("low"), F.expr("percentile(case when k >= 0 then m end, 0.975)").alias("high"))
    return got.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "low", "high")])


def values_at(rows: DataFrame, group: str, value: str, ranks: dict[str, str]) -> DataFrame:
    """(group, name...): the values at given places (from 0, expressions over the group's number of rows n) of each group's sorted values.

    Equal values are counted before anything is shuffled, and the counts are added up by ranges of the values, so a group with a third of
    all rows is neither sorted nor buffered in one task. Nulls take no part; a null group is one."""
    c = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    order = [F.col(value).asc()]
    x = ordered.ranged(c, group, order)
    base = ordered.carried_sum(x, group, before=F.sum("k"))
    upto = F.sum("k").over(ordered.within(group, order))
    x = x.withColumn("upto", upto).join(base, [group, ordered.PART], "left").withColumn("upto", F.col("upto") + F.coalesce("before", F.lit(0)))
    x = cut(x.select(group, value, "k", "upto"))
    n = x.groupBy(group).agg(F.max("upto").alias("n"))
    at = x.join(F.broadcast(n) if n.limit(100_001).count() <= 100_000 else n, group)
    return at.groupBy(group).agg(*(F.max(F.when(F.expr(f"{e} >= upto - k and {e} < upto"), F.col(value))).alias(name) for name, e in ranks.items()))
