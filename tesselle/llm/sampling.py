"""A bounded sample of texts for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_texts(texts: DataFrame, most: int) -> list[str]:
    """At most ``most`` different texts of the one column, those of the smallest hashes: about that many pass a threshold on the
    hash in the scan, repeats are taken out before anything is collected, and the rest are ordered by the hash, so neither a task nor the driver ever holds
    more than a bounded number and a text that makes up a third of all rows counts once."""
    t = texts.toDF("t").where("t is not null and t <> ''").select("t", F.pmod(F.xxhash64("t"), F.lit(1 << 40)).alias("h"))
    n = t.agg(F.approx_count_distinct("h")).first()[0]
    if n > 2 * most:
        t = t.where(F.col("h") < int((1 << 40) * 1.3 * most / n))
    rows = t.groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(most).collect()
    return [r["t"] for r in sorted(rows, key=lambda r: (r["h"], r["t"]))]
