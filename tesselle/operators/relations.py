"""Dated amend and repeal links between texts: designations, superseding, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def superseding(links: DataFrame, ends: list[str]) -> DataFrame:
    """(link_id, by): for every link the latest end of the same text after it, if any.

    links: link_id, text_id, nature, day. One aggregation gives the latest end of each text; a link earlier than it is superseded.
    """
    last = links.where(F.col("nature").isin(ends)).groupBy("text_id").agg(F.max(F.struct("day", "link_id")).alias("e"))
    return links.join(last, "text_id").where(F.col("day") < F.col("e.day")).select("link_id", F.col("e.link_id").alias("by"))


def unfold(designations: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """(key, number): ranges of article numbers as one row a number, for equi-joins."""
    return designations.select(key, F.explode(F.sequence(F.col(first), F.greatest(first, last))).alias("number"))


def status_summary(links: DataFrame, ends: list[str]) -> DataFrame:
    """(text_id, nature, counterparts, latest) without links a later end supersedes."""
    gone = superseding(links, ends).select("link_id")
    live = links.join(gone, "link_id", "left_anti")
    return live.groupBy("text_id", "nature").agg(F.count_distinct("other_id").alias("counterparts"), F.max("day").alias("latest"))
