"""Filters, facets, pages, caps, islands and priority passes over result sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselle.operators import ordered
from tesselle.session import cut


def law_filter(laws: DataFrame, language: str | None = None, status: str | None = None, category_ids: list[int] | None = None, types: list[str] | None = None, years: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """All given conditions at once; a null date never passes a bound on the year."""
    if language:
        laws = laws.where(F.col("language") == language)
    if status:
        laws = laws.where(F.col("status") == status)
    if category_ids:
        laws = laws.where(F.col("category_id").isin(category_ids))
    if types:
        laws = laws.where(F.col("type").isin(types))
    # bounds on the date itself, so that they reach the scan
    if years[0] is not None:
        laws = laws.where(F.col("publication_date") >= F.lit(f"{years[0]}-01-01").cast("date"))
    if years[1] is not None:
        laws = laws.where(F.col("publication_date") <= F.lit(f"{years[1]}-12-31").cast("date"))
    return laws


def disjunctive_facet(rows: DataFrame, chosen: dict[str, list], facet: str) -> DataFrame:
    """(value, n) of one facet over the rows that pass the choices of all other facets; nulls are a value."""
    for name, values in chosen.items():
        if name != facet:
            rows = rows.where(F.col(name).isin(values))
    return rows.groupBy(F.col(facet).alias("value")).agg(F.count("*").alias("n"))


def top_per_group(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows a key; the limit is pushed below the shuffle by the window group limit."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def positions(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of an order with their position; only those meet in one task."""
    return rows.orderBy(*order).limit(most).withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page and the total before slicing; the total is one broadcast row, the slice a distributed top-n."""
    total = rows.agg(F.count("*").alias("total"))
    cut = positions(rows, order, offset + limit).where(F.col("pos") > offset)
    return cut.join(F.broadcast(total))


def first_pass(passes: list[DataFrame]) -> DataFrame:
    """The rows of the first pass that has any, with its number from 1."""
    tagged = reduce(DataFrame.unionByName, [p.withColumn("pass", F.lit(k + 1)) for k, p in enumerate(passes)])
    first = tagged.agg(F.min("pass").alias("first"))
    return tagged.join(F.broadcast(first)).where("pass = first").drop("first")


def islands(pieces: DataFrame) -> DataFrame:
    """Runs of consecutive pieces of one kind within a law; a long law is cut into ranges."""
    order = [F.col("order_no").asc(), F.col("id").asc()]
    x = ordered.ranged(pieces, "law_id", order)
    last = ordered.carried(x, "law_id", p=F.max_by(F.struct("order_no", "kind"), F.struct("order_no", "id")))
    w = ordered.within("law_id", order)
    x = x.join(last, ["law_id", ordered.PART], "left").withColumn("p", F.coalesce(F.lag(F.struct("order_no", "kind")).over(w), "p"))
    x = x.withColumn("b", (F.col("p").isNull() | (F.col("order_no") != F.col("p.order_no") + 1) | ~F.col("kind").eqNullSafe(F.col("p.kind"))).cast("int"))
    x = cut(x.drop("p"))
    base = ordered.carried_sum(x, "law_id", b0=F.sum("b"))
    run = F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("run", run).join(base, ["law_id", ordered.PART], "left").withColumn("island", F.col("run") + F.coalesce("b0", F.lit(0)))
    return x.groupBy("law_id", "island").agg(F.min("order_no").alias("first_no"), F.max("order_no").alias("last_no"), F.count("*").alias("pieces"))


def places(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their place in a total order of the whole table, counted by ranges."""
    x = ordered.ranged(rows.withColumn("_all", F.lit(1)), "_all", order)
    base = ordered.carried_sum(x, "_all", before=F.count("*"))
    x = x.withColumn(name, F.row_number().over(ordered.within("_all", order))).join(base, ["_all", ordered.PART], "left")
    return x.withColumn(name, F.col(name) + F.coalesce("before", F.lit(0))).drop("_all", ordered.PART, "before")


def page_ranges(pages: DataFrame, most: int) -> DataFrame:
    """Contiguous page ranges of at most ``most`` pages."""
    p = pages.where("page is not null").distinct()
    p = p.withColumn("k", F.col("page") - F.row_number().over(Window.partitionBy("law_id").orderBy("page")))
    p = p.withColumn("b", F.floor((F.row_number().over(Window.partitionBy("law_id", "k").orderBy("page")) - 1) / most))
    return p.groupBy("law_id", "k", "b").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page")).drop("k", "b")


def interleave(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two ranked lists (key, rank) taken in turn; a key keeps its first place."""
    both = first.select(key, "rank", F.lit(0).alias("side")).union(second.select(key, "rank", F.lit(1)))
    place = both.groupBy(key).agg(F.min(F.struct("rank", "side")).alias("at"))
    return place.withColumn("pos", F.row_number().over(Window.orderBy("at.rank", "at.side"))).select(key, "pos")
