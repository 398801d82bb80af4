"""Full-text, trigram and vector retrieval, and the fusion of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselle.functions import text, vectors


def postings(docs: DataFrame, fields: dict[str, float], key: str = "id") -> DataFrame:
    """(key, term, weight, hits): one row a document and term; a field's weight counts once a field, hits add up."""
    parts = [docs.select(key, F.lit(w).alias("w"), F.explode(text.words(F.col(c))).alias("term")) for c, w in fields.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.groupBy(key, "term").agg(F.sum("w").alias("weight"), F.count("*").alias("hits"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def text_scores(docs: DataFrame, query: list[str], fields: dict[str, float], key: str = "id", every: bool = False) -> DataFrame:
    """(key, score, terms): weighted hits of the query's terms; only documents with all terms if ``every``.

    Counts terms in place instead of building postings: one scan, no shuffle.
    """
    split = docs.select(*[c for c in docs.columns if c not in fields], *[text.words(F.col(c)).alias(f"_{c}") for c in fields])
    hit = lambda c, w: F.coalesce(F.size(F.filter(F.col(f"_{c}"), lambda t: t == w)), F.lit(0))
    per = [sum((hit(c, w) * F.lit(weight) for c, weight in fields.items()), F.lit(0.0)) for w in query]
    has = [(p > 0).cast("int") for p in per]
    out = split.select(*[c for c in split.columns if not c.startswith("_")], sum(per, F.lit(0.0)).alias("score"), sum(has, F.lit(0)).alias("terms"))
    return out.where(F.col("terms") >= (len(query) if every else 1))


def nearest(items: DataFrame, vector: list[float], k: int, key: str, column: str = "embedding") -> DataFrame:
    """(key, similarity) of the k most similar items: a projection of key and cosine, then a distributed top-k."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    sim = F.round(vectors.cosine(F.col(column), q), 9)
    return items.select(key, sim.alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def ranked(scores: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of an order with their rank."""
    return scores.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rrf(first: DataFrame, second: DataFrame, key: str, k: int = 60, first_weight: float = 0.4, second_weight: float = 0.6) -> DataFrame:
    """(key, score) by weighted reciprocal-rank fusion of two rankings (key, rank)."""
    both = first.select(key, (F.lit(first_weight) / (k + F.col("rank"))).alias("s")).union(second.select(key, (F.lit(second_weight) / (k + F.col("rank"))).alias("s")))
    return both.groupBy(key).agg(F.sum("s").alias("score"))


def min_max(rows: DataFrame, column: str, bounded: bool = False) -> DataFrame:
    """The column spread over 0..1; all 1 when it has no span. Rows of a bounded number (a fused ranking) are spread in one
    pass over a window; others by a broadcast row of their extremes."""
    if bounded:
        whole = Window.partitionBy()
        out = rows.withColumns({"lo": F.min(column).over(whole), "hi": F.max(column).over(whole)})
    else:
        out = rows.join(F.broadcast(rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))))
    return out.withColumn(column, F.when(F.col("hi") - F.col("lo") < 1e-9, 1.0).otherwise((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")))).drop("lo", "hi")


def hybrid(docs: DataFrame, items: DataFrame, query: list[str], vector: list[float], key: str, fields: dict[str, float], budget: int = 50, limit: int = 10) -> DataFrame:
    """(key, score): text and vector rankings of one id space, fused and normalised."""
    t = ranked(text_scores(docs, query, fields, key), [F.desc("score"), F.asc(key)], budget)
    v = ranked(nearest(items, vector, budget, key), [F.desc("similarity"), F.asc(key)], budget)
    return min_max(rrf(t, v, key), "score", bounded=True).orderBy(F.desc("score"), key).limit(limit)


def lsh_nearest(items: DataFrame, vector: list[float], k: int, key: str, bits: int = 6, tables: int = 8, seed: int = 7, column: str = "embedding") -> DataFrame:
    """Approximate k nearest: signs of seeded hyperplanes as buckets in several tables, exact cosine on what shares one."""
    import random

    rnd = random.Random(seed)
    dim = len(vector)
    q = [float(x) for x in vector]
    keep = F.lit(False)
    for _ in range(tables):
        same = F.lit(True)
        for _ in range(bits):
            p = [rnd.gauss(0, 1) for _ in range(dim)]
            side = sum(a * b for a, b in zip(p, q)) >= 0
            same = same & ((vectors.dot(F.col(column), F.array(*[F.lit(x) for x in p])) >= 0) == F.lit(side))
        keep = keep | same
    return nearest(items.where(keep), vector, k, key, column)
