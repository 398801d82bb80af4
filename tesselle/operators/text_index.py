"""A persisted inverted index of laws, articles and documents: one row a (kind, id, term) with its weight, in buckets of the term.

A query reads the buckets of its own terms only (partition pruning, and the terms pushed down to the sorted files), so its cost follows the
postings of its terms and not the corpus. The index is written once to the shared folder for a state of the tables (their files'
sizes and times) and found again within the session.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselle.functions import text
from tesselle.session import bounded, shared_dir, table
from tesselle.sources import tables as T

BUCKETS = 32
# Weights of the fields - title, number and own title, body.
WEIGHTS = {"A": 1.0, "B": 0.2, "D": 0.05}
_BUILT: dict[tuple, str] = {}


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def bucket_of(term: str) -> int:
    """The same for a term the driver holds: the hash is that of the SQL function, with its seed."""
    h = xxhash.xxh64_intdigest(term.encode(), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % BUCKETS


def _field(rows: DataFrame, column: str, weight: str) -> DataFrame:
    return rows.select("kind", "id", "law_id", F.explode(text.words(F.col(column))).alias("term"), F.lit(weight).alias("field"))


def postings(laws: DataFrame, articles: DataFrame, documents: DataFrame) -> DataFrame:
    """(kind, id, law_id, term, weight, hits, in_title). kind is l, a or d; a law's title counts for its articles as well.

    A law's title is exploded once and its terms joined with its articles, so a long law costs its articles times its few title words.
    Null fields have no terms; repeated rows count once.
    """
    a = articles.select(F.lit("a").alias("kind"), F.col("id").cast("bigint").alias("id"), F.col("law_id").cast("bigint").alias("law_id"), "number", "title", "content")
    x = laws.select(F.lit("l").alias("kind"), F.col("id").cast("bigint").alias("id"), F.col("id").cast("bigint").alias("law_id"), "title", "content")
    d = documents.select(F.lit("d").alias("kind"), F.col("doc_id").cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("law_id"), "text")
    titles = _field(x, "title", "A")
    rows = titles.union(_field(x, "content", "D")).union(_field(a, "number", "B")).union(_field(a, "title", "B")).union(_field(a, "content", "D")).union(_field(d, "text", "D"))
    rows = rows.union(a.select("kind", "id", "law_id").join(titles.select("law_id", "term", "field"), "law_id").select("kind", "id", "law_id", "term", "field"))
    weight = F.when(F.col("field") == "A", WEIGHTS["A"]).when(F.col("field") == "B", WEIGHTS["B"]).otherwise(WEIGHTS["D"])
    return rows.groupBy("kind", "id", "law_id", "term").agg(F.sum(weight).alias("weight"), F.count("*").alias("hits"), F.max(F.col("field") == "A").alias("in_title"))


def state(s: SparkSession, d: str) -> tuple:
    """What changes with the files of the tables: their number, size and time; a few calls to the file system, no scan."""
    out = []
    for t in ("laws", "articles", "documents"):
        at = s._jvm.org.apache.hadoop.fs.Path(f"{d}/{t}.parquet")
        fs = at.getFileSystem(s._jsc.hadoopConfiguration())
        size = fs.getContentSummary(at)
        out.append((size.getFileCount(), size.getLength(), fs.getFileStatus(at).getModificationTime()))
    return tuple(out)


def write(post: DataFrame, path: str) -> None:
    post.withColumn("bucket", bucket(F.col("term"))).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def index(s: SparkSession, d: str) -> DataFrame:
    """The index of the tables in a folder, built where this session has none of their present state."""
    key = (s.sparkContext.applicationId, d, state(s, d))
    if key not in _BUILT:
        path = f"{shared_dir(s)}/index-{abs(hash(key))}"
        write(postings(T.laws(s, d, "title", "content"), T.articles(s, d, "law_id", "number", "title", "content"), table(s, d, "documents").select("doc_id", "text")), path)
        _BUILT[key] = path
    return s.read.parquet(_BUILT[key])


def of_terms(ix: DataFrame, kind: str, terms: list[str]) -> DataFrame:
    """The postings of the terms; only their buckets are read."""
    buckets = sorted({bucket_of(t) for t in terms})
    return ix.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms) & (F.col("kind") == kind))


def matches(ix: DataFrame, kind: str, terms: list[str], every: bool = True) -> DataFrame:
    """(id, law_id, score, hits, terms, title_match) of what holds all terms, or any."""
    g = of_terms(ix, kind, terms).groupBy("id", "law_id").agg(F.round(F.sum("weight"), 6).alias("score"), F.sum("hits").alias("hits"), F.count("*").alias("terms"), F.max("in_title").alias("title_match"))
    return g.where(F.col("terms") >= (len(set(terms)) if every else 1))


def frequencies(ix: DataFrame, kind: str, terms: list[str]) -> dict[str, int]:
    """In how many documents each term stands."""
    return {r["term"]: r["n"] for r in of_terms(ix, kind, terms).groupBy("term").agg(F.count("*").alias("n")).collect()}


def rarer_queries(df: dict[str, int], terms: list[str]) -> list[list[str]]:
    """The query without absent terms, then without its commonest ones, one by one."""
    known = sorted({t for t in terms if df.get(t)}, key=lambda t: (-df[t], t))
    return [known[k:] for k in range(0 if len(known) < len(set(terms)) else 1, len(known))]


def any_terms(c: Column) -> Column:
    """A query of bare words as an OR of those longer than one letter; one with quotes, a minus or OR stays as it is."""
    t = F.trim(c)
    w = F.filter(F.split(t, r"[ \t\n]+"), lambda x: F.length(x) > 1)
    return F.when(t.rlike('["-]') | F.upper(t).contains(" OR ") | (F.size(w) < 2), t).otherwise(F.array_join(w, " OR "))


def cap_per_law(hits: DataFrame, most: int = 3) -> DataFrame:
    """The best ``most`` hits of each law with law_rank, in the order score, then text order, then id."""
    w = Window.partitionBy("law_id").orderBy(F.desc("score"), F.asc_nulls_last("order_no"), "id")
    return hits.withColumn("law_rank", F.row_number().over(w)).where(F.col("law_rank") <= most)


def cascade(ix: DataFrame, kind: str, terms: list[str], limit: int, fallback=None) -> DataFrame:
    """(id, law_id, score, tier): all terms (1); else all of the rarer ones (2), filled up with any term (3); else ``fallback()`` (4).

    Whether a tier has rows is asked of the index, so at most one row a tier reaches the driver."""
    full = matches(ix, kind, terms)
    if not full.isEmpty():
        out = full.select("id", "law_id", "score", F.lit(1).alias("tier"))
    else:
        got = None
        for few in rarer_queries(frequencies(ix, kind, terms), terms):
            m = matches(ix, kind, few)
            if not m.isEmpty():
                got = m.select("id", "law_id", "score", F.lit(2).alias("tier"))
                break
        loose = matches(ix, kind, terms, every=False).select("id", "law_id", "score", F.lit(3).alias("tier"))
        out = loose if got is None else got.union(loose.join(got.select("id"), "id", "left_anti").select("id", "law_id", "score", "tier"))
        if fallback is not None and got is None and loose.isEmpty():
            out = fallback().select("id", "law_id", "score", F.lit(4).alias("tier"))
    return out.orderBy("tier", F.desc("score"), "law_id", "id").limit(limit)


def chosen(ids: DataFrame, most: int = 10_000) -> list[int]:
    """The ids of a bounded result, for a filter that reaches the scan; more than ``most`` is refused."""
    return [r[0] for r in bounded(ids, most, "result")]
