"""Documents to rows: paragraphs, articles, table cells, kinds, citations, embedding text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How an article heading is written.
HEADING = r"(?im)^[ \t]*(?:article|art[ií]culo|artikel)[ ]+(\S{1,10}?)[ ]*(?:[.:][ ]*-?|-)[ ]*"


def paragraphs(docs: DataFrame, key: str, text: str, shortest: int = 30) -> DataFrame:
    """(key, order_no, content) of the parts between blank lines, numbered from 1 before short ones are dropped."""
    parts = docs.select(key, F.posexplode(F.split(text, r"\n[ \t]*\n")).alias("k", "content"))
    return parts.select(key, (F.col("k") + 1).alias("order_no"), F.trim("content").alias("content")).where(F.length("content") >= shortest)


def chunk_articles(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, order_no, number, kind, content): what stands before the first heading as preamble, then one row an article;
    paragraphs where a text has no heading. No character of the text is lost but the headings."""
    heading = re.compile(HEADING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                marks = list(heading.finditer(t))
                if not marks:
                    rows += [(k, i + 1, f"PARA_{i + 1}", "paragraph", p.strip()) for i, p in enumerate(re.split(r"\n\s*\n", t)) if p.strip()]
                    continue
                if (head := t[: marks[0].start()].strip()):
                    rows.append((k, 0, "PREAMBULE", "preamble", head))
                ends = [m.start() for m in marks[1:]] + [len(t)]
                rows += [(k, i + 1, m[1].upper(), "article", t[m.end() : e].strip()) for i, (m, e) in enumerate(zip(marks, ends))]
            if rows:
                x = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int32()), *(pa.array(c, pa.string()) for c in x[2:])], names=["key", "order_no", "number", "kind", "content"])

    return docs.select(F.col(key).cast("bigint").alias("key"), text).mapInArrow(run, "key bigint, order_no int, number string, kind string, content string").withColumnRenamed("key", key)


def table_cells(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row_no, cell_no, cell) of tables written with HTML rows or with bars; rule lines are no rows."""
    html = docs.where(F.lower(text).contains("<tr")).select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("row_no", "r"))
    html = html.select(key, "row_no", F.posexplode(F.regexp_extract_all("r", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1)).alias("cell_no", "cell"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.startswith(F.trim(x), F.lit("|")) & ~x.rlike(r"^[|: -]+$"))
    bars = docs.where(F.col(text).contains("|") & ~F.lower(text).contains("<tr")).select(key, F.posexplode(lines).alias("row_no", "r"))
    bars = bars.select(key, "row_no", F.posexplode(F.split(F.regexp_replace(F.trim("r"), r"^\||\|$", ""), r"\|")).alias("cell_no", "cell"))
    return html.union(bars).select(key, "row_no", "cell_no", F.trim("cell").alias("cell"))


def roster_share(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lines, persons): lines with a registration number among non-blank ones."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return docs.select(key, F.size(lines).alias("lines"), F.size(F.filter(lines, lambda x: x.rlike(r"matricule [0-9]+"))).alias("persons"))


def citations(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, times): articles and sections a text refers to."""
    found = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(?:l'article|section|artículo|artikels) ([0-9]+)"), 1))
    return docs.select(key, found.alias("number")).groupBy(key, "number").agg(F.count("*").alias("times"))


def embed_text(number: Column, title: Column, content: Column, most: int = 500) -> Column:
    """Header and flattened body."""
    body = F.substring(F.regexp_replace(content, r"[ \n\t]+", " "), 1, most)
    return F.concat_ws(" | ", F.nullif(number, F.lit("")), F.nullif(title, F.lit("")), body)


def mentions(docs: DataFrame, key: str, text: str, widest: int = 30) -> DataFrame:
    """(key, number) of the article numbers a text mentions, ranges like "34 à 36" unfolded up to ``widest``."""
    pairs = F.explode(F.regexp_extract_all(text, F.lit(r"(?i)articles? ([0-9]+(?: (?:à|to) [0-9]+)?)"), 1))
    x = docs.select(key, pairs.alias("m"))
    lo = F.regexp_extract("m", r"^([0-9]+)", 1).cast("int")
    hi = F.coalesce(F.nullif(F.regexp_extract("m", r"([0-9]+)$", 1), F.lit("")).cast("int"), lo)
    return x.select(key, F.explode(F.sequence(lo, F.greatest(lo, F.least(hi, lo + widest)))).alias("number")).distinct()
