"""Files to texts: DOCX by its own XML, texts with page marks, and what of a document has been read so far."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHORTEST = 50
MARK = r"<<PAGE:([0-9]+)>>"


def docx_text(raw: bytes) -> str:
    """The paragraphs of a DOCX, a line each; tabs and breaks kept."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{w}p"):
        line = ""
        for e in p.iter():
            line += e.text or "" if e.tag == f"{w}t" else "\t" if e.tag == f"{w}tab" else "\n" if e.tag == f"{w}br" else ""
        out.append(line)
    return "\n".join(out)


def texts(s: SparkSession, folder: str, shortest: int = SHORTEST) -> DataFrame:
    """(path, type, text, error) of the DOCX and text files of a folder; a file that cannot be read, of another type or with hardly any text has an
    error and no text, and stops nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kind = "docx" if raw[:4] == b"PK\x03\x04" else "pdf" if raw[:4] == b"%PDF" else "text"
                text, error = None, None
                try:
                    if kind == "pdf":
                        error = "no reader for pdf"
                    else:
                        text = docx_text(raw) if kind == "docx" else raw.decode("utf-8")
                        if len(text.strip()) <= shortest:
                            text, error = None, "too short"
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}"
                rows.append((path, kind, text, error))
            if rows:
                x = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in x], names=["path", "type", "text", "error"])

    files = s.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInArrow(run, "path string, type string, text string, error string")


def pages(docs: DataFrame, key: str, text: str, first: int = 1) -> DataFrame:
    """(key, page, text): the parts of a text between its <<PAGE:n>> marks; what stands before the first mark is page ``first``."""
    marks, parts = F.regexp_extract_all(text, F.lit(MARK), 1), F.split(text, MARK)
    rows = docs.where(F.col(text).isNotNull()).select(key, marks.alias("m"), F.posexplode(parts).alias("k", "t"))
    page = F.when(F.col("k") == 0, F.lit(first)).otherwise(F.get("m", F.col("k") - 1).cast("int"))
    return rows.select(key, page.alias("page"), F.regexp_replace("t", r"^\s+|\s+$", "").alias("text")).where("text <> ''")


def failed_pages(pages: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """(key, failed): the pages of each document (key, n_pages) that gave no text, in order; they block nothing."""
    every = wanted.select(key, F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page")).where("n_pages > 0")
    missing = every.join(pages.select(key, "page").distinct(), [key, "page"], "left_anti")
    return wanted.select(key).join(missing.groupBy(key).agg(F.array_sort(F.collect_list("page")).alias("failed")), key, "left").select(key, F.coalesce("failed", F.array().cast("array<int>")).alias("failed"))


def inventory(results: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, done, failed, remaining): where a document (key, n_pages) stands, from results (key, page, ok) of all batches so far; a page read once is done, whatever failed before."""
    state = results.groupBy(key, "page").agg(F.max("ok").alias("ok"))
    n = state.groupBy(key).agg(F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"))
    x = wanted.join(n, key, "left").na.fill(0, ["done", "failed"])
    return x.select(key, "done", "failed", (F.col("n_pages") - F.col("done") - F.col("failed")).cast("bigint").alias("remaining"))
