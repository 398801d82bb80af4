"""The corpus tables as the operators read them: exact repeats of a row count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselle.session import table


def once(df: DataFrame) -> DataFrame:
    """Exact repeats of a row out. Grouping by all selected columns, not keeping the first of an id, lets filters on any
    column pass below it to the scan; only the columns a plan needs are shuffled."""
    return df.distinct()


def laws(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return once(table(s, d, "laws").select("id", *columns))


def articles(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return once(table(s, d, "articles").select("id", *columns))


def messages(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return once(table(s, d, "messages").select("id", *columns))


def conversations(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return once(table(s, d, "conversations").select("id", *columns))


def vectors(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "articles_vecteurs").select("article_id", "law_id", "embedding"))


def json_lines(s: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSONL journal; a truncated last line becomes nulls instead of failing."""
    return s.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def latest_verdicts(journal: DataFrame, key: str = "id", order: str = "line") -> DataFrame:
    """The last row a key."""
    return journal.groupBy(key).agg(F.max_by(F.struct(*journal.columns), order).alias("r")).select("r.*")


def json_index(s: SparkSession, path: str) -> DataFrame:
    """A JSON array of documents."""
    return s.read.option("multiLine", True).schema("doc_id string, path string, title string, sha256 string, reference string").json(path)


def binary_files(s: SparkSession, folder: str) -> DataFrame:
    """(path, type, sha256, length) of every file; the type by its first bytes."""
    b = s.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    head = F.hex(F.substring("content", 1, 4))
    kind = F.when(head == "25504446", "pdf").when(head == "504B0304", "docx").when(head == "D0CF11E0", "doc").otherwise("other")
    return b.select("path", kind.alias("type"), F.sha2("content", 256).alias("sha256"), "length")


def vector_batches(s: SparkSession, folder: str, dim: int, tolerance: float = 1e-3) -> DataFrame:
    """(id, vector, reason) from .npz batches with ids and vectors; reason is null for rows to load."""
    import io

    import numpy as np
    import pyarrow as pa

    def read(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                with np.load(io.BytesIO(raw)) as z:
                    ids, v = z["ids"].astype(np.int64), z["vectors"].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(v), pa.list_(pa.float32()))], names=["id", "vector"])

    rows = s.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder).select("content").mapInArrow(read, "id bigint, vector array<float>")
    n = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    seen = rows.groupBy("id").agg(F.count("*").alias("times"))
    why = F.when(F.size("vector") != dim, "dimension").when(F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not finite").when(F.abs(n - 1) > tolerance, "norm").when(F.col("times") > 1, "seen twice")
    return rows.join(seen, "id").select("id", "vector", why.alias("reason"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_events(df: DataFrame, path: str) -> None:
    """Appends search events, the query cut to 500 characters."""
    df.withColumn("query", F.substring("query", 1, 500)).write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Replaces exactly the partitions the rows touch."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
