"""Sinks that change a table in place: upsert with expiry, purge, replace, copy of changes, verified vectors; each writes a new state beside the old and
swaps the two, so a reader never sees half of it and a failed job leaves the old state."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fs(s: SparkSession, path: str):
    at = s._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(s._jsc.hadoopConfiguration()), at


def exists(s: SparkSession, path: str) -> bool:
    fs, at = _fs(s, path)
    return fs.exists(at)


def swap(df: DataFrame, path: str) -> None:
    """Writes the rows beside the table and puts them in its place."""
    s, new = df.sparkSession, f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(new)
    fs, at = _fs(s, path)
    if fs.exists(at):
        fs.delete(at, True)
    fs.rename(_fs(s, new)[1], at)
    s.catalog.clearCache()


def upsert(rows: DataFrame, path: str, keys: list[str], order: Column) -> None:
    """Inserts rows or puts them in the place of those with their keys; of several new rows of a key the last by ``order`` stays."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    if exists(rows.sparkSession, path):
        old = rows.sparkSession.read.parquet(path)
        new = old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new)
    swap(new, path)


def upsert_with_expiry(rows: DataFrame, path: str, now: Column, seconds: int) -> None:
    """(key, payload) into a cache with created_at and expires_at."""
    stamped = rows.select("key", "payload", now.alias("created_at"), (now + F.make_dt_interval(secs=F.lit(seconds))).alias("expires_at"))
    upsert(stamped, path, ["key"], F.desc("payload"))


def alive(s: SparkSession, path: str, now: Column) -> DataFrame:
    return s.read.parquet(path).where(F.col("expires_at") > now)


def purge(s: SparkSession, paths: list[str], now: Column) -> int:
    """Deletes what has expired from every table and says how many rows that were."""
    gone = 0
    for path in paths:
        t = s.read.parquet(path)
        n = t.where(F.col("expires_at") <= now).count()
        if n:
            swap(t.where((F.col("expires_at") > now) | F.col("expires_at").isNull()), path)
        gone += n
    return gone


def replace_for(rows: DataFrame, path: str, key: str) -> None:
    """Replaces all rows of the keys that the new rows have; other keys stay."""
    s = rows.sparkSession
    if exists(s, path):
        old = s.read.parquet(path)
        rows = old.join(rows.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(rows)
    swap(rows, path)


def sync(source: DataFrame, path: str, key: str, columns: list[str]) -> dict[str, int]:
    """Makes the copy equal to its source: counts of rows inserted, changed (compared null-safe) and removed as orphans."""
    s = source.sparkSession
    src = source.select(key, *columns).dropDuplicates([key])
    if not exists(s, path):
        swap(src, path)
        return {"inserted": src.count(), "changed": 0, "removed": 0}
    old = s.read.parquet(path).select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_old"))
    both = src.withColumn("_new", F.lit(True)).join(old, key, "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    n = both.agg(F.count_if(F.col("_old").isNull()).alias("inserted"), F.count_if(F.col("_old").isNotNull() & F.col("_new").isNotNull() & ~same).alias("changed"), F.count_if(F.col("_new").isNull()).alias("removed")).first().asDict()
    if any(n.values()):
        swap(src, path)
    return n


def load_vectors(batch: DataFrame, articles: DataFrame, path: str, dim: int, model: str, tolerance: float = 1e-3) -> dict[str, int]:
    """Writes the vectors of a batch (id, vector, text_hash) whose article still has the text they were made of; counts by reason of the others.

    articles: id, embed, content. A vector must have the size, finite components and unit length; an id twice in the batch is refused."""
    seen = batch.groupBy("id").agg(F.count("*").alias("_n"))
    a = articles.select("id", F.col("embed").alias("_embed"), F.sha2("content", 256).alias("_hash")).dropDuplicates(["id"])
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    why = (
        F.when(F.col("_n") > 1, "seen twice").when(F.size("vector") != dim, "dimension").when(F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite").when(F.abs(norm - 1) > tolerance, "norm")
        .when(F.col("_hash").isNull(), "unknown").when(~F.coalesce("_embed", F.lit(False)), "not embeddable").when(~F.col("_hash").eqNullSafe(F.col("text_hash")), "changed").otherwise("written")
    )
    x = batch.join(seen, "id").join(a, "id", "left").withColumn("_why", why)
    counts = {r["_why"]: r["count"] for r in x.groupBy("_why").count().collect()}
    replace_for(x.where("_why = 'written'").select("id", "vector", F.lit(model).alias("model")), path, "id")
    return counts


def copy_file(s: SparkSession, source: str, target: str) -> bool:
    """Copies a file under a temporary name and renames it; a target of the same size is left alone. Whether it was copied."""
    fs, a = _fs(s, source)
    to, b = _fs(s, target)
    if to.exists(b) and to.getFileStatus(b).getLen() == fs.getFileStatus(a).getLen():
        return False
    part = _fs(s, f"{target}.part-{uuid.uuid4().hex}")[1]
    s._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, to, part, False, True, s._jsc.hadoopConfiguration())
    if to.exists(b):
        to.delete(b, False)
    return bool(to.rename(part, b))


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def after_response(stream: DataFrame, path: str, checkpoint: str):
    """Appends the rows of a stream to a table, batch by batch, and starts it; the caller does not wait."""
    return stream.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
