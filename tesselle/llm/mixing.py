"""Problem 9: documents mixed so that each source gives its target share of the total size in tokens.

Sizes are tokens of a public byte-level BPE (path a parameter). The total defaults to the largest at which every source that has
documents can give its share within its repeats; shares of sources without documents are spread over the others in
proportion. A source's budget is filled by whole passes over its documents and one partial pass. The partial pass is a
subset-sum problem on counts: documents are counted by exact token length, the budget is shared out over the
lengths in proportion, and bounded-knapsack dynamic programming fits what remains to the token. The chosen number of each length is
then taken in the order of a seeded hash of doc_id.

Only the table of token lengths of one source (as many rows as there are different lengths) meets in one task; documents are
ranked within (source, length), so a source with a third of all rows is split by its lengths.

Defined results for awkward input: null and empty texts have no tokens and are never chosen; a null source or one without
target is left out; spellings of a source differing in case, blanks, hyphens and underscores are one; repeated rows count
once; a null share or repeat count means 0; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselle.session import cut

TOKENIZER = os.environ.get("TESSELLE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how this public vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED = 42
WINDOW = 4


def source_key(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")


def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary, read where the driver is; executors get it by broadcast (its size is that of the public file, about a megabyte)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _tokens(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for b in batches:
            n = [len(bpe.encode_ordinary(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return run


def sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of every document with a text and a source, the source in its usual spelling."""
    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key(F.col("source")).alias("source"), "text")
    d = d.where("doc_id is not null and source is not null and text is not null and text <> ''")
    return d.mapInArrow(_tokens(documents.sparkSession.sparkContext.broadcast(ranks(tokenizer))), "doc_id bigint, source string, tokens bigint").where("tokens > 0").dropDuplicates(["doc_id"])


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their tokens come closest to the budget from below."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    share = counts * (budget / total)
    take = np.floor(share).astype(np.int64)
    left = budget - int((lengths * take).sum())
    window = WINDOW * int(lengths.max())
    for k in np.argsort(-(share - take), kind="stable"):  # one more of the lengths that lost most by rounding down
        if left <= window:
            break
        if take[k] < counts[k] and lengths[k] <= left:
            take[k] += 1
            left -= int(lengths[k])
    # Bounded knapsack over the rest: by[w] is the length that first reached the sum w.
    by = np.full(left + 1, -1, np.int64)
    reach = np.zeros(left + 1, bool)
    reach[0] = True
    for k in np.argsort(-lengths, kind="stable"):
        n, size = int(counts[k] - take[k]), int(lengths[k])
        new = reach
        while n and size <= left:
            step = np.zeros_like(reach)
            step[size:] = new[:-size]
            new = step & ~reach
            if not new.any():
                break
            by[new] = k
            reach = reach | new
            n -= 1
        if reach[left]:
            break
    w = int(np.flatnonzero(reach)[-1])
    while w:
        take[by[w]] += 1
        w -= int(lengths[by[w]])
    return take


def plan(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, budget) of every target; one small row a source."""
    have = docs.groupBy("source").agg(F.sum("tokens").alias("available"))
    t = targets.select(source_key(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    t = t.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(have, "source", "left").withColumn("available", F.when(F.col("max_repeats") > 0, F.coalesce("available", F.lit(0))).otherwise(0))
    whole = Window.partitionBy()  # a row a target
    t = t.withColumn("open", (F.col("available") > 0) & (F.col("target_share") > 0))
    t = t.withColumn("fair", F.when(F.col("open"), F.col("target_share") / F.sum(F.when(F.col("open"), F.col("target_share"))).over(whole)))
    most = F.min(F.col("available") * F.col("max_repeats") / F.col("fair")).over(whole)
    t = t.withColumn("total", F.lit(total_tokens).cast("double") if total_tokens else most)
    return t.withColumn("budget", F.coalesce(F.least(F.floor(F.col("total") * F.col("fair") + 1e-6), F.col("available") * F.col("max_repeats")), F.lit(0)).cast("bigint"))


def _choose(key: tuple, pdf):
    import pandas as pd

    pdf = pdf.sort_values("tokens")
    lengths, counts = pdf["tokens"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    budget, size = int(pdf["budget"].iloc[0]), int((lengths * counts).sum())
    passes = budget // size
    take = fit_budget(lengths, counts, budget - passes * size) if budget % size else np.zeros_like(counts)
    return pd.DataFrame({"source": key[0], "tokens": lengths, "passes": passes, "take": take})


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, copies) of the chosen documents."""
    docs = cut(sizes(documents, tokenizer))
    budget = plan(docs, targets, total_tokens).select("source", "budget").where("budget > 0")
    table = docs.groupBy("source", "tokens").agg(F.count("*").alias("n")).join(budget, "source")
    chosen = table.groupBy("source").applyInPandas(_choose, "source string, tokens bigint, passes bigint, take bigint")
    w = Window.partitionBy("source", "tokens").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    ranked = docs.join(chosen.where("passes > 0 or take > 0"), ["source", "tokens"]).withColumn("k", F.row_number().over(w))
    return ranked.withColumn("copies", F.col("passes") + (F.col("k") <= F.col("take")).cast("int")).where("copies > 0").select("doc_id", "source", "tokens", "copies")


def shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, target_share, documents, rows, tokens, actual_share) of every target, also of those that can give nothing."""
    got = mix(documents, targets, total_tokens, seed, tokenizer).groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("rows"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    t = targets.select(source_key(F.col("source")).alias("source"), "target_share").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    out = t.join(got, "source", "left").na.fill(0, ["documents", "rows", "tokens"])
    return out.withColumn("actual_share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 6))
