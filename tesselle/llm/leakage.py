"""Problem 8: evaluation passages inside the corpus, by winnowing.

Both sides keep the minimal hash of every window of ``window`` consecutive k-grams of words, so that any shared
run of k + window - 1 words is certain to share a fingerprint. Fingerprints are joined, and the
hits are extended to the full common run on the words themselves. The test side, and the pairs that hit, are broadcast only
when their counted rows stay under ``BROADCAST_ROWS``; beyond that the same joins shuffle.

Defined results for awkward input: null and empty texts and texts shorter than the run share nothing; repeated rows
count once; empty tables give an empty result; extra columns are ignored. A fingerprint that is common in the corpus
only meets the items that hold it, so a boilerplate passage costs its own occurrences and no pairs of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.llm.bounds import broadcast_if_small
from tesselle.llm.words import flat, grams, plain_words
from tesselle.session import cut

RUN = 14
K = 7
BROADCAST_ROWS = 1_000_000
BROADCAST_ITEMS = 10_000
SALTS = 32


def _winnow(h: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    if len(h) < window:
        return h[:0], owner[:0]
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    at = np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(axis=1)
    inside = owner[: len(view)] == owner[window - 1 :]
    at = np.unique(at[inside])
    return h[at], owner[at]


def _fingerprints(key: str, k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, bounds = flat(b.column(1).to_pylist(), plain_words)
            h, owner = _winnow(*grams(words, bounds, k), window)
            if len(h):
                pair = np.unique(np.stack([owner.astype(np.uint64), h]), axis=1)
                ids = b.column(0).take(pa.array(pair[0].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(pair[1].view(np.int64))], names=[key, "fp"])

    return run


def fingerprints(texts: DataFrame, key: str, text: str, run: int = RUN, k: int = K) -> DataFrame:
    """(key, fp): the winnowed fingerprints of every text; window = run - k + 1."""
    return texts.select(key, text).where(F.col(text).isNotNull()).mapInArrow(_fingerprints(key, k, run - k + 1), f"{key} bigint, fp bigint")


def longest_common_run(a: list[str], b: list[str]) -> tuple[int, int]:
    """Length and start (in a) of the longest run of words that both have."""
    best, at, last = 0, 0, {}
    where: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    for i, w in enumerate(a):
        now = {}
        for j in where.get(w, ()):
            now[j] = n = last.get(j - 1, 0) + 1
            if n > best:
                best, at = n, i - n + 1
        last = now
    return best, at


def _extend(run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[int, list[str]] = {}
        for b in batches:
            rows = []
            last, words = None, []
            for d, text, i, passage in zip(*(c.to_pylist() for c in b.columns)):
                if i not in items:
                    if len(items) > 10_000:
                        items.clear()
                    items[i] = plain_words(passage)
                if d != last:
                    last, words = d, plain_words(text)
                n, at = longest_common_run(words, items[i])
                if n >= run:
                    rows.append((d, i, n, at))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "item_id", "run_words", "run_start"])

    return go


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, k: int = K) -> DataFrame:
    """(doc_id, item_id, run_words, run_start): every document and item that share a run of at least ``run`` words."""
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    held = items.select("item_id", F.col("text").alias("passage")).where("item_id is not null and passage is not null").distinct()
    test = fingerprints(held, "item_id", "passage", run, k).distinct()
    test = broadcast_if_small(cut(test), BROADCAST_ROWS)
    pairs = cut(fingerprints(docs, "doc_id", "text", run, k).join(test, "fp").select("doc_id", "item_id").distinct())
    pairs = broadcast_if_small(pairs, BROADCAST_ROWS)  # else all texts would be shuffled for the few that hit
    hits = docs.join(pairs, "doc_id").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    if held.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS:
        hits = hits.join(F.broadcast(held), "item_id")
    else:  # an item that leaked everywhere is spread over SALTS keys
        hits = hits.join(held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["item_id", "salt"])
    return hits.select("doc_id", "text", "item_id", "passage").mapInArrow(_extend(run), "doc_id bigint, item_id bigint, run_words bigint, run_start bigint").distinct()


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id").distinct()
