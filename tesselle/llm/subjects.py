"""Problem 3: the subject areas a law's text deals with, by propagating labels over a document-similarity graph.

Two laws are similar where they share a phrase. The graph is kept bipartite - laws and phrases - so that a phrase
shared by a third of all laws costs its own edges and no pairs of laws. An edge counts only through a verified phrase: one
whose laws' labels lean towards some category far beyond chance (stock phrases and procedure are spread evenly and fall out).

The texts are read twice: once to add up, for every phrase, the labels of the laws that hold it (added up in the task before
anything is shuffled), and once to keep each law's verified phrases, sentence by sentence. Labels then spread by joins: phrases take the mean of their
laws' labels, an edge takes the categories on which its law and its phrase agree, and laws and phrases are estimated anew from their edges. A
round joins the laws' rows with their labels, looks the phrases' labels up in a broadcast table (at most ``MOST_PHRASES`` rows; beyond that every lookup is a join by shuffle)
and adds both kinds of labels up. Laws whose category_id and first suggestion agree are trusted seeds and are clamped: they enter
every round with the labels they came with (``TRUST`` 1); several categories may remain with a law.
At the end each sentence goes to the category its phrases speak for, the propagated labels of its law deciding between equal ones,
and a law has every category with at least ``SHARE`` of its sentences. A category without a text of its own has no phrase that leans to it, so it
is never given out.

Defined results for awkward input: null and empty contents have no row; repeated rows count once; null labels and unknown
categories are no seeds; empty tables give an empty result; extra columns are ignored; very long texts are read whole;
a sentence whose categories tie goes to the category its law leans to, then to the smaller id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselle.llm.bounds import bounded, broadcast_if_small
from tesselle.llm.words import mix
from tesselle.session import cut, cut_table

SHARE = 0.19
MIN_LAWS = 4
ROUNDS = 4
TRUST = 1.0
MOST_PHRASES = 300_000  # broadcast up to here
MOST_LAWS = 300_000
MOST_WORDS = 100_000  # of the table of function words
MOST_CATEGORIES = 1000
HEAD = re.compile(r"^\s*(?:article|art[ií]culo|artikel|art\.)\s+\S{1,8}?\s*[.:]\s*(?:[-–—]\s*)?", re.I | re.M)
CUT = re.compile(r"[-‐‑\xad¬][ \t]*\n\s*(?=[^\W\d_])")
TOKEN = re.compile(r"[^\W\d_]+|[.!?]\s+(?=[^\W\d_«])")
MIN_WORDS = 4
HELD = 1_000_000


class Hashes(dict):
    """Token to hash, each worked out once: 0 for a word without content, 1 for the end of a sentence."""

    def __init__(self, common: frozenset[str]):
        super().__init__()
        self.common = common

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        if token[0] in ".!?":
            got = 1
        else:
            got = 0 if len(token) <= 2 or token in self.common else xxhash.xxh64_intdigest(token) | 2
        self[token] = got
        return got


class Reader:
    """Texts to phrases: pairs of neighbouring content words of a sentence and single ones, as hashes; function words between them are skipped."""

    def __init__(self, common: frozenset[str]):
        self.hashes = Hashes(common)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch: phrase, its text, its sentence (numbered through the batch), and the sentences of each text that have enough words."""
        flat, owner = [], []
        for k, t in enumerate(texts):
            if "\n" in t:
                t = CUT.sub("", HEAD.sub("", t))
            else:
                t = HEAD.sub("", t)
            h = list(map(self.hashes.__getitem__, TOKEN.findall(t.lower())))
            flat += h
            flat.append(1)
            owner.append(len(h) + 1)
        h = np.array(flat, np.uint64)
        own = np.repeat(np.arange(len(texts)), owner)
        end = h == 1
        sentence = np.cumsum(end) - end
        size = np.bincount(sentence[~end], minlength=int(end.sum()))
        good = size >= MIN_WORDS
        first = np.flatnonzero(end)
        sentences = np.bincount(own[first][good], minlength=len(texts))
        keep = (h > 1) & good[np.minimum(sentence, len(good) - 1)]
        h, own, sentence = h[keep], own[keep], sentence[keep]
        two = np.flatnonzero(sentence[1:] == sentence[:-1])
        pair = mix(h[two] * np.uint64(0x100000001B3) + mix(h[two + 1]))
        f, s, o = np.concatenate([h, pair]), np.concatenate([sentence, sentence[two]]), np.concatenate([own, own[two]])
        order = np.lexsort((f, s))
        f, s, o = f[order], s[order], o[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
        return f[new].view(np.int64), o[new], s[new], sentences


def _masses(common, cats: list[int]):
    """content, category_id, suggestions -> (f, m0 ...): for the phrases of the task's laws, how many labelled laws hold them and their labels, added up."""

    n_cats = len(cats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(common.value)
        held = np.zeros(0, np.int64), np.zeros((0, n_cats), np.float32)

        def merged(f, m):
            order = np.argsort(f, kind="stable")
            f, m = f[order], m[order]
            start = np.flatnonzero(np.append(True, f[1:] != f[:-1])) if len(f) else np.zeros(0, np.int64)
            return f[start], np.add.reduceat(m, start, axis=0) if len(f) else m

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(held[0]), *(pa.array(held[1][:, c].astype(np.float64)) for c in range(n_cats))], names=["f", *(f"m{c}" for c in range(n_cats))])

        for b in batches:
            own, _ = seeds(b.column(1).to_pylist(), b.column(2).to_pylist(), cats)
            some = np.flatnonzero(own.sum(axis=1) > 0)
            own, texts = own[some].astype(np.float32), b.column(0).take(pa.array(some)).to_pylist()
            for a in range(0, len(texts), 1000):
                f, o, _, _ = reader.phrases(texts[a : a + 1000])
                order = np.lexsort((o, f))
                f, o = f[order], o[order]
                new = np.ones(len(f), bool)
                new[1:] = (f[1:] != f[:-1]) | (o[1:] != o[:-1])
                f, o = f[new], o[new]
                f, m = merged(f, own[a : a + 1000][o])
                held = merged(np.concatenate([held[0], f]), np.concatenate([held[1], m]))
            if len(held[0]) > HELD:
                yield emit()
                held = np.zeros(0, np.int64), np.zeros((0, n_cats), np.float32)
        if len(held[0]):
            yield emit()

    return run


def _sentences(common, known):
    """law, content -> (law, total, ends, fs): a law's sentences, and the verified phrases of each, as places in the sorted ``known`` (all phrases as hashes
    if there is none); ``ends`` says where each sentence's phrases end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sure = Reader(common.value), known.value if known is not None else None
        for b in batches:
            texts = b.column(1).to_pylist()
            for a in range(0, len(texts), 1000):
                f, o, s, n = reader.phrases(texts[a : a + 1000])
                if sure is not None:
                    at = np.searchsorted(sure, f)
                    at[at == len(sure)] = 0
                    ok = sure[at] == f if len(sure) else np.zeros(len(f), bool)
                    f, o, s = at[ok], o[ok], s[ok]
                last = np.flatnonzero(np.append(s[1:] != s[:-1], True)) if len(s) else np.zeros(0, np.int64)
                laws = len(n)
                bounds = np.searchsorted(o, np.arange(laws + 1))
                per = np.searchsorted(o[last], np.arange(laws + 1))
                ends = last + 1 - bounds[o[last]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, laws), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.array(ends.astype(np.int32))), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(f.astype(np.int64)))],
                    names=["law", "total", "ends", "fs"],
                )

    return run


class Packed:
    """A batch of laws with phrases: one flat row a phrase, with its law and sentence."""

    def __init__(self, b: pa.RecordBatch, n_cats: int):
        ends, fs, v = b.column("ends"), b.column("fs"), b.column("v")
        self.f = fs.flatten().to_numpy()
        size = np.diff(fs.offsets.to_numpy())
        self.law = np.repeat(np.arange(b.num_rows), size)
        sentences = np.diff(ends.offsets.to_numpy())
        e = ends.flatten().to_numpy().astype(np.int64)
        base = np.concatenate([[0], np.cumsum(size)])[:-1]
        last = e + np.repeat(base, sentences)
        self.sentence = np.searchsorted(last, np.arange(len(self.f)), side="right")
        self.owner = np.repeat(np.arange(b.num_rows), sentences)
        self.v = np.zeros((b.num_rows, n_cats))
        some = v.is_valid().to_numpy(zero_copy_only=False)
        if some.any():
            self.v[some] = v.filter(pa.array(some)).flatten().to_numpy().reshape(-1, n_cats)


def _round(phi, n_cats: int, hold: bool):
    """One round over packed laws: their labels anew (rows law, v) and the phrases' labels, added up in the task (rows f, c, u).
    Without ``hold`` only the phrases', from the labels the laws have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = phi.value
        total = np.zeros((known if isinstance(known, int) else len(known), n_cats))
        names = ["law", "v", "f", "c", "u"]
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                b = whole.slice(a, 1000)
                x = Packed(b, n_cats)
                if hold:
                    r = known[x.f] * (x.v[x.law] + 0.02)
                    t = r.sum(axis=1, keepdims=True)
                    r = np.divide(r, t, out=np.zeros_like(r), where=t > 0)
                    v = np.zeros_like(x.v)
                    for c in range(n_cats):
                        v[:, c] = np.bincount(x.law, r[:, c], minlength=len(v))
                    t = v.sum(axis=1, keepdims=True)
                    v = np.divide(v, t, out=np.zeros_like(v), where=t > 0)
                    held = b.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
                    v[held] = (1 - TRUST) * v[held] + TRUST * x.v[held]
                    none = pa.nulls(len(v), pa.int32())
                    yield pa.RecordBatch.from_arrays([b.column("law"), pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), n_cats).cast(pa.list_(pa.float64())), none, none, pa.nulls(len(v), pa.float64())], names=names)
                else:
                    r = x.v[x.law]
                for c in range(n_cats):
                    total[:, c] += np.bincount(x.f, r[:, c], minlength=len(total))
        f, c = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(f), pa.int64()), pa.nulls(len(f), pa.list_(pa.float64())), pa.array(f.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(total[f, c])], names=names)

    return run


def _vote(phi, cats: list[int], share: float):
    """Each sentence to the category its phrases speak for, and the categories of every law with their share of its sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_cats = phi.value, len(cats)
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                b = whole.slice(a, 1000)
                x = Packed(b, n_cats)
                n = len(x.owner)
                u = np.stack([np.bincount(x.sentence, known[x.f, c], minlength=n) for c in range(n_cats)], axis=1).round(9) if n else np.zeros((0, n_cats))
                best = u.max(axis=1, initial=0.0)
                said = best > 0
                lean = np.where(u[said] == best[said, None], x.v[x.owner[said]].round(9), -1.0).argmax(axis=1)
                count = np.bincount(x.owner[said] * n_cats + lean, minlength=b.num_rows * n_cats).reshape(-1, n_cats)
                part = count / np.maximum(1, b.column("total").to_numpy())[:, None]
                i, c = np.nonzero((count > 0) & (part >= share))
                yield pa.RecordBatch.from_arrays([b.column("law").take(pa.array(i)), pa.array(np.array(cats, np.int32)[c]), pa.array(count[i, c]), pa.array(part[i, c])], names=["law_id", "category_id", "sentences", "share"])

    return run


OUT = "law_id bigint, category_id int, sentences bigint, share double"


def common_set(common_words: DataFrame) -> frozenset[str]:
    return frozenset(r["word"].lower() for r in bounded(common_words.select("word").where("word is not null").distinct(), MOST_WORDS, "common_words"))


def once(laws: DataFrame) -> DataFrame:
    """(law, content, category_id, s) with one row an id: only the ids that repeat are shuffled."""
    x = laws.select(F.col("id").cast("bigint").alias("law"), "content", "category_id", F.expr("filter(suggested_categories, s -> s is not null)").alias("s")).where("law is not null")
    twice = broadcast_if_small(cut(x.groupBy("law").count().where("count > 1").select("law")), MOST_LAWS)
    return x.join(twice, "law", "left_anti").union(x.join(twice, "law", "left_semi").dropDuplicates(["law"]))


def seeds(category: list, suggested: list, cats: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The labels laws come with, weighted, a column a category, and which of them are trusted (label and first suggestion agree)."""
    at = {c: k for k, c in enumerate(cats)}
    w, trusted = np.zeros((len(category), len(cats))), np.zeros(len(category), bool)
    for i, (own, more) in enumerate(zip(category, suggested)):
        if own in at:
            w[i, at[own]] += 0.6
            trusted[i] = bool(more) and more[0] == own
        for k, c in enumerate(more or ()):
            if c in at:
                w[i, at[c]] += 0.1 if k else 0.3
    total = w.sum(axis=1, keepdims=True)
    return np.divide(w, total, out=np.zeros_like(w), where=total > 0), trusted


def labels(rows: DataFrame, cats: list[int]) -> DataFrame:
    """(law, trusted, v0 ...) of every law with a label; a column a category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, trusted = seeds(b.column(1).to_pylist(), b.column(2).to_pylist(), cats)
            some = np.flatnonzero(w.sum(axis=1) > 0)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array(trusted[some]), *(pa.array(c) for c in w[some].T)], names=["law", "trusted", *(f"v{c}" for c in range(len(cats)))])

    return rows.select("law", "category_id", "s").mapInArrow(run, "law bigint, trusted boolean" + "".join(f", v{c} double" for c in range(len(cats))))


def subjects(laws: DataFrame, categories: DataFrame, common_words: DataFrame, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """(law_id, category_id, sentences, share) of every category with at least ``share`` of a law's sentences."""
    spark = laws.sparkSession
    common = spark.sparkContext.broadcast(common_set(common_words))
    cats = sorted(r["id"] for r in bounded(categories.where("id is not null").select("id").distinct(), MOST_CATEGORIES, "categories"))
    rows = once(laws)
    label = cut(labels(rows, cats))
    C = range(len(cats))
    total = label.selectExpr("count(*)", *(f"sum(v{c})" for c in C)).first()
    if not total[0]:
        return spark.createDataFrame([], OUT)
    texts = rows.where("content is not null and content <> ''")
    # Verification: the leading category's share among a phrase's labelled laws, against its share among all.
    lean = texts.select("content", "category_id", "s").mapInArrow(_masses(common, cats), "f bigint" + "".join(f", m{c} double" for c in C))
    lean = lean.groupBy("f").agg(*(F.expr(f"sum(m{c})").alias(f"m{c}") for c in C)).selectExpr("*", " + ".join(f"m{c}" for c in C) + " as t").where(f"t >= {MIN_LAWS - 1e-3}")
    prior = [total[c + 1] / total[0] for c in C]
    sure = cut(lean.where(" or ".join(f"(m{c} / t >= 0.3 and m{c} / t - {p} >= 3.5 * sqrt({p * (1 - p)} / t))" for c, p in zip(C, prior))).select("f"))
    label = label.select("law", "trusted", F.array(*(f"v{c}" for c in C)).alias("v"))
    if sure.limit(MOST_PHRASES + 1).count() > MOST_PHRASES:
        return _by_shuffle(texts, label, sure, common, cats, share, rounds)
    known = spark.sparkContext.broadcast(np.sort(np.array([r["f"] for r in sure.collect()], np.int64)))
    read = texts.select("law", "content").mapInArrow(_sentences(common, known), "law bigint, total int, ends array<int>, fs array<bigint>")
    read = cut_table(read.where("total > 0"))
    held = label.select("law", "trusted")
    n = len(known.value)

    def phrases_of(x: DataFrame) -> np.ndarray:
        """The phrases' labels as shares; at most MOST_PHRASES rows of a column a category."""
        u = np.zeros((n, len(cats)))
        for r in x.where("f is not null").groupBy("f", "c").agg(F.sum("u").alias("u")).collect():
            u[r["f"], r["c"]] = r["u"]
        t = u.sum(axis=1, keepdims=True)
        return np.divide(u, t, out=np.zeros_like(u), where=t > 0)

    def joined(pi: DataFrame) -> DataFrame:
        return read.join(broadcast_if_small(pi, MOST_LAWS), "law", "left").join(broadcast_if_small(held, MOST_LAWS), "law", "left").select("law", "total", "ends", "fs", "v", F.coalesce("trusted", F.lit(False)).alias("trusted"))

    schema = "law bigint, v array<double>, f int, c int, u double"
    pi = label.select("law", "v")
    u = phrases_of(joined(pi).mapInArrow(_round(spark.sparkContext.broadcast(n), len(cats), False), schema))
    for _ in range(rounds):
        x = cut_table(joined(pi).mapInArrow(_round(spark.sparkContext.broadcast(np.where(u > 0.02, u, 0.0)), len(cats), True), schema))
        pi, u = x.where("law is not null").select("law", "v"), phrases_of(x)
    return joined(pi).mapInArrow(_vote(spark.sparkContext.broadcast(np.where(u >= 0.5, u, 0.0)), cats, share), OUT)


def _by_shuffle(texts: DataFrame, label: DataFrame, sure: DataFrame, common, cats: list[int], share: float, rounds: int) -> DataFrame:
    """The same for more phrases than fit a broadcast: every lookup a join by shuffle, a row a (law, phrase, category)."""
    number = F.explode(F.map_from_arrays(F.lit(list(range(len(cats)))), F.lit(cats)))
    names = texts.sparkSession.range(1).select(number.alias("k", "c"))
    read = cut_table(texts.select("law", "content").mapInArrow(_sentences(common, None), "law bigint, total int, ends array<int>, fs array<bigint>").where("total > 0"))
    said = read.select("law", "ends", F.posexplode("fs").alias("at", "f")).join(sure, "f").select("law", "f", F.expr("size(filter(ends, e -> e <= at))").alias("no"))
    said = cut_table(said)
    edge = cut_table(said.groupBy("law", "f").agg(F.count("*").alias("n")))
    pi = label.select("law", F.posexplode("v").alias("c", "v")).where("v > 0")
    kept = pi.join(label.where("trusted").select("law"), "law", "left_semi").withColumnRenamed("v", "s")
    trusted = label.where("trusted").select("law", F.lit(True).alias("held"))
    phi = edge.join(pi, "law").groupBy("f", "c").agg(F.sum(F.col("n") * F.col("v")).alias("u"))
    part = lambda x, v, *by: x.withColumn(v, F.col(v) / F.sum(v).over(Window.partitionBy(*by)))
    for _ in range(rounds):
        x = edge.join(part(phi, "u", "f").where("u > 0.02"), "f").join(pi, ["law", "c"], "left").withColumn("r", F.col("u") * (F.coalesce("v", F.lit(0.0)) + 0.02))
        x = cut(part(x, "r", "law", "f").select("law", "f", "c", F.expr("n * r as r")))
        phi = x.groupBy("f", "c").agg(F.sum("r").alias("u"))
        new = part(x.groupBy("law", "c").agg(F.sum("r").alias("v")), "v", "law")
        pi = new.join(kept, ["law", "c"], "full").join(trusted, "law", "left").selectExpr("law", "c", f"if(held, {1 - TRUST}D * coalesce(v, 0) + {TRUST}D * coalesce(s, 0), v) as v")
    phi = part(phi, "u", "f").where("u >= 0.5")
    speak = said.join(phi, "f").groupBy("law", "no", "c").agg(F.round(F.sum("u"), 9).alias("u")).join(pi, ["law", "c"], "left")
    best = speak.groupBy("law", "no").agg(F.max(F.struct("u", F.round(F.coalesce("v", F.lit(0.0)), 9).alias("v"), F.negative("c").alias("c"))).alias("w"))
    got = best.groupBy("law", F.negative("w.c").alias("k")).agg(F.count("*").alias("sentences"))
    out = got.join(read.select("law", "total"), "law").withColumn("share", F.col("sentences") / F.col("total")).where(F.col("share") >= share)
    return out.join(F.broadcast(names), "k").select(F.col("law").alias("law_id"), F.col("c").cast("int").alias("category_id"), "sentences", "share")


def found(laws: DataFrame, categories: DataFrame, common_words: DataFrame) -> DataFrame:
    return subjects(laws, categories, common_words).select(F.col("law_id").cast("int").alias("law_id"), "category_id")
