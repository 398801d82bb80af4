"""Problem 7: the language of every law and of every segment of a mixed one.

One bit-sliced Bloom filter holds the character n-grams of all languages: a slot carries one bit a language, so that the
conjunction of an n-gram's HASHES slots is the bitmask of all languages that contain it. A segment's
bits are counted per language and corrected for the false positives that the fill of each slice makes expected; the highest
corrected count decides. The confidence is the chance that it is right, a logistic function of its lead over the second and of the number of
n-grams, fitted on short pieces of segments that took no part in the training.

A word's bits are counted once and kept (``Bitmask.word``), as one integer with a field a language, so a text costs a look-up a word.

The filter is trained on a bounded sample of ``SAMPLE`` segments, labelled by the function words of the common_words table
(labels of the laws themselves are not trusted). An n-gram belongs to the languages in which it is at least a fifth
as frequent as where it is most frequent. The filter's size is fixed (2^20 slots) and it is broadcast.

Running heads of printed pages are no text of the law: they take no part in the decision, and a segment of nothing
else goes with the text before it.

Defined results for awkward input: null and blank contents have no row; repeated rows count once; an empty table gives an
empty result; extra columns are ignored; very long texts are read whole; a segment of fewer than MIN_WORDS words (the end of a sentence torn by a page) goes with the one before it
(the first such with the one after); equal counts go to the alphabetically first language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.llm.bounds import bounded
from tesselle.llm.pages import Furniture, learn_titles
from tesselle.llm.sampling import sample_texts

SLOTS = 1 << 20
HASHES = 3
SAMPLE = 4000
GRAM = 4
MIN_WORDS = 5
MOST_WORDS = 100_000  # of the table of function words
FIELD = 40  # bits a language in a packed count
PIECES = (2, 3, 4, 6, 9, 14)  # words in the pieces the confidence is fitted on
BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
WORDS = re.compile(r"[^\W\d_]+")


def segments(text: str) -> list[str]:
    """The parts between blank lines."""
    return [s for s in BLANK.split(text.replace("\r\n", "\n").strip()) if s.strip()]


def grams(text: str) -> list[str]:
    """Character n-grams of words with their borders; short words are whole."""
    out = []
    for w in WORDS.findall(text.lower()):
        w = f" {w} "
        out += [w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))]
    return out


class Bitmask:
    """The filter: slots of one bit a language, each slice's chance of a false positive, and the two numbers of the confidence."""

    def __init__(self, slots: np.ndarray, languages: list[str], trust: tuple[float, float] = (0.0, 1.0)):
        self.slots, self.languages, self.trust, self.cache = slots, languages, trust, {}
        fill = np.array([(slots >> slots.dtype.type(k) & slots.dtype.type(1)).mean() for k in range(len(languages))])
        self.false = fill**HASHES

    @classmethod
    def build(cls, members: dict[str, int], languages: list[str]) -> Bitmask:
        width = next((t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= len(languages)), None)
        if width is None:
            raise ValueError(f"{len(languages)} languages, at most 64 fit the bitmask")
        slots = np.zeros(SLOTS, width)
        for g, mask in members.items():
            for at in cls._slots(g):
                slots[at] |= width(mask)
        return cls(slots, languages)

    @staticmethod
    def _slots(g: str) -> list[int]:
        h = xxhash.xxh64_intdigest(g)
        return [(h >> (20 * k)) % SLOTS for k in range(HASHES)]

    def mask(self, g: str) -> int:
        got = (1 << len(self.languages)) - 1
        for at in self._slots(g):
            got &= int(self.slots[at])
        return got

    def word(self, w: str) -> int:
        """The n-grams of a word, and how many of them each language holds, packed: FIELD bits each, the languages' above."""
        got = self.cache.get(w)
        if got is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            got = 0
            for g in grams(w):
                got += 1
                m = self.mask(g)
                for k in range(len(self.languages)):
                    if m >> k & 1:
                        got += 1 << FIELD * (k + 1)
            self.cache[w] = got
        return got

    def packed(self, words: list[str]) -> int:
        return sum(map(self.word, words))

    def unpacked(self, packed: int) -> tuple[np.ndarray, int]:
        """Corrected popcounts by language, and the number of n-grams."""
        top = (1 << FIELD) - 1
        n = packed & top
        hits = np.array([packed >> FIELD * (k + 1) & top for k in range(len(self.languages))], float)
        return np.maximum(0, (hits - n * self.false) / (1 - self.false)), n

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        return self.unpacked(self.packed(WORDS.findall(text.lower())))

    def lead(self, packed: int) -> tuple[int, float]:
        """The place of the language with most n-grams (-1 without letters), and its lead over the second in standard deviations."""
        c, n = self.unpacked(packed)
        if not n or c.max() == 0:
            return -1, 0.0
        order = np.argsort(-c, kind="stable")
        return int(order[0]), float((c[order[0]] - c[order[1]]) / np.sqrt(n)) if len(c) > 1 else float(np.sqrt(n))

    def judge(self, packed: int) -> tuple[str | None, float]:
        """(language, confidence); (None, 0) for a text without letters."""
        at, lead = self.lead(packed)
        if at < 0:
            return None, 0.0
        return self.languages[at], float(round(1 / (1 + np.exp(-np.clip(self.trust[0] + self.trust[1] * lead, -30, 30))), 4))

    def decide(self, text: str) -> tuple[str | None, float]:
        return self.judge(self.packed(WORDS.findall(text.lower())))


def calibrated(model: Bitmask, pieces: list[tuple[list[str], str]]) -> Bitmask:
    """The model with its confidence fitted to how often it is right on pieces (words, true language): logistic regression, by Newton steps."""
    x, y = [], []
    for words, language in pieces:
        at, lead = model.lead(model.packed(words))
        if at >= 0:
            x.append((1.0, lead))
            y.append(float(model.languages[at] == language))
    if not x:
        return model
    x, y, b = np.array(x), np.array(y), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (y - p) - 0.1 * b
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), g)
    return Bitmask(model.slots, model.languages, (float(b[0]), float(b[1])))


def labelled(texts: list[str], common: dict[str, frozenset[str]]) -> list[tuple[list[str], str]]:
    """(words, language) of the texts whose function words clearly speak for one language."""
    out = []
    for t in texts:
        words = WORDS.findall(t.lower())
        votes = sorted(((sum(w in common[x] for w in words), x) for x in common), reverse=True)
        if votes and votes[0][0] >= 6 and (len(votes) < 2 or votes[0][0] >= 2 * votes[1][0]):
            out.append((words, votes[0][1]))
    return out


def pieces(rows: list[tuple[list[str], str]]) -> list[tuple[list[str], str]]:
    return [(words[at : at + n], x) for words, x in rows for k, n in enumerate(PIECES) if (at := 7 * k) + n <= len(words)]


def fit(texts: list[str], common: dict[str, frozenset[str]]) -> Bitmask:
    """Clearly labelled segments become the training text of their language; every fifth is left out and its pieces fit the confidence."""
    languages = sorted(common)
    rows = labelled(texts, common)
    held = rows[4::5]
    count = {x: Counter() for x in languages}
    total = dict.fromkeys(languages, 1)
    for k, (words, x) in enumerate(rows):
        if k % 5 != 4 or len(rows) < 50:
            g = [g for w in words for g in grams(w)]
            count[x].update(g)
            total[x] += len(g)
    for x in languages:  # the function words themselves, in case a language is missing from the sample
        count[x].update(g for w in common[x] for g in grams(w))
    members: dict[str, int] = {}
    for g in set().union(*count.values()):
        rate = [count[x][g] / total[x] for x in languages]
        if max(count[x][g] for x in languages) >= 2 or any(g.strip() in common[x] for x in languages):
            top = max(rate)
            members[g] = sum(1 << k for k, r in enumerate(rate) if r * 5 >= top)
    return calibrated(Bitmask.build(members, languages), pieces(held))


def common_sets(common_words: DataFrame) -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for r in bounded(common_words.where("lang is not null and word is not null").select("lang", "word").distinct(), MOST_WORDS, "common_words"):
        out.setdefault(r["lang"].lower(), set()).add(r["word"].lower())
    return {x: frozenset(w) for x, w in out.items()}


def train(laws: DataFrame, common_words: DataFrame, sample: int = SAMPLE) -> Bitmask:
    seg = laws.where("content is not null").select(F.explode(F.split("content", r"\n[^\S\n]*\n")).alias("s")).where("length(s) > 60")
    return fit(sample_texts(seg, sample), common_sets(common_words))


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, languages, trust, titles = shared.value
        model, furniture = Bitmask(slots, languages, trust), Furniture(titles)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                bodies = []
                for s in segments(text):
                    lines = s.split("\n")
                    kept = [x for x in lines if not furniture.kinds(x.strip())] if len(lines) > 1 or len(s) < 200 else lines
                    bodies.append(WORDS.findall("\n".join(kept).lower()))
                counted = [model.packed(w) for w in bodies]
                verdict = [model.judge(c) if len(w) >= MIN_WORDS else (None, 0.0) for w, c in zip(bodies, counted)]
                sound = [k for k, v in enumerate(verdict) if v[0]]
                whole = model.judge(sum(counted))
                if not sound:  # nothing but scraps: they are judged together
                    if whole[0]:
                        rows.append((i, 0, whole[0], whole[1], False))
                    continue
                last = verdict[sound[0]]
                for k, v in enumerate(verdict):
                    verdict[k] = last = v if v[0] else last
                kinds = {verdict[k][0] for k in sound}
                if len(kinds) > 1:
                    rows += [(i, k + 1, v[0], v[1], True) for k, v in enumerate(verdict)]
                else:
                    rows.append((i, 0, verdict[sound[0]][0], whole[1], False))
            if rows:
                x = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int32()), pa.array(x[2], pa.string()), pa.array(x[3], pa.float64()), pa.array(x[4], pa.bool_())], names=["law_id", "segment_no", "language", "confidence", "mixed"])

    return run


def detect(laws: DataFrame, common_words: DataFrame, model: Bitmask | None = None) -> DataFrame:
    """(law_id, segment_no, language, confidence, mixed): one row with segment_no 0 for a law in one language, one row
    for each segment of a mixed law."""
    model = model or train(laws, common_words)
    titles = learn_titles(laws.where("content is not null").select("content"))
    shared = laws.sparkSession.sparkContext.broadcast((model.slots, model.languages, model.trust, titles))
    texts = laws.select(F.col("id").cast("bigint").alias("id"), "content").where("id is not null and content is not null")
    return texts.mapInArrow(_judge(shared), "law_id bigint, segment_no int, language string, confidence double, mixed boolean").distinct()


def labels(laws: DataFrame, common_words: DataFrame) -> DataFrame:
    """(law_id, language, confidence, mixed, label, detected): what each law is in (its most confident segment's language if mixed), and whether
    language and detected_language are right, wrong, unknown (none of the filter's languages) or missing."""
    known = sorted(common_sets(common_words))
    best = detect(laws, common_words).groupBy("law_id").agg(F.max_by(F.struct("language", "confidence"), F.struct("confidence", F.negative("segment_no"))).alias("v"), F.max("mixed").alias("mixed"))
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    given = laws.select(F.col("id").cast("bigint").alias("law_id"), clean("language").alias("a"), clean("detected_language").alias("b")).dropDuplicates(["law_id"])
    judged = lambda c: F.when(F.col(c).isNull(), "missing").when(~F.col(c).isin(known), "unknown").when(F.col(c) == F.col("v.language"), "right").otherwise("wrong")
    return best.join(given, "law_id").select("law_id", "v.language", "v.confidence", "mixed", judged("a").alias("label"), judged("b").alias("detected"))


def found(laws: DataFrame, common_words: DataFrame) -> DataFrame:
    """Mixed laws by segment, and laws in one language whose label is missing, unknown or another."""
    label = laws.select(F.col("id").cast("bigint").alias("law_id"), F.lower(F.trim("language")).alias("label")).distinct()
    rows = detect(laws, common_words).join(label, "law_id").where("mixed or label is null or label <> language")
    return rows.select(F.col("law_id").cast("int").alias("law_id"), "segment_no", "language").distinct()
