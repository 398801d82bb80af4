"""Problem 2: statistics of each text and a verdict on its form: prose, list, table or junk.

One pass over the texts computes the statistics; a gradient-boosted tree ensemble (one sequence of regression trees a
class, softmax loss) judges them. It is trained here, on a bounded sample of ``SAMPLE`` texts to which plain structural
rules give a weak label (texts on which no rule speaks are not used), and its probabilities are calibrated by one
temperature and one offset a class on ``HOLDOUT``, a hand-checked set of texts. The whole corpus is then judged in one pass without a shuffle; the
ensemble is broadcast, its size is fixed by ROUNDS and DEPTH.

Defined results for awkward input: a null content has no row, an empty or blank text is junk with zero statistics; repeated
rows count once; an empty table gives an empty result (and trains on made-up texts); extra columns are ignored; very long texts are measured whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.llm.bounds import bounded
from tesselle.llm.sampling import sample_texts

FORMS = ["prose", "list", "table", "junk"]
SAMPLE = 10_000
ROUNDS = 50
DEPTH = 3
RATE = 0.2

WORDS = re.compile(r"[^\W\d_]+")
BULLET = re.compile(r"\s*(?:[-–—•*·▪◦‣o]\s+\S|\(?(?:\d{1,3}|[a-z]{1,2}|[ivx]{1,5}|[A-Z])[.)°]\s*\S|\d{1,3}\s*[-–—]\s+\S|§\s)")
CELLS = re.compile(r"\||\t|<t[dhr]\b|^.{0,40}\S {2,}\S.{0,60} {2,}\S.{0,40}$|\S;\S[^;]*;\S[^;]*;\S")
LEADER = re.compile(r"[.…_·]{4,}|(?: \.){4,}")
MARK = re.compile(r"(?:^|\s)(?:[-–—•*·▪◦‣](?=\s+[^\W\d_]{2})|\(?(?:\d{1,3}°?|[a-z]|[ivx]{1,5})\)(?=\s*\S)|\d{1,3}°(?=\s*\S))")
NUMBER = re.compile(r"(?:^|\s)\(?(\d{1,3})[.)°](?=[)°]?\s*\S)")
NO_DIGIT = re.compile(r"\D+")
STOP = re.compile(r"[.;!?:](?:\s|$)")
TAG = re.compile(r"</?t[a-z]{0,5}\b[^>]*>")
VOWEL = re.compile(r"[aeiouyàâäáãåæéèêëíîïìóôöòõøœúùûü]")
SENTENCE_END = (".", "!", "?", ":", ";", ",", "»", "…")
STATS = ["n_chars", "n_lines", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "share_lines_punctuated", "share_common_words", "share_bullets", "share_cells", "share_leaders", "words_per_line", "share_short_words", "share_no_vowel", "share_repeated_words", "longest_token", "words_per_sentence", "share_prose_lines", "share_marks", "share_full_lines", "share_single_signs", "ends_in_stop", "share_matched_ends"]


def counting(text: str) -> int:
    """How far the text counts its entries: 1. 2. 3. ..."""
    k = 0
    for m in NUMBER.finditer(text):
        k += int(m[1]) == k + 1
    return k if k > 2 else 0


def statistics(text: str, common: frozenset[str]) -> list[float]:
    """The values of STATS."""
    lines = [x for x in text.split("\n") if x.strip()]
    words = WORDS.findall(TAG.sub(" ", text) if "<" in text else text)
    n, nl, nc = len(words), max(1, len(lines)), max(1, len(text) - text.count(" ") - text.count("\n"))
    if not lines:
        return [float(len(text))] + [0.0] * (len(STATS) - 1)
    low = [w.lower() for w in words]
    letters = sum(map(len, words))
    digits = len(NO_DIGIT.sub("", text))
    counted = Counter(low)
    nw = max(1, n)
    flow = max(len(x.split()) for x in STOP.split(text))
    tokens = text.split()
    bullets, cells = [bool(BULLET.match(x)) for x in lines], [bool(CELLS.search(x)) for x in lines]
    width = max(map(len, lines))
    first = [x.split(None, 1)[0] for x in lines]
    full = sum(len(x.rstrip()) + 1 + len(y) > width for x, y in zip(lines, first[1:]))
    ends = Counter(x.rstrip()[-1] for x in lines)
    return [
        float(len(text)),
        float(len(lines)),
        float(n),
        letters / nw,
        (nc - letters - digits) / nc,
        digits / nc,
        sum(x.rstrip().endswith(SENTENCE_END) for x in lines) / nl,
        sum(counted[w] for w in counted if w in common) / nw,
        sum(bullets) / nl,
        sum(cells) / nl,
        sum(bool(LEADER.search(x)) for x in lines) / nl,
        n / nl,
        sum(len(w) <= 2 for w in words) / nw,
        sum(n for w, n in counted.items() if len(w) > 2 and not VOWEL.search(w)) / nw,
        1 - len(counted) / nw,
        float(max(map(len, text.split()), default=0)),
        float(flow or 0),
        sum(not b and not c and sum(w in common for w in x.lower().split()) >= 2 for x, b, c in zip(lines, bullets, cells)) / nl,
        max(len(MARK.findall(text)), counting(text)) / nw,
        full / max(1, len(lines) - 1) if len(lines) > 1 else 1.0,
        sum(len(t) == 1 for t in tokens) / max(1, len(tokens)),
        float(text.rstrip()[-1:] in ".!?»"),
        max(ends[c] for c in ends) / nl,
    ]


def weak_label(s: dict[str, float]) -> str | None:
    """What plain structure says about a text; None where it says nothing clear."""
    if s["n_words"] == 0 or s["share_no_vowel"] > 0.4 or s["share_leaders"] > 0.6 or s["symbol_ratio"] > 0.6:
        return "junk"
    if s["share_cells"] < 0.5 and (s["digit_ratio"] > 0.7 or s["longest_token"] > 80):
        return "junk"
    if s["n_chars"] >= 20 and (s["share_single_signs"] > 0.7 or s["share_cells"] < 0.5 and (s["mean_word_length"] < 2.9 or s["share_single_signs"] > 0.4 and s["share_bullets"] < 0.5)):
        return "junk"
    if s["n_lines"] >= 3 and s["share_cells"] >= 0.75 and 0.05 < s["digit_ratio"] < 0.75:
        return "table"
    if s["n_lines"] >= 3 and s["share_bullets"] >= 0.75 and s["words_per_line"] < 9 or s["n_lines"] < 3 and s["share_marks"] > 0.1 and s["n_words"] >= 6:
        return "list"
    if s["n_lines"] >= 4 and s["words_per_line"] < 7 and s["share_full_lines"] < 0.6 and s["ends_in_stop"] == 0 and s["mean_word_length"] > 3.5 and s["share_cells"] < 0.2:
        return "list"
    running = s["n_lines"] <= 2 or s["share_full_lines"] > 0.7 or s["words_per_line"] > 9
    if running and s["share_common_words"] > 0.2 and s["n_words"] >= 20 and s["mean_word_length"] > 3.5 and s["share_marks"] < 0.03 and s["share_cells"] < 0.3 and s["share_no_vowel"] < 0.1:
        return "prose"
    if s["n_lines"] <= 2 and 4 <= s["n_words"] < 20 and s["ends_in_stop"] == 1 and s["mean_word_length"] > 3.5 and s["share_no_vowel"] < 0.2 and s["share_marks"] == 0:
        return "prose"
    return None


class Trees:
    """Gradient-boosted regression trees for several classes on a histogram of each feature."""

    def __init__(self, trees: list[list[tuple]], base: np.ndarray, scale: float = 1.0, shift: np.ndarray | None = None):
        self.trees, self.base, self.scale, self.shift = trees, base, scale, np.zeros(len(base)) if shift is None else shift

    @staticmethod
    def _grow(x, edges, g, h, depth):
        """A tree as nested tuples (feature, threshold, left, right) or a leaf value."""
        if depth == 0 or len(g) < 8:
            return float(np.clip(-g.sum() / (h.sum() + 1.0), -3, 3))
        best = (1e-3, None, None)
        top = g.sum() ** 2 / (h.sum() + 1.0)
        for f in range(1, x.shape[1]):  # not the first, the bare size
            at = np.searchsorted(edges[f], x[:, f], side="left")
            gs, hs = (np.bincount(at, v, minlength=len(edges[f]) + 1).cumsum()[:-1] for v in (g, h))
            if len(gs):
                gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - top
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, edges[f][k])
        if best[1] is None:
            return float(np.clip(-g.sum() / (h.sum() + 1.0), -3, 3))
        left = x[:, best[1]] <= best[2]
        return (best[1], float(best[2]), Trees._grow(x[left], edges, g[left], h[left], depth - 1), Trees._grow(x[~left], edges, g[~left], h[~left], depth - 1))

    @staticmethod
    def _apply(tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        left = x[:, tree[0]] <= tree[1]
        return np.where(left, Trees._apply(tree[2], x), Trees._apply(tree[3], x))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, classes: int, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> Trees:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
        share = np.bincount(y, minlength=classes) + 1.0
        weight = (len(y) / (classes * share))[y] ** 0.5
        base = np.log(share / share.sum())
        score = np.tile(base, (len(x), 1))
        out = []
        for _ in range(rounds):
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            step = []
            for c in range(classes):
                g, h = (p[:, c] - (y == c)) * weight, p[:, c] * (1 - p[:, c]) * weight
                t = cls._grow(x, edges, g, h, depth)
                step.append(t)
                score[:, c] += rate * cls._apply(t, x)
            out.append(step)
        return cls(out, base)

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.tile(self.base, (len(x), 1))
        for step in self.trees:
            for c, t in enumerate(step):
                score[:, c] += RATE * self._apply(t, x)
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Temperature and class offsets that minimise the log loss on held-out rows, by gradient descent with decay."""
        raw, one = self.raw(x), np.eye(len(self.base))[y]
        a, b = 0.0, np.zeros(len(self.base))
        for _ in range(400):
            p = self._soft(raw * np.exp(a) + b)
            d = (p - one) / len(x)
            a -= 0.2 * ((d * raw).sum() * np.exp(a) + 0.01 * a)
            b -= 0.5 * (d.sum(axis=0) + 0.2 * b)
        return Trees(self.trees, self.base, float(np.exp(a)), b)

    @staticmethod
    def _soft(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._soft(self.raw(x) * self.scale + self.shift)

    def parts(self) -> tuple:
        return self.trees, self.base, self.scale, self.shift


def fit(texts: list[str], common: frozenset[str]) -> Trees:
    from tesselle.llm.quality_holdout import HOLDOUT

    rows, labels = [], []
    for t in texts:
        s = statistics(t, common)
        label = weak_label(dict(zip(STATS, s)))
        if label:
            rows.append(s)
            labels.append(FORMS.index(label))
    hx = np.array([statistics(t, common) for _, t in HOLDOUT])
    hy = np.array([FORMS.index(f) for f, _ in HOLDOUT])
    for form in set(range(len(FORMS))) - set(labels):  # a corpus that lacks a form: made-up texts of that form stand in
        for t in stand_ins(FORMS[form]):
            rows.append(statistics(t, common))
            labels.append(form)
    return Trees.fit(np.array(rows), np.array(labels), len(FORMS)).calibrate(hx, hy)


def stand_ins(form: str, n: int = 40) -> list[str]:
    """Made-up texts of a form, by rule."""
    rng = np.random.default_rng(11)
    words = "la route du nord et le pont de la ville sont à la charge de toute personne qui garde the house of the town is kept by a clerk".split()
    say = lambda k: " ".join(rng.choice(words, k))
    if form == "prose":
        return [say(int(rng.integers(25, 90))).capitalize() + "." for _ in range(n)]
    if form == "list":
        return ["\n".join(f"{mark} {say(3)} ;" for _ in range(int(rng.integers(4, 12)))) for mark in "-•–" for _ in range(n // 3)] + ["\n".join(f"{i + 1}. {say(3)}" for i in range(6)) for _ in range(n // 3)]
    if form == "table":
        return ["\n".join(f"| {rng.integers(1, 99)} | {say(2)} | {rng.integers(10, 9999)} |" for _ in range(int(rng.integers(3, 9)))) for _ in range(n)]
    return [" ".join("".join(rng.choice(list("bcdfghjkqz"), 5)) for _ in range(14)) for _ in range(n // 2)] + ["".join(rng.choice(list("0123456789/.-\n"), 80)) for _ in range(n // 2)]


def common_set(common_words: DataFrame, most: int = 100_000) -> frozenset[str]:
    """The words of the table of function words; a table of more than ``most`` is refused."""
    return frozenset(r["word"].lower() for r in bounded(common_words.select("word").where("word is not null").distinct(), most, "common_words"))


def train(articles: DataFrame, common: frozenset[str], sample: int = SAMPLE) -> Trees:
    return fit(sample_texts(articles.select("content"), sample), common)


def judge(articles: DataFrame, common_words: DataFrame, model: Trees | None = None) -> DataFrame:
    """(article_id, the STATS, form, confidence) of every article with a content."""
    common = common_set(common_words)
    model = model or train(articles, common)
    shared = articles.sparkSession.sparkContext.broadcast((model.parts(), common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, words = shared.value
        trees = Trees(*parts)
        for b in batches:
            texts = b.column(1).to_pylist()
            if not texts:
                continue
            x = np.array([statistics(t, words) for t in texts])
            p = trees.probabilities(x)
            blank = x[:, STATS.index("n_words")] == 0
            p[blank] = np.eye(len(FORMS))[FORMS.index("junk")]
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c) for c in x.T), pa.array([FORMS[k] for k in best]), pa.array(p.max(axis=1))], names=["article_id", *STATS, "form", "confidence"])

    schema = "article_id bigint, " + ", ".join(f"{s} double" for s in STATS) + ", form string, confidence double"
    return articles.select("id", "content").where("id is not null and content is not null").mapInArrow(run, schema).dropDuplicates(["article_id"])


def found(articles: DataFrame, common_words: DataFrame) -> DataFrame:
    return judge(articles, common_words).where("form <> 'prose'").select(F.col("article_id").cast("int").alias("article_id"), "form")
