"""Problem 10: text decoded with the wrong character encoding.

A multinomial classifier over hashed byte bigrams of words names the encoding chain that spoilt a word. It
is trained on words of the corpus itself, spoilt on purpose through every chain of ``CHAINS``, against the same words
left alone. A chain is accepted for a word when the chain inverts it strictly (every character encodes, the bytes
decode without error) and the restored word reads better under the clean words' character model; otherwise the next
ranked chain is tried until the classifier prefers "clean". The replacement sign U+FFFD marks a loss that cannot be restored.

The classifier is fitted on all texts of the corpus, each once, and cleans them in ``ROUNDS`` rounds, dropping texts it finds
garbled. A text is kept as its set of words beyond ASCII; a round counts, by a shuffle of words, how many sound texts hold
each. Weights and character table are sums over the words, and only these sums (whole numbers, so their order doesn't matter) reach the driver.
Every text is then judged whole, in one pass without a shuffle. Weights (classes x 2^12) and characters (2^16) that are broadcast have a fixed size.
An attested word stays as it is: for the words that the weights alone would restore, the counts of both spellings are joined,
and the pairs refused (64 bits of hash each) are broadcast as well; beyond ``REFUSED`` of them is an error, never a cut.

Defined results for awkward input: null and empty texts are not garbled; repeated rows count once; an empty table gives an
empty result; extra columns are ignored; ASCII words are never judged, so very long texts cost one scan.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.session import TooLarge, cut, cut_table

ROUNDS = 3
ATTESTED = 3
REFUSED = 8_000_000
HELD = 300_000
SUMMERS = 64
BUCKETS = 1 << 12
MARGIN = 2.0
TOKEN = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")

# Fixed values: (encoding the text was written in, encoding it was read in), applied in order.
CHAINS = {
    "utf8>cp1252": [("utf-8", "cp1252")],
    "utf8>latin1": [("utf-8", "latin-1")],
    "utf8>cp1252 twice": [("utf-8", "cp1252"), ("utf-8", "cp1252")],
    "utf8>latin1 twice": [("utf-8", "latin-1"), ("utf-8", "latin-1")],
    "utf8>mac_roman": [("utf-8", "mac_roman")],
    "utf8>cp850": [("utf-8", "cp850")],
    "utf8>cp437": [("utf-8", "cp437")],
    "utf8>cp1251": [("utf-8", "cp1251")],
    "utf8>cp1250": [("utf-8", "cp1250")],
    "utf8>iso8859_15": [("utf-8", "iso8859_15")],
    "cp1252>cp437": [("cp1252", "cp437")],
    "cp1252>cp850": [("cp1252", "cp850")],
    "cp1252>mac_roman": [("cp1252", "mac_roman")],
    "cp1252>cp1251": [("cp1252", "cp1251")],
    "cp1252>cp1250": [("cp1252", "cp1250")],
    "cp850>cp1252": [("cp850", "cp1252")],
    "cp437>cp1252": [("cp437", "cp1252")],
    "mac_roman>cp1252": [("mac_roman", "cp1252")],
}
NAMES = ["clean", *CHAINS]


def _decode(raw: bytes, enc: str) -> str:
    """Bytes without a character in the encoding become the control character of the same number, as browsers read them."""
    try:
        return raw.decode(enc)
    except UnicodeDecodeError:
        return "".join(_one(b, enc) for b in raw)


def _one(b: int, enc: str) -> str:
    try:
        return bytes([b]).decode(enc)
    except UnicodeDecodeError:
        return chr(b)


def _encode(text: str, enc: str) -> bytes:
    try:
        return text.encode(enc)
    except UnicodeEncodeError:
        return b"".join(c.encode(enc) if _can(c, enc) else bytes([ord(c)]) if 0x80 <= ord(c) < 0xA0 else c.encode(enc) for c in text)


def _can(c: str, enc: str) -> bool:
    try:
        c.encode(enc)
        return True
    except UnicodeEncodeError:
        return False


def spoil(text: str, chain: str) -> str | None:
    """The text after the chain; None if it holds a character the chain can't write."""
    try:
        for wrote, read in CHAINS[chain]:
            text = _decode(text.encode(wrote), read)
        return text
    except UnicodeError:
        return None


def restore(text: str, chain: str) -> str | None:
    """The text before the chain; None unless every step decodes strictly."""
    try:
        for wrote, read in reversed(CHAINS[chain]):
            text = _encode(text, read).decode(wrote)
        return text
    except UnicodeError:
        return None


def _bare(token: str) -> str:
    return token.strip(".,;:!?()[]«»\"' ").casefold()


def _features(token: str) -> list[int]:
    raw = b" " + token.encode("utf-8") + b" "
    return [xxhash.xxh32_intdigest(raw[i : i + 2]) % BUCKETS for i in range(len(raw) - 1) if raw[i] > 127 or raw[i + 1] > 127]


def _contexts(word: str) -> list[int]:
    """Slots of the pairs and of the triple around every character beyond ASCII, in the character table."""
    s = f" {word} "
    out = []
    for i in range(1, len(s) - 1):
        if ord(s[i]) > 127:
            out += [xxhash.xxh32_intdigest(x.encode("utf-8")) & 0xFFFF for x in ("<" + s[i - 1 : i + 1], ">" + s[i : i + 2], s[i - 1 : i + 2])]
    return out


def _pair(word: str, back: str) -> int:
    """A hash of two bare words, as a signed number of 64 bits."""
    h = xxhash.xxh64_intdigest(f"{word}\0{back}".encode())
    return h - (1 << 64) if h >> 63 else h


class Model:
    """Multinomial weights by chain, a model of the characters around each other in clean words, and the attested words that are
    left alone: from the number of texts that hold each word beyond ASCII, or as the sorted hashes of the refused pairs."""

    def __init__(self, weights: np.ndarray, table: np.ndarray, known: dict[str, int], refused: np.ndarray | None = None):
        self.weights, self.table, self.known, self.refused, self.cache = weights, table, known, refused, {}

    def parts(self) -> tuple:
        return self.weights, self.table, self.known, self.refused

    def reading(self, word: str) -> float:
        """Log-likelihood of a word's characters beyond ASCII in their surroundings."""
        return float(self.table[_contexts(word)].sum())

    def better(self, word: str, chain: str) -> str | None:
        """The word with the chain undone, if that works strictly and reads better."""
        back = restore(word, chain)
        if back is None or back == word:
            return None
        if self.attested(_bare(word), _bare(back)):
            return None
        return back if self.reading(back) > self.reading(word) + MARGIN else None

    def attested(self, word: str, back: str) -> bool:
        """Whether sound texts hold the word, and no better attested one behind it."""
        if self.refused is None:
            seen = self.known.get(word, 0)
            return seen >= ATTESTED and seen >= self.known.get(back, 0)
        at = np.searchsorted(self.refused, key := _pair(word, back))
        return bool(at < len(self.refused) and self.refused[at] == key)

    def judge(self, token: str) -> tuple[str, str | None]:
        """(chain, restored word); ("clean", None) for a sound word, ("lost", None) beyond restoring."""
        got = self.cache.get(token)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.cache[token] = self._judge(token)
        return got

    def undo(self, token: str, main: str) -> str:
        """The restored word, by the document's main chain where that fits."""
        own, back = self.judge(token)
        if own in ("clean", "lost"):
            return token
        return (main != "lost" and main != own and self.better(token, main)) or back

    def _judge(self, token: str) -> tuple[str, str | None]:
        if "�" in token:
            return "lost", None
        f = _features(token)
        score = self.weights[:, f].sum(axis=1)
        for c in np.argsort(-score, kind="stable"):
            if c == 0:
                return "clean", None
            if (back := self.better(token, NAMES[c])) is not None:
                return NAMES[c], back
        return "clean", None


def _sound(token: str, model: Model | None) -> bool:
    """Whether a text with the word may be learned from: by the model so far, else if no chain of UTF-8 can be undone."""
    if model:
        return model.judge(token)[0] == "clean"
    return "�" not in token and all(restore(token, c) in (None, token) for c in NAMES[1:] if c.startswith("utf8"))


def _sums(words: Iterable[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the features by chain, and of the slots of the character table, over words held by so many texts."""
    counts, table = np.zeros((len(NAMES), BUCKETS), np.int64), np.zeros(1 << 16, np.int64)
    for w, n in words:
        for c, name in enumerate(NAMES):
            bad = w if c == 0 else spoil(w, name)
            if bad is not None and (c == 0 or bad != w):
                np.add.at(counts[c], _features(bad), n)
        np.add.at(table, _contexts(w), n)
    return counts, table


def _logs(counts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts, table = counts + 0.05, table + 0.2
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), np.log(table / table.sum()).astype(np.float32)


def fit(texts: list[str]) -> Model:
    """Trains on the words of sound texts; a text found garbled by the model so far is left out of the next round."""
    model = None
    for _ in range(ROUNDS):
        words: Counter[str] = Counter()
        known: Counter[str] = Counter()
        for t in texts:
            tokens = set(TOKEN.findall(t))
            if all(_sound(w, model) for w in tokens):
                words.update(tokens)
                known.update({_bare(w) for w in tokens})
        model = Model(*_logs(*_sums(words.items())), dict(known))
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, words: the different words beyond ASCII of each text, with a blank between."""
    for b in batches:
        rows = [(h, " ".join(set(TOKEN.findall(t)))) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if not t.isascii()]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.string())], names=["h", "words"])


def _count(shared) -> Callable:
    """bare, word, n: how many sound texts hold a word, and how many its bare form; 0 for words of no sound text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            both = [(x, *kv) for x, c in ((False, words), (True, known)) for kv in c.items()]
            words.clear()
            known.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*both), (pa.bool_(), pa.string(), pa.int64()))], names=["bare", "word", "n"])

        model = Model(*shared.value) if shared.value else None
        words: Counter[str] = Counter()
        known: Counter[str] = Counter()
        seen: dict[str, tuple[bool, str]] = {}
        for b in batches:
            for line in b.column(0).to_pylist():
                tokens = line.split(" ")
                for w in tokens:
                    if w not in seen:
                        seen[w] = _sound(w, model), _bare(w)
                if all(seen[w][0] for w in tokens):
                    words.update(tokens)
                    known.update({seen[w][1] for w in tokens})
                else:
                    words.update(dict.fromkeys(tokens, 0))
                if len(seen) > HELD:
                    seen.clear()
                if len(words) > HELD:
                    yield flush()
        if words:
            yield flush()

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """counts, characters: the sums over the words of a task."""
    counts, table = _sums(x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (counts, table)], names=["counts", "characters"])


def _doubtful(shared) -> Callable:
    """word, back, pair: bare spellings before and after every chain that could be undone in a word which the model, attested words aside, finds garbled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in batches:
            rows = set()
            for w in b.column(0).to_pylist():
                if model.judge(w)[0] not in ("clean", "lost"):
                    word = _bare(w)
                    rows |= {(word, _bare(back), _pair(word, _bare(back))) for c in NAMES[1:] if (back := model.better(w, c)) is not None}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["word", "back", "pair"])

    return run


def train(documents: DataFrame) -> Model:
    """Fits on all different texts, as ``fit`` does on a list."""
    sc = documents.sparkSession.sparkContext
    texts = documents.where("text is not null").select(F.xxhash64("text").alias("h"), "text")
    bags = cut_table(texts.mapInArrow(_bags, "h bigint, words string").dropDuplicates(["h"]).select("words"))
    none = np.zeros(0, np.int64)
    model = None
    for _ in range(ROUNDS):
        counts = cut(bags.mapInArrow(_count(sc.broadcast(model and model.parts())), "bare boolean, word string, n bigint").groupBy("bare", "word").agg(F.sum("n").alias("n")))
        words = counts.where("not bare").select("word", "n").repartition(min(SUMMERS, sc.defaultParallelism))
        sums = words.where("n > 0").mapInArrow(_sum, "counts binary, characters binary").collect()
        total = [sum((np.frombuffer(zlib.decompress(r[k]), np.int64) for r in sums), np.zeros(size, np.int64)) for k, size in ((0, len(NAMES) * BUCKETS), (1, 1 << 16))]
        parts = *_logs(total[0].reshape(-1, BUCKETS), total[1]), {}
        pairs = words.select("word").mapInArrow(_doubtful(sc.broadcast((*parts, none))), "word string, back string, pair bigint").distinct()
        held = counts.where(f"bare and n >= {ATTESTED}").select("word", "n")
        refused = pairs.join(held, "word").join(held.toDF("back", "there"), "back", "left").where("n >= coalesce(there, 0)").select("pair").distinct()
        refused = cut(refused)
        if refused.count() > REFUSED:
            raise TooLarge(f"attested words that read as garbled: more than {REFUSED} pairs")
        model = Model(*parts, np.sort(refused.toArrow().column(0).to_numpy()))
    return model


def repair(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, chains, words, lost, restored) of every garbled document: the chains met, how many words
    are garbled and how many of them lost, and the text with every restorable word put right."""
    model = model or train(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        judge = model.judge
        for b in batches:
            rows = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text.isascii():
                    continue
                chains = Counter(judge(w)[0] for w in TOKEN.findall(text))
                del chains["clean"]
                if chains:
                    main = chains.most_common(1)[0][0]
                    fixed = TOKEN.sub(lambda m: model.undo(m.group(), main), text)
                    rows.append((d, sorted(chains), sum(chains.values()), chains["lost"], fixed))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())],
                    names=["doc_id", "chains", "words", "lost", "restored"],
                )

    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    return docs.mapInArrow(run, "doc_id bigint, chains array<string>, words bigint, lost bigint, restored string").distinct()


def found(documents: DataFrame) -> DataFrame:
    return repair(documents).select("doc_id").distinct()
