"""Furniture of printed pages inside a text: running heads and page numbers on lines of their own.

Running heads are learned from the corpus: a line that recurs in many records, is no sentence, and stands next to a page
number (or carries one) far more often than prose does. Heads damaged in scanning still match within two edits.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How a page number is printed.
PAGE = r"(?:[-–—]\s?\d{1,4}\s?[-–—]|\[\d{1,4}\]|p\.\s?\d{1,4}|page\s\d{1,4}(?:\s?/\s?\d{1,4})?|\d{1,4}(?:\s\.)?)"
PAGE_LINE = re.compile(rf"\s*{PAGE}\s*", re.I)
PAGE_END = re.compile(rf"(?:\s{{2,}}|\t){PAGE}\s*$", re.I)
ISSUE_END = re.compile(r"\s*[/—–-]\s*(?:n\S?\s*)?\d+\s*$", re.I)

MIN_RECORDS = 5
MIN_PAGED = 0.3


def key(line: str) -> str:
    plain = line if line.isascii() else unicodedata.normalize("NFD", line)
    return "".join(c for c in plain if c.isalpha()).upper()


def head_key(line: str) -> tuple[str, bool]:
    """Letters of the line without issue and page, and whether it carries a page number."""
    bare = PAGE_END.sub("", line)
    return key(ISSUE_END.sub("", bare)), bare != line


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, paged = Counter(), Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            lines = [x.strip() for x in text.split("\n")]
            lines = [x for x in lines if x]
            mine: dict[str, bool] = {}
            for i, x in enumerate(lines):
                if not (12 <= len(x) <= 90) or not x[0].isupper() or x[-1] in ".;:,!?-¬\xad" or len(x.split()) < 3:
                    continue
                bare = PAGE_END.sub("", x)
                page, title = bare != x, ISSUE_END.sub("", bare)
                k = key(title)
                if len(k) < 12 or "|" in title or any(c.isdigit() for c in title):
                    continue
                near = page or (i and PAGE_LINE.fullmatch(lines[i - 1])) or (i + 1 < len(lines) and PAGE_LINE.fullmatch(lines[i + 1]))
                mine[k] = mine.get(k, False) or bool(near)
            for k, near in mine.items():
                seen[k] += 1
                paged[k] += near
        if len(seen) > 200_000:
            yield _rows(seen, paged)
            seen, paged = Counter(), Counter()
    yield _rows(seen, paged)


def _rows(seen: Counter, paged: Counter) -> pa.RecordBatch:
    ks = list(seen)
    return pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), pa.array([seen[k] for k in ks], pa.int64()), pa.array([paged[k] for k in ks], pa.int64())], names=["k", "n", "p"])


def learn_titles(texts: DataFrame) -> list[str]:
    """Keys of the running heads of the printed volumes, from all texts of one column, without the rarer spellings of a commoner one."""
    c = texts.toDF("t").where("t like '%\n%'").mapInArrow(_candidates, "k string, n bigint, p bigint")
    # far beyond what a line of prose gets by chance, one in twenty
    c = c.groupBy("k").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).where(f"n >= {MIN_RECORDS} and p >= {MIN_PAGED} * n and p >= 0.05 * n + 0.5 * sqrt(n) + 1.5")
    titles = Heads()
    for r in sorted(c.collect(), key=lambda r: (-r["n"], r["k"])):
        if not titles.like(r["k"]):
            titles.add(r["k"])
    return list(titles.all)


def _within(a: str, b: str, most: int) -> bool:
    """Edit distance of at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


class Heads:
    """Running heads, found by spellings within two edits that begin or end alike: one third of such a head stands unharmed
    in the spelling, at most two places from its own."""

    def __init__(self, titles: list[str] = ()):
        self.all: dict[str, None] = {}
        self.lengths, self.starts, self.ends = set(), set(), set()
        self.thirds: dict[tuple[int, int, str], list[str]] = defaultdict(list)
        for t in titles:
            self.add(t)

    @staticmethod
    def _cuts(n: int) -> list[tuple[int, int, int]]:
        return [(0, 0, n // 3), (1, n // 3, 2 * n // 3), (2, 2 * n // 3, n)]

    def add(self, t: str) -> None:
        if t not in self.all:
            self.all[t] = None
            self.lengths.add(len(t))
            self.starts.add(t[:3])
            self.ends.add(t[-3:])
            for j, a, b in self._cuts(len(t)):
                self.thirds[len(t), j, t[a:b]].append(t)

    def like(self, k: str) -> bool:
        """Whether k is a head or such a spelling of one."""
        if k in self.all:
            return True
        if k[:3] not in self.starts and k[-3:] not in self.ends:
            return False
        tried = set()
        for n in range(len(k) - 2, len(k) + 3):
            if n not in self.lengths:
                continue
            for j, a, b in self._cuts(n):
                for d in range(-2, 3):
                    if a + d < 0 or b + d > len(k):
                        continue
                    for t in self.thirds.get((n, j, k[a + d : b + d]), ()):
                        if t not in tried and (k[:3] == t[:3] or k[-3:] == t[-3:]):
                            tried.add(t)
                            if _within(k, t, 2):
                                return True
        return False


class Furniture:
    """Tells running heads and page numbers from text, line by line."""

    def __init__(self, titles: list[str]):
        self.heads, self.cache = Heads(titles), {}
        self.longest = 1.5 * max(map(len, titles), default=0) + 24

    def kinds(self, line: str) -> tuple[str, ...]:
        """() for text; else header, page_number or both."""
        if len(line) > self.longest:
            return ()
        got = self.cache.get(line)
        if got is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            got = self.cache[line] = self._kinds(line)
        return got

    def _kinds(self, line: str) -> tuple[str, ...]:
        if PAGE_LINE.fullmatch(line):
            return ("page_number",)
        if not (12 <= len(line) <= self.longest):
            return ()
        k, page = head_key(line.strip())
        if self.heads.like(k):
            return ("header", "page_number") if page else ("header",)
        return ()
