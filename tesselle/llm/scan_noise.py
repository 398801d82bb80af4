"""Problem 1: noise of scanned pages - cut words, misread characters, running heads, page numbers - and its repair.

1. Running heads are learned from all texts (``pages``); heads and page numbers on lines of their own are furniture.
2. All words of the running text are counted over the whole corpus.
3. Every word type gets an anagram hash, the sum of its characters' hashes. A confusion (m read as rn) shifts it by a
   fixed difference, so rare types are joined with frequent ones on hash minus difference, in SQL, for one and for two
   confusions; the spelling is then verified and the variants ranked by frequency. A variant of letters alone that is
   commoner than one in RATIO is a misreading only if it keeps to the records that show other signs of scanning.
4. A word cut at a line end is joined again, unless the corpus writes it with its own hyphen more often than without.
5. One pass over the texts strips the furniture, joins cut words and lines, and applies the corrections.

Lists, tables and junk (by structure) are left as they are. Corrections and hyphened compounds are broadcast only while their
counted rows stay under ``BROADCAST_ROWS``; beyond that the words and cut words of each record are joined with them by a shuffle.

Defined results for awkward input: null and empty texts have no noise; repeated rows count once; an empty table gives an
empty result; extra columns are ignored; very long texts are read whole; words of equal rank go to the alphabetically first correction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselle.llm.pages import Furniture, learn_titles
from tesselle.session import cut

BROADCAST_ROWS = 200_000
MIN_FREQUENT = 8
RATIO = 1000
LEAST_EVIDENCE = 7.0  # log of the odds

# Fixed values: (as printed, as read).
CONFUSIONS = [
    ("e", "c"), ("é", "c"), ("t", "†"), ("n", "ri"), ("i", "!"), ("a", "@"), ("o", "0"), ("s", "5"), ("u", "ii"), ("l", "1"), ("l", "i"), ("g", "q"),
    ("m", "rn"), ("d", "cl"), ("é", "6"), ("e", "6"), ("v", "\\/"), ("t", "l"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("h", "li"), ("é", "e"), ("é", "e'"), ("è", "e'"), ("è", "e"), ("c", "("), ("i", "1"),
    ("i", "l"), ("b", "6"), ("g", "9"), ("z", "2"), ("s", "$"), ("l", "|"), ("i", "|"), ("e", "€"), ("w", "vv"), ("b", "8"), ("ô", "0"), ("à", "@"), ("â", "@"), ("î", "!"), ("è", "6"), ("ê", "6"), ("è", "c"), ("ê", "c"),
]

SIGNS = r"[0-9!@†(€$|/ﬁﬂ’'\\]"
HYPHENS = "-‐‑\xad¬"
INNER = re.compile(r"[^\W\d_][0-9!@†€$|][^\W\d_]")
CUT = re.compile(rf"([^\W\d_]+)[{HYPHENS}]\s*$")
START = re.compile(r"[^\W\d_]+")
STRIP = ".,;:?«»\"“”[]–—…*"
# What French elides before an apostrophe.
ELIDED = re.compile(r"(?:[cdjlmnst]|qu|lorsqu|puisqu|jusqu|quoiqu|presqu)['’]", re.I)
OWNED = re.compile(r"['’]s?$")
LETTER = re.compile(r"[^\W\d_]")
BULLET = re.compile(r"\s*(?:[-–—•*·▪]\s+\S|\(?(?:\d{1,3}|[a-z]|[ivx]{1,5})[.)°]\s*\S)")
CELL = re.compile(r"\||\t|<t[dhr]\b|\S {2,}\S.* {2,}\S|\S;\S[^;]*;\S")
VOWEL = re.compile(r"[aeiouyàâäáãåéèêëíîïóôöúùûü]", re.I)


def is_running(lines: list[str]) -> bool:
    """Whether the lines are running text rather than a list, a table or junk."""
    if not lines:
        return False
    n = len(lines)
    if sum(bool(BULLET.match(x)) for x in lines) > 0.5 * n or sum(bool(CELL.search(x)) for x in lines) > 0.5 * n:
        return False
    tokens = " ".join(lines).split()
    words = [t for t in tokens if LETTER.search(t)]
    if len(words) < 0.6 * len(tokens) or sum(map(len, words)) < 3.4 * len(words) or sum(bool(VOWEL.search(w)) for w in words) < 0.6 * len(words) or max(map(len, words)) > 60:
        return False
    if n >= 4 and len(tokens) < 7 * n:  # short lines: text fills its measure, entries don't
        width = max(map(len, lines))
        full = sum(len(x.rstrip()) + 1 + len(y.split(None, 1)[0]) > width for x, y in zip(lines, lines[1:]))
        return full > 0.5 * (n - 1) or lines[-1].rstrip()[-1:] == "."
    return True


class Page:
    """A text taken apart: kinds of furniture found, paragraphs of remaining lines, and the words cut between lines."""

    def __init__(self, text: str, furniture: Furniture):
        self.kinds: set[str] = set()
        self.lines: list[tuple[str, bool]] = []  # (line, whether a paragraph begins)
        blank = torn = False
        for raw in text.split("\n"):
            line = raw.strip()
            if not line:
                blank = True
                continue
            kinds = furniture.kinds(line)
            if kinds:
                self.kinds.update(kinds)
                torn = True
                continue
            before = self.lines[-1][0] if self.lines else ""
            begins = not before or blank and not (torn and before[-1] not in ".!?:;»")
            self.lines.append((line, begins))
            blank = torn = False

    def running(self) -> bool:
        return is_running([x for x, _ in self.lines])

    def cuts(self) -> Iterator[tuple[int, str, str]]:
        """(line, first part, second part) of every word cut at the end of that line."""
        for i in range(len(self.lines) - 1):
            a, b = self.lines[i][0], self.lines[i + 1][0]
            if a[-1] in HYPHENS and (m := CUT.search(a)) and (s := START.match(b)) and (s[0][0].islower() or m[1].isupper()):
                yield i, m[1], s[0]


def span(token: str) -> tuple[int, int]:
    """Where the word lies in a token between blanks: without outer punctuation, elided article and possessive."""
    core = token.lstrip(STRIP + "(")
    start = len(token) - len(core)
    core = core.rstrip(STRIP + ")'’")
    if m := ELIDED.match(core):
        start, core = start + m.end(), core[m.end() :]
    return start, start + len(OWNED.sub("", core))


def word(token: str) -> str:
    a, b = span(token)
    return token[a:b].lower()


def tokens(text: str) -> list[str]:
    return [w for t in text.split() if len(w := word(t)) > 1 and LETTER.search(w)]


def _count(titles):
    def rows(raw: Counter[str], plain: Counter[str], marked: Counter[str]) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {}
        for t, n in raw.items():
            if len(w := word(t)) > 1 and LETTER.search(w):
                c = counts.setdefault(w, [0, 0, 0])
                c[0] += n
                c[1] += plain[t] + marked[t]
                c[2] += marked[t]
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(3))], names=["w", "n", "r", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        furniture = Furniture(titles.value)
        raw, plain, marked = Counter(), Counter(), Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                scanned = False
                if "\n" in text:
                    page = Page(text, furniture)
                    lines = [x for x, _ in page.lines]
                    scanned = bool(page.kinds)
                    for i, first, second in page.cuts():  # cut words are no evidence
                        lines[i] = CUT.sub("", lines[i])
                        lines[i + 1] = lines[i + 1][len(second) :]
                        scanned = True
                    text = " ".join(lines)
                found = text.split()
                raw.update(found)
                (marked if scanned or INNER.search(text) else plain).update(set(found))
            if len(raw) > 500_000:
                yield rows(raw, plain, marked)
                raw, plain, marked = Counter(), Counter(), Counter()
        yield rows(raw, plain, marked)

    return run


def count_words(texts: DataFrame, titles) -> DataFrame:
    """(w, n, r, m) over all text but the furniture and cut words of all records: occurrences, records (once a spelling with
    its punctuation) and those among them that show signs of scanning."""
    sums = [F.sum(c).alias(c) for c in "nrm"]
    return texts.select("content").mapInArrow(_count(titles), "w string, n bigint, r bigint, m bigint").groupBy("w").agg(*sums)


def _sum_hash(w: str) -> str:
    return f"aggregate(transform(split({w}, ''), c -> if(c = '', 0L, pmod(xxhash64(c), 1099511627776L))), 0L, (s, x) -> s + x)"


def corrections(types: DataFrame) -> DataFrame:
    """(wrong, w): the best frequent variant of every rare type within one or two confusions, by anagram hashes."""
    spark = types.sparkSession
    table = spark.createDataFrame(CONFUSIONS, "good string, bad string")
    diffs = table.selectExpr("good", "bad", f"{_sum_hash('bad')} - {_sum_hash('good')} as d")
    steps = F.array(*[F.struct(F.lit(r["good"]).alias("good"), F.lit(r["bad"]).alias("bad"), F.lit(r["d"]).alias("d")) for r in diffs.collect()])
    freq = types.where((F.col("n") >= MIN_FREQUENT) & ~F.col("w").rlike(SIGNS)).selectExpr("w as g", "n as ng", "r as rg", "m as mg", f"{_sum_hash('w')} as h")
    top = types.agg(F.max("n")).first()[0] or 0
    rare = types.where(F.col("n") * 4 <= top).where("length(w) > 1").selectExpr("w as wrong", "n", "r", "m", f"{_sum_hash('w')} as h0")
    rare = rare.repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), "wrong")  # small rows that multiply
    rare = rare.withColumn("p", F.filter(steps, lambda x: F.instr(F.col("wrong"), x["bad"]) > 0))

    def undone(w: str, x: str, v: str, then: str) -> str:
        """Whether some way to undo confusion x in w makes ``then`` true of the word v that results."""
        made = f"concat(substring({w}, 1, i - 1), {x}.good, substring({w}, i + length({x}.bad)))"
        ways = f"transform(filter(sequence(1, length({w})), i -> substring({w}, i, length({x}.bad)) = {x}.bad), i -> {made})"
        return f"exists({ways}, {v} -> {then})"

    one = rare.select("wrong", "n", "r", "m", "h0", F.explode("p").alias("x")).withColumn("h", F.expr("h0 - x.d")).join(freq, "h")
    one = one.where(undone("wrong", "x", "v", "v = g")).select("wrong", "n", "r", "m", "g", "ng", "rg", "mg", F.lit(1).alias("done"))
    two = rare.where("length(wrong) > 4").select("wrong", "n", "r", "m", "h0", "p", F.posexplode("p").alias("k", "x"))
    two = two.select("wrong", "n", "r", "m", "h0", "x", F.explode(F.expr("slice(p, k + 1, size(p) - k)")).alias("y")).withColumn("h", F.expr("h0 - x.d - y.d")).join(freq, "h")
    two = two.where(undone("wrong", "x", "v", undone("v", "y", "u", "u = g"))).select("wrong", "n", "r", "m", "g", "ng", "rg", "mg", F.lit(2).alias("done"))
    usual = F.expr(f"n <= 2 + ng / {RATIO} + 2 * sqrt(ng / {RATIO})") | F.col("wrong").rlike(SIGNS)
    links = cut(one.union(two).where("wrong <> g and n * 4 <= ng").withColumn("usual", usual))
    # Beyond that it is judged by its records: are as many of them scanned as of misread words', or as of the right word's?
    m, r = links.where("usual").groupBy("wrong").agg(F.max("m").alias("m"), F.max("r").alias("r")).agg(F.sum("m"), F.sum("r")).first()
    share, base = (9 + (m or 0)) / (10 + (r or 0)), "greatest(0.001, least(0.999, mg / rg))"
    odds = f"m * ln({share} / {base}) + (r - m) * ln({1 - share} / (1 - {base}))"
    links = links.where(f"usual or ({share} > {base} and {odds} >= {LEAST_EVIDENCE})")
    best = links.groupBy("wrong").agg(F.min_by("g", F.struct("done", F.negative("ng"), "g")).alias("w"))
    return best


def compounds(types: DataFrame) -> DataFrame:
    """(w): types written with their own hyphen inside a line more often than without."""
    c = types.where("w rlike '^[^-]+-[^-]+$' and n >= 2").selectExpr("w", "n", "replace(w, '-', '') as j")
    return c.join(types.selectExpr("w as j", "n as nj"), "j", "left").where("n > coalesce(nj, 0)").select("w")


def _mend(titles, right, hyphened, fixes_inside: bool, with_text: bool):
    """Kinds of noise, and the repaired text if asked for (else only records with noise), of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        furniture, known, own = Furniture(titles.value), right.value, hyphened.value
        sound: dict[str, bool] = {}

        def is_wrong(token: str) -> bool:
            got = sound.get(token)
            if got is None:
                if len(sound) > 500_000:
                    sound.clear()
                got = sound[token] = word(token) in known
            return got

        for b in batches:
            rows = []
            cols = [c.to_pylist() for c in b.columns]
            for k, (t, i, text) in enumerate(zip(*cols[:3])):
                kinds: set[str] = set()
                fixed = text
                if fixes_inside:
                    known, own, sound = dict(cols[3][k] or ()), set(cols[4][k] or ()), {}
                if "\n" in text:
                    page = Page(text, furniture)
                    kinds, lines = set(page.kinds), [x for x, _ in page.lines]
                    joined: set[int] = set()
                    for at, first, second in page.cuts():
                        joined.add(at)
                        if f"{first}-{second}".lower() in own:  # a compound broken at its own hyphen
                            lines[at] = lines[at][:-1] + "-"
                        else:
                            kinds.add("hyphen")
                            lines[at] = lines[at][:-1]
                    fixed = "".join(line if at == 0 or at - 1 in joined else ("\n\n" if begins else " ") + line for at, (line, (_, begins)) in enumerate(zip(lines, page.lines)))
                if any(map(is_wrong, fixed.split())):
                    kinds.add("misread")
                    fixed = re.sub(r"\S+", lambda m: _swap(m.group(), known) if is_wrong(m.group()) else m.group(), fixed)
                if (kinds or with_text and "\n" in text) and t != "law" and not Page(text, furniture).running():
                    kinds, fixed = set(), text
                if kinds or with_text:
                    rows.append((t, i, sorted(kinds), fixed if with_text else None))
            if rows:
                x = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.string()), pa.array(x[1], pa.int64()), pa.array(x[2], pa.list_(pa.string())), pa.array(x[3], pa.string())], names=["record_type", "record_id", "noise", "text"])

    return run


def _swap(token: str, known: dict[str, str]) -> str:
    a, b = span(token)
    core = token[a:b]
    good = known.get(core.lower())
    if good is None:
        return token
    shaped = good.upper() if core.isupper() and len(core) > 1 else good[:1].upper() + good[1:] if core[:1].isupper() else good
    return token[:a] + shaped + token[b:]


def _words_of(titles):
    """The distinct words of every record, once cut words are joined with and without their hyphen, and (cut) those cut words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        furniture = Furniture(titles.value)
        for b in batches:
            rows = []
            for t, i, text in zip(*(c.to_pylist() for c in b.columns)):
                page = Page(text, furniture)
                cuts = list(page.cuts())
                joined = {at for at, _, _ in cuts}
                whole = "".join(x[:-1] if at in joined else x + " " for at, (x, _) in enumerate(page.lines))
                kept = "".join(x[:-1] + "-" if at in joined else x + " " for at, (x, _) in enumerate(page.lines)) if cuts else ""
                rows += [(t, i, w, False) for w in {*tokens(whole), *tokens(kept)}]
                rows += [(t, i, w, True) for w in {f"{first}-{second}".lower() for _, first, second in cuts}]
            if rows:
                x = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.string()), pa.array(x[1], pa.int64()), pa.array(x[2], pa.string()), pa.array(x[3], pa.bool_())], names=["record_type", "id", "wrong", "cut"])

    return run


def _small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def records(articles: DataFrame, laws: DataFrame) -> DataFrame:
    """(record_type, id, content) of both tables."""
    return articles.select(F.lit("article").alias("record_type"), F.col("id").cast("bigint").alias("id"), "content").union(laws.select(F.lit("law"), F.col("id").cast("bigint"), "content")).where("id is not null and content is not null")


def mend(articles: DataFrame, laws: DataFrame, with_text: bool = True) -> DataFrame:
    """(record_type, record_id, noise, text): the kinds of noise of every record with a content, and its text repaired
    into continuous paragraphs; lists, tables and junk come back unchanged. Without text only records with noise have a row."""
    spark = articles.sparkSession
    texts = records(articles, laws)
    titles = spark.sparkContext.broadcast(learn_titles(texts.select("content")))
    types = cut(count_words(texts, titles))
    right, own = cut(corrections(types)), cut(compounds(types))
    schema = "record_type string, record_id bigint, noise array<string>, text string"
    if _small(right) and _small(own):
        known = spark.sparkContext.broadcast({r["wrong"]: r["w"] for r in right.collect()})
        hyphened = spark.sparkContext.broadcast(frozenset(r["w"] for r in own.collect()))
        return texts.mapInArrow(_mend(titles, known, hyphened, False, with_text), schema).dropDuplicates(["record_type", "record_id"])
    said = texts.mapInArrow(_words_of(titles), "record_type string, id bigint, wrong string, cut boolean")
    fixes = said.where("not cut").join(right, "wrong").select("record_type", "id", "cut", "wrong", "w")
    broken = said.where("cut").join(own.withColumnRenamed("w", "wrong"), "wrong").select("record_type", "id", "cut", "wrong", F.lit(None).cast("string").alias("w"))
    found_in = (
        fixes.union(broken)
        .groupBy("record_type", "id")
        .agg(F.map_from_entries(F.collect_set(F.when(~F.col("cut"), F.struct("wrong", "w")))).alias("fixes"), F.collect_set(F.when(F.col("cut"), F.col("wrong"))).alias("own"))
    )
    none = spark.sparkContext.broadcast({})
    return texts.join(found_in, ["record_type", "id"], "left").select("record_type", "id", "content", "fixes", "own").mapInArrow(_mend(titles, none, none, True, with_text), schema).dropDuplicates(["record_type", "record_id"])


def found(articles: DataFrame, laws: DataFrame) -> DataFrame:
    noise = mend(articles, laws, with_text=False).select("record_type", F.col("record_id").cast("int").alias("record_id"), F.explode("noise").alias("noise"))
    return noise.distinct()
