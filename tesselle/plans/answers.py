"""Questions, answers and their sources: mentions, citations, snippets, pieces of articles, control of sentences; with the oracle SQL."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselle.functions import legal, text, vectors
from tesselle.operators import links as K
from tesselle.operators import ranking
from tesselle.plans.analytics import A, L, M
from tesselle.plans.retrieval import fold, words
from tesselle.plans.status import _BASE
from tesselle.plans.texts import quoted, values
from tesselle.session import broadcast_if_small, table
from tesselle.sources import tables as T

Q: dict = {}
SQL: dict[str, str] = {}


def q(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- pieces of articles: islands, their choice, their text

_PIECES = f"(SELECT id, law_id, number, order_no, kind, content, split_part(upper(number), '.', 1) AS base FROM {A} WHERE number IS NOT NULL AND law_id IS NOT NULL AND order_no IS NOT NULL)"
_ISL = f"(SELECT *, sum(b) OVER (PARTITION BY law_id, base ORDER BY order_no, id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN contains(number, '.') AND order_no = lag(order_no) OVER w + 1 THEN 0 ELSE 1 END AS b FROM {_PIECES} WINDOW w AS (PARTITION BY law_id, base ORDER BY order_no, id)))"


def _islands(s: SparkSession, d: str) -> DataFrame:
    """Pieces of an article in one island: a number with a suffix right after the piece before it goes on. Grouped by law and number, never by law alone."""
    x = T.articles(s, d, "law_id", "number", "order_no", "kind", "content").where("number is not null and law_id is not null and order_no is not null")
    x = x.withColumn("base", F.split_part(F.upper("number"), F.lit("."), F.lit(1)))
    w = Window.partitionBy("law_id", "base").orderBy("order_no", "id")
    new = ~(F.contains(F.col("number"), F.lit(".")) & F.coalesce(F.col("order_no") == F.lag("order_no").over(w) + 1, F.lit(False)))
    return x.withColumn("island", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


@q(f"""WITH i AS (SELECT law_id, base, island, arg_min(kind, order_no * 1000000 + id) AS kind, bool_or(upper(trim(number, ' ')) = base) AS exact, min(order_no) AS first_no, min(id) AS first_id, count(*) AS pieces FROM {_ISL} GROUP BY 1, 2, 3)
SELECT law_id, base, first_no, pieces FROM (SELECT *, row_number() OVER (PARTITION BY law_id, base ORDER BY CASE WHEN coalesce(kind, 'article') = 'article' THEN 0 ELSE 1 END, CASE WHEN exact THEN 0 ELSE 1 END, first_no, first_id) AS r FROM i) WHERE r = 1""")
def chosen_island(s: SparkSession, d: str) -> DataFrame:
    """Of the islands that carry a number the one to show: a real article, then the exact number, then text order."""
    i = _islands(s, d).groupBy("law_id", "base", "island").agg(F.min_by("kind", F.struct("order_no", "id")).alias("kind"), F.max(F.upper(F.trim("number")) == F.col("base")).alias("exact"), F.min("order_no").alias("first_no"), F.min("id").alias("first_id"), F.count("*").alias("pieces"))
    rank = F.struct((F.coalesce("kind", F.lit("article")) != "article").alias("a"), (~F.col("exact")).alias("b"), "first_no", "first_id")
    return i.groupBy("law_id", "base").agg(F.min_by(F.struct("first_no", "pieces"), rank).alias("r")).select("law_id", "base", "r.first_no", "r.pieces")


def rejoin(pieces: Column) -> Column:
    """The texts of an article's pieces as one: from each further piece the longest beginning it shares with the first, up to a line end, is dropped."""
    first = F.coalesce(F.get(pieces, F.lit(0)), F.lit(""))

    def rest(p: Column) -> Column:
        heads = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split(p, "\n")) - 1, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(F.split(p, "\n"), F.lit(1), k), "\n"), F.lit("\n"))), lambda h: F.startswith(F.concat(first, F.lit("\n")), h) & (F.length(h) > 1))
        cut = F.coalesce(F.array_max(F.transform(heads, lambda h: F.length(h))), F.lit(0))
        return F.regexp_replace(F.substr(p, cut + 1, F.length(p)), r"^\s+|\s+$", "")

    parts = F.concat(F.array(F.regexp_replace(first, r"^\s+|\s+$", "")), F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: rest(F.coalesce(p, F.lit("")))))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


JOINED = [(1, "Chapeau.\na) un", "Chapeau.\nb) deux", None, "Chapeau.\na) un\nb) deux"), (2, "Seul", None, None, "Seul"), (3, "A\nB\nx", "A\nB\ny", "z", "A\nB\nx\ny\nz"), (4, "Abc\nd", "Abx\ne", None, "Abc\nd\nAbx\ne")]


@q(f"SELECT id, want AS joined FROM {values([(r[0], r[4]) for r in JOINED], 'id', 'want')}")
def rejoined_pieces(s: SparkSession, d: str) -> DataFrame:
    """Pieces of an article put together again without the head repeated in each; the expected texts are written out in the SQL."""
    x = s.createDataFrame([r[:4] for r in JOINED], "id int, a string, b string, c string")
    return x.select("id", rejoin(F.array_compact(F.array("a", "b", "c"))).alias("joined"))


# ---- mentions and citations


_MEN = f"(SELECT id, conversation_id, unnest(regexp_extract_all(content, '(?i)(?:article|section|art[.]) ([0-9]+)', 1)) AS number FROM {M} WHERE content IS NOT NULL)"
_CITED = f"(SELECT id, CAST(json_extract(j, '$.law_id') AS INTEGER) AS law_id, json_extract_string(j, '$.article_number') AS number, k FROM (SELECT id, unnest(json_extract(sources, '$[*]')) AS j, generate_subscripts(json_extract(sources, '$[*]'), 1) AS k FROM {M} WHERE sources IS NOT NULL AND json_valid(sources)))"


def _cited(s: SparkSession, d: str) -> DataFrame:
    """Every source of every message, not only the first."""
    src = F.from_json("sources", "array<struct<law_id:int,article_number:string>>")
    x = T.messages(s, d, "sources").where("sources is not null").select("id", F.posexplode(src).alias("k", "r"))
    return x.select("id", F.col("r.law_id").alias("law_id"), F.col("r.article_number").alias("number"), (F.col("k") + 1).alias("k"))


@q(f"SELECT DISTINCT m.id, m.number FROM {_MEN} m WHERE NOT EXISTS (SELECT 1 FROM {_CITED} c WHERE c.id = m.id AND {_BASE('c.number')} = m.number)")
def mentions_no_source_carries(s: SparkSession, d: str) -> DataFrame:
    """Article numbers an answer names that none of its sources carries."""
    m = T.messages(s, d, "content").where("content is not null").select("id", F.explode(F.regexp_extract_all("content", F.lit("(?i)(?:article|section|art[.]) ([0-9]+)"), 1)).alias("number")).distinct()
    c = _cited(s, d).select("id", K.base_number(F.col("number")).alias("number"))
    return m.join(c, ["id", "number"], "left_anti")


@q(f"SELECT c.id, c.k, c.law_id, c.number, min(a.id) AS article_id FROM {_CITED} c LEFT JOIN {A} a ON a.law_id = c.law_id AND a.number = c.number GROUP BY 1, 2, 3, 4")
def citations_of_all_sources(s: SparkSession, d: str) -> DataFrame:
    """Every source of every message resolved to an article, or to none."""
    a = table(s, d, "articles").groupBy("law_id", "number").agg(F.min("id").alias("article_id"))
    return _cited(s, d).join(a, ["law_id", "number"], "left").select("id", F.col("k").cast("bigint").alias("k"), "law_id", "number", "article_id")


@q(f"SELECT c.id, c.k, CASE WHEN l.id IS NULL THEN 'unknown text' WHEN l.status IS DISTINCT FROM 'published' THEN 'not published' WHEN a.n IS NULL THEN 'unknown article' ELSE 'held' END AS verdict FROM {_CITED} c LEFT JOIN {L} l ON l.id = c.law_id LEFT JOIN (SELECT law_id, number, count(*) AS n FROM {A} GROUP BY 1, 2) a ON a.law_id = c.law_id AND a.number = c.number")
def citations_refused(s: SparkSession, d: str) -> DataFrame:
    """Why each citation is held or refused."""
    l = T.laws(s, d, "status").withColumnRenamed("id", "law_id").withColumn("there", F.lit(True))
    a = table(s, d, "articles").select("law_id", "number", F.lit(True).alias("held")).distinct()
    x = _cited(s, d).join(l, "law_id", "left").join(a, ["law_id", "number"], "left")
    v = F.when(F.col("there").isNull(), "unknown text").when(~F.col("status").eqNullSafe("published"), "not published").when(F.col("held").isNull(), "unknown article").otherwise("held")
    return x.select("id", F.col("k").cast("bigint").alias("k"), v.alias("verdict"))


@q(f"SELECT c.id, row_number() OVER (PARTITION BY c.id ORDER BY min(c.k)) AS n, c.law_id, c.number, substring(arg_min(a.content, a.id), 1, 80) AS passage FROM {_CITED} c LEFT JOIN {A} a ON a.law_id = c.law_id AND a.number = c.number GROUP BY c.id, c.law_id, c.number")
def numbered_sources(s: SparkSession, d: str) -> DataFrame:
    """A message's distinct sources numbered in order, with the passage the corpus now holds."""
    a = table(s, d, "articles").groupBy("law_id", "number").agg(F.min_by(F.substring("content", 1, 80), "id").alias("passage"))
    g = _cited(s, d).groupBy("id", "law_id", "number").agg(F.min("k").alias("k")).join(a, ["law_id", "number"], "left")
    return g.select("id", F.row_number().over(Window.partitionBy("id").orderBy("k")).alias("n"), "law_id", "number", "passage")


@q(f"SELECT id, state, count(*) AS n FROM (SELECT c.id, CASE WHEN a.n IS NULL THEN 'unresolvable' WHEN EXISTS (SELECT 1 FROM {_MEN} m WHERE m.id = c.id AND m.number = {_BASE('c.number')}) THEN 'cited' ELSE 'read' END AS state FROM {_CITED} c LEFT JOIN (SELECT law_id, number, count(*) AS n FROM {A} GROUP BY 1, 2) a ON a.law_id = c.law_id AND a.number = c.number) GROUP BY 1, 2")
def sources_by_use(s: SparkSession, d: str) -> DataFrame:
    """Sources an answer cites, those it read without citing, and those the corpus does not hold."""
    m = T.messages(s, d, "content").where("content is not null").select("id", F.explode(F.regexp_extract_all("content", F.lit("(?i)(?:article|section|art[.]) ([0-9]+)"), 1)).alias("b")).distinct().withColumn("said", F.lit(True))
    a = table(s, d, "articles").select("law_id", "number", F.lit(True).alias("held")).distinct()
    x = _cited(s, d).withColumn("b", K.base_number(F.col("number"))).join(a, ["law_id", "number"], "left").join(m, ["id", "b"], "left")
    return x.groupBy("id", F.when(F.col("held").isNull(), "unresolvable").when(F.col("said"), "cited").otherwise("read").alias("state")).agg(F.count("*").alias("n"))


@q(f"SELECT a.id AS id_a, b.id AS id_b FROM (SELECT id, hash FROM (SELECT id, string_agg(law_id || ':' || number, ',' ORDER BY law_id, number) AS hash FROM (SELECT DISTINCT id, law_id, number FROM {_CITED}) GROUP BY id)) b JOIN (SELECT hash, min(id) AS id FROM (SELECT id, string_agg(law_id || ':' || number, ',' ORDER BY law_id, number) AS hash FROM (SELECT DISTINCT id, law_id, number FROM {_CITED}) GROUP BY id) GROUP BY hash) a ON a.hash = b.hash WHERE a.id < b.id")
def same_sources(s: SparkSession, d: str) -> DataFrame:
    """Messages that rest on the same set of sources, each beside the first of them."""
    g = _cited(s, d).where("law_id is not null and number is not null").select("id", "law_id", "number").distinct().groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "law_id", "number"))), ",").alias("h"))
    first = g.groupBy("h").agg(F.min("id").alias("id_a"))
    return g.join(first, "h").where("id_a < id").select("id_a", F.col("id").alias("id_b"))


FOREIGN = "(french|german|spanish|belgian|swiss) (law|code|act)|(loi|code|droit) (fran[çc]aise?|allemande?|espagnole?|belge|suisse)"


@q(f"SELECT id, len(regexp_extract_all(lower(content), '{FOREIGN}')) AS n FROM {M} WHERE content IS NOT NULL")
def foreign_law(s: SparkSession, d: str) -> DataFrame:
    return T.messages(s, d, "content").where("content is not null").select("id", F.size(F.regexp_extract_all(F.lower("content"), F.lit(FOREIGN), 0)).cast("bigint").alias("n"))


_KEYW = lambda c: f"array_to_string(list_sort(list_distinct(list_filter({words(c)}, lambda w: length(w) > 3 AND NOT list_contains([{', '.join(quoted(w) for w in text.STOP_WORDS)}], w)))), ' ')"
_NAMES = [(1, "the effluent discharge decree of 2009"), (2, "licence du pilote"), (3, "municipal cadastre law"), (4, "")]


@q(f"SELECT n.id AS name_id, l.id AS law_id FROM {values(_NAMES, 'id', 'x')} n JOIN {L} l ON len(list_filter(string_split({_KEYW('n.x')}, ' '), lambda w: w <> '')) >= 2 AND len(list_filter(string_split({_KEYW('n.x')}, ' '), lambda w: NOT list_contains(string_split({_KEYW('l.title')}, ' '), w) AND NOT regexp_matches(w, '^[0-9]+$'))) = 0")
def texts_by_words(s: SparkSession, d: str) -> DataFrame:
    """Texts whose title holds all content words (at least two) of a name; they meet on the name's first word."""
    n = s.createDataFrame(_NAMES, "name_id int, x string").select("name_id", F.array_sort(text.content_words(F.col("x"))).alias("w")).where("size(w) >= 2").withColumn("w", F.filter("w", lambda v: ~v.rlike("^[0-9]+$")))
    l = T.laws(s, d, "title").where("title is not null").select(F.col("id").alias("law_id"), text.content_words(F.col("title")).alias("t"))
    x = l.select("law_id", "t", F.explode("t").alias("first")).join(broadcast_if_small(n.withColumn("first", F.element_at("w", 1)), 10_000), "first")
    return x.where(F.size(F.array_except("w", "t")) == 0).select("name_id", "law_id").distinct()


@q(f"SELECT k AS key, min(id) AS law_id, count(*) AS texts FROM (SELECT id, {_KEYW('title')} AS k FROM {L} WHERE title IS NOT NULL) GROUP BY 1")
def name_table(s: SparkSession, d: str) -> DataFrame:
    """The dictionary of named texts by their set of content words."""
    x = T.laws(s, d, "title").where("title is not null").select("id", F.array_join(F.array_sort(text.content_words(F.col("title"))), " ").alias("key"))
    return x.groupBy("key").agg(F.min("id").alias("law_id"), F.count("*").alias("texts"))


_GLUED = "(?i)(?:^|[.;:][ ]|\\n)[ ]*(?:article|art[.]) ([0-9]{1,4})[ ]*[.:][ ]*[-–—]"


@q(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(content, '{_GLUED}', 1), lambda n: n IS DISTINCT FROM {_BASE('number')}))), ',') AS others FROM {A} WHERE content IS NOT NULL AND len(list_filter(regexp_extract_all(content, '{_GLUED}', 1), lambda n: n IS DISTINCT FROM {_BASE('number')})) > 0")
def headings_inside_chunks(s: SparkSession, d: str) -> DataFrame:
    """Headings of other articles inside a chunk, each number once."""
    x = T.articles(s, d, "number", "content").where("content is not null").withColumn("own", K.base_number(F.col("number")))
    n = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all("content", F.lit(_GLUED.replace("\\n", "\n")), 1), lambda v: ~v.eqNullSafe(F.col("own")))))
    return x.select("id", F.array_join(n, ",").alias("others")).where("others <> ''")


# ---- sentences, passages, batches

# Abbreviations that do not end a sentence.
ABBREVIATIONS = "art al cf ex n no p pp vol chap sect lit let dr mr mrs mme mlle st etc civ soc crim bull ref".split()
_END = re.compile(r"[.!?…]+[»”\")\]]*(?=\s+[A-ZÀ-Þ«“\"(\[]|\s*$)")


def sentences(t: str | None) -> list[str]:
    """The sentences of a text in order; a line end always ends one, an abbreviation or a single letter before the stop never does."""
    out = []
    for line in (t or "").splitlines():
        at = 0
        for m in _END.finditer(line):
            w = re.search(r"([^\W\d_]+)$", line[at : m.start()])
            if w and m[0][0] == "." and (len(w[1]) == 1 or w[1].lower() in ABBREVIATIONS):
                continue
            if re.search(r"[^\W\d_]", line[at : m.end()]):
                out.append(line[at : m.end()].strip())
            at = m.end()
        if re.search(r"[^\W\d_]", line[at:]):
            out.append(line[at:].strip())
    return out


def batches(sizes: list[int], most: int) -> list[list[int]]:
    """Groups (by their sizes) in order into as few batches of at most ``most`` as that allows, then as even as possible; places of the groups."""
    def packed(limit: int) -> list[list[int]]:
        out: list[list[int]] = []
        for k, n in enumerate(sizes):
            if out and sum(sizes[i] for i in out[-1]) + n <= limit:
                out[-1].append(k)
            else:
                out.append([k])
        return out

    if not sizes:
        return []
    if max(sizes) > most:
        raise ValueError(f"a group of {max(sizes)} in batches of {most}")
    best = packed(most)
    for limit in range(max(max(sizes), math.ceil(sum(sizes) / len(best))), most):
        if len(packed(limit)) <= len(best):
            return packed(limit)
    return best


def passage_stands(passage: str, body: str) -> bool:
    """Whether a quoted passage stands in a text: words compared folded, white space and punctuation aside, its parts between […] each in turn."""
    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower().translate(str.maketrans(text.ACCENTED, text.PLAIN)))) + " "
    at, whole = 0, flat(body)
    parts = [flat(p) for p in re.split(r"\[\s*(?:…|\.\.\.)\s*\]", passage)]
    parts = [p for p in parts if p.strip()]
    for p in parts:
        k = whole.find(p, at)
        if k < 0:
            return False
        at = k + len(p) - 1
    return bool(parts)


@q()
def sentences_of_articles(s: SparkSession, d: str) -> DataFrame:
    """(id, n, sentence) of every article, by the guarded splitter, in Arrow batches."""
    import pyarrow as pa

    def run(batch_iter):
        for b in batch_iter:
            rows = [(i, k + 1, x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, x in enumerate(sentences(t))]
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2])], names=["id", "n", "sentence"])

    return T.articles(s, d, "content").where("content is not null").mapInArrow(run, "id int, n int, sentence string")


BATCHED = [(1, "3 3 3 3", 6, "0,1;2,3"), (2, "5 1 1 1", 6, "0;1,2,3"), (3, "2 2 2 2 2", 6, "0,1,2;3,4"), (4, "", 6, ""), (5, "6", 6, "0")]


@q(f"SELECT id, want AS packed FROM {values([(r[0], r[3]) for r in BATCHED], 'id', 'want')}")
def balanced_batches(s: SparkSession, d: str) -> DataFrame:
    """Groups of sentences in as few and then as even batches as a bound allows; the expected packing is written out in the SQL."""
    @F.pandas_udf("string")
    def pack(sizes: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([";".join(",".join(map(str, b)) for b in batches([int(v) for v in x.split()], int(m))) for x, m in zip(sizes, most)])

    return s.createDataFrame([r[:3] for r in BATCHED], "id int, sizes string, most int").select("id", pack("sizes", "most").alias("packed"))


_FLAT = lambda c: f"' ' || array_to_string({words(c)}, ' ') || ' '"


@q(f"SELECT c.id, c.k, bool_or(contains({_FLAT('m.content')}, {_FLAT('substring(a.content, 1, 60)')})) AS quoted FROM {_CITED} c JOIN {M} m ON m.id = c.id JOIN {A} a ON a.law_id = c.law_id AND a.number = c.number WHERE a.content IS NOT NULL AND m.content IS NOT NULL GROUP BY 1, 2")
def passages_quoted(s: SparkSession, d: str) -> DataFrame:
    """Whether an answer quotes the opening words of a source, compared by folded words."""
    flat = lambda c: F.concat(F.lit(" "), F.array_join(text.words(c), " "), F.lit(" "))
    m = T.messages(s, d, "content").where("content is not null").select("id", flat(F.col("content")).alias("said"))
    a = T.articles(s, d, "law_id", "number", "content").where("content is not null").select("law_id", "number", flat(F.substring("content", 1, 60)).alias("head"))
    x = _cited(s, d).join(m, "id").join(a, ["law_id", "number"])
    return x.groupBy("id", F.col("k").cast("bigint").alias("k")).agg(F.max(F.contains(F.col("said"), F.col("head"))).alias("quoted"))


# ---- questions

_OWN = lambda c: f"list_filter({words(c)}, lambda w: length(w) > 3 AND NOT list_contains([{', '.join(quoted(w) for w in text.STOP_WORDS)}], w) AND NOT list_contains(['quel', 'quelle', 'what', 'when', 'does', 'faut', 'comprends', 'understand', 'bonjour', 'hello'], w) AND NOT regexp_matches(w, '^[0-9]+$'))"
VAGUE = ["quel", "quelle", "what", "when", "does", "faut", "comprends", "understand", "bonjour", "hello"]
_ASKED = f"(SELECT id, conversation_id, created_at, content, len(list_distinct({_OWN('content')})) AS own FROM {M} WHERE lower(trim(role)) = 'user' AND content IS NOT NULL AND conversation_id IS NOT NULL)"


def own_words(c: Column) -> Column:
    """Content words of a question that are its own: no stop words, no words any question has, no numbers."""
    return F.array_distinct(F.filter(text.words(c), lambda w: (F.length(w) > 3) & ~w.isin(text.STOP_WORDS + VAGUE) & ~w.rlike("^[0-9]+$")))


@q(f"SELECT id, own, own < 2 AS follows_up FROM {_ASKED}")
def follow_up_questions(s: SparkSession, d: str) -> DataFrame:
    """Questions with fewer than two words of their own go on with the one before."""
    x = T.messages(s, d, "conversation_id", "content", "role").where("lower(trim(role)) = 'user' and content is not null and conversation_id is not null")
    return x.select("id", F.size(own_words(F.col("content"))).cast("bigint").alias("own")).select("id", "own", (F.col("own") < 2).alias("follows_up"))


@q(f"SELECT conversation_id, id AS subject_id, n - r AS later FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY CASE WHEN own >= 2 THEN 1 ELSE 0 END DESC, r DESC) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at NULLS FIRST, id) AS r, count(*) OVER (PARTITION BY conversation_id) AS n FROM {_ASKED})) WHERE pick = 1 AND own >= 2")
def subject_before_follow_ups(s: SparkSession, d: str) -> DataFrame:
    """The last question of a conversation that is no follow-up, and how many follow-ups came after it. By aggregates, without a window a conversation."""
    x = T.messages(s, d, "conversation_id", "created_at", "content", "role").where("lower(trim(role)) = 'user' and content is not null and conversation_id is not null")
    x = x.select("conversation_id", "id", F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 62))).alias("t"), (F.size(own_words(F.col("content"))) >= 2).alias("own"))
    last = x.where("own").groupBy("conversation_id").agg(F.max(F.struct("t", "id")).alias("s"))
    y = x.join(last, "conversation_id").groupBy("conversation_id", "s").agg(F.count_if(F.struct("t", "id") > F.col("s")).alias("later"))
    return y.select("conversation_id", F.col("s.id").alias("subject_id"), "later")


def stems(query: str) -> list[str]:
    """Beginnings of a query's words that stand for their forms: folded, no stop words, numbers or excluded (-word) ones; the first max(6, n - 4) letters."""
    out: list[str] = []
    for minus, w in re.findall(r"(-?)([^\W_]+)", query):
        w = w.lower().translate(str.maketrans(text.ACCENTED, text.PLAIN))
        if not minus and len(w) >= 3 and not w.isdigit() and w not in text.STOP_WORDS and (r := w[: max(6, len(w) - 4)] if len(w) > 6 else w) not in out:
            out.append(r)
    return out


def snippet(body: str | None, query: str, width: int = 300) -> str | None:
    """The window with most different stems, then most hits, cut at words, its hits marked; null without a hit. One pass over the hits with two pointers."""
    roots = stems(query)
    if not body or not roots:
        return None
    low = body.lower() if len(body.lower()) == len(body) else body
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(f"({re.escape(r)})" for r in roots) + r")\w*")
    hits = [(m.start(), m.end(), m.lastindex) for m in pattern.finditer(low.translate(str.maketrans(text.ACCENTED, text.PLAIN)))]
    if not hits:
        return None
    best, at, z, seen = (-1, -1), 0, 0, {}
    a = 0
    for begin, _, _ in hits:
        start = max(0, begin - width // 5)
        while z < len(hits) and hits[z][1] <= start + width:
            seen[hits[z][2]] = seen.get(hits[z][2], 0) + 1
            z += 1
        while a < z and hits[a][0] < start:
            seen[hits[a][2]] -= 1
            a += 1
        score = (sum(n > 0 for n in seen.values()), z - a)
        if score > best:
            best, at = score, start
    end = min(len(body), at + width)
    start = at
    if start > 0 and 0 <= (k := body.find(" ", start)) < end:
        start = k + 1
    if end < len(body) and (k := body.rfind(" ", start, end)) > start:
        end = k
    out, cursor = "", start
    for b, e, _ in hits:
        if b >= start and e <= end:
            out += body[cursor:b] + f"<mark>{body[b:e]}</mark>"
            cursor = e
    out = (out + body[cursor:end]).strip()
    return ("… " if start > 0 else "") + out + (" …" if end < len(body) else "")


@q()
def best_snippets(s: SparkSession, d: str) -> DataFrame:
    """The best window of every document for a query, marked; whole texts are read. Checked on small texts."""
    @F.pandas_udf("string")
    def cut(t: pd.Series) -> pd.Series:
        return t.map(lambda x: snippet(x, "licence du pilote"))

    return table(s, d, "documents").where("text is not null").select("doc_id", cut("text").alias("snippet")).where("snippet is not null")


@q(f"SELECT DISTINCT type AS value, trim(regexp_replace({fold('type')}, '[ \\t\\n_-]+', ' ', 'g'), ' ') AS folded FROM laws WHERE type IS NOT NULL")
def folded_kinds(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "laws").where("type is not null").select(F.col("type").alias("value")).distinct()
    return t.select("value", F.trim(F.regexp_replace(text.fold(F.col("value")), r"[ \t\n_-]+", " ")).alias("folded"))


# ---- placing and picking rows of a bounded result

_TOP = f"(SELECT law_id, id, r AS pos, content FROM (SELECT law_id, id, content, row_number() OVER (ORDER BY n DESC, id) AS r FROM (SELECT law_id, id, content, len(list_filter({words('content')}, lambda w: w = 'licence')) AS n FROM {A} WHERE law_id IS NOT NULL AND content IS NOT NULL) WHERE n > 0) WHERE r <= 20)"


def _top(s: SparkSession, d: str) -> DataFrame:
    x = T.articles(s, d, "law_id", "content").where("law_id is not null and content is not null").withColumn("n", F.size(F.filter(text.words(F.col("content")), lambda w: w == "licence"))).where("n > 0")
    y = x.orderBy(F.desc("n"), "id").limit(20)
    return y.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n"), "id"))).select("law_id", "id", "pos", "content")


@q(f"WITH t AS MATERIALIZED (SELECT * FROM {_TOP}), f AS (SELECT min(pos) AS m FROM t WHERE contains(content, 'province') OR contains(content, 'zone')) SELECT id, row_number() OVER (ORDER BY first, place) AS pos FROM (SELECT t.id, t.pos AS place, CASE WHEN t.pos = f.m THEN 0 ELSE 1 END AS first FROM t, f)")
def pinned_row(s: SparkSession, d: str) -> DataFrame:
    """The first row that meets a condition at the front, the others in their order."""
    return ranking.pin(_top(s, d), F.contains(F.col("content"), F.lit("province")) | F.contains(F.col("content"), F.lit("zone"))).select("id", "pos")


@q(f"SELECT id, tier FROM (SELECT id, 0 AS tier FROM {_TOP} WHERE pos % 7 = 0 UNION ALL SELECT id, 1 FROM (SELECT * FROM {_TOP} WHERE pos % 7 <> 0 ORDER BY pos LIMIT 8))")
def priority_then_top(s: SparkSession, d: str) -> DataFrame:
    """Rows of priority first, then the best eight others."""
    x = _top(s, d)
    first = x.where("pos % 7 = 0").select("id", F.lit(0).alias("tier"))
    return first.union(x.join(first, "id", "left_anti").orderBy("pos").limit(8).select("id", F.lit(1)))


@q(f"SELECT id FROM {_TOP} t WHERE regexp_matches({fold('content')}, '(pilote|pilot)') OR EXISTS (SELECT 1 FROM articles_vecteurs v WHERE v.article_id = t.id AND v.article_id <= 200)")
def corroborated_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows that hold a word of the question, or that another result has as well."""
    other = table(s, d, "articles_vecteurs").where("article_id <= 200").select(F.col("article_id").alias("id"), F.lit(True).alias("too")).distinct()
    return _top(s, d).join(other, "id", "left").where(text.fold(F.col("content")).rlike("(pilote|pilot)") | F.coalesce("too", F.lit(False))).select("id")


MODEL = [(1, '{"scores": [{"i": 1, "s": 7}, {"i": 2, "s": 14}, {"i": 9, "s": 3}, {"i": 2, "s": 1}]}'), (2, "no json"), (3, '{"scores": [{"i": 3, "s": -2}]}')]


@q("SELECT CAST(id AS INTEGER) AS id, CAST(place AS INTEGER) AS place, CAST(score AS DOUBLE) AS score FROM (VALUES (1, 1, 7.0), (1, 2, 10.0), (3, 3, 0.0)) t(id, place, score)")
def model_scores_parsed(s: SparkSession, d: str) -> DataFrame:
    """A model's scores out of JSON: rows out of range and later repeats dropped, scores within 0..10; anything else gives none."""
    x = s.createDataFrame(MODEL, "id int, raw string").select("id", F.posexplode(F.from_json("raw", "scores array<struct<i:int,s:double>>")["scores"]).alias("k", "r"))
    x = x.where("r.i between 1 and 5").groupBy("id", F.col("r.i").alias("place")).agg(F.min_by("r.s", "k").alias("s"))
    return x.select("id", "place", F.least(F.greatest("s", F.lit(0.0)), F.lit(10.0)).alias("score"))


@q(f"SELECT id, round(CASE WHEN m IS NULL THEN f ELSE 0.5 * f + 0.5 * least(greatest(m, 0), 10) / 10 END, 6) AS score FROM (SELECT id, 1.0 / pos AS f, CASE WHEN pos <= 12 AND pos % 3 <> 0 THEN CAST(pos % 14 AS DOUBLE) END AS m FROM {_TOP})")
def model_score_blend(s: SparkSession, d: str) -> DataFrame:
    """The first score blended with a model's where it gave one; the model is a column, not a call."""
    x = _top(s, d).select("id", (F.lit(1.0) / F.col("pos")).alias("f"), F.when((F.col("pos") <= 12) & (F.col("pos") % 3 != 0), (F.col("pos") % 14).cast("double")).alias("m"))
    return x.select("id", F.round(ranking.blend("f", "m"), 6).alias("score"))


@q("SELECT label, round(median(s), 6) AS median, count(*) AS pairs FROM (SELECT a.label, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 9) AS s FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) a JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) b ON a.label = b.label AND a.r < b.r AND b.r <= 12) GROUP BY 1")
def pairwise_similarity_median(s: SparkSession, d: str) -> DataFrame:
    """The median similarity of the pairs among the first twelve of each label; the cap on the group is the feature, so pairs stay bounded."""
    w = Window.partitionBy("label").orderBy("vec_id")
    x = table(s, d, "embeddings").withColumn("r", F.row_number().over(w)).where("r <= 12").select("label", "r", "embedding")
    y = x.join(x.select("label", F.col("r").alias("r2"), F.col("embedding").alias("e2")), "label").where("r < r2").select("label", F.round(vectors.cosine(F.col("embedding"), F.col("e2")), 9).alias("s"))
    return y.groupBy("label").agg(F.round(F.median("s"), 6).alias("median"), F.count("*").alias("pairs"))
