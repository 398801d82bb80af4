"""Retrieval over the persisted index, its ranking and refinement, with the oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselle.functions import text, vectors
from tesselle.operators import ranking as K
from tesselle.operators import refinement as R
from tesselle.operators import search as S
from tesselle.operators import text_index as I
from tesselle.plans.analytics import A, L, M
from tesselle.plans.retrieval import VEC, VSQL, cos, fold, words
from tesselle.plans.texts import quoted
from tesselle.session import table
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


def _has(c: str, t: str) -> str:
    return f"len(list_filter({c}, lambda w: w = '{t}'))"


# Words of every article by field, its law's title among them.
_AW = f"(SELECT a.id, a.law_id, a.order_no, a.number, a.section, a.content, l.title AS law_title, l.reference, l.type, l.category_id, l.publication_date, coalesce({words('l.title')}, []) AS wa, list_concat(coalesce({words('a.number')}, []), coalesce({words('a.title')}, [])) AS wb, coalesce({words('a.content')}, []) AS wd FROM {A} a LEFT JOIN {L} l ON l.id = a.law_id)"
_LW = f"(SELECT id, id AS law_id, title, coalesce({words('title')}, []) AS wa, coalesce({words('content')}, []) AS wd FROM {L})"


def _score(terms: list[str], law: bool = False) -> str:
    per = [f"1.0 * {_has('wa', t)} + 0.05 * {_has('wd', t)}" + ("" if law else f" + 0.2 * {_has('wb', t)}") for t in terms]
    return f"round({' + '.join(per)}, 6)"


def _holds(terms: list[str], law: bool = False) -> str:
    return " + ".join(f"(list_contains(wa, '{t}') OR list_contains(wd, '{t}')" + ("" if law else f" OR list_contains(wb, '{t}')") + ")::INT" for t in terms)


TWO = ["licence", "pilote"]
THREE = ["licence", "timber", "pension"]


@q(f"SELECT law_id, id, score, CAST(law_rank AS INTEGER) AS law_rank, title_match FROM (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY score DESC, order_no NULLS LAST, id) AS law_rank FROM (SELECT *, {_score(TWO)} AS score, list_contains(wa, '{TWO[0]}') OR list_contains(wa, '{TWO[1]}') AS title_match FROM {_AW} WHERE {_holds(TWO)} = 2)) WHERE law_rank <= 3 ORDER BY score DESC, law_id, law_rank LIMIT 60")
def fts_articles_weighted(s: SparkSession, d: str) -> DataFrame:
    """Articles that hold all words, by weighted fields, three a law at most, sixty in all."""
    m = I.matches(I.index(s, d), "a", TWO)
    x = m.join(T.articles(s, d, "order_no").withColumn("id", F.col("id").cast("bigint")), "id")
    return I.cap_per_law(x).orderBy(F.desc("score"), "law_id", "law_rank").limit(60).select(F.col("law_id").cast("int").alias("law_id"), F.col("id").cast("int").alias("id"), "score", "law_rank", "title_match")


_DF = "(SELECT term, count(*) AS df FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS term, id FROM {_AW} WHERE {_holds([t])} = 1" for t in THREE) + ") GROUP BY term)"
_ORD = f"(SELECT term, row_number() OVER (ORDER BY df DESC, term) AS k, count(*) OVER () AS n FROM {_DF})"


@q(f"SELECT CAST(a.k AS INTEGER) AS step, string_agg(b.term, ' ' ORDER BY b.k) AS terms FROM {_ORD} a JOIN {_ORD} b ON b.k >= a.k WHERE a.n < 3 OR a.k > 1 GROUP BY a.k")
def rare_term_queries(s: SparkSession, d: str) -> DataFrame:
    """The query without absent words, then without its commonest, one by one."""
    df = I.frequencies(I.index(s, d), "a", THREE)
    rows = I.rarer_queries(df, THREE)
    return s.createDataFrame([(len({t for t in THREE if df.get(t)}) - len(r) + 1, " ".join(r)) for r in rows], "step int, terms string")


_H3 = f"(SELECT id, law_id, {_score(THREE)} AS score, {_holds(THREE)} AS n, " + ", ".join(f"{_holds([t])} AS h{i}" for i, t in enumerate(THREE)) + f" FROM {_AW})"

@q(f"""WITH h AS MATERIALIZED (SELECT * FROM {_H3} WHERE n > 0), o AS MATERIALIZED (SELECT * FROM {_ORD}),
hit AS (SELECT h.id, o.k FROM h, o WHERE {" AND ".join(f"(h.h{i} = 1 OR coalesce((SELECT k FROM o WHERE term = '{t}'), 0) < o.k)" for i, t in enumerate(THREE))}),
f AS (SELECT min(k) AS k FROM hit)
SELECT id, law_id, score, tier FROM (SELECT id, law_id, CASE WHEN id IN (SELECT id FROM hit WHERE k = (SELECT k FROM f)) THEN round({" + ".join(f"CASE WHEN coalesce((SELECT k FROM o WHERE term = '{t}'), 0) >= (SELECT k FROM f) THEN s{i} ELSE 0 END" for i, t in enumerate(THREE))}, 6) ELSE score END AS score, CASE WHEN n = 3 THEN 1 WHEN id IN (SELECT id FROM hit WHERE k = (SELECT k FROM f)) THEN 2 ELSE 3 END AS tier FROM (SELECT h.*, {", ".join(f"p.s{i}" for i in range(3))} FROM h JOIN (SELECT id AS pid, {", ".join(f"{_score([t])} AS s{i}" for i, t in enumerate(THREE))} FROM {_AW}) p ON p.pid = h.id)) ORDER BY tier, score DESC, law_id, id LIMIT 15""")
def fts_cascade(s: SparkSession, d: str) -> DataFrame:
    """All words; else the rarer ones together, filled up with any word; else trigrams of the titles."""
    ix = I.index(s, d)

    def near() -> DataFrame:
        x = T.laws(s, d, "title").select("id", text.trigram_similarity(F.col("title"), F.lit(" ".join(THREE))).alias("score")).where("score >= 0.3")
        return x.select(F.col("id").cast("bigint").alias("id"), F.col("id").cast("bigint").alias("law_id"), F.round("score", 6).alias("score"))

    return I.cascade(ix, "a", THREE, 15, near).select(F.col("id").cast("int").alias("id"), F.col("law_id").cast("int").alias("law_id"), "score", "tier")


_W = "list_filter(regexp_split_to_array(t, '[ \\t\\n]+'), lambda x: length(x) > 1)"


@q(f"SELECT id, CASE WHEN regexp_matches(t, '[\"-]') OR contains(upper(t), ' OR ') OR len({_W}) < 2 THEN t ELSE array_to_string({_W}, ' OR ') END AS rewritten FROM (SELECT id, trim(content, ' ') AS t FROM {M} WHERE content IS NOT NULL AND lower(trim(role)) = 'user')")
def any_terms_rewrite(s: SparkSession, d: str) -> DataFrame:
    return T.messages(s, d, "content", "role").where("content is not null and lower(trim(role)) = 'user'").select("id", I.any_terms(F.col("content")).alias("rewritten"))


@q(f"SELECT 'a' AS kind, count(*) AS documents, sum(u) AS postings FROM (SELECT id, len(list_distinct(list_concat(list_concat(wa, wb), wd))) AS u FROM {_AW} WHERE law_id IS DISTINCT FROM 1) WHERE u > 0 UNION ALL SELECT 'l', count(*), sum(u) FROM (SELECT id, len(list_distinct(list_concat(wa, wd))) AS u FROM {_LW} WHERE id <> 1) WHERE u > 0 UNION ALL SELECT 'd', count(*), sum(len(list_distinct(w))) FROM (SELECT {words('text')} AS w FROM documents) WHERE len(w) > 0")
def index_without_a_law(s: SparkSession, d: str) -> DataFrame:
    """The index with one law taken out again: documents and postings of each kind."""
    x = I.index(s, d).where("law_id is null or law_id <> 1")
    return x.groupBy("kind").agg(F.count_distinct("id").alias("documents"), F.count("*").alias("postings"))


@q(f"SELECT id, round({_score(['pension', 'retraite'], True)}, 6) AS score, list_contains(wa, 'pension') OR list_contains(wa, 'retraite') OR title ILIKE '%pension de%' AS title_match FROM {_LW} WHERE {_holds(['pension', 'retraite'], True)} = 2 OR title ILIKE '%pension de%' ORDER BY score DESC, id LIMIT 60")
def fts_laws_or_title(s: SparkSession, d: str) -> DataFrame:
    """Laws that hold all words, or whose title holds the phrase; a title hit without words scores by what it has."""
    ix = I.index(s, d)
    every, some = I.matches(ix, "l", ["pension", "retraite"]), I.matches(ix, "l", ["pension", "retraite"], every=False)
    like = T.laws(s, d, "title").where(F.col("title").ilike("%pension de%")).select(F.col("id").cast("bigint").alias("id"), F.lit(True).alias("like"))
    x = like.join(every.select("id", F.lit(True).alias("fts")), "id", "full").join(some.select("id", "score", "title_match"), "id", "left")
    y = x.select(F.col("id").cast("int").alias("id"), F.coalesce("score", F.lit(0.0)).alias("score"), (F.coalesce("title_match", F.lit(False)) | F.coalesce("like", F.lit(False))).alias("title_match"))
    return y.orderBy(F.desc("score"), "id").limit(60)


FUZZY = ["pensions", "retraites"]
_TRI1 = lambda w: f"list_distinct(list_transform(range(1, length({w}) + 2), lambda i: substring('  ' || {w} || ' ', i, 3)))"
_WS = lambda t: f"coalesce(list_max(list_transform({words('title')}, lambda w: len(list_intersect({_TRI1('w')}, {_TRI1(quoted(t))})) * 1.0 / len(list_distinct(list_concat({_TRI1('w')}, {_TRI1(quoted(t))}))))), 0)"


def _fuzzy(s: SparkSession, d: str, floor: float = 0.5) -> DataFrame:
    per = [text.word_similarity(F.lit(w), F.col("title")) for w in FUZZY]
    x = T.laws(s, d, "title").where("title is not null").select("id", *(p.alias(f"s{i}") for i, p in enumerate(per)))
    return x.where(" and ".join(f"s{i} >= {floor}" for i in range(len(per)))).select("id", F.round(sum((F.col(f"s{i}") for i in range(len(per))), F.lit(0.0)) / len(per), 6).alias("score"))


@q(f"SELECT id, round((a + b) / 2, 6) AS score FROM (SELECT id, {_WS(FUZZY[0])} AS a, {_WS(FUZZY[1])} AS b FROM {L} WHERE title IS NOT NULL) WHERE a >= 0.5 AND b >= 0.5")
def fuzzy_titles(s: SparkSession, d: str) -> DataFrame:
    """Titles to which every word of the query is similar to some word; the mean of the similarities ranks them."""
    return _fuzzy(s, d)


PASSES = ["pension", "retraite"]


@q(f"""WITH t AS (SELECT id, 1.0 * ({' + '.join(_has('wa', w) for w in PASSES)}) AS score FROM {_LW} WHERE {' AND '.join(f"list_contains(wa, '{w}')" for w in PASSES)} ORDER BY score DESC, id LIMIT 20),
z AS (SELECT id, round((a + b) / 2, 6) AS score FROM (SELECT id, {_WS(FUZZY[0])} AS a, {_WS(FUZZY[1])} AS b FROM {L} WHERE title IS NOT NULL) WHERE a >= 0.5 AND b >= 0.5 AND id NOT IN (SELECT id FROM t) AND (SELECT count(*) FROM t) < 20 ORDER BY score DESC, id LIMIT 20),
b AS (SELECT law_id, id, {_score(PASSES)} AS score FROM {_AW} WHERE {_holds(PASSES)} = {len(PASSES)} ORDER BY score DESC, law_id, id LIMIT 20)
SELECT 1 AS pass, id AS law_id, CAST(NULL AS INTEGER) AS article_id, round(score, 6) AS score FROM t UNION ALL SELECT 2, id, NULL, score FROM z UNION ALL SELECT 3, law_id, id, score FROM b""")
def three_pass_retrieval(s: SparkSession, d: str) -> DataFrame:
    """Titles that hold all words, then similar titles not yet seen if there is room, then bodies."""
    ix = I.index(s, d)
    titles = I.of_terms(ix, "l", PASSES).where("in_title").join(table(s, d, "laws").select(F.col("id").cast("bigint").alias("id"), text.words(F.col("title")).alias("w")).distinct(), "id")
    t = titles.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.size(F.filter("w", lambda w: w == F.col("term"))).cast("double")).alias("score")).where(f"n = {len(PASSES)}")
    t = t.select(F.col("id").cast("int").alias("law_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "law_id").limit(20)
    room = t.agg((F.count("*") < 20).alias("room"))
    z = _fuzzy(s, d).withColumnRenamed("id", "law_id").join(t.select("law_id"), "law_id", "left_anti").join(F.broadcast(room)).where("room").orderBy(F.desc("score"), "law_id").limit(20)
    b = I.matches(ix, "a", PASSES).orderBy(F.desc("score"), "law_id", "id").limit(20)
    none = F.lit(None).cast("int")
    out = t.select(F.lit(1).alias("pass"), "law_id", none.alias("article_id"), "score").union(z.select(F.lit(2), "law_id", none, "score"))
    return out.union(b.select(F.lit(3), F.col("law_id").cast("int"), F.col("id").cast("int"), "score"))


@q(f"SELECT id, round(least(score / greatest(max(score) OVER (), 0.001), 1), 6) AS score FROM (SELECT id, {_score(['licence'])} AS score FROM {_AW} WHERE {_holds(['licence'])} = 1)")
def max_normalised_rank(s: SparkSession, d: str) -> DataFrame:
    m = I.matches(I.index(s, d), "a", ["licence"]).select(F.col("id").cast("int").alias("id"), "score")
    return K.max_normalised(m, "score").select("id", F.round("score", 6).alias("score"))


# ---- the candidate set: made once, then filtered, sorted, paged and counted

_NAT = lambda c: f"trim(regexp_replace({fold(c)}, '[ \\t\\n_-]+', ' ', 'g'), ' ')"
_SET = f"(SELECT l.id, l.type, l.category_id, l.publication_date, row_number() OVER (ORDER BY x.score DESC, l.id) AS pos FROM (SELECT id, {_score(['licence'], True)} AS score FROM {_LW} WHERE {_holds(['licence'], True)} = 1 ORDER BY score DESC, id LIMIT 400) x JOIN {L} l ON l.id = x.id)"
_TYPES, _CATS, _FROM, _TO = ["DECRET", "decree", "loi"], [1, 2, 3, 4, 5, 6, 7], "1995-01-01", "2020-12-31"
_CT = f"coalesce({_NAT('type')} IN ('decret', 'decree', 'loi'), false)"
_CC = f"coalesce(category_id IN ({', '.join(map(str, _CATS))}), false)"
_CD = f"coalesce(publication_date BETWEEN DATE '{_FROM}' AND DATE '{_TO}', false)"


def _candidates(s: SparkSession, d: str) -> DataFrame:
    top = I.matches(I.index(s, d), "l", ["licence"]).select(F.col("id").cast("int").alias("id"), "score").orderBy(F.desc("score"), "id").limit(400)
    x = T.laws(s, d, "type", "category_id", "publication_date").join(F.broadcast(top), "id")  # at most 400 rows
    return x.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).drop("score")


def _conditions() -> dict:
    nature = F.trim(F.regexp_replace(text.fold(F.col("type")), r"[ \t\n_-]+", " "))
    day = F.col("publication_date")
    return {
        "type": F.coalesce(nature.isin([t.lower() for t in _TYPES]), F.lit(False)),
        "category": F.coalesce(F.col("category_id").isin(_CATS), F.lit(False)),
        "year": F.coalesce((day >= F.lit(_FROM).cast("date")) & (day <= F.lit(_TO).cast("date")), F.lit(False)),
    }


@q(f"SELECT id, total, row_number() OVER (ORDER BY publication_date DESC NULLS LAST, pos) AS place FROM (SELECT *, count(*) OVER () AS total FROM {_SET} WHERE {_CT} AND {_CC} AND {_CD}) ORDER BY place LIMIT 10 OFFSET 5")
def candidate_set_page(s: SparkSession, d: str) -> DataFrame:
    """A page of the candidate set after filters and a stable sort by date, with the total before slicing."""
    x = _candidates(s, d)
    for c in _conditions().values():
        x = x.where(c)
    return R.page(x, [F.desc_nulls_last("publication_date"), F.asc("pos")], 5, 10).select("id", "total", F.col("pos").alias("place"))


@q(f"""SELECT 'type' AS facet, type AS value, count(*) AS n FROM {_SET} WHERE {_CC} AND {_CD} GROUP BY 2 UNION ALL SELECT 'category', CAST(category_id AS VARCHAR), count(*) FROM {_SET} WHERE {_CT} AND {_CD} GROUP BY 2
UNION ALL SELECT 'year', CAST(year(publication_date) AS VARCHAR), count(*) FROM {_SET} WHERE {_CT} AND {_CC} GROUP BY 2""")
def candidate_set_facets(s: SparkSession, d: str) -> DataFrame:
    """All three facets in one pass over the candidate set: each counts the rows that pass every filter but its own; null is a value."""
    x, c = _candidates(s, d), _conditions()
    value = {"type": F.col("type"), "category": F.col("category_id").cast("string"), "year": F.year("publication_date").cast("string")}
    own = [F.when(F.reduce(F.array(*[c[o] for o in c if o != f]), F.lit(True), lambda a, b: a & b), F.struct(F.lit(f).alias("facet"), value[f].alias("value"))) for f in c]
    return x.select(F.explode(F.array_compact(F.array(*own))).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


# ---- grouping, fusion and re-ranking

_HITS = f"(SELECT *, row_number() OVER (ORDER BY score DESC, law_id, kind, id) AS pos FROM (SELECT 0 AS kind, id, law_id, number, score FROM (SELECT id, law_id, number, {_score(['licence'])} AS score FROM {_AW} WHERE {_holds(['licence'])} = 1) UNION ALL SELECT 1, id, id, NULL, 1.0 * {_has('wa', 'licence')} FROM {_LW} WHERE list_contains(wa, 'licence')) ORDER BY pos LIMIT 200)"
_PSEUDO = "regexp_matches(number, '(?i)^(PREAMBULE|LEGAL_BASIS|SIGNATURE|ANNEXE|FULL_TEXT|SECTION_[0-9]+|PARA_[0-9]+)([.][0-9]+)?$')"


@q(f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY pos) AS k FROM {_HITS}),
g AS (SELECT law_id, arg_min(id, k) FILTER (kind = 0) AS article_id, max(score) FILTER (k = 1 OR kind = 1) AS score, max(kind) AS t, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 3 AND kind = 0 AND number <> '' AND NOT {_PSEUDO}), '') AS articles, min(pos) AS first FROM h GROUP BY law_id)
SELECT law_id, article_id, round(score, 6) AS score, CASE WHEN t = 1 THEN 'title' ELSE 'body' END AS scope, articles, row_number() OVER (ORDER BY t DESC, score DESC, first) AS pos FROM g""")
def hits_to_documents(s: SparkSession, d: str) -> DataFrame:
    """Hits grouped to their laws: title hits first, up to three matched articles with a real number."""
    ix = I.index(s, d)
    m = I.matches(ix, "a", ["licence"]).join(T.articles(s, d, "number").withColumn("id", F.col("id").cast("bigint")), "id")
    a = m.select(F.lit(0).alias("kind"), "id", "law_id", "number", "score")
    laws = table(s, d, "laws").select(F.col("id").cast("bigint").alias("id"), text.words(F.col("title")).alias("w")).distinct().where(F.array_contains("w", "licence"))
    l = laws.select(F.lit(1).alias("kind"), "id", F.col("id").alias("law_id"), F.lit(None).cast("string").alias("number"), F.size(F.filter("w", lambda w: w == "licence")).cast("double").alias("score"))
    top = a.union(l).orderBy(F.desc("score"), "law_id", "kind", "id").limit(200)
    hits = top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "law_id", "kind", "id")))
    out = K.to_documents(hits.select("law_id", F.when(F.col("kind") == 0, F.col("id")).alias("article_id"), "number", "score", F.when(F.col("kind") == 1, "title").otherwise("body").alias("scope"), "pos"))
    return out.select(F.col("law_id").cast("int").alias("law_id"), F.col("article_id").cast("int").alias("article_id"), F.round("score", 6).alias("score"), "scope", "articles", "pos")


_OKV = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_TR = f"(SELECT key, row_number() OVER (ORDER BY score DESC, key) AS rank FROM (SELECT 'a:' || id AS key, {_score(['licence'])} AS score FROM {_AW} WHERE {_holds(['licence'])} = 1 UNION ALL SELECT 'l:' || id, {_score(['licence'], True)} FROM {_LW} WHERE {_holds(['licence'], True)} = 1) ORDER BY rank LIMIT 50)"
_VR = f"(SELECT 'a:' || id AS key, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (SELECT DISTINCT ON (article_id) article_id AS id, round({cos('embedding::DOUBLE[]', VSQL)}, 9) AS s FROM articles_vecteurs WHERE {_OKV}) ORDER BY rank LIMIT 50)"


def _text_rank(s: SparkSession, d: str) -> DataFrame:
    ix = I.index(s, d)
    both = I.matches(ix, "a", ["licence"]).select(K.typed_key("a", "id").alias("key"), "score").union(I.matches(ix, "l", ["licence"]).select(K.typed_key("l", "id"), "score"))
    return S.ranked(both, [F.desc("score"), F.asc("key")], 50).select("key", "rank")


def _vector_rank(s: SparkSession, d: str) -> DataFrame:
    v = T.vectors(s, d).where(vectors.usable(F.col("embedding"), 64)).select(F.col("article_id").cast("bigint").alias("id"), "embedding")
    near = S.nearest(v, VEC, 50, "id")
    return S.ranked(near, [F.desc("similarity"), F.asc("id")], 50).select(K.typed_key("a", "id").alias("key"), "rank")


_TYPED = f"SELECT key, round(sum(s), 8) AS score FROM (SELECT key, 0.4 / (60 + rank) AS s FROM {_TR} UNION ALL SELECT key, 0.6 / (60 + rank) FROM {_VR}) GROUP BY 1"


@q(_TYPED)
def typed_key_fusion(s: SparkSession, d: str) -> DataFrame:
    """Text hits on laws and articles fused with vector hits on articles; an article and a law of one number never meet."""
    return S.rrf(_text_rank(s, d), _vector_rank(s, d), "key").select("key", F.round("score", 8).alias("score"))


@q(f"SELECT 'text' AS mode, key, CAST(rank AS INTEGER) AS place FROM {_TR} WHERE rank <= 10 UNION ALL SELECT 'semantic', key, CAST(rank AS INTEGER) FROM {_VR} WHERE rank <= 10 UNION ALL SELECT 'hybrid', key, CAST(r AS INTEGER) FROM (SELECT key, row_number() OVER (ORDER BY score DESC, key) AS r FROM ({_TYPED})) WHERE r <= 10")
def search_by_mode(s: SparkSession, d: str) -> DataFrame:
    """The three modes over one index, ten rows each; without a vector the hybrid mode is the text ranking."""
    t, v = _text_rank(s, d), _vector_rank(s, d)
    fused = S.rrf(t, v, "key").select("key", F.round("score", 8).alias("score"))
    place = S.ranked(fused, [F.desc("score"), F.asc("key")], 10).select(F.lit("hybrid").alias("mode"), "key", F.col("rank").cast("int").alias("place"))
    first = lambda x, mode: x.where("rank <= 10").select(F.lit(mode).alias("mode"), "key", F.col("rank").cast("int").alias("place"))
    return first(t, "text").union(first(v, "semantic")).union(place)


@q("SELECT n, greatest(4 * n, 20) AS chunks, least(greatest(8 * n, 100), 500) AS candidates, least(greatest(least(greatest(8 * n, 100), 500), 400), 1000) AS width, least(greatest(n / 100.0, 0.1), 1.0) AS threshold FROM (VALUES (1), (5), (20), (40), (100), (300)) t(n)")
def search_budgets(s: SparkSession, d: str) -> DataFrame:
    """How many chunks, candidates and index entries a page of n rows is worth, and a trigram threshold within its bounds."""
    n, clamp = F.col("n"), lambda x, a, b: F.least(F.greatest(x, F.lit(a)), F.lit(b))
    c = clamp(8 * n, 100, 500)
    return s.createDataFrame([(k,) for k in (1, 5, 20, 40, 100, 300)], "n int").select("n", F.greatest(4 * n, F.lit(20)).alias("chunks"), c.alias("candidates"), clamp(c, 400, 1000).alias("width"), clamp(n / 100.0, 0.1, 1.0).alias("threshold"))


QUESTION = "la licence du pilote"
_CW = lambda c: f"list_distinct(list_filter({words(c)}, lambda w: length(w) > 3 AND NOT list_contains(['{chr(39) + ', ' + chr(39)}'], w)))".replace("['', '']", "[" + ", ".join(quoted(w) for w in text.STOP_WORDS) + "]")
_J = lambda a, b: f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) * 1.0 / len(list_distinct(list_concat({a}, {b}))) END)"
_FC = fold("content")
_RAW = f"""(SELECT id, pos, round(1.0 * rel + 0.4 * len(list_intersect(q, {_CW('content')})) / len(q) + 0.35 * (CASE WHEN contains({_FC}, '{QUESTION}') THEN 1.0 ELSE contains({_FC}, 'licence pilote')::INT * 1.0 END)
 + 0.25 * {_J('q', _CW("concat_ws(' ', law_title, reference)"))} + 0.15 * {_J('q', _CW("coalesce(section, '')"))} + CASE WHEN upper(number) = '3' THEN 0.8 ELSE 0 END - CASE WHEN regexp_matches({_FC}, '{K.BOILERPLATE}') THEN 0.25 WHEN length({_FC}) < 80 THEN 0.1 ELSE 0 END, 9) AS raw
 FROM (SELECT id, number, coalesce(content, '') AS content, section, law_title, reference, ['licence', 'pilote'] AS q, row_number() OVER (ORDER BY score DESC, id) AS pos, least(score / greatest(max(score) OVER (), 0.001), 1) AS rel FROM (SELECT *, {_score(TWO)} AS score FROM {_AW} WHERE {_holds(TWO)} > 0 ORDER BY score DESC, id LIMIT 50)))"""


@q(f"SELECT id, round(CASE WHEN max(raw) OVER () - min(raw) OVER () < 1e-9 THEN 1 ELSE (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) END, 6) AS rerank_score, CAST(row_number() OVER (ORDER BY raw DESC, pos) AS INTEGER) AS place FROM {_RAW}")
def rerank_all_features(s: SparkSession, d: str) -> DataFrame:
    """The first fifty hits ranked again by all lexical features; the words of the question come from the question."""
    top = I.matches(I.index(s, d), "a", TWO, every=False).orderBy(F.desc("score"), "id").limit(50)
    top = K.max_normalised(top, "score").withColumnRenamed("score", "relevance_score")
    a = T.articles(s, d, "law_id", "number", "content", "section").join(F.broadcast(top.select("id", "relevance_score")), "id")  # fifty rows
    x = a.join(T.laws(s, d, "title", "reference").withColumnsRenamed({"id": "law_id", "title": "law_title"}), "law_id", "left").withColumn("pos", F.row_number().over(Window.orderBy(F.desc("relevance_score"), "id")))
    return K.rerank(x, QUESTION, "3").select("id", F.round("rerank_score", 6).alias("rerank_score"), F.col("new_pos").alias("place"))
