"""Text functions, full-text, trigram and vector search, ranking, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselle.functions import text, vectors
from tesselle.operators import ordered
from tesselle.operators import refinement as R
from tesselle.operators import search as S
from tesselle.operators import text_index
from tesselle.plans.analytics import A, L
from tesselle.session import table
from tesselle.sources import tables as T

Q: dict = {}
SQL: dict[str, str] = {}
VEC = [((i * 37) % 64 - 31.5) / 100 for i in range(64)]
VSQL = "[" + ", ".join(f"{x}::DOUBLE" for x in VEC) + "]"
FOLD = "translate(lower({c}), '" + text.ACCENTED + "', '" + text.PLAIN + "')"
STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


def fold(c: str) -> str:
    return FOLD.format(c=c)


def words(c: str) -> str:
    return f"regexp_extract_all({fold(c)}, '([a-z0-9]+)', 1)"


def cos(a: str, b: str) -> str:
    dot = lambda x, y: f"list_inner_product({x}, {y})"
    return f"({dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0))"


def q(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- functions over text


@q(f"SELECT id, {fold('title')} AS folded, len({words('title')}) AS n FROM {L}")
def fold_and_words(s: SparkSession, d: str) -> DataFrame:
    return T.laws(s, d, "title").select("id", text.fold(F.col("title")).alias("folded"), F.size(text.words(F.col("title"))).cast("bigint").alias("n"))


@q(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter({words('content')}, lambda w: length(w) > 3 AND NOT list_contains({STOP}, w)))), ' ') AS words FROM {L}")
def content_words(s: SparkSession, d: str) -> DataFrame:
    return T.laws(s, d, "content").select("id", F.array_join(F.array_sort(text.content_words(F.col("content"))), " ").alias("words"))


@q(f"SELECT id, array_to_string(list_slice(list_filter(regexp_extract_all({fold('title')}, '([a-z]+)', 1), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w)), 1, 10), ' ') AS keywords FROM {L}")
def keyword_extraction(s: SparkSession, d: str) -> DataFrame:
    return T.laws(s, d, "title").select("id", F.array_join(text.keywords(F.col("title")), " ").alias("keywords"))


_FR = "['le','la','les','des','du','une','dans','pour','qui','que','est']"
_EN = "['the','of','and','to','in','is','for','that','which','any']"


@q(f"SELECT doc_id, CASE WHEN f > e THEN 'fr' WHEN e > f THEN 'en' END AS vote FROM (SELECT doc_id, len(list_filter(w, lambda x: list_contains({_FR}, x))) AS f, len(list_filter(w, lambda x: list_contains({_EN}, x))) AS e FROM (SELECT doc_id, {words('text')} AS w FROM documents))")
def question_language_vote(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.language_vote(F.col("text")).alias("vote"))


@q("""SELECT doc_id, round(CASE WHEN length(text) < 10 THEN 0 ELSE 0.4 * length(regexp_replace(text, '[^A-Za-zÀ-ÿ]', '', 'g')) / length(text)
 + 0.3 * len(list_filter(t, lambda x: length(x) BETWEEN 2 AND 20)) / greatest(len(t), 1) + 0.3 * least(((instr(lo, ' le ') > 0)::INT + (instr(lo, ' la ') > 0)::INT + (instr(lo, ' de ') > 0)::INT + (instr(lo, ' et ') > 0)::INT + (instr(lo, ' the ') > 0)::INT + (instr(lo, ' of ') > 0)::INT + (instr(lo, ' and ') > 0)::INT + (instr(lo, ' to ') > 0)::INT) / 5.0, 1.0) END, 6) AS score
 FROM (SELECT doc_id, text, lower(text) AS lo, list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda x: x <> '') AS t FROM documents)""")
def text_quality_score(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.round(text.quality_score(F.col("text")), 6).alias("score"))


@q(f"""SELECT id, length(trim(regexp_replace(regexp_replace(replace(replace(translate(regexp_replace(content, '(?m)^[ \\t]*(?:[-–—] ?[0-9]{{1,4}} ?[-–—]|\\[[0-9]{{1,4}}\\]|[Pp]age [0-9]{{1,4}}(?: / [0-9]{{1,4}})?)[ \\t]*$', '', 'g'), '’‘“”–—', '''''""--'), 'ﬁ', 'fi'), '…', '...'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', e'\\n\\n', 'g'), ' ')) AS size FROM {A}""")
def ocr_cleanup_regex(s: SparkSession, d: str) -> DataFrame:
    return T.articles(s, d, "content").select("id", F.length(text.clean_ocr(F.col("content"))).cast("bigint").alias("size"))


@q(f"SELECT id, regexp_replace(title, '(?i)(pension|licence)', '<mark>\\1</mark>', 'g') AS marked FROM {L} WHERE regexp_matches(title, '(?i)(pension|licence)')")
def highlight_mark(s: SparkSession, d: str) -> DataFrame:
    return T.laws(s, d, "title").where(F.col("title").rlike("(?i)(pension|licence)")).select("id", text.highlight(F.col("title"), "pension|licence").alias("marked"))


@q(f"SELECT id, sha256(concat_ws('|', coalesce(language, ''), coalesce(status, ''), lower(trim(title)))) AS key FROM {L}")
def cache_key_sha256(s: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("|", F.coalesce("language", F.lit("")), F.coalesce("status", F.lit("")), F.lower(F.trim("title")))
    return T.laws(s, d, "language", "status", "title").select("id", F.sha2(key, 256).alias("key"))


@q(f"SELECT id, nullif(regexp_extract(content, '(?i)(?:article|section) ([0-9]+)', 1), '') AS article, nullif(regexp_extract(title, 'n° ([0-9]+/[0-9]+)', 1), '') AS act FROM {L}")
def parse_article_reference(s: SparkSession, d: str) -> DataFrame:
    x = T.laws(s, d, "content", "title")
    return x.select("id", F.nullif(F.regexp_extract("content", r"(?i)(?:article|section) ([0-9]+)", 1), F.lit("")).alias("article"), F.nullif(F.regexp_extract("title", r"n° ([0-9]+/[0-9]+)", 1), F.lit("")).alias("act"))


@q(f"SELECT id, CASE WHEN lower(title) LIKE 'loi%' OR lower(title) LIKE 'law%' THEN 'law' WHEN lower(title) LIKE 'd%cret%' OR lower(title) LIKE 'decree%' THEN 'decree' WHEN lower(title) LIKE 'ord%' THEN 'order' ELSE 'autre' END AS kind FROM {L}")
def infer_type_from_title(s: SparkSession, d: str) -> DataFrame:
    t = F.lower("title")
    kind = F.when(t.startswith("loi") | t.startswith("law"), "law").when(t.like("d%cret%") | t.startswith("decree"), "decree").when(t.startswith("ord"), "order").otherwise("autre")
    return T.laws(s, d, "title").select("id", kind.alias("kind"))


@q(f"SELECT id, CASE WHEN y <> '' THEN make_date(CAST(y AS INTEGER), 1, 1) END AS inferred, CASE WHEN y <> '' THEN abs(year(publication_date) - CAST(y AS INTEGER)) <= 1 END AS near FROM (SELECT id, publication_date, regexp_extract(title, 'n° ([0-9]{{4}})/', 1) AS y FROM {L})")
def infer_date_simple(s: SparkSession, d: str) -> DataFrame:
    y = F.nullif(F.regexp_extract("title", r"n° ([0-9]{4})/", 1), F.lit("")).cast("int")
    return T.laws(s, d, "title", "publication_date").select("id", F.make_date(y, F.lit(1), F.lit(1)).alias("inferred"), (F.abs(F.year("publication_date") - y) <= 1).alias("near"))


# ---- search


@q(f"SELECT id, score FROM (SELECT id, round(2.0 * len(list_filter({words('title')}, lambda w: w = 'pension')) + 0.1 * len(list_filter({words('content')}, lambda w: w = 'pension')) + 2.0 * len(list_filter({words('title')}, lambda w: w = 'retraite')) + 0.1 * len(list_filter({words('content')}, lambda w: w = 'retraite')), 6) AS score FROM {L}) WHERE score > 0 ORDER BY score DESC, id LIMIT 60")
def fts_weighted_ranked(s: SparkSession, d: str) -> DataFrame:
    x = S.text_scores(T.laws(s, d, "title", "content"), ["pension", "retraite"], {"title": 2.0, "content": 0.1})
    return x.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(60)


@q(f"SELECT law_id, id, score, r AS law_rank FROM (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY score DESC, order_no NULLS LAST, id) AS r FROM (SELECT law_id, id, order_no, len(list_filter({words('content')}, lambda w: w = 'licence')) AS score FROM {A}) WHERE score > 0) WHERE r <= 3")
def fts_per_law_cap(s: SparkSession, d: str) -> DataFrame:
    x = S.text_scores(T.articles(s, d, "law_id", "order_no", "content"), ["licence"], {"content": 1.0})
    return R.top_per_group(x, "law_id", [F.desc("score"), F.asc_nulls_last("order_no"), F.asc("id")], 3).select("law_id", "id", F.col("score").cast("bigint").alias("score"), F.col("rank").alias("law_rank"))


@q(f"""WITH h AS (SELECT id, list_contains(w, 'reservation')::INT + list_contains(w, 'timber')::INT AS n FROM (SELECT id, {words('content')} AS w FROM {A}))
SELECT id, CASE WHEN n = 2 THEN 1 ELSE 2 END AS tier FROM h WHERE n > 0""")
def fts_or_complement_tiers(s: SparkSession, d: str) -> DataFrame:
    x = S.text_scores(T.articles(s, d, "content"), ["reservation", "timber"], {"content": 1.0})
    return x.select("id", F.when(F.col("terms") == 2, 1).otherwise(2).alias("tier"))


@q(f"SELECT term, count(*) AS df, CAST(sum(hits) AS BIGINT) AS hits FROM (SELECT id, term, count(*) AS hits FROM (SELECT id, unnest({words('content')}) AS term FROM {A}) GROUP BY 1, 2) GROUP BY term")
def term_document_frequency(s: SparkSession, d: str) -> DataFrame:
    p = S.postings(T.articles(s, d, "content"), {"content": 1.0})
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("hits").alias("hits"))


_TRI = "list_distinct(flatten(list_transform({w}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def tri(c: str) -> str:
    return _TRI.format(w=words(c))


@q(f"""SELECT id, round(len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM (SELECT id, {tri('title')} AS a, {tri("'decree on the effluent discharge'")} AS b FROM {L}) WHERE len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))) >= 0.3""")
def trigram_similarity_topk(s: SparkSession, d: str) -> DataFrame:
    sim = text.trigram_similarity(F.col("title"), F.lit("decree on the effluent discharge"))
    return T.laws(s, d, "title").select("id", sim.alias("x")).where("x >= 0.3").select("id", F.round("x", 6).alias("similarity"))


_TRI1 = lambda w: f"list_distinct(list_transform(range(1, length({w}) + 2), lambda i: substring('  ' || {w} || ' ', i, 3)))"
_WS = lambda c, t: f"coalesce(list_max(list_transform({words(c)}, lambda w: len(list_intersect({_TRI1('w')}, {_TRI1(t)})) * 1.0 / len(list_distinct(list_concat({_TRI1('w')}, {_TRI1(t)}))))), 0)"
_BOTH = "round(least(" + _WS("title", "'pensions'") + ", " + _WS("title", "'retraite'") + "), 6)"


@q(f"SELECT id, title, {_BOTH} AS similarity FROM {L} WHERE {_BOTH} >= 0.5")
def title_word_similarity(s: SparkSession, d: str) -> DataFrame:
    x = T.laws(s, d, "title")
    both = F.least(text.word_similarity(F.lit("pensions"), F.col("title")), text.word_similarity(F.lit("retraite"), F.col("title")))
    return x.select("id", "title", F.round(both, 6).alias("similarity")).where("similarity >= 0.5")


@q(f"SELECT id, title, starts_with({fold('title')}, 'decret') AS is_prefix FROM {L} WHERE status = 'published' AND (starts_with({fold('title')}, 'decret') OR contains({fold('reference')}, 'dec-2009')) ORDER BY is_prefix DESC, title, id LIMIT 10")
def suggest_prefix_first(s: SparkSession, d: str) -> DataFrame:
    x = T.laws(s, d, "title", "reference", "status").where("status = 'published'")
    x = x.select("id", "title", text.fold(F.col("title")).startswith("decret").alias("is_prefix"), text.fold(F.col("reference")).contains("dec-2009").alias("r"))
    return x.where("is_prefix or r").drop("r").orderBy(F.desc("is_prefix"), "title", "id").limit(10)


# ---- vectors


@q(f"SELECT vec_id, round({cos('embedding::DOUBLE[]', VSQL)}, 6) AS similarity FROM embeddings ORDER BY round({cos('embedding::DOUBLE[]', VSQL)}, 9) DESC, vec_id LIMIT 10")
def knn_exact_cosine(s: SparkSession, d: str) -> DataFrame:
    return S.nearest(table(s, d, "embeddings"), VEC, 10, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@q(f"SELECT vec_id, round({cos('embedding::DOUBLE[]', VSQL)}, 6) AS similarity FROM embeddings WHERE label IN (1, 3) ORDER BY round({cos('embedding::DOUBLE[]', VSQL)}, 9) DESC, vec_id LIMIT 10")
def knn_filtered_cosine(s: SparkSession, d: str) -> DataFrame:
    return S.nearest(table(s, d, "embeddings").where("label in (1, 3)"), VEC, 10, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@q(f"SELECT vec_id, round({cos('list_slice(embedding, 1, 16)::DOUBLE[]', f'list_slice({VSQL}, 1, 16)')}, 6) AS similarity FROM embeddings ORDER BY round({cos('list_slice(embedding, 1, 16)::DOUBLE[]', f'list_slice({VSQL}, 1, 16)')}, 9) DESC, vec_id LIMIT 10")
def knn_matryoshka_slice(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 16).alias("embedding"))
    return S.nearest(x, VEC[:16], 10, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@q(f"""WITH c AS (SELECT q.vec_id AS query, e.vec_id, round({cos('e.embedding::DOUBLE[]', 'q.embedding::DOUBLE[]')}, 9) AS s FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query, vec_id, round(s, 6) AS similarity, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS r FROM c) WHERE r <= 5""")
def knn_batch_bruteforce(s: SparkSession, d: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 20, by matrix products of blocks."""
    from tesselle.operators.bulk_knn import batch_nearest

    return batch_nearest(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), F.col("id") % 20 == 0, 5).select(F.col("query"), F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


@q()
def knn_lsh_rerank(s: SparkSession, d: str) -> DataFrame:
    return S.lsh_nearest(table(s, d, "embeddings"), VEC, 10, "vec_id")


@q()
def ann_recall_at_k(s: SparkSession, d: str) -> DataFrame:
    exact, near = S.nearest(table(s, d, "embeddings"), VEC, 10, "vec_id"), S.lsh_nearest(table(s, d, "embeddings"), VEC, 10, "vec_id")
    return exact.join(near.select("vec_id", F.lit(1).alias("hit")), "vec_id", "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


@q(f"SELECT vec_id, round(greatest(0, least(1, {cos('embedding::DOUBLE[]', VSQL)})), 6) AS score FROM embeddings")
def cosine_score_clamped(s: SparkSession, d: str) -> DataFrame:
    c = vectors.cosine(F.col("embedding"), F.array(*map(F.lit, VEC)))
    return table(s, d, "embeddings").select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6).alias("score"))


@q("SELECT count(*) AS vectors, count(*) FILTER (abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) < 0.001) AS unit, count(*) FILTER (len(embedding) <> 64) AS wrong_size FROM (SELECT DISTINCT ON (article_id) * FROM articles_vecteurs)")
def vector_norm_check(s: SparkSession, d: str) -> DataFrame:
    v = T.vectors(s, d)
    return v.agg(F.count("*").alias("vectors"), F.count_if(F.abs(vectors.norm(F.col("embedding")) - 1) < 0.001).alias("unit"), F.count_if(F.size("embedding") != 64).alias("wrong_size"))


# ---- ranking

_TXT = f"(SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, len(list_filter({words('text')}, lambda w: w = 'licence')) + len(list_filter({words('text')}, lambda w: w = 'pilote')) AS score FROM documents) WHERE score > 0 ORDER BY rank LIMIT 50)"
_SEM = f"(SELECT vec_id AS doc_id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (SELECT vec_id, round({cos('embedding::DOUBLE[]', VSQL)}, 9) AS s FROM embeddings) ORDER BY rank LIMIT 50)"
_RRF = f"(SELECT doc_id, sum(s) AS score FROM (SELECT doc_id, 0.4 / (60 + rank) AS s FROM {_TXT} UNION ALL SELECT doc_id, 0.6 / (60 + rank) FROM {_SEM}) GROUP BY 1)"


def _two(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = text_index.matches(text_index.index(s, d), "d", ["licence", "pilote"], every=False).select(F.col("id").alias("doc_id"), F.col("hits").alias("score"))
    t = S.ranked(m, [F.desc("score"), F.asc("doc_id")], 50).select("doc_id", "rank")
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    v = S.ranked(S.nearest(e, VEC, 50, "doc_id"), [F.desc("similarity"), F.asc("doc_id")], 50).select("doc_id", "rank")
    return t, v


@q(f"SELECT doc_id, round(score, 8) AS score FROM {_RRF}")
def rrf_fusion_weighted(s: SparkSession, d: str) -> DataFrame:
    return S.rrf(*_two(s, d), "doc_id").select("doc_id", F.round("score", 8).alias("score"))


@q(f"SELECT doc_id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS score FROM {_RRF}")
def min_max_normalize(s: SparkSession, d: str) -> DataFrame:
    return S.min_max(S.rrf(*_two(s, d), "doc_id"), "score", bounded=True).select("doc_id", F.round("score", 6).alias("score"))


@q(f"SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS score FROM {_RRF}) ORDER BY score DESC, doc_id LIMIT 10")
def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    return S.min_max(S.rrf(*_two(s, d), "doc_id"), "score", bounded=True).orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


@q(f"SELECT doc_id, row_number() OVER (ORDER BY rank, side) AS pos FROM (SELECT doc_id, rank, side, row_number() OVER (PARTITION BY doc_id ORDER BY rank, side) AS k FROM (SELECT doc_id, rank, 0 AS side FROM {_TXT} UNION ALL SELECT doc_id, rank, 1 FROM {_SEM})) WHERE k = 1")
def interleave_two_rankings(s: SparkSession, d: str) -> DataFrame:
    return R.interleave(*_two(s, d), "doc_id")


@q(f"SELECT law_id, id, hits FROM (SELECT law_id, id, hits, row_number() OVER (PARTITION BY law_id ORDER BY hits DESC, id) AS r FROM (SELECT law_id, id, len(list_filter({words('content')}, lambda w: w = 'licence')) AS hits FROM {A}) WHERE hits > 0) WHERE r = 1")
def group_chunks_to_docs(s: SparkSession, d: str) -> DataFrame:
    x = S.text_scores(T.articles(s, d, "law_id", "content"), ["licence"], {"content": 1.0})
    best = x.groupBy("law_id").agg(F.max_by(F.struct("id", "score"), F.struct("score", F.negative("id"))).alias("b"))
    return best.select("law_id", "b.id", F.col("b.score").cast("bigint").alias("hits"))


@q("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedupe_first_occurrence(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("r")).select("user_id", "r.event_id", "r.ts")


@q(f"SELECT label, count(*) AS kept FROM (SELECT label, {cos('embedding::DOUBLE[]', VSQL)} AS s, max({cos('embedding::DOUBLE[]', VSQL)}) OVER (PARTITION BY label) AS top FROM embeddings) WHERE top >= 0.2 OR s >= 0.1 GROUP BY label")
def similarity_barrier(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "embeddings").select("label", vectors.cosine(F.col("embedding"), F.array(*map(F.lit, VEC))).alias("s"))
    g = x.groupBy("label").agg(F.max("s").alias("top"), F.count("*").alias("n"), F.count_if(F.col("s") >= 0.1).alias("own"))
    return g.select("label", F.when(F.col("top") >= 0.2, F.col("n")).otherwise(F.col("own")).alias("kept")).where("kept > 0")


@q(f"SELECT law_id, id FROM (SELECT law_id, id, sum(least(length(content), 6000)) OVER (PARTITION BY law_id ORDER BY order_no NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY law_id ORDER BY order_no NULLS LAST, id) AS r FROM {A} WHERE content IS NOT NULL) WHERE used <= 2400 OR r = 1")
def context_budget_packing(s: SparkSession, d: str) -> DataFrame:
    a = T.once(table(s, d, "articles").where("content is not null").select("id", "law_id", "order_no", F.least(F.length("content"), F.lit(6000)).alias("n")))
    order = [F.asc_nulls_last("order_no"), F.asc("id")]
    x = ordered.ranged(a, "law_id", order)
    w = ordered.within("law_id", order)
    base = ordered.carried_sum(x, "law_id", used0=F.sum("n"))
    x = x.withColumn("used", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("r", F.row_number().over(w)).join(base, ["law_id", ordered.PART], "left")
    return x.where("used + coalesce(used0, 0) <= 2400 or r = 1 and used0 is null").select("law_id", "id")


_LEX = f"(1.0 * len(list_filter({words('title')}, lambda w: list_contains(['pension', 'retraite'], w))) + 0.4 * (CASE WHEN contains({fold('content')}, 'pension de retraite') THEN 1 ELSE 0 END) - (CASE WHEN length(content) < 80 THEN 0.1 ELSE 0 END))"


@q(f"SELECT id, round({_LEX}, 6) AS score FROM {L} WHERE contains({fold('content')}, 'retraite')")
def rerank_lexical_features(s: SparkSession, d: str) -> DataFrame:
    x = T.laws(s, d, "title", "content").where(text.fold(F.col("content")).contains("retraite"))
    hits = F.size(F.filter(text.words(F.col("title")), lambda w: w.isin("pension", "retraite")))
    score = 1.0 * hits + 0.4 * text.fold(F.col("content")).contains("pension de retraite").cast("int") - F.when(F.length("content") < 80, 0.1).otherwise(0.0)
    return x.select("id", F.round(score, 6).alias("score"))


_SH = "CASE WHEN len({w}) < 3 THEN [] ELSE list_distinct(list_transform(range(1, len({w}) - 1), lambda i: array_to_string(list_slice({w}, i, i + 2), ' '))) END"


_CLS = f"(SELECT category_id, array_to_string(list_sort(s), '|') AS key, min(id) AS id, any_value(s) AS s, count(*) AS members FROM (SELECT id, category_id, {_SH.format(w=words('title'))} AS s FROM {L} WHERE category_id IS NOT NULL) WHERE len(s) > 0 GROUP BY 1, 2)"


def _title_classes(s: SparkSession, d: str) -> DataFrame:
    x = T.laws(s, d, "title", "category_id").where("category_id is not null").select("id", "category_id", text.word_shingles(F.col("title")).alias("s")).where("size(s) > 0")
    return x.withColumn("key", F.array_join(F.array_sort("s"), "|"))


@q(f"SELECT x.id, c.id AS class_id, c.members FROM (SELECT id, category_id, array_to_string(list_sort({_SH.format(w=words('title'))}), '|') AS key FROM {L} WHERE category_id IS NOT NULL) x JOIN {_CLS} c ON c.category_id = x.category_id AND c.key = x.key")
def title_classes(s: SparkSession, d: str) -> DataFrame:
    """The class of every title among those of its category with the same word trigrams: the smallest id, and the number of members."""
    x = _title_classes(s, d)
    g = x.groupBy("category_id", "key").agg(F.min("id").alias("class_id"), F.count("*").alias("members"))
    return x.join(g, ["category_id", "key"]).select("id", "class_id", "members")


@q(f"SELECT a.id AS id_a, b.id AS id_b, round(len(list_intersect(a.s, b.s)) * 1.0 / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM {_CLS} a JOIN {_CLS} b ON a.category_id = b.category_id AND a.id < b.id WHERE len(list_intersect(a.s, b.s)) * 1.0 / len(list_distinct(list_concat(a.s, b.s))) >= 0.5")
def word_trigram_jaccard_pairs(s: SparkSession, d: str) -> DataFrame:
    """Classes of titles of one category (``title_classes``) alike by word trigrams: pairs of their first members. Titles meet only on one of the
    n - ceil(n / 2) + 1 rarest trigrams of each, within a factor of two in size, and are then compared whole."""
    t = _title_classes(s, d).groupBy("category_id", "key").agg(F.min("id").alias("id"), F.first("s").alias("s"))
    g = t.select("category_id", "id", F.size("s").alias("n"), F.explode("s").alias("g"))
    df = g.groupBy("category_id", "g").agg(F.count("*").alias("df"))
    w = Window.partitionBy("id").orderBy("df", "g")
    p = g.join(df, ["category_id", "g"]).withColumn("r", F.row_number().over(w)).where("r <= n - ceil(n / 2) + 1").select("category_id", "g", F.col("id").alias("id_a"), "n")
    b = p.withColumnsRenamed({"id_a": "id_b", "n": "m"})
    c = p.join(b, ["category_id", "g"]).where("id_a < id_b and m <= 2 * n and n <= 2 * m").select("id_a", "id_b").distinct()
    sets = t.select("id", "s")
    both = c.join(sets.withColumnsRenamed({"id": "id_a", "s": "x"}), "id_a").join(sets.withColumnsRenamed({"id": "id_b", "s": "y"}), "id_b")
    return both.select("id_a", "id_b", text.jaccard(F.col("x"), F.col("y")).alias("j")).where("j >= 0.5").select("id_a", "id_b", F.round("j", 6).alias("jaccard"))
