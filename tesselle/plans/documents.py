"""Document rows, relations between texts, evaluation and streams, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselle.functions import text
from tesselle.operators import components, etl, evaluation, relations
from tesselle.operators import search as S
from tesselle.plans.analytics import A, L, M
from tesselle.plans.retrieval import cos, words
from tesselle.session import broadcast_if_small, table
from tesselle.sources import tables as T
from tesselle.streaming import windows as W

Q: dict = {}
SQL: dict[str, str] = {}


def q(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- documents to rows


@q(f"SELECT id, CAST(k AS INTEGER) AS order_no, trim(c, ' ') AS content FROM (SELECT id, unnest(p) AS c, generate_subscripts(p, 1) AS k FROM (SELECT id, regexp_split_to_array(content, '\\n[ \\t]*\\n') AS p FROM {L})) WHERE length(trim(c, ' ')) >= 30")
def paragraph_chunks(s: SparkSession, d: str) -> DataFrame:
    return etl.paragraphs(T.laws(s, d, "content"), "id", "content")


@q()
def chunk_articles_udtf(s: SparkSession, d: str) -> DataFrame:
    return etl.chunk_articles(T.laws(s, d, "content"), "id", "content")


@q(f"SELECT kind, embed, count(*) AS n, count(*) FILTER (length(content) > 600) AS long_ones FROM {A} GROUP BY kind, embed")
def chunk_kinds_counts(s: SparkSession, d: str) -> DataFrame:
    x = T.once(table(s, d, "articles").select("id", "kind", "embed", F.length("content").alias("n")))
    return x.groupBy("kind", "embed").agg(F.count("*").alias("n"), F.count_if(F.col("n") > 600).alias("long_ones"))


@q(f"SELECT sha256(trim(regexp_replace(lower(content), '[ \\n\\t]+', ' ', 'g'), ' ')) AS hash, min(id) AS kept, count(*) AS copies FROM {A} WHERE content IS NOT NULL GROUP BY 1")
def dedupe_content_hash(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "articles").where("content is not null").select("id", text.content_hash(F.col("content")).alias("hash")).distinct()
    return x.groupBy("hash").agg(F.min("id").alias("kept"), F.count("*").alias("copies"))


@q(f"""WITH r AS (SELECT id, unnest(p) AS r, generate_subscripts(p, 1) - 1 AS row_no, true AS html FROM (SELECT id, regexp_extract_all(content, '(?is)<tr\\b[^>]*>(.*?)</tr>', 1) AS p FROM {A} WHERE contains(lower(content), '<tr'))
UNION ALL SELECT id, unnest(p), generate_subscripts(p, 1) - 1, false FROM (SELECT id, list_filter(string_split(content, e'\\n'), lambda x: starts_with(trim(x, ' '), '|') AND NOT regexp_matches(x, '^[|: -]+$')) AS p FROM {A} WHERE contains(content, '|') AND NOT contains(lower(content), '<tr')))
SELECT id, CAST(row_no AS INTEGER) AS row_no, CAST(k - 1 AS INTEGER) AS cell_no, trim(c, ' ') AS cell FROM (SELECT id, row_no, unnest(cells) AS c, generate_subscripts(cells, 1) AS k FROM
 (SELECT id, row_no, CASE WHEN html THEN regexp_extract_all(r, '(?is)<td\\b[^>]*>(.*?)</td>', 1) ELSE string_split(regexp_replace(trim(r, ' '), '^\\||\\|$', '', 'g'), '|') END AS cells FROM r))""")
def table_cells(s: SparkSession, d: str) -> DataFrame:
    return etl.table_cells(T.articles(s, d, "content"), "id", "content")


@q(f"SELECT id, lines, persons FROM (SELECT id, len(x) AS lines, len(list_filter(x, lambda y: regexp_matches(y, 'matricule [0-9]+'))) AS persons FROM (SELECT id, list_filter(string_split(content, e'\\n'), lambda y: trim(y, ' ') <> '') AS x FROM {A})) WHERE lines >= 5 AND persons >= 0.2 * lines")
def roster_table_classifier(s: SparkSession, d: str) -> DataFrame:
    return etl.roster_share(T.articles(s, d, "content"), "id", "content").where("lines >= 5 and persons >= 0.2 * lines").select("id", F.col("lines").cast("bigint").alias("lines"), F.col("persons").cast("bigint").alias("persons"))


@q(f"SELECT id, number, count(*) AS times FROM (SELECT id, unnest(regexp_extract_all(lower(content), '(?:l''article|section|artículo|artikels) ([0-9]+)', 1)) AS number FROM {L}) GROUP BY 1, 2")
def citation_edges_extracted(s: SparkSession, d: str) -> DataFrame:
    return etl.citations(T.laws(s, d, "content"), "id", "content")


@q(f"SELECT id, concat_ws(' | ', nullif(number, ''), nullif(title, ''), substring(regexp_replace(content, '[ \\n\\t]+', ' ', 'g'), 1, 500)) AS embed_text FROM {A}")
def embed_text_builder(s: SparkSession, d: str) -> DataFrame:
    return T.articles(s, d, "number", "title", "content").select("id", etl.embed_text(F.col("number"), F.col("title"), F.col("content")).alias("embed_text"))


@q("SELECT d.doc_id, w.lang, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-zà-ÿ]+)', 1)) AS word FROM documents) d JOIN common_words w ON w.word = d.word GROUP BY 1, 2")
def language_lookup_join(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]+)"), 1)).alias("word"))
    return x.join(broadcast_if_small(table(s, d, "common_words"), 100_000), "word").groupBy("doc_id", "lang").agg(F.count("*").alias("hits"))


# ---- relations between texts: laws of one category as dated links, the kind by their order

_LINKS = f"(SELECT id AS link_id, category_id AS text_id, CASE WHEN id % 4 = 0 THEN 'repeals' ELSE 'amends' END AS nature, publication_date AS day, law.year_of AS other_id FROM (SELECT *, CAST(year(publication_date) AS INTEGER) AS year_of FROM {L}) law WHERE category_id IS NOT NULL AND publication_date IS NOT NULL)"


def _links(s: SparkSession, d: str) -> DataFrame:
    x = T.laws(s, d, "category_id", "publication_date").where("category_id is not null and publication_date is not null")
    return x.select(F.col("id").alias("link_id"), F.col("category_id").alias("text_id"), F.when(F.col("id") % 4 == 0, "repeals").otherwise("amends").alias("nature"), F.col("publication_date").alias("day"), F.year("publication_date").alias("other_id"))


@q(f"SELECT a.link_id, b.link_id AS \"by\" FROM {_LINKS} a JOIN {_LINKS} b ON a.text_id = b.text_id AND b.nature = 'repeals' AND b.day > a.day AND NOT EXISTS (SELECT 1 FROM {_LINKS} c WHERE c.text_id = b.text_id AND c.nature = 'repeals' AND (c.day > b.day OR c.day = b.day AND c.link_id > b.link_id))")
def superseding_links(s: SparkSession, d: str) -> DataFrame:
    return relations.superseding(_links(s, d), ["repeals"])


@q(f"SELECT l.law_id, a.id AS article_id FROM (SELECT id AS law_id, id % 5 + 1 AS lo, id % 5 + 3 AS hi FROM {L}) l JOIN {A} a ON a.law_id = l.law_id AND a.order_no BETWEEN l.lo AND l.hi")
def designation_range_match(s: SparkSession, d: str) -> DataFrame:
    r = T.laws(s, d).select(F.col("id").alias("law_id"), (F.col("id") % 5 + 1).alias("lo"), (F.col("id") % 5 + 3).alias("hi"))
    a = T.articles(s, d, "law_id", "order_no").select("law_id", F.col("order_no").alias("number"), F.col("id").alias("article_id"))
    return relations.unfold(r, "law_id", "lo", "hi").join(a, ["law_id", "number"]).select("law_id", "article_id")


@q(f"SELECT text_id, nature, count(DISTINCT other_id) AS counterparts, max(day) AS latest FROM {_LINKS} a WHERE day >= coalesce((SELECT max(day) FROM {_LINKS} b WHERE b.text_id = a.text_id AND b.nature = 'repeals'), DATE '0001-01-01') GROUP BY 1, 2")
def status_summary_per_text(s: SparkSession, d: str) -> DataFrame:
    return relations.status_summary(_links(s, d), ["repeals"])


_RANGED = f"(SELECT id, content FROM {L} UNION ALL SELECT -id, 'Voir articles ' || (id % 50) || ' à ' || (id % 50 + id % 7) || ', article ' || id || ' et articles 9 to 3.' FROM {L})"
_M = lambda k: f"CAST(nullif(regexp_extract(m, '{k}', 1), '') AS INTEGER)"


@q(f"SELECT DISTINCT id, CAST(unnest(range(lo, greatest(lo, least(hi, lo + 30)) + 1)) AS INTEGER) AS number FROM (SELECT id, {_M('^([0-9]+)')} AS lo, coalesce({_M('([0-9]+)$')}, {_M('^([0-9]+)')}) AS hi FROM (SELECT id, unnest(regexp_extract_all(content, '(?i)articles? ([0-9]+(?: (?:à|to) [0-9]+)?)', 1)) AS m FROM {_RANGED}))")
def article_mentions(s: SparkSession, d: str) -> DataFrame:
    """Articles that texts mention, ranges unfolded; every law is joined by a sentence with ranges, forward and backward."""
    x = T.laws(s, d, "content").select("id", "content")
    n = F.col("id")
    more = x.select((-n).alias("id"), F.concat(F.lit("Voir articles "), (n % 50).cast("string"), F.lit(" à "), (n % 50 + n % 7).cast("string"), F.lit(", article "), n.cast("string"), F.lit(" et articles 9 to 3.")).alias("content"))
    return etl.mentions(x.union(more), "id", "content")


@q(f"SELECT m.id AS message_id, CAST(json_extract(m.sources, '$[0].law_id') AS INTEGER) AS law_id, json_extract_string(m.sources, '$[0].article_number') AS number, min(a.id) AS article_id FROM {M} m LEFT JOIN {A} a ON a.law_id = CAST(json_extract(m.sources, '$[0].law_id') AS INTEGER) AND a.number = json_extract_string(m.sources, '$[0].article_number') WHERE json_valid(m.sources) AND json_array_length(m.sources) > 0 GROUP BY 1, 2, 3")
def citation_resolution(s: SparkSession, d: str) -> DataFrame:
    m = T.messages(s, d, "sources").select(F.col("id").alias("message_id"), F.get_json_object("sources", "$[0].law_id").cast("int").alias("law_id"), F.get_json_object("sources", "$[0].article_number").alias("number")).where("law_id is not null")
    a = table(s, d, "articles").groupBy("law_id", "number").agg(F.min("id").alias("article_id"))
    return m.join(a, ["law_id", "number"], "left").select("message_id", "law_id", "number", "article_id")


@q(f"WITH RECURSIVE e AS (SELECT DISTINCT o1.o_custkey AS a, o2.o_custkey AS b FROM orders o1 JOIN orders o2 ON o1.o_orderkey % 997 = o2.o_orderkey % 997 AND CAST(o1.o_orderdate AS DATE) = CAST(o2.o_orderdate AS DATE) AND o1.o_custkey <> o2.o_custkey), r(n, m) AS (SELECT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n) SELECT n AS node, min(m) AS root FROM r GROUP BY n")
def connected_texts(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_custkey", (F.col("o_orderkey") % 997).alias("k"), F.to_date("o_orderdate").alias("day"))
    hub = o.groupBy("k", "day").agg(F.min("o_custkey").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return components.components(o.join(hub, ["k", "day"]).select(F.col("o_custkey").alias("a"), F.col("hub").alias("b")))


# ---- evaluation: nearest vectors of one label as gold

_RANKS = f"""(SELECT question, min(rank) AS rank FROM (SELECT q.vec_id AS question, e.label = q.label AS good, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cos('e.embedding::DOUBLE[]', 'q.embedding::DOUBLE[]')}, 9) DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0) WHERE good AND rank <= 20 GROUP BY 1)"""
_ALL = f"(SELECT v.vec_id AS question, r.rank FROM embeddings v LEFT JOIN {_RANKS} r ON r.question = v.vec_id WHERE v.vec_id % 20 = 0)"


def _ranks(s: SparkSession, d: str) -> DataFrame:
    from tesselle.operators.bulk_knn import batch_nearest

    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    near = batch_nearest(e, F.col("id") % 20 == 0, 20)
    asked = e.where("id % 20 = 0").select(F.col("id").alias("question"), F.col("label").alias("want"))
    good = near.join(e.select("id", "label"), "id").join(asked, F.col("query") == F.col("question")).where("label = want")
    return asked.select("question").join(good.groupBy("question").agg(F.min("rank").alias("rank")), "question", "left")


@q(f"SELECT k, round((SELECT avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END) FROM {_ALL}), 6) AS recall FROM (VALUES (1), (5), (20)) t(k)")
def recall_at_k(s: SparkSession, d: str) -> DataFrame:
    return evaluation.recall_at(_ranks(s, d), [1, 5, 20]).select("k", F.round("recall", 6).alias("recall"))


@q(f"SELECT round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr, count(*) AS questions FROM {_ALL}")
def mrr_cutoff(s: SparkSession, d: str) -> DataFrame:
    return evaluation.mrr(_ranks(s, d), 10).select(F.round("mrr", 6).alias("mrr"), "questions")


@q()
def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    return evaluation.bootstrap(table(s, d, "events"), "value")


@q(f"""WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY n DESC, doc_id) AS rank FROM (SELECT doc_id, len(list_filter({words('text')}, lambda w: w = 'licence')) AS n FROM documents) WHERE n > 0 ORDER BY rank LIMIT 30),
v AS (SELECT doc_id, row_number() OVER (ORDER BY n DESC, doc_id) AS rank FROM (SELECT doc_id, len(list_filter({words('text')}, lambda w: w = 'pension')) AS n FROM documents) WHERE n > 0 ORDER BY rank LIMIT 30),
p AS (SELECT k, w FROM (VALUES (10), (60)) a(k), (VALUES (0.2), (0.8)) b(w)), s AS (SELECT k, w, doc_id, sum(x) AS score FROM (SELECT k, w, doc_id, w / (k + rank) AS x FROM t, p UNION ALL SELECT k, w, doc_id, (1 - w) / (k + rank) FROM v, p) GROUP BY 1, 2, 3)
SELECT k, CAST(w AS DOUBLE) AS w, doc_id, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY k, w ORDER BY round(score, 12) DESC, doc_id) AS r FROM s) WHERE r <= 5""")
def rrf_parameter_sweep(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "text")
    t, v = (S.ranked(S.text_scores(docs, [w], {"text": 1.0}, "doc_id"), [F.desc("score"), F.asc("doc_id")], 30) for w in ("licence", "pension"))
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k in (10, 60) for w in (0.2, 0.8)]))
    x = t.select("doc_id", "rank", grid.alias("p")).select("p.k", "p.w", "doc_id", (F.col("p.w") / (F.col("p.k") + F.col("rank"))).alias("x"))
    x = x.union(v.select("doc_id", "rank", grid.alias("p")).select("p.k", "p.w", "doc_id", ((1 - F.col("p.w")) / (F.col("p.k") + F.col("rank"))).alias("x")))
    g = x.groupBy("k", "w", "doc_id").agg(F.sum("x").alias("score"))
    r = F.row_number().over(Window.partitionBy("k", "w").orderBy(F.desc(F.round("score", 12)), "doc_id"))
    return g.withColumn("r", r).where("r <= 5").select("k", "w", "doc_id", F.round("score", 8).alias("score"))


@q(f"SELECT coalesce(language, '-') AS label, coalesce(detected_language, '-') AS detected, count(*) AS n FROM {L} GROUP BY 1, 2")
def confusion_matrix(s: SparkSession, d: str) -> DataFrame:
    return T.laws(s, d, "language", "detected_language").groupBy(F.coalesce("language", F.lit("-")).alias("label"), F.coalesce("detected_language", F.lit("-")).alias("detected")).agg(F.count("*").alias("n"))


@q("SELECT event_type, list_sort(list(value))[CAST(least(count(*) - 1, CAST(floor(0.9 * count(*)) AS BIGINT)) + 1 AS BIGINT)] AS p90, max(value) AS longest FROM events GROUP BY 1")
def p90_by_index(s: SparkSession, d: str) -> DataFrame:
    """The value at place min(n - 1, int(0.9 n)) of the sorted ones, by rank instead of a collected list."""
    e = table(s, d, "events")
    at = evaluation.values_at(e, "event_type", "value", {"p90": "least(n - 1, cast(floor(0.9 * n) as bigint))"})
    return e.groupBy("event_type").agg(F.max("value").alias("longest")).join(at, "event_type").select("event_type", "p90", "longest")


# ---- streams, run over all that is available


@q("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_window_counts(s: SparkSession, d: str) -> DataFrame:
    out = W.run_available(W.tumbling_of(W.read_closed(s, f"{d}/events.parquet")))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@q("SELECT start, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'error') >= 3 AND count(*) FILTER (event_type = 'error') >= 0.3 * count(*) AS degraded FROM (SELECT event_type, unnest(list_transform(range(0, 6), lambda i: date_trunc('hour', ts) - to_hours(CAST(i AS INTEGER)))) AS start FROM events) GROUP BY 1")
def sliding_window_failure_rate(s: SparkSession, d: str) -> DataFrame:
    out = W.run_available(W.sliding_failures_of(W.read_closed(s, f"{d}/events.parquet")))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@q("""WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM y GROUP BY user_id, k""")
def session_window_sessions(s: SparkSession, d: str) -> DataFrame:
    out = W.run_available(W.sessions_of(W.read_closed(s, f"{d}/events.parquet")))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@q("SELECT event_id, user_id, event_type, ts FROM events")
def dedup_within_watermark(s: SparkSession, d: str) -> DataFrame:
    """Every second event comes twice; each is passed on once."""
    e = W.read_events(s, f"{d}/events.parquet")
    out = W.run_available(W.deduplicated_of(e.union(e.where("event_id % 2 = 1"))))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@q("SELECT e.event_id, e.event_type, c.c_mktsegment AS segment FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def stream_static_join(s: SparkSession, d: str) -> DataFrame:
    static = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return W.run_available(W.enriched_of(W.read_events(s, f"{d}/events.parquet"), static))


@q()
def rate_limiter_replay(s: SparkSession, d: str) -> DataFrame:
    return W.replay_limiter(table(s, d, "events"))
