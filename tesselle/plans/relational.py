"""Joins, sets, windows, refinement and facets, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselle.functions import text
from tesselle.operators import refinement as R
from tesselle.plans.analytics import A, C, L, M, V
from tesselle.operators import ordered
from tesselle.session import bounded, broadcast_if_small, table
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


FILTER = "language = 'fr' AND status = 'published' AND category_id IN (1, 2, 5) AND year(publication_date) BETWEEN 2000 AND 2015"


@q(f"SELECT id, reference, category_id, publication_date FROM {L} WHERE {FILTER}")
def law_filter_conjunctive(s: SparkSession, d: str) -> DataFrame:
    x = T.laws(s, d, "reference", "language", "status", "category_id", "publication_date")
    return R.law_filter(x, language="fr", status="published", category_ids=[1, 2, 5], years=(2000, 2015)).select("id", "reference", "category_id", "publication_date")


@q(f"SELECT id FROM {L} l WHERE status = 'published' AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.law_id = l.id)")
def anti_join_without_children(s: SparkSession, d: str) -> DataFrame:
    return T.laws(s, d, "status").where("status = 'published'").join(table(s, d, "articles").select(F.col("law_id").alias("id")), "id", "left_anti").select("id")


@q(f"SELECT id, reference FROM {L} l WHERE EXISTS (SELECT 1 FROM articles a WHERE a.law_id = l.id AND a.kind = 'table')")
def semi_join_exists(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "articles").where("kind = 'table'").select(F.col("law_id").alias("id"))
    return T.laws(s, d, "reference").join(a, "id", "left_semi").select("id", "reference")


@q(f"SELECT l.id, (SELECT count(*) FROM {A} a WHERE a.law_id = l.id) AS articles FROM {L} l")
def correlated_count_children(s: SparkSession, d: str) -> DataFrame:
    n = T.articles(s, d, "law_id").groupBy(F.col("law_id").alias("law")).agg(F.count("*").alias("n"))
    return T.laws(s, d).join(n, F.col("id") == F.col("law"), "left").select("id", F.coalesce("n", F.lit(0)).alias("articles"))


@q(f"SELECT l.language, c.persona, count(*) AS cited FROM (SELECT conversation_id, CAST(json_extract(unnest(json_extract(sources, '$[*]')), '$.law_id') AS INTEGER) AS law_id FROM {M} WHERE sources IS NOT NULL AND json_valid(sources)) m JOIN {C} c ON c.id = m.conversation_id JOIN {L} l ON l.id = m.law_id GROUP BY 1, 2")
def three_way_source_join(s: SparkSession, d: str) -> DataFrame:
    """Every source of every message, joined with its conversation and its law."""
    m = T.messages(s, d, "conversation_id", "sources").where("sources is not null").select("conversation_id", F.explode(F.from_json("sources", "array<struct<law_id:int>>")["law_id"]).alias("law_id"))
    x = m.join(T.conversations(s, d, "persona").withColumnRenamed("id", "conversation_id"), "conversation_id").join(T.laws(s, d, "language").withColumnRenamed("id", "law_id"), "law_id")
    return x.groupBy("language", "persona").agg(F.count("*").alias("cited"))


@q(f"SELECT law_id, id, rank FROM (SELECT law_id, id, row_number() OVER (PARTITION BY law_id ORDER BY length(content) DESC NULLS LAST, order_no, id) AS rank FROM {A}) WHERE rank <= 3")
def per_group_cap_topk(s: SparkSession, d: str) -> DataFrame:
    a = T.once(table(s, d, "articles").select("id", "law_id", "order_no", F.length("content").alias("n")))
    return R.top_per_group(a, "law_id", [F.desc_nulls_last("n"), F.asc_nulls_last("order_no"), F.asc("id")], 3).select("law_id", "id", "rank")


@q(f"SELECT id, total FROM (SELECT id, count(*) OVER () AS total, row_number() OVER (ORDER BY publication_date DESC NULLS LAST, id) AS r FROM {L} WHERE status = 'published') WHERE r BETWEEN 21 AND 40")
def page_with_total(s: SparkSession, d: str) -> DataFrame:
    x = T.laws(s, d, "status", "publication_date").where("status = 'published'")
    return R.page(x, [F.desc_nulls_last("publication_date"), F.asc("id")], offset=20, limit=20).select("id", "total")


@q(f"""WITH h AS (SELECT id, 1 AS pass FROM {L} WHERE title ILIKE '%pension de retraite%' UNION ALL SELECT id, 2 FROM {L} WHERE content ILIKE '%pension de retraite%')
SELECT id, pass FROM h WHERE pass = (SELECT min(pass) FROM h)""")
def priority_lookup_first_pass(s: SparkSession, d: str) -> DataFrame:
    x = T.laws(s, d, "title", "content")
    return R.first_pass([x.where(F.col("title").ilike("%pension de retraite%")).select("id"), x.where(F.col("content").ilike("%pension de retraite%")).select("id")])


@q(f"""WITH x AS (SELECT law_id, order_no, CASE WHEN lag(order_no) OVER w IS NULL OR order_no <> lag(order_no) OVER w + 1 OR kind IS DISTINCT FROM lag(kind) OVER w THEN 1 ELSE 0 END AS b FROM {A} WHERE law_id IS NOT NULL AND order_no IS NOT NULL WINDOW w AS (PARTITION BY law_id ORDER BY order_no, id)),
y AS (SELECT law_id, order_no, sum(b) OVER (PARTITION BY law_id ORDER BY order_no ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT law_id, order_no, b FROM x))
SELECT law_id, CAST(island AS BIGINT) AS island, min(order_no) AS first_no, max(order_no) AS last_no, count(*) AS pieces FROM y GROUP BY 1, 2""")
def gaps_and_islands_sequences(s: SparkSession, d: str) -> DataFrame:
    return R.islands(T.articles(s, d, "law_id", "order_no", "kind").where("law_id is not null and order_no is not null"))


@q(f"""WITH p AS (SELECT DISTINCT law_id, page_number AS page FROM articles WHERE page_number IS NOT NULL), i AS (SELECT law_id, page, page - row_number() OVER (PARTITION BY law_id ORDER BY page) AS k FROM p),
j AS (SELECT law_id, page, k, (row_number() OVER (PARTITION BY law_id, k ORDER BY page) - 1) // 4 AS b FROM i) SELECT law_id, min(page) AS first_page, max(page) AS last_page FROM j GROUP BY law_id, k, b""")
def page_range_islands(s: SparkSession, d: str) -> DataFrame:
    return R.page_ranges(table(s, d, "articles").select("law_id", F.col("page_number").alias("page")), most=4)


@q(f"SELECT article_id, number FROM (SELECT id AS article_id, number FROM {A} EXCEPT ALL SELECT v.article_id, a.number FROM {V} v JOIN {A} a ON a.id = v.article_id)")
def multiset_diff_except_all(s: SparkSession, d: str) -> DataFrame:
    read = lambda: table(s, d, "articles").select(F.col("id").alias("article_id"), "number").distinct()
    held = table(s, d, "articles_vecteurs").select("article_id").distinct()
    return read().exceptAll(held.join(read(), "article_id"))


@q("SELECT user_id, event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key_upsert(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    best = e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("r"))
    return best.select("user_id", "event_type", "r.ts", "r.value")


@q("SELECT sha256(text) AS hash, min(doc_id) AS canonical, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def canonical_per_hash(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return x.groupBy("hash").agg(F.min("doc_id").alias("canonical"), F.count("*").alias("copies")).where("copies > 1")


@q(f"""SELECT id, array_to_string(list_distinct_ordered, ',') AS kept FROM (SELECT id, (SELECT list(x ORDER BY k) FROM (SELECT x, min(k) AS k FROM (SELECT unnest(suggested_categories) AS x, generate_subscripts(suggested_categories, 1) AS k) WHERE x IN (SELECT id FROM categories) GROUP BY x)) AS list_distinct_ordered FROM {L} WHERE suggested_categories IS NOT NULL)""")
def array_cleanup_ordered(s: SparkSession, d: str) -> DataFrame:
    valid = [r["id"] for r in bounded(table(s, d, "categories").select("id").where("id is not null").distinct(), 10_000, "categories")]
    x = T.laws(s, d, "suggested_categories").where("suggested_categories is not null")
    kept = F.array_distinct(F.filter("suggested_categories", lambda c: c.isin(valid)))
    return x.select("id", F.nullif(F.array_join(kept, ","), F.lit("")).alias("kept"))


_MOVE = "(SELECT a.id AS source, b.id AS target FROM categories a JOIN categories b ON a.name = 'Textes divers' AND b.display_order = (SELECT min(display_order) FROM categories))"


@q(f"SELECT id, CASE WHEN category_id = m.source THEN m.target ELSE category_id END AS category_id, array_to_string(list_transform(suggested_categories, lambda c: CASE WHEN c = m.source THEN m.target ELSE c END), ',') AS suggestions FROM {L} l LEFT JOIN {_MOVE} m ON true")
def update_from_join_replace(s: SparkSession, d: str) -> DataFrame:
    """One category's laws and suggestions given to another; both are looked up in the table of categories."""
    c = table(s, d, "categories")
    first = c.agg(F.min("display_order").alias("o"))
    source, target = c.where("name = 'Textes divers'").select(F.col("id").alias("source")), c.join(F.broadcast(first), F.col("display_order") == F.col("o")).select(F.col("id").alias("target"))
    x = T.laws(s, d, "category_id", "suggested_categories").join(F.broadcast(source.join(target)), how="left")  # one row
    swap = lambda c: F.when(c == F.col("source"), F.col("target")).otherwise(c)
    return x.select("id", swap(F.col("category_id")).alias("category_id"), F.array_join(F.transform("suggested_categories", swap), ",").alias("suggestions"))


@q(f"""WITH n AS (SELECT law_id, count(*) AS n FROM {A} GROUP BY 1) SELECT CASE WHEN n.n > 100 THEN 'large' WHEN n.n >= 5 THEN 'medium' ELSE 'small' END AS stratum, count(*) AS articles, count(*) FILTER (length(a.content) >= 200) AS long_enough FROM {A} a JOIN n USING (law_id) GROUP BY 1""")
def stratified_counts(s: SparkSession, d: str) -> DataFrame:
    a = T.once(table(s, d, "articles").select("id", "law_id", F.length("content").alias("size"))).where("law_id is not null")
    g = a.groupBy("law_id").agg(F.count("*").alias("n"), F.count_if(F.col("size") >= 200).alias("l"))
    stratum = F.when(F.col("n") > 100, "large").when(F.col("n") >= 5, "medium").otherwise("small")
    return g.groupBy(stratum.alias("stratum")).agg(F.sum("n").alias("articles"), F.sum("l").alias("long_enough"))


@q(f"""SELECT count(*) FILTER (c.id IS NULL AND l.category_id IS NOT NULL) AS dangling, count(*) FILTER (l.category_id IS NULL) AS unset, count(*) AS laws FROM {L} l LEFT JOIN categories c ON c.id = l.category_id""")
def referential_integrity(s: SparkSession, d: str) -> DataFrame:
    x = T.laws(s, d, "category_id").join(broadcast_if_small(table(s, d, "categories").select(F.col("id").alias("cid")), 10_000), F.col("category_id") == F.col("cid"), "left")
    return x.agg(F.count_if(F.expr("cid is null and category_id is not null")).alias("dangling"), F.count_if(F.col("category_id").isNull()).alias("unset"), F.count("*").alias("laws"))


@q(f"""SELECT coalesce(v.article_id, a.id) AS article_id, CASE WHEN a.id IS NULL THEN 'orphan' WHEN v.article_id IS NULL THEN 'missing' ELSE 'stale' END AS state FROM {V} v FULL JOIN (SELECT * FROM {A} WHERE embedding IS NOT NULL OR id IN (SELECT article_id FROM articles_vecteurs)) a ON a.id = v.article_id WHERE a.id IS NULL OR v.article_id IS NULL OR a.law_id IS DISTINCT FROM v.law_id""")
def sync_copy_drift(s: SparkSession, d: str) -> DataFrame:
    v = T.vectors(s, d).select("article_id", F.col("law_id").alias("vlaw"))
    a = T.once(table(s, d, "articles").select("id", "law_id", F.col("embedding").isNotNull().alias("has")))
    x = v.join(a, v["article_id"] == a["id"], "full").where("id is null or (article_id is null and has) or (article_id is not null and not law_id <=> vlaw)")
    return x.select(F.coalesce("article_id", "id").alias("article_id"), F.when(F.col("id").isNull(), "orphan").when(F.col("article_id").isNull(), "missing").otherwise("stale").alias("state"))


_CAND = f"(SELECT id, type, category_id, year(publication_date) AS year FROM {L} WHERE status = 'published')"
CHOSEN = {"type": ["loi", "law"], "category_id": [1, 2, 3], "year": [2010, 2011, 2012]}


def _facet(s: SparkSession, d: str, name: str) -> DataFrame:
    x = T.laws(s, d, "type", "category_id", "publication_date", "status").where("status = 'published'").withColumn("year", F.year("publication_date"))
    return R.disjunctive_facet(x, CHOSEN, name)


@q(f"SELECT type AS value, count(*) AS n FROM {_CAND} WHERE category_id IN (1, 2, 3) AND year IN (2010, 2011, 2012) GROUP BY 1")
def facets_disjunctive_type(s: SparkSession, d: str) -> DataFrame:
    return _facet(s, d, "type")


@q(f"SELECT category_id AS value, count(*) AS n FROM {_CAND} WHERE type IN ('loi', 'law') AND year IN (2010, 2011, 2012) GROUP BY 1")
def facets_disjunctive_category(s: SparkSession, d: str) -> DataFrame:
    return _facet(s, d, "category_id")


@q(f"SELECT CAST(year AS INTEGER) AS value, count(*) AS n FROM {_CAND} WHERE type IN ('loi', 'law') AND category_id IN (1, 2, 3) GROUP BY 1")
def facets_disjunctive_year(s: SparkSession, d: str) -> DataFrame:
    return _facet(s, d, "year")


@q(f"SELECT id, row_number() OVER (ORDER BY publication_date ASC NULLS LAST, id) AS up, row_number() OVER (ORDER BY publication_date DESC NULLS LAST, id) AS down FROM {L}")
def date_sort_nulls_last(s: SparkSession, d: str) -> DataFrame:
    """The place of every law in both orders; places are counted by ranges, no task sorts the whole table."""
    x = T.laws(s, d, "publication_date")
    up = R.places(x, [F.asc_nulls_last("publication_date"), F.asc("id")], "up")
    return R.places(up, [F.desc_nulls_last("publication_date"), F.asc("id")], "down").select("id", "up", "down")


@q(f"SELECT id, CAST(json_array_length(sources) AS INTEGER) AS n FROM {M} WHERE sources IS NOT NULL AND json_valid(sources) AND json_type(sources) = 'ARRAY'")
def json_shape_filter(s: SparkSession, d: str) -> DataFrame:
    return T.messages(s, d, "sources").select("id", F.json_array_length("sources").alias("n")).where("n is not null")


@q("SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def star_join_revenue(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    x = table(s, d, "orders").select("o_orderkey", "o_custkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    x = x.join(table(s, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("n_name", "r_name").agg(F.round(F.sum("rev"), 2).alias("revenue"), F.count("*").alias("orders"))


@q(f"SELECT number, regexp_replace(regexp_replace(upper(number), '^(ARTICLE|ART\\.?)[ ]+', ''), '^[ .:''-]+|[ .:''-]+$', '', 'g') AS stripped, count(*) AS n FROM {A} WHERE number IS NOT NULL GROUP BY 1, 2")
def normalize_article_number(s: SparkSession, d: str) -> DataFrame:
    n = F.regexp_replace(F.upper("number"), r"^(?:ARTICLE|ART\.?)[ ]+", "")
    x = T.articles(s, d, "number").where("number is not null")
    return x.groupBy("number", F.regexp_replace(n, r"^[ .:'-]+|[ .:'-]+$", "").alias("stripped")).agg(F.count("*").alias("n"))


@q(f"SELECT id, nullif(regexp_extract(CASE WHEN upper(number) IN ('PREMIER', '1ER', 'FIRST', '1ST') THEN '1' ELSE upper(number) END, '^([0-9]+)', 1), '') AS base FROM {A}")
def article_base_number(s: SparkSession, d: str) -> DataFrame:
    return T.articles(s, d, "number").select("id", text.base_number(F.col("number")).alias("base"))
