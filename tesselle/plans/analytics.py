"""Analytics over the corpus, the search events and the conversations, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselle.operators import evaluation
from tesselle.session import table
from tesselle.sources import tables as T

Q: dict = {}
SQL: dict[str, str] = {}
L = "(SELECT DISTINCT ON (id) * FROM laws)"
A = "(SELECT DISTINCT ON (id) * FROM articles)"
M = "(SELECT DISTINCT ON (id) * FROM messages)"
C = "(SELECT DISTINCT ON (id) * FROM conversations)"
V = "(SELECT DISTINCT ON (article_id) * FROM articles_vecteurs)"
ROLE = "lower(trim(role))"


def q(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _one(df: DataFrame, *aggs) -> DataFrame:
    return df.agg(*aggs)


@q(f"SELECT language, count(*) AS laws FROM {L} GROUP BY language")
def overview_by_language(s: SparkSession, d: str) -> DataFrame:
    return T.laws(s, d, "language").groupBy("language").agg(F.count("*").alias("laws"))


@q(f"SELECT status, count(*) AS laws, count(*) FILTER (created_at >= (SELECT max(created_at) FROM laws) - INTERVAL 30 DAY) AS recent FROM {L} GROUP BY status")
def overview_by_status(s: SparkSession, d: str) -> DataFrame:
    last = table(s, d, "laws").agg(F.max("created_at").alias("last"))
    x = T.laws(s, d, "status", "created_at").join(F.broadcast(last))  # one row
    return x.groupBy("status").agg(F.count("*").alias("laws"), F.count_if(F.expr("created_at >= last - interval 30 days")).alias("recent"))


@q(f"SELECT type, language, count(*) AS laws, CAST(trunc(avg(length(content))) AS BIGINT) AS avg_length FROM {L} GROUP BY type, language")
def law_stats_avg_length(s: SparkSession, d: str) -> DataFrame:
    return T.laws(s, d, "type", "language", "content").groupBy("type", "language").agg(F.count("*").alias("laws"), F.avg(F.length("content")).cast("bigint").alias("avg_length"))


@q("SELECT event_type AS mode, count(*) AS searches, round(count(*) * 100.0 / (SELECT count(*) FROM events), 4) AS percent FROM events GROUP BY event_type")
def search_modes_usage(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "events").groupBy(F.col("event_type").alias("mode")).agg(F.count("*").alias("searches"))
    return g.withColumn("percent", F.round(F.col("searches") * 100.0 / F.sum("searches").over(Window.partitionBy()), 4))


@q("SELECT event_type AS mode, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS longest FROM events WHERE event_type <> 'view' GROUP BY event_type")
def search_latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").where("event_type <> 'view'")
    at = evaluation.values_at(e, "event_type", "value", {"p50": "cast(ceil(0.5 * n) as bigint) - 1", "p95": "cast(ceil(0.95 * n) as bigint) - 1"})
    return e.groupBy("event_type").agg(F.max("value").alias("longest")).join(at, "event_type").select(F.col("event_type").alias("mode"), "p50", "p95", "longest")


@q("SELECT CAST(ts AS DATE) AS day, round(count(*) FILTER (event_type = 'view') * 100.0 / count(*), 4) AS hit_percent FROM events GROUP BY 1")
def search_cache_hit_rate(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.count_if(F.col("event_type") == "view") * 100.0 / F.count("*"), 4).alias("hit_percent"))


@q("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS query, count(*) AS times FROM events GROUP BY 1 ORDER BY times DESC, query LIMIT 10")
def popular_queries_topn(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("query"))
    return e.groupBy("query").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "query").limit(10)


@q(f"SELECT c.persona, count(*) FILTER ({ROLE} = 'user') AS questions, count(*) FILTER ({ROLE} = 'assistant') AS answers, count(DISTINCT m.conversation_id) AS conversations FROM {M} m JOIN {C} c ON c.id = m.conversation_id GROUP BY c.persona")
def usage_question_answer_counts(s: SparkSession, d: str) -> DataFrame:
    m = T.messages(s, d, "conversation_id", "role").withColumn("r", F.lower(F.trim("role"))).drop("id")
    x = m.join(T.conversations(s, d, "persona").withColumnRenamed("id", "conversation_id"), "conversation_id")
    return x.groupBy("persona").agg(F.count_if(F.col("r") == "user").alias("questions"), F.count_if(F.col("r") == "assistant").alias("answers"), F.count_distinct("conversation_id").alias("conversations"))


@q(f"SELECT hour, count(*) AS uses FROM (SELECT CAST(hour(created_at) AS INTEGER) AS hour FROM {C} UNION ALL SELECT CAST(hour(ts) AS INTEGER) FROM events) GROUP BY hour ORDER BY uses DESC, hour LIMIT 5")
def usage_peak_hours_union(s: SparkSession, d: str) -> DataFrame:
    h = T.conversations(s, d, "created_at").select(F.hour("created_at").alias("hour")).union(table(s, d, "events").select(F.hour("ts")))
    return h.groupBy("hour").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "hour").limit(5)


@q(f"SELECT CAST(created_at AS DATE) AS day, count(DISTINCT user_id) AS users, count(*) FILTER (user_id IS NULL) AS anonymous FROM {C} GROUP BY 1")
def usage_active_users_distinct(s: SparkSession, d: str) -> DataFrame:
    return T.conversations(s, d, "created_at", "user_id").groupBy(F.to_date("created_at").alias("day")).agg(F.count_distinct("user_id").alias("users"), F.count_if(F.col("user_id").isNull()).alias("anonymous"))


_ROLLUP = f"""SELECT c.persona, CAST(c.created_at AS DATE) AS day, count(DISTINCT c.id) AS conversations, count(m.id) AS messages, count(*) FILTER (lower(trim(m.role)) = 'user') AS questions,
  round(avg(m.confidence), 9) AS avg_confidence, sum(m.retrieval_time_ms) // nullif(count(m.retrieval_time_ms), 0) AS avg_retrieval FROM {C} c LEFT JOIN {M} m ON m.conversation_id = c.id GROUP BY 1, 2"""


def daily_rollup(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """One row a persona and day; time averages are floored divisions over known times."""
    x = conversations.select(F.col("id").alias("cid"), "persona", F.to_date("created_at").alias("day")).join(messages, F.col("cid") == F.col("conversation_id"), "left")
    return x.groupBy("persona", "day").agg(
        F.count_distinct("cid").alias("conversations"),
        F.count("id").alias("messages"),
        F.count_if(F.lower(F.trim("role")) == "user").alias("questions"),
        F.round(F.avg("confidence"), 9).alias("avg_confidence"),
        F.expr("sum(retrieval_time_ms) div nullif(count(retrieval_time_ms), 0)").alias("avg_retrieval"),
    )


def _roll(s: SparkSession, d: str) -> DataFrame:
    return daily_rollup(T.conversations(s, d, "persona", "created_at"), T.messages(s, d, "conversation_id", "role", "confidence", "retrieval_time_ms"))


@q(_ROLLUP.replace("sum(m.retrieval_time_ms) // nullif(count(m.retrieval_time_ms), 0)", "CAST(sum(m.retrieval_time_ms) // nullif(count(m.retrieval_time_ms), 0) AS BIGINT)"))
def persona_daily_rollup(s: SparkSession, d: str) -> DataFrame:
    return _roll(s, d)


@q(f"SELECT persona, CAST(sum(conversations) AS BIGINT) AS conversations, CAST(sum(questions) AS BIGINT) AS questions, round(sum(avg_confidence * questions) / nullif(sum(questions) FILTER (avg_confidence IS NOT NULL), 0), 8) AS confidence, CAST(sum(messages) // count(*) AS BIGINT) AS messages_a_day FROM ({_ROLLUP}) GROUP BY persona")
def persona_rollup_weighted(s: SparkSession, d: str) -> DataFrame:
    known = F.sum(F.when(F.col("avg_confidence").isNotNull(), F.col("questions")))
    return _roll(s, d).groupBy("persona").agg(
        F.sum("conversations").alias("conversations"), F.sum("questions").alias("questions"), F.round(F.sum(F.col("avg_confidence") * F.col("questions")) / F.nullif(known, F.lit(0)), 8).alias("confidence"), F.expr("sum(messages) div count(*)").alias("messages_a_day")
    )


@q(f"SELECT p.persona, coalesce(n, 0) AS conversations, round(coalesce(n, 0) * 100.0 / (SELECT count(*) FROM {C}), 2) AS percent FROM (VALUES ('citoyen'), ('avocat'), ('juge')) p(persona) LEFT JOIN (SELECT persona, count(*) AS n FROM {C} GROUP BY 1) USING (persona)")
def persona_usage_share(s: SparkSession, d: str) -> DataFrame:
    n = T.conversations(s, d, "persona").groupBy("persona").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    total = n.agg(F.max("total").alias("total"))
    p = s.createDataFrame([("citoyen",), ("avocat",), ("juge",)], "persona string").join(F.broadcast(total))
    x = p.join(n.select("persona", "n"), "persona", "left").withColumn("conversations", F.coalesce("n", F.lit(0)))
    return x.select("persona", "conversations", F.round(F.col("conversations") * 100.0 / F.col("total"), 2).alias("percent"))


@q(f"""WITH x AS (SELECT c.id, c.persona, CAST(c.created_at AS DATE) AS day, count(m.id) AS n, epoch(max(m.created_at)) - epoch(min(m.created_at)) AS secs FROM {C} c LEFT JOIN {M} m ON m.conversation_id = c.id GROUP BY 1, 2, 3)
SELECT persona, count(*) AS conversations, CAST(sum(n) AS BIGINT) AS messages, round(avg(n), 4) AS per_conversation, CAST(trunc(avg(secs) FILTER (n >= 2)) AS BIGINT) AS avg_seconds, count(DISTINCT day) AS active_days FROM x GROUP BY persona""")
def engagement_metrics(s: SparkSession, d: str) -> DataFrame:
    c = T.conversations(s, d, "persona", "created_at").select(F.col("id").alias("cid"), "persona", F.to_date("created_at").alias("day"))
    m = T.messages(s, d, "conversation_id", "created_at").withColumn("t", F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6)
    x = c.join(m, F.col("cid") == F.col("conversation_id"), "left").groupBy("cid", "persona", "day").agg(F.count("id").alias("n"), (F.max("t") - F.min("t")).alias("secs"))
    return x.groupBy("persona").agg(F.count("*").alias("conversations"), F.sum("n").alias("messages"), F.round(F.avg("n"), 4).alias("per_conversation"), F.avg(F.when(F.col("n") >= 2, F.col("secs"))).cast("bigint").alias("avg_seconds"), F.count_distinct("day").alias("active_days"))


@q(f"SELECT content AS question, count(*) AS times FROM {M} WHERE {ROLE} = 'user' AND content IS NOT NULL GROUP BY 1 ORDER BY times DESC, question LIMIT 20")
def popular_questions(s: SparkSession, d: str) -> DataFrame:
    m = T.messages(s, d, "role", "content").where("lower(trim(role)) = 'user' and content is not null")
    return m.groupBy(F.col("content").alias("question")).agg(F.count("*").alias("times")).orderBy(F.desc("times"), "question").limit(20)


@q(f"""WITH x AS (SELECT c.persona, m.confidence, m.generation_time_ms AS g FROM {M} m JOIN {C} c ON c.id = m.conversation_id)
SELECT persona, 'confidence' AS metric, round(avg(confidence), 9) AS value FROM x GROUP BY 1 UNION ALL SELECT persona, 'generation_ms', round(avg(g), 9) FROM x GROUP BY 1""")
def compare_profiles(s: SparkSession, d: str) -> DataFrame:
    m = T.messages(s, d, "conversation_id", "confidence", "generation_time_ms").drop("id")
    x = m.join(T.conversations(s, d, "persona").withColumnRenamed("id", "conversation_id"), "conversation_id").groupBy("persona")
    x = x.agg(F.round(F.avg("confidence"), 9).alias("confidence"), F.round(F.avg("generation_time_ms"), 9).alias("generation_ms"))
    return x.unpivot("persona", ["confidence", "generation_ms"], "metric", "value")


@q("SELECT day, n AS searches, n - lag(n) OVER (ORDER BY day) AS change, CAST(sum(n) OVER (ORDER BY day ROWS 6 PRECEDING) AS BIGINT) AS week FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)")
def daily_trend(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day")  # over one row a day
    return n.select("day", F.col("n").alias("searches"), (F.col("n") - F.lag("n").over(w)).alias("change"), F.sum("n").over(w.rowsBetween(-6, 0)).alias("week"))


@q(f"SELECT c.id AS category_id, c.name, count(l.id) AS laws, round(count(l.id) * 100.0 / (SELECT count(*) FROM {L}), 2) AS percent FROM categories c LEFT JOIN {L} l ON l.category_id = c.id GROUP BY 1, 2")
def category_share_left_join(s: SparkSession, d: str) -> DataFrame:
    n = T.laws(s, d, "category_id").groupBy("category_id").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    total = n.agg(F.max("total").alias("total"))
    x = table(s, d, "categories").select(F.col("id").alias("category_id"), "name").join(n.select("category_id", "n"), "category_id", "left").join(F.broadcast(total))
    return x.select("category_id", "name", F.coalesce("n", F.lit(0)).alias("laws"), F.round(F.coalesce("n", F.lit(0)) * 100.0 / F.col("total"), 2).alias("percent"))


@q(f"SELECT split_part(reference, '-', 1) AS family, type, count(*) AS laws, max(publication_date) AS latest FROM {L} WHERE status = 'published' GROUP BY 1, 2")
def corpus_family_figures(s: SparkSession, d: str) -> DataFrame:
    x = T.laws(s, d, "reference", "type", "status", "publication_date").where("status = 'published'")
    return x.groupBy(F.split_part("reference", F.lit("-"), F.lit(1)).alias("family"), "type").agg(F.count("*").alias("laws"), F.max("publication_date").alias("latest"))


@q(f"SELECT coalesce(language, 'inconnue') AS language, coalesce(status, 'inconnu') AS status, count(*) AS laws, count(DISTINCT category_id) AS categories FROM {L} GROUP BY 1, 2")
def index_stats_coalesced(s: SparkSession, d: str) -> DataFrame:
    x = T.laws(s, d, "language", "status", "category_id")
    return x.groupBy(F.coalesce("language", F.lit("inconnue")).alias("language"), F.coalesce("status", F.lit("inconnu")).alias("status")).agg(F.count("*").alias("laws"), F.count_distinct("category_id").alias("categories"))


@q(f"SELECT count(*) FILTER (embedding_model = 'enc-a/2') AS current, count(*) FILTER (embedding IS NOT NULL AND embedding_model IS DISTINCT FROM 'enc-a/2') AS foreign_model, count(*) FILTER (embedding IS NULL) AS missing FROM {A}")
def vector_provenance_counts(s: SparkSession, d: str) -> DataFrame:
    now = F.col("embedding_model").eqNullSafe("enc-a/2")
    x = T.once(table(s, d, "articles").select("id", "embedding_model", F.col("embedding").isNull().alias("none")))
    return x.agg(F.count_if(F.col("embedding_model") == "enc-a/2").alias("current"), F.count_if(~F.col("none") & ~now).alias("foreign_model"), F.count_if("none").alias("missing"))


@q(f"SELECT l.id AS law_id, count(a.id) AS articles, count(DISTINCT a.page_number) AS pages, round(count(DISTINCT a.page_number) * 1.0 / nullif(max(a.page_number), 0), 6) AS coverage FROM {L} l LEFT JOIN {A} a ON a.law_id = l.id GROUP BY l.id")
def page_coverage_left_join(s: SparkSession, d: str) -> DataFrame:
    a = T.articles(s, d, "law_id", "page_number").groupBy("law_id").agg(F.count("*").alias("n"), F.count_distinct("page_number").alias("p"), F.max("page_number").alias("last"))
    x = T.laws(s, d).withColumnRenamed("id", "law_id").join(a, "law_id", "left")
    return x.select("law_id", F.coalesce("n", F.lit(0)).alias("articles"), F.coalesce("p", F.lit(0)).alias("pages"), F.round(F.col("p") / F.nullif("last", F.lit(0)), 6).alias("coverage"))


@q(f"SELECT count(*) AS articles, count(*) FILTER (content LIKE '%|%') AS with_bars, count(*) FILTER (title IS NULL) AS untitled, count(DISTINCT law_id) AS laws, count(*) FILTER (kind IS NULL OR kind = 'article') AS real_articles FROM {A}")
def corpus_quality_counters(s: SparkSession, d: str) -> DataFrame:
    x = T.articles(s, d, "content", "title", "law_id", "kind")
    return x.agg(F.count("*").alias("articles"), F.count_if(F.col("content").contains("|")).alias("with_bars"), F.count_if(F.col("title").isNull()).alias("untitled"), F.count_distinct("law_id").alias("laws"), F.count_if(F.expr("kind is null or kind = 'article'")).alias("real_articles"))


@q("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
