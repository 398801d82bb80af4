"""Further operators of the inventory: sources, caches, neighbours, conversations, texts, evaluation; with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselle.functions import text
from tesselle.operators import evaluation, ordered
from tesselle.operators import refinement as R
from tesselle.plans.analytics import A, C, L, M, ROLE
from tesselle.plans.retrieval import fold, words
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


# ---- sources, caches, upserts


@q(f"SELECT count(*) AS remaining, count(*) FILTER (embedding IS NULL) AS never FROM {A} WHERE embed AND (embedding IS NULL OR embedding_model IS DISTINCT FROM 'enc-a/2')")
def remaining_vectors(s: SparkSession, d: str) -> DataFrame:
    x = T.once(table(s, d, "articles").where("embed").select("id", "embedding_model", F.col("embedding").isNull().alias("none")))
    return x.where(F.col("none") | ~F.col("embedding_model").eqNullSafe("enc-a/2")).agg(F.count("*").alias("remaining"), F.count_if("none").alias("never"))


@q(f"SELECT state, count(*) AS n FROM (SELECT CASE WHEN a.id IS NULL THEN 'unknown' WHEN NOT a.embed THEN 'not embeddable' WHEN len(v.embedding) <> 64 THEN 'dimension' WHEN a.law_id IS DISTINCT FROM v.law_id THEN 'changed' ELSE 'load' END AS state FROM (SELECT DISTINCT ON (article_id) * FROM articles_vecteurs) v LEFT JOIN {A} a ON a.id = v.article_id) GROUP BY 1")
def verified_vector_load(s: SparkSession, d: str) -> DataFrame:
    """Why each vector of a batch would be written or refused."""
    a = T.articles(s, d, "embed", "law_id").withColumnsRenamed({"id": "article_id", "law_id": "now"})
    v = table(s, d, "articles_vecteurs").select("article_id", "law_id", F.size("embedding").alias("dim")).distinct()
    x = v.join(a, "article_id", "left")
    state = F.when(F.col("embed").isNull(), "unknown").when(~F.col("embed"), "not embeddable").when(F.col("dim") != 64, "dimension").when(~F.col("now").eqNullSafe(F.col("law_id")), "changed").otherwise("load")
    return x.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@q("SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS key, max(ts) + INTERVAL 1 DAY AS expires_at, max(ts) + INTERVAL 1 DAY > (SELECT max(ts) FROM events) AS alive FROM events GROUP BY 1, 2")
def cache_ttl_upsert(s: SparkSession, d: str) -> DataFrame:
    """Latest write of each cache key, its expiry, and whether it is alive at the end of the log."""
    e = table(s, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("key"), "ts")
    last = e.agg(F.max("ts").alias("now"))
    g = e.groupBy("user_id", "key").agg(F.max("ts").alias("t")).withColumn("expires_at", F.expr("t + interval 1 day"))
    return g.join(F.broadcast(last)).select("user_id", "key", "expires_at", (F.col("expires_at") > F.col("now")).alias("alive"))


@q("SELECT event_type, count(*) AS purged FROM (SELECT event_type, ts FROM events) WHERE ts + INTERVAL 20 DAY <= (SELECT max(ts) FROM events) GROUP BY 1")
def cache_ttl_purge(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_type", "ts")
    return e.join(F.broadcast(e.agg(F.max("ts").alias("now")))).where("ts + interval 20 days <= now").groupBy("event_type").agg(F.count("*").alias("purged"))


@q("SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) <= 500 AS kept FROM events")
def lru_eviction_by_size(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    return table(s, d, "events").select("event_id", (F.sum("value").over(w) <= 500).alias("kept"))


@q(f"SELECT l.name, c.id IS NULL AS inserted FROM (VALUES ('justice pénale'), ('pêche'), ('santé et hygiène')) l(name) LEFT JOIN categories c ON lower(c.name) = l.name")
def insert_if_absent(s: SparkSession, d: str) -> DataFrame:
    new = s.createDataFrame([("justice pénale",), ("pêche",), ("santé et hygiène",)], "name string")
    have = table(s, d, "categories").select(F.lower("name").alias("name"), F.lit(True).alias("there"))
    return new.join(have, "name", "left").select("name", F.col("there").isNull().alias("inserted"))


@q("SELECT doc_id, length(text) AS size FROM documents WHERE law_reference IS NOT NULL ORDER BY size, doc_id LIMIT 100")
def smallest_sources_first(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").where("law_reference is not null").select("doc_id", F.length("text").cast("bigint").alias("size"))
    return x.orderBy("size", "doc_id").limit(100)


@q(f"SELECT l.id, round(100.0 * coalesce(a.n, 0) / nullif(length(l.content), 0), 4) AS retention FROM {L} l LEFT JOIN (SELECT law_id, sum(length(content)) AS n FROM {A} GROUP BY 1) a ON a.law_id = l.id")
def character_retention(s: SparkSession, d: str) -> DataFrame:
    a = T.once(table(s, d, "articles").select("id", "law_id", F.length("content").alias("n"))).groupBy("law_id").agg(F.sum("n").alias("n"))
    x = T.once(table(s, d, "laws").select("id", F.length("content").alias("size"))).join(a, F.col("id") == F.col("law_id"), "left")
    return x.select("id", F.round(F.lit(100.0) * F.coalesce("n", F.lit(0)) / F.nullif("size", F.lit(0)), 4).alias("retention"))


@q("SELECT doc_id, l.id AS law_id FROM documents d LEFT JOIN (SELECT reference, min(id) AS id FROM laws GROUP BY 1) l ON l.reference = d.law_reference")
def reference_to_id_lookup(s: SparkSession, d: str) -> DataFrame:
    """One reference holds a tenth of the documents: the side with one row a reference is joined to it, AQE splits the hot key."""
    ids = table(s, d, "laws").groupBy(F.col("reference").alias("law_reference")).agg(F.min("id").alias("law_id"))
    return table(s, d, "documents").select("doc_id", "law_reference").join(ids, "law_reference", "left").select("doc_id", "law_id")


# ---- neighbours, islands, orders


@q(f"SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after FROM {A} WHERE content IS NOT NULL AND law_id IS NOT NULL WINDOW w AS (PARTITION BY law_id ORDER BY order_no NULLS LAST, id)")
def previous_next_article(s: SparkSession, d: str) -> DataFrame:
    order = [F.asc_nulls_last("order_no"), F.asc("id")]
    x = ordered.ranged(T.once(table(s, d, "articles").where("content is not null and law_id is not null").select("id", "law_id", "order_no")), "law_id", order)
    place = F.struct(F.col("order_no").isNull(), "order_no", "id")
    last, first = ordered.carried(x, "law_id", b=F.max_by("id", place)), ordered.carried_back(x, "law_id", a=F.min_by("id", place))
    w, at = ordered.within("law_id", order), ["law_id", ordered.PART]
    return x.join(last, at, "left").join(first, at, "left").select("id", F.coalesce(F.lag("id").over(w), "b").alias("before"), F.coalesce(F.lead("id").over(w), "a").alias("after"))


@q(f"SELECT id, section, last_value(section IGNORE NULLS) OVER (PARTITION BY law_id ORDER BY order_no NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS running FROM {A}")
def running_section(s: SparkSession, d: str) -> DataFrame:
    order = [F.asc_nulls_last("order_no"), F.asc("id")]
    x = ordered.ranged(T.articles(s, d, "law_id", "order_no", "section"), "law_id", order)
    latest = ordered.carried_forward(x, "law_id", had=F.max_by("section", F.when(F.col("section").isNotNull(), F.struct(F.col("order_no").isNull(), "order_no", "id"))))
    w = ordered.within("law_id", order).rowsBetween(Window.unboundedPreceding, 0)
    return x.join(latest, ["law_id", ordered.PART], "left").select("id", "section", F.coalesce(F.last("section", ignorenulls=True).over(w), "had").alias("running"))


@q(f"SELECT id, CAST(nullif(regexp_extract(reference, '^LOI-[0-9]{{4}}-([0-9]+)$', 1), '') AS BIGINT) AS act_no FROM {L} ORDER BY publication_date DESC NULLS LAST, act_no DESC NULLS LAST, id LIMIT 50")
def total_order_with_act_number(s: SparkSession, d: str) -> DataFrame:
    n = F.nullif(F.regexp_extract("reference", r"^LOI-[0-9]{4}-([0-9]+)$", 1), F.lit("")).cast("bigint")
    x = T.laws(s, d, "reference", "publication_date").withColumn("act_no", n)
    return x.orderBy(F.desc_nulls_last("publication_date"), F.desc_nulls_last("act_no"), "id").limit(50).select("id", "act_no")


@q(f"SELECT law_id, number, count(*) AS homonyms, min(id) AS first_id FROM {A} WHERE number IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def homonymous_articles(s: SparkSession, d: str) -> DataFrame:
    return T.articles(s, d, "law_id", "number").where("number is not null").groupBy("law_id", "number").agg(F.count("*").alias("homonyms"), F.min("id").alias("first_id")).where("homonyms > 1")


@q(f"SELECT DISTINCT a.id, b.id AS target FROM (SELECT id, law_id, unnest(regexp_extract_all(content, '(?:l''article|section) ([0-9]+)', 1)) AS number FROM {A}) a JOIN {A} b ON a.law_id = b.law_id AND b.number = a.number AND a.id <> b.id")
def follow_references(s: SparkSession, d: str) -> DataFrame:
    """Every reference of every article to an article of its law."""
    a = T.articles(s, d, "law_id", "content").select("id", "law_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?:l'article|section) ([0-9]+)"), 1)).alias("number")).distinct()
    b = T.articles(s, d, "law_id", "number").withColumnRenamed("id", "target")
    return a.join(b, ["law_id", "number"]).where("id <> target").select("id", "target").distinct()


# ---- conversations


@q(f"SELECT conversation_id, id AS message_id, r AS place FROM (SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM {M} WHERE conversation_id IS NOT NULL) WHERE r <= 5")
def last_messages(s: SparkSession, d: str) -> DataFrame:
    x = T.messages(s, d, "conversation_id", "created_at").where("conversation_id is not null")
    return R.top_per_group(x, "conversation_id", [F.desc_nulls_last("created_at"), F.desc("id")], 5).select("conversation_id", F.col("id").alias("message_id"), F.col("rank").alias("place"))


@q(f"SELECT id, persona FROM {C} WHERE user_id = (SELECT user_id FROM {C} WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1) ORDER BY updated_at DESC NULLS LAST, id LIMIT 20")
def conversations_of_busiest_user(s: SparkSession, d: str) -> DataFrame:
    c = T.conversations(s, d, "user_id", "persona", "updated_at")
    top = c.where("user_id is not null").groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(1).select("user_id")
    return c.join(F.broadcast(top), "user_id").orderBy(F.desc_nulls_last("updated_at"), "id").limit(20).select("id", "persona")


@q(f"SELECT conversation_id, id, content FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM {M} WHERE {ROLE} = 'user' AND length(content) - length(replace(content, ' ', '')) >= 4 AND conversation_id IS NOT NULL) WHERE r = 1")
def conversation_subject(s: SparkSession, d: str) -> DataFrame:
    """The last question long enough to stand alone."""
    x = T.messages(s, d, "conversation_id", "created_at", "role", "content").where("lower(trim(role)) = 'user' and conversation_id is not null and length(content) - length(replace(content, ' ', '')) >= 4")
    return R.top_per_group(x, "conversation_id", [F.desc_nulls_last("created_at"), F.desc("id")], 1).select("conversation_id", "id", "content")


@q(f"SELECT conversation_id, round(sum(CASE WHEN confidence IS NULL THEN 0 ELSE confidence END), 4) AS confidence, CAST(sum(coalesce(retrieval_time_ms, 0) + coalesce(generation_time_ms, 0)) AS BIGINT) AS busy_ms, count(DISTINCT lower(trim(role))) AS roles FROM {M} GROUP BY 1")
def interaction_rows(s: SparkSession, d: str) -> DataFrame:
    x = T.messages(s, d, "conversation_id", "confidence", "retrieval_time_ms", "generation_time_ms", "role")
    busy = F.coalesce("retrieval_time_ms", F.lit(0)) + F.coalesce("generation_time_ms", F.lit(0))
    return x.groupBy("conversation_id").agg(F.round(F.sum(F.coalesce("confidence", F.lit(0.0))), 4).alias("confidence"), F.sum(busy).alias("busy_ms"), F.count_distinct(F.lower(F.trim("role"))).alias("roles"))


@q(f"SELECT m.id, CASE WHEN len(regexp_extract_all(content, '(?i)article [0-9]+')) > 0 THEN 0.4 ELSE 0 END + CASE WHEN length(content) BETWEEN 100 AND 600 THEN 0.3 WHEN length(content) > 600 THEN 0.2 ELSE 0.1 END AS score FROM {M} m WHERE {ROLE} = 'assistant' AND content IS NOT NULL")
def answer_confidence(s: SparkSession, d: str) -> DataFrame:
    n = F.length("content")
    band = F.when(n.between(100, 600), 0.3).when(n > 600, 0.2).otherwise(0.1)
    cites = F.when(F.col("content").rlike("(?i)article [0-9]+"), 0.4).otherwise(0.0)
    return T.messages(s, d, "role", "content").where("lower(trim(role)) = 'assistant' and content is not null").select("id", (cites + band).alias("score"))


_SRC = f"(SELECT id, CAST(json_extract(j, '$.law_id') AS INTEGER) AS law_id, json_extract_string(j, '$.article_number') AS number FROM (SELECT id, unnest(json_extract(sources, '$[*]')) AS j FROM {M} WHERE sources IS NOT NULL AND json_valid(sources)))"


@q(f"SELECT m.id, count(*) AS cited, count(a.law_id) AS held FROM {_SRC} m LEFT JOIN (SELECT DISTINCT law_id, number FROM articles) a ON a.law_id = m.law_id AND a.number = m.number GROUP BY m.id")
def verified_citations(s: SparkSession, d: str) -> DataFrame:
    """How many of a message's citations the corpus holds."""
    m = T.messages(s, d, "sources").where("sources is not null").select("id", F.explode(F.from_json("sources", "array<struct<law_id:int,article_number:string>>")).alias("r")).select("id", "r.law_id", F.col("r.article_number").alias("number"))
    a = table(s, d, "articles").select("law_id", "number", F.lit(True).alias("held")).distinct()
    return m.join(a, ["law_id", "number"], "left").groupBy("id").agg(F.count("*").alias("cited"), F.count("held").alias("held"))


# ---- texts


@q(f"SELECT id, trim(regexp_replace({fold('title')}, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM {L}")
def slugs(s: SparkSession, d: str) -> DataFrame:
    return T.laws(s, d, "title").select("id", F.regexp_replace(F.regexp_replace(text.fold(F.col("title")), "[^a-z0-9]+", "-"), "^-+|-+$", "").alias("slug"))


@q(f"SELECT id, CAST(greatest(1, ceil(len({words('content')}) / 200.0)) AS BIGINT) AS minutes FROM {L}")
def reading_time(s: SparkSession, d: str) -> DataFrame:
    return T.laws(s, d, "content").select("id", F.greatest(F.lit(1), F.ceil(F.size(text.words(F.col("content"))) / 200)).cast("bigint").alias("minutes"))


@q(f"SELECT id, regexp_extract(title, '^(.*?) (?:concernant|regarding) ', 1) AS heading, regexp_extract(title, ' (?:concernant|regarding) (.*)$', 1) AS subject FROM {L}")
def heading_and_subject(s: SparkSession, d: str) -> DataFrame:
    return T.laws(s, d, "title").select("id", F.regexp_extract("title", "^(.*?) (?:concernant|regarding) ", 1).alias("heading"), F.regexp_extract("title", " (?:concernant|regarding) (.*)$", 1).alias("subject"))


@q(f"SELECT id, year(publication_date) AS year, CASE WHEN month(publication_date) = 1 AND day(publication_date) = 1 THEN NULL ELSE publication_date END AS day FROM {L}")
def trusted_dates(s: SparkSession, d: str) -> DataFrame:
    day = F.col("publication_date")
    return T.laws(s, d, "publication_date").select("id", F.year(day).cast("bigint").alias("year"), F.when((F.month(day) == 1) & (F.dayofmonth(day) == 1), None).otherwise(day).alias("day"))


@q("SELECT doc_id, CASE WHEN p > 0 THEN substring(text, greatest(1, p - 60), 150) END AS window FROM (SELECT doc_id, text, instr(lower(text), 'licence') AS p FROM documents)")
def snippet_window(s: SparkSession, d: str) -> DataFrame:
    p = F.instr(F.lower("text"), "licence")
    return table(s, d, "documents").select("doc_id", F.when(p > 0, F.substr("text", F.greatest(F.lit(1), p - 60), F.lit(150))).alias("window"))


@q("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(substring(text, 1, 300), '(?s)\\s+\\S*\\z', '') END AS cut FROM documents")
def truncate_on_boundary(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.when(F.length("text") <= 300, F.col("text")).otherwise(F.regexp_replace(F.substring("text", 1, 300), r"(?s)\s+\S*\z", "")).alias("cut"))


@q(f"SELECT id, trim(regexp_replace(substring(regexp_replace(content, '(?m)^.*(?:Charte|Charter|Carta|Charta).*$', '', 'g'), 1, 400), '[ \\n\\t]+', ' ', 'g'), ' ') AS excerpt FROM {L} WHERE content IS NOT NULL")
def classification_excerpt(s: SparkSession, d: str) -> DataFrame:
    body = F.substring(F.regexp_replace("content", r"(?m)^.*(?:Charte|Charter|Carta|Charta).*$", ""), 1, 400)
    return T.laws(s, d, "content").where("content is not null").select("id", F.trim(F.regexp_replace(body, r"[ \n\t]+", " ")).alias("excerpt"))


@q(f"SELECT id, len(list_filter(string_split(content, e'\\n'), lambda x: trim(x, ' ') <> '')) AS lines, len(regexp_extract_all(content, '[.!?](?: |$|\\n)')) AS sentences FROM {A} WHERE content IS NOT NULL")
def lines_and_sentences(s: SparkSession, d: str) -> DataFrame:
    x = T.articles(s, d, "content").where("content is not null")
    lines = F.size(F.filter(F.split("content", "\n"), lambda y: F.trim(y) != ""))
    return x.select("id", lines.cast("bigint").alias("lines"), F.size(F.regexp_extract_all("content", F.lit(r"[.!?](?: |$|\n)"), 0)).cast("bigint").alias("sentences"))


@q(f"SELECT id, CASE WHEN length(content) < 600 AND regexp_matches(content, '(?i)(abrog|repeal|takes effect|publié|official)') THEN 'boilerplate' WHEN length(content) < 120 THEN 'short' ELSE 'body' END AS class FROM {A} WHERE content IS NOT NULL")
def boilerplate_classifier(s: SparkSession, d: str) -> DataFrame:
    n = F.length("content")
    c = F.when((n < 600) & F.col("content").rlike("(?i)(abrog|repeal|takes effect|publié|official)"), "boilerplate").when(n < 120, "short").otherwise("body")
    return T.articles(s, d, "content").where("content is not null").select("id", c.alias("class"))


_FLAT = lambda c: f"' ' || array_to_string(regexp_extract_all({fold(c)}, '([a-z0-9]+)', 1), ' ') || ' '"


@q(f"SELECT item_id, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, {_FLAT('text')} AS t FROM documents) d JOIN (SELECT item_id, {_FLAT('text')} AS t FROM eval_items WHERE text IS NOT NULL) e ON len(e.t) > 2 AND contains(d.t, e.t) GROUP BY 1")
def benchmark_contamination_contains(s: SparkSession, d: str) -> DataFrame:
    """Evaluation items that stand whole in documents, compared by their words. Candidates share the item's first ten words
    (all words of a shorter item), so documents meet items by an equi-join; the whole item is then looked for."""
    flat = lambda c: F.concat(F.lit(" "), F.array_join(text.words(F.col(c)), " "), F.lit(" "))
    e = table(s, d, "eval_items").where("text is not null").select("item_id", text.words(F.col("text")).alias("w")).where("size(w) > 0")
    e = e.select("item_id", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("item"), F.least(F.size("w"), F.lit(10)).alias("n"), F.xxhash64(F.array_join(F.slice("w", 1, 10), " ")).alias("h"))
    sizes = [r["n"] for r in bounded(e.select("n").distinct(), 10, "run lengths")]
    docs = table(s, d, "documents").where("text is not null").select("doc_id", text.words(F.col("text")).alias("w"), flat("text").alias("t"))

    def runs_of(n: int):
        own = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ")))
        return F.when(F.size("w") >= n, own).otherwise(F.array().cast("array<bigint>"))

    runs = F.array_distinct(F.flatten(F.array(*map(runs_of, sizes)))) if sizes else F.array().cast("array<bigint>")
    hits = docs.select("doc_id", "t", F.explode(runs).alias("h")).join(broadcast_if_small(e, 100_000), "h").where(F.contains("t", "item"))
    return hits.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))


@q("SELECT d.doc_id, r.service FROM documents d JOIN (VALUES ('licence', 'permits'), ('pension', 'welfare'), ('impôt', 'taxes')) r(word, service) ON contains(lower(d.text), r.word)")
def directory_routing(s: SparkSession, d: str) -> DataFrame:
    """Rules by word: each is a filter over one scan, exploded, so no join is needed."""
    rules = {"licence": "permits", "pension": "welfare", "impôt": "taxes"}
    low = F.lower("text")
    hit = F.array_compact(F.array(*[F.when(low.contains(w), F.lit(v)) for w, v in rules.items()]))
    return table(s, d, "documents").select("doc_id", F.explode(hit).alias("service"))


# ---- evaluation


@q("SELECT t AS threshold, label, count(*) FILTER (norm < t) AS refused, count(*) AS n FROM (SELECT label, list_inner_product(list_slice(embedding, 1, 8)::DOUBLE[], list_slice(embedding, 1, 8)::DOUBLE[]) AS norm FROM embeddings), (VALUES (0.05), (0.1), (0.2)) v(t) GROUP BY 1, 2")
def threshold_sweep(s: SparkSession, d: str) -> DataFrame:
    from tesselle.functions import vectors

    head = F.slice("embedding", 1, 8)
    x = table(s, d, "embeddings").select("label", vectors.dot(head, head).alias("norm"), F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.2)))).alias("threshold"))
    return x.groupBy("threshold", "label").agg(F.count_if(F.col("norm") < F.col("threshold")).alias("refused"), F.count("*").alias("n"))


@q("SELECT event_type, median(value) AS median, round(stddev_samp(value), 7) AS spread, min(value) AS low, max(value) AS high, round(avg(value), 7) AS mean FROM events GROUP BY 1")
def latency_summary(s: SparkSession, d: str) -> DataFrame:
    """The median by rank over counted values, so no buffer holds a type's values."""
    e = table(s, d, "events")
    mid = evaluation.values_at(e, "event_type", "value", {"lo": "cast(floor((n - 1) / 2) as bigint)", "hi": "cast(floor(n / 2) as bigint)"})
    g = e.groupBy("event_type").agg(F.round(F.stddev_samp("value"), 7).alias("spread"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 7).alias("mean"))
    return g.join(mid, "event_type").select("event_type", ((F.col("lo") + F.col("hi")) / 2).alias("median"), "spread", "low", "high", "mean")


@q("SELECT user_id, event_id, CAST((SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.ts > a.ts - INTERVAL 1 HOUR AND (b.ts < a.ts OR b.ts = a.ts)) AS BIGINT) AS last_hour FROM events a")
def sliding_count_per_user(s: SparkSession, d: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-3_599_999_999, 0)
    return table(s, d, "events").withColumn("t", t).select("user_id", "event_id", F.count("*").over(w).alias("last_hour"))


@q("SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 2")
def top_lines_per_supplier(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return R.top_per_group(x, "l_suppkey", [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 2).drop("l_extendedprice")
