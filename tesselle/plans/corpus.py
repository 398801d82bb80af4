"""Chunks, verdicts, samples, feedback, schedules and control of the corpus, with the oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselle.functions import text
from tesselle.operators import chunking, limiter, ranking
from tesselle.operators.bulk_knn import batch_nearest
from tesselle.plans.analytics import A, C, L, M
from tesselle.plans.retrieval import cos, fold, words
from tesselle.plans.texts import values
from tesselle.session import bounded, broadcast_if_small, table
from tesselle.sources import documents as D
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


# ---- chunks of laws

_BARE = "regexp_replace({c}, '[ \\n\\t\\r]+', '', 'g')"


@q(f"SELECT id, length({_BARE.format(c='content')}) AS signs, true AS kept FROM {L} WHERE content IS NOT NULL AND length({_BARE.format(c='content')}) > 0")
def chunks_keep_all_text(s: SparkSession, d: str) -> DataFrame:
    """For every law: its signs, and whether its chunks hold all of them but headings (at most forty signs each) and section headers."""
    x = T.laws(s, d, "content").where("content is not null")
    c = chunking.table_of(x, "id", "content").groupBy("id").agg(F.sum(F.length(F.regexp_replace("content", r"[ \n\t\r]+", ""))).alias("got"), F.count("*").alias("n"), F.count_distinct("section").alias("h"))
    size = x.select(F.col("id").cast("bigint").alias("id"), F.length(F.regexp_replace("content", r"[ \n\t\r]+", "")).cast("bigint").alias("signs")).where("signs > 0")
    return size.join(c, "id", "left").select("id", "signs", F.coalesce((F.col("got") <= F.col("signs")) & (F.col("signs") - F.col("got") <= 40 * F.col("n") + 120 * F.col("h")), F.lit(False)).alias("kept"))


@q()
def refined_chunks(s: SparkSession, d: str) -> DataFrame:
    """All laws cut, classified and rewritten for retrieval. Checked on small texts."""
    return chunking.table_of(T.laws(s, d, "content", "reference"), "id", "content", refined=True, reference="reference")


@q()
def chunk_kinds(s: SparkSession, d: str) -> DataFrame:
    return refined_chunks(s, d).groupBy("kind", "embed").agg(F.count("*").alias("chunks"), F.sum("copies").alias("with_copies"), F.round(F.avg(F.length("content")), 3).alias("mean_length"))


@q(f"SELECT law_id, page, string_agg(content, ' ' ORDER BY order_no, id) AS text FROM (SELECT law_id, page_number AS page, order_no, id, trim(regexp_replace(content, '[ \\n\\t\\r]+', ' ', 'g'), ' ') AS content FROM {A} WHERE law_id BETWEEN 2 AND 60 AND page_number IS NOT NULL AND content IS NOT NULL AND order_no IS NOT NULL) GROUP BY 1, 2")
def pages_between_marks(s: SparkSession, d: str) -> DataFrame:
    """Laws written out with page marks and cut at them again: the pages come back as they were. Laws of bounded length are put together."""
    a = T.articles(s, d, "law_id", "page_number", "order_no", "content").where("law_id between 2 and 60 and page_number is not null and content is not null and order_no is not null")
    flat = F.trim(F.regexp_replace("content", r"[ \n\t\r]+", " "))
    p = a.groupBy("law_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("order_no", "id", flat.alias("t")))).alias("x"))
    p = p.select("law_id", F.struct(F.col("page_number").alias("page"), F.array_join(F.transform("x", lambda r: r["t"]), " ").alias("t")).alias("y"))
    whole = p.groupBy("law_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("y")), lambda r: F.concat(F.lit("<<PAGE:"), r["page"].cast("string"), F.lit(">>\n"), r["t"])), "\n").alias("text"))
    return D.pages(whole, "law_id", "text")


@q(f"SELECT a.id, 'copy of ' || b.kept AS note FROM {A} a JOIN (SELECT sha256(content) AS h, min(id) AS kept FROM {A} WHERE content IS NOT NULL GROUP BY 1 HAVING count(*) > 1) b ON sha256(a.content) = b.h WHERE a.id <> b.kept")
def noted_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Every copy with the reason it is left out."""
    x = T.articles(s, d, "content").where("content is not null").select("id", F.sha2("content", 256).alias("h"))
    first = x.groupBy("h").agg(F.min("id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    return x.join(first, "h").where("id <> kept").select("id", F.concat(F.lit("copy of "), F.col("kept").cast("string")).alias("note"))


_OLD = f"(SELECT law_id, number, sha256(content) AS h, row_number() OVER (PARTITION BY law_id, number, sha256(content) ORDER BY id) AS k, id FROM {A} WHERE content IS NOT NULL AND number IS NOT NULL AND law_id IS NOT NULL)"
_NEW = f"(SELECT law_id, number, h, row_number() OVER (PARTITION BY law_id, number, h ORDER BY id) AS k, id FROM (SELECT law_id, CASE WHEN number = '1er' THEN '1' ELSE number END AS number, sha256(content) AS h, id FROM {A} WHERE content IS NOT NULL AND number IS NOT NULL AND law_id IS NOT NULL AND kind IS DISTINCT FROM 'fragment'))"


@q(f"SELECT CASE WHEN o.id IS NULL THEN 'add' WHEN n.id IS NULL THEN 'remove' ELSE 'keep' END AS action, count(*) AS chunks FROM {_OLD} o FULL JOIN {_NEW} n ON o.law_id = n.law_id AND o.number = n.number AND o.h = n.h AND o.k = n.k GROUP BY 1")
def replacement_plan(s: SparkSession, d: str) -> DataFrame:
    """A multiset of stored chunks against a new cutting: what is kept, added and removed, equal chunks paired one to one."""
    x = T.articles(s, d, "law_id", "number", "content", "kind").where("content is not null and number is not null and law_id is not null").withColumn("h", F.sha2("content", 256))
    new = x.where("not kind <=> 'fragment'").withColumn("number", F.when(F.col("number") == "1er", "1").otherwise(F.col("number")))
    paired = lambda y, n: y.groupBy("law_id", "number", "h").agg(F.count("*").alias(n))
    both = paired(x, "o").join(paired(new, "n"), ["law_id", "number", "h"], "full").na.fill(0, ["o", "n"])
    rows = both.select(F.explode(F.array(F.struct(F.lit("keep").alias("action"), F.least("o", "n").alias("c")), F.struct(F.lit("remove").alias("action"), F.greatest(F.col("o") - F.col("n"), F.lit(0)).alias("c")), F.struct(F.lit("add").alias("action"), F.greatest(F.col("n") - F.col("o"), F.lit(0)).alias("c")))).alias("r"))
    return rows.groupBy("r.action").agg(F.sum("r.c").alias("chunks")).where("chunks > 0")


@q(f"SELECT a.id FROM {A} a JOIN {L} l ON l.id = a.law_id WHERE l.type IN ('décret', 'decree', 'arrêté', 'order') AND a.page_number BETWEEN 1 AND 3 AND a.kind IS DISTINCT FROM 'annexe' AND regexp_matches(a.number, '^[0-9]+$') AND CAST(nullif(regexp_extract(a.number, '^([0-9]{{1,9}})$', 1), '') AS INTEGER) < 12")
def reproduced_articles(s: SparkSession, d: str) -> DataFrame:
    """Articles on the first pages of a decree, not marked as an annexe, with a number under a bound."""
    l = T.laws(s, d, "type").where(F.col("type").isin("décret", "decree", "arrêté", "order")).select(F.col("id").alias("law_id"))
    n = F.nullif(F.regexp_extract("number", "^([0-9]{1,9})$", 1), F.lit("")).cast("int")
    return T.articles(s, d, "law_id", "number", "page_number", "kind").where("page_number between 1 and 3 and not kind <=> 'annexe'").where(n < 12).join(l, "law_id").select("id")


# ---- verdicts of a classifier given as text

RAW = [(1, '[{"i": 1, "code": "A", "p": 0.9}, {"i": 2, "code": "Z", "p": 0.8}, {"i": 1, "code": "B", "p": 0.7}, {"i": 3, "code": "C", "p": 1.4}, {"i": 9, "code": "A", "p": 0.5}]'), (2, "not json"), (3, '[{"i": 2, "code": "B", "p": -1}]')]


@q("SELECT CAST(batch AS INTEGER) AS batch, CAST(i AS INTEGER) AS i, code, CAST(p AS DOUBLE) AS p FROM (VALUES (1, 1, 'A', 0.9), (1, 3, 'C', 1.0), (3, 2, 'B', 0.0)) t(batch, i, code, p)")
def verdicts_read(s: SparkSession, d: str) -> DataFrame:
    """A classifier's answer out of JSON: places in range, known codes, confidences within 0..1, the first of a place."""
    x = s.createDataFrame(RAW, "batch int, raw string").select("batch", F.posexplode(F.from_json("raw", "array<struct<i:int,code:string,p:double>>")).alias("k", "r"))
    x = x.where("r.i between 1 and 5 and r.code in ('A', 'B', 'C')").groupBy("batch", F.col("r.i").alias("i")).agg(F.min_by("r", "k").alias("r"))
    return x.select("batch", "i", "r.code", F.least(F.greatest("r.p", F.lit(0.0)), F.lit(1.0)).alias("p"))


_VER = f"(SELECT id, category_id AS now, suggested_categories[1] AS target, language_confidence AS p, suggested_categories AS all_of FROM {L})"


@q(f"SELECT CASE WHEN target IS NULL OR target NOT IN (SELECT id FROM categories) THEN 'review: unknown' WHEN p IS NULL OR p < 0.6 THEN 'review: uncertain' WHEN now IS NOT NULL AND now <> target THEN 'kept' WHEN now = target THEN 'same' ELSE 'set' END AS outcome, count(*) AS laws FROM {_VER} GROUP BY 1")
def verdicts_applied(s: SparkSession, d: str) -> DataFrame:
    """What a run of verdicts does: unknown and uncertain ones to review, an existing different category kept, the others set."""
    c = broadcast_if_small(table(s, d, "categories").select(F.col("id").alias("target"), F.lit(True).alias("known")), 10_000)
    x = T.laws(s, d, "category_id", "suggested_categories", "language_confidence").select("id", F.col("category_id").alias("now"), F.get("suggested_categories", F.lit(0)).alias("target"), F.col("language_confidence").alias("p")).join(c, "target", "left")
    o = F.when(F.col("known").isNull(), "review: unknown").when(F.col("p").isNull() | (F.col("p") < 0.6), "review: uncertain").when(F.col("now") != F.col("target"), "kept").when(F.col("now") == F.col("target"), "same").otherwise("set")
    return x.groupBy(o.alias("outcome")).agg(F.count("*").alias("laws"))


@q("SELECT id, name FROM categories UNION ALL SELECT -count(*), min(name) FROM categories")
def category_mapping(s: SparkSession, d: str) -> DataFrame:
    """Names by id out of one map, and a row with the number of entries."""
    m = table(s, d, "categories").agg(F.map_from_entries(F.collect_list(F.struct("id", "name"))).alias("m"))
    return m.select(F.explode("m").alias("id", "name")).select(F.col("id").cast("bigint").alias("id"), "name").union(m.select((-F.size("m")).cast("bigint"), F.array_min(F.map_values("m"))))


# ---- samples, lookups


@q(f"WITH n AS (SELECT law_id, count(*) AS n FROM {A} GROUP BY 1), x AS (SELECT a.id, CASE WHEN n.n > 100 THEN 0 ELSE 1 END AS stratum FROM {A} a JOIN n USING (law_id) WHERE n.n >= 5 AND length(a.content) >= 200) SELECT stratum, CAST(least(count(*), 25) AS BIGINT) AS sampled FROM x GROUP BY 1")
def sample_per_stratum(s: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 25 articles of each stratum of law size; the oracle checks the sizes."""
    a = T.once(table(s, d, "articles").select("id", "law_id", F.length("content").alias("n"))).where("law_id is not null")
    size = a.groupBy("law_id").agg(F.count("*").alias("k")).where("k >= 5").select("law_id", F.when(F.col("k") > 100, 0).otherwise(1).alias("stratum"))
    x = a.where("n >= 200").join(size, "law_id").select("id", "stratum").withColumn("r", F.row_number().over(Window.partitionBy("stratum").orderBy(F.xxhash64(F.lit(7), "id"), "id"))).where("r <= 25")
    return x.groupBy("stratum").agg(F.count("*").alias("sampled"))


_LANGS = ["fr", "en"]


@q(f"SELECT id FROM (SELECT a.id, dense_rank() OVER (ORDER BY CASE l.language WHEN 'fr' THEN 1 ELSE 2 END) AS r FROM {A} a JOIN {L} l ON l.id = a.law_id WHERE l.language IN ('fr', 'en') AND (contains(lower(l.title), 'pension') OR contains(l.reference, 'LOI-2010')) AND a.number = '2') WHERE r = 1")
def lookup_by_language(s: SparkSession, d: str) -> DataFrame:
    """Articles of a number in texts whose title or reference holds a word: in the question's language, else in the other."""
    l = T.laws(s, d, "title", "reference", "language").where(F.col("language").isin(_LANGS) & (F.contains(F.lower("title"), F.lit("pension")) | F.contains("reference", F.lit("LOI-2010"))))
    x = T.articles(s, d, "law_id", "number").where("number = '2'").join(l.select(F.col("id").alias("law_id"), F.when(F.col("language") == "fr", 1).otherwise(2).alias("p")), "law_id")
    return x.join(F.broadcast(x.agg(F.min("p").alias("first"))), F.col("p") == F.col("first")).select("id")


_LIST = [40, 7, 3, 12, 1]


@q(f"SELECT id, law_id FROM {A} WHERE law_id = (SELECT law_id FROM {A} WHERE law_id IN ({', '.join(map(str, _LIST))}) AND upper(trim(number, ' .:-')) = '3' ORDER BY list_position([{', '.join(map(str, _LIST))}], law_id) LIMIT 1) AND upper(trim(number, ' .:-')) = '3'")
def article_in_first_law(s: SparkSession, d: str) -> DataFrame:
    """The article in the first law of an ordered list that has its number."""
    x = T.articles(s, d, "law_id", "number").where(F.col("law_id").isin(_LIST) & (F.upper(F.btrim("number", F.lit(" .:-"))) == "3")).withColumn("p", F.array_position(F.array(*map(F.lit, _LIST)), F.col("law_id")))
    return x.join(F.broadcast(x.agg(F.min("p").alias("first"))), F.col("p") == F.col("first")).select("id", "law_id")


@q(f"SELECT i.id, a2.id AS gold, CASE WHEN a1.id IS NOT NULL THEN 'kept' WHEN a2.id IS NOT NULL THEN 'moved' ELSE 'lost' END AS state FROM (SELECT id * 3 AS id, law_id, number FROM {A} WHERE number IS NOT NULL AND law_id IS NOT NULL) i LEFT JOIN {A} a1 ON a1.id = i.id AND a1.law_id = i.law_id AND a1.number = i.number LEFT JOIN (SELECT law_id, number, min(id) AS id FROM {A} WHERE id % 2 = 0 GROUP BY 1, 2) a2 ON a2.law_id = i.law_id AND a2.number = i.number")
def reattached_keys(s: SparkSession, d: str) -> DataFrame:
    """Gold rows whose ids no longer hold, attached again by text and number; those without any are lost."""
    a = T.articles(s, d, "law_id", "number")
    i = a.where("number is not null and law_id is not null").select((F.col("id") * 3).alias("id"), "law_id", "number")
    now = a.select("id", F.col("law_id").alias("l1"), F.col("number").alias("n1"))
    other = a.where("id % 2 = 0").groupBy("law_id", "number").agg(F.min("id").alias("gold"))
    x = i.join(now, "id", "left").withColumn("held", F.coalesce((F.col("l1") == F.col("law_id")) & (F.col("n1") == F.col("number")), F.lit(False))).join(other, ["law_id", "number"], "left")
    return x.select("id", "gold", F.when(F.col("held"), "kept").when(F.col("gold").isNotNull(), "moved").otherwise("lost").alias("state"))


@q("SELECT n_name AS entry FROM nation WHERE n_regionkey IS NULL OR n_regionkey = 1 UNION ALL SELECT 'everywhere'")
def directory_of_region(s: SparkSession, d: str) -> DataFrame:
    """Entries of a region and those of none."""
    x = table(s, d, "nation").select(F.col("n_name").alias("entry"), F.col("n_regionkey").alias("region")).union(s.createDataFrame([("everywhere", None)], "entry string, region int"))
    return x.where(F.col("region").isNull() | (F.col("region") == 1)).select("entry")


@q(f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY publication_date DESC NULLS LAST, id) AS r FROM {L} WHERE status = 'published' AND length(content) > 200 AND title IS NOT NULL) WHERE r BETWEEN 11 AND 20")
def page_after_judging(s: SparkSession, d: str) -> DataFrame:
    """Rows are filtered, judged, and paged after that, so a page is full as long as there are rows."""
    x = T.once(table(s, d, "laws").select("id", "status", "title", "publication_date", F.length("content").alias("n"))).where("status = 'published'").where("n > 200 and title is not null")
    top = x.orderBy(F.desc_nulls_last("publication_date"), "id").limit(20)
    return top.withColumn("r", F.row_number().over(Window.orderBy(F.desc_nulls_last("publication_date"), "id"))).where("r > 10").select("id")


_WORDS2 = f"(SELECT id, law_id, {_BARE.format(c='content')} AS b, {words('content')} AS w FROM {A} WHERE content IS NOT NULL AND law_id IS NOT NULL)"


@q(f"SELECT side, id FROM (SELECT side, id, row_number() OVER (PARTITION BY side ORDER BY n DESC, id) AS r FROM (SELECT 'a' AS side, id, len(list_filter(w, lambda x: x = 'licence')) AS n FROM {_WORDS2} WHERE law_id <= 50 UNION ALL SELECT 'b', id, len(list_filter(w, lambda x: x = 'pension')) FROM {_WORDS2} WHERE law_id <= 50) WHERE n > 0) WHERE r <= 8")
def two_subjects(s: SparkSession, d: str) -> DataFrame:
    """Two searches side by side within the same laws, the best eight of each."""
    a = T.articles(s, d, "law_id", "content").where("content is not null and law_id <= 50").select("id", text.words(F.col("content")).alias("w"))
    one = lambda side, word: a.select(F.lit(side).alias("side"), "id", F.size(F.filter("w", lambda x: x == word)).alias("n")).where("n > 0").orderBy(F.desc("n"), "id").limit(8).select("side", "id")
    return one("a", "licence").union(one("b", "pension"))


# ---- feedback: derived from the messages, as the tables have none

_FB = f"(SELECT m.id AS message_id, c.persona, CAST(m.created_at AS DATE) AS day, m.id % 3 <> 0 AS helpful, CASE WHEN m.id % 4 <> 0 THEN m.id % 5 + 1 END AS rating FROM {M} m JOIN {C} c ON c.id = m.conversation_id WHERE lower(trim(m.role)) = 'assistant' AND m.created_at IS NOT NULL)"


def _feedback(s: SparkSession, d: str) -> DataFrame:
    m = T.messages(s, d, "conversation_id", "role", "created_at").where("lower(trim(role)) = 'assistant' and created_at is not null")
    c = T.conversations(s, d, "persona").withColumnRenamed("id", "conversation_id")
    return m.join(c, "conversation_id").select(F.col("id").alias("message_id"), "persona", F.to_date("created_at").alias("day"), (F.col("id") % 3 != 0).alias("helpful"), F.when(F.col("id") % 4 != 0, F.col("id") % 5 + 1).alias("rating"))


@q(f"SELECT persona, count(*) FILTER (helpful) AS helpful, count(*) FILTER (NOT helpful) AS unhelpful, round(avg(helpful::INT), 3) AS satisfaction, round(avg(rating), 2) AS rating FROM {_FB} GROUP BY ROLLUP (persona)")
def feedback_statistics(s: SparkSession, d: str) -> DataFrame:
    """Feedback in total and by persona."""
    g = _feedback(s, d).rollup("persona").agg(F.count_if("helpful").alias("helpful"), F.count_if(~F.col("helpful")).alias("unhelpful"), F.round(F.avg(F.col("helpful").cast("int")), 3).alias("satisfaction"), F.round(F.avg("rating"), 2).alias("rating"))
    return g.select("persona", "helpful", "unhelpful", "satisfaction", "rating")


_DAYQ = f"(SELECT c.persona, CAST(m.created_at AS DATE) AS day, count(*) FILTER (lower(trim(m.role)) = 'user') AS questions, count(DISTINCT m.conversation_id) AS conversations FROM {M} m JOIN {C} c ON c.id = m.conversation_id WHERE m.created_at IS NOT NULL GROUP BY 1, 2)"


def _days(s: SparkSession, d: str) -> DataFrame:
    m = T.messages(s, d, "conversation_id", "role", "created_at").where("created_at is not null").join(T.conversations(s, d, "persona").withColumnRenamed("id", "conversation_id"), "conversation_id")
    return m.groupBy("persona", F.to_date("created_at").alias("day")).agg(F.count_if(F.lower(F.trim("role")) == "user").alias("questions"), F.count_distinct("conversation_id").alias("conversations"))


@q(f"SELECT q.persona, q.day, questions, conversations, coalesce(f.helpful, 0) AS helpful, coalesce(f.unhelpful, 0) AS unhelpful, coalesce(round(f.s, 3), 0) AS satisfaction FROM {_DAYQ} q LEFT JOIN (SELECT persona, day, count(*) FILTER (helpful) AS helpful, count(*) FILTER (NOT helpful) AS unhelpful, avg(helpful::INT) AS s FROM {_FB} GROUP BY 1, 2) f ON f.persona IS NOT DISTINCT FROM q.persona AND f.day = q.day")
def daily_rollup_with_feedback(s: SparkSession, d: str) -> DataFrame:
    """Every profile's days with the satisfaction of the same day; 0 without feedback, no row without a conversation."""
    f = _feedback(s, d).groupBy(F.col("persona").alias("p"), F.col("day").alias("d")).agg(F.count_if("helpful").alias("helpful"), F.count_if(~F.col("helpful")).alias("unhelpful"), F.round(F.avg(F.col("helpful").cast("int")), 3).alias("satisfaction"))
    x = _days(s, d)
    return x.join(f, x["persona"].eqNullSafe(f["p"]) & (x["day"] == f["d"]), "left").select("persona", "day", "questions", "conversations", F.coalesce("helpful", F.lit(0)).alias("helpful"), F.coalesce("unhelpful", F.lit(0)).alias("unhelpful"), F.coalesce("satisfaction", F.lit(0.0)).alias("satisfaction"))


PROFILES = ["citizen", "lawyer", "student", "nobody"]


@q(f"SELECT p.persona, coalesce(sum(questions), 0) AS questions, coalesce(sum(conversations), 0) AS conversations, count(day) AS days FROM {values([(p,) for p in PROFILES], 'persona')} p LEFT JOIN (SELECT * FROM {_DAYQ} WHERE day > (SELECT max(day) FROM {_DAYQ}) - INTERVAL 30 DAY) q ON q.persona = p.persona GROUP BY 1")
def profiles_last_thirty_days(s: SparkSession, d: str) -> DataFrame:
    """Every listed profile over the last thirty days, the last one included; zeros for one without any."""
    x = _days(s, d)
    x = x.join(F.broadcast(x.agg(F.max("day").alias("last")))).where("day > last - interval 30 days")
    p = s.createDataFrame([(v,) for v in PROFILES], "persona string")
    return p.join(x, "persona", "left").groupBy("persona").agg(F.coalesce(F.sum("questions"), F.lit(0)).alias("questions"), F.coalesce(F.sum("conversations"), F.lit(0)).alias("conversations"), F.count("day").alias("days"))


GIVEN = [(1, 5), (2, 9), (-5, 3), (3, None), (3, 4), (4, 1)]


@q(f"SELECT g.message_id, g.rating, CASE WHEN m.id IS NULL THEN 'unknown message' WHEN g.rating NOT BETWEEN 1 AND 5 THEN 'rating' WHEN g.k > 1 THEN 'given before' ELSE 'stored' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY rating NULLS FIRST) AS k FROM {values(GIVEN, 'message_id', 'rating')}) g LEFT JOIN {M} m ON m.id = g.message_id")
def guarded_feedback(s: SparkSession, d: str) -> DataFrame:
    """Feedback is stored once for a message that exists, with a rating from 1 to 5 or none."""
    g = s.createDataFrame(GIVEN, "message_id int, rating int").withColumn("k", F.row_number().over(Window.partitionBy("message_id").orderBy(F.asc_nulls_first("rating"))))
    m = T.messages(s, d).withColumnRenamed("id", "message_id").withColumn("there", F.lit(True))
    state = F.when(F.col("there").isNull(), "unknown message").when(~F.col("rating").between(1, 5), "rating").when(F.col("k") > 1, "given before").otherwise("stored")
    return g.join(m, "message_id", "left").select("message_id", "rating", state.alias("state"))


@q(f"SELECT kind, count(*) AS texts, sum(length(content)) AS before, sum(length(regexp_replace(content, '[ \\n\\t]+', ' ', 'g'))) AS after, round(1 - sum(length(regexp_replace(content, '[ \\n\\t]+', ' ', 'g'))) * 1.0 / sum(length(content)), 6) AS saved FROM {A} WHERE content IS NOT NULL GROUP BY 1")
def normalisation_counters(s: SparkSession, d: str) -> DataFrame:
    x = T.articles(s, d, "kind", "content").where("content is not null").select("kind", F.length("content").alias("b"), F.length(F.regexp_replace("content", r"[ \n\t]+", " ")).alias("a"))
    return x.groupBy("kind").agg(F.count("*").alias("texts"), F.sum("b").alias("before"), F.sum("a").alias("after")).withColumn("saved", F.round(1 - F.col("after") / F.col("before"), 6))


# ---- control and state



@q(f"SELECT id, CASE WHEN content IS NULL OR trim(content, ' ') = '' THEN NULL ELSE sha256(concat_ws('|', coalesce(title, ''), content)) END AS print FROM {A}")
def staleness_fingerprints(s: SparkSession, d: str) -> DataFrame:
    """A hash of a part's text; null for an empty part."""
    p = F.sha2(F.concat_ws("|", F.coalesce("title", F.lit("")), "content"), 256)
    return T.articles(s, d, "title", "content").select("id", F.when(F.col("content").isNotNull() & (F.trim("content") != ""), p).alias("print"))


_N = f"(SELECT l.id, count(a.id) AS n FROM {L} l LEFT JOIN {A} a ON a.law_id = l.id GROUP BY 1)"


@q(f"SELECT l.id, CASE WHEN l.content IS NULL OR length(l.content) < 50 THEN 'no text' WHEN n.n = 0 THEN 'no article' WHEN l.category_id IS NULL THEN 'no category' WHEN l.language IS NULL OR l.language IS DISTINCT FROM l.detected_language THEN 'language' END AS reason FROM {L} l JOIN {_N} n ON n.id = l.id")
def first_blocking_reason(s: SparkSession, d: str) -> DataFrame:
    """The first of the reasons, in a fixed order, that keeps a text back; null for none."""
    n = table(s, d, "articles").select(F.col("law_id").alias("id"), F.lit(True).alias("has")).where("id is not null").distinct()
    x = T.laws(s, d, "content", "category_id", "language", "detected_language").join(n, "id", "left")
    r = F.coalesce(F.when(F.col("content").isNull() | (F.length("content") < 50), "no text"), F.when(F.col("has").isNull(), "no article"), F.when(F.col("category_id").isNull(), "no category"), F.when(F.col("language").isNull() | ~F.col("language").eqNullSafe(F.col("detected_language")), "language"))
    return x.select("id", r.alias("reason"))


@q(f"SELECT id, reviewed AND same AS reviewed FROM (SELECT id, id % 3 = 0 AS reviewed, CASE WHEN language_confidence >= 0.9 THEN 'good' ELSE 'poor' END = CASE WHEN id % 2 = 0 THEN 'good' ELSE 'poor' END AS same FROM {L} WHERE language_confidence IS NOT NULL)")
def review_carried_forward(s: SparkSession, d: str) -> DataFrame:
    """A mark of review stays where the new verdict is the one that was reviewed."""
    x = T.laws(s, d, "language_confidence").where("language_confidence is not null")
    old = x.select("id", F.when(F.col("id") % 2 == 0, "good").otherwise("poor").alias("old"), (F.col("id") % 3 == 0).alias("mark"))
    new = x.select("id", F.when(F.col("language_confidence") >= 0.9, "good").otherwise("poor").alias("new"))
    return new.join(old, "id").select("id", (F.col("mark") & (F.col("new") == F.col("old"))).alias("reviewed"))


CALLS = [(60, 10), (60, 10), (30, 5)]


@q("SELECT CAST(n AS INTEGER) AS n, CAST(a AS DOUBLE) AS start, CAST(b AS DOUBLE) AS finish FROM (VALUES (1, 0, 10), (2, 60, 70), (3, 70, 75)) t(n, a, b)")
def schedule_of_batches(s: SparkSession, d: str) -> DataFrame:
    """When calls sent one after another would start and end within a budget of a hundred tokens a minute; computed by hand in the SQL."""
    rows = [(k + 1, float(a), float(b)) for k, (a, b) in enumerate(limiter.schedule(CALLS, 0.0, tokens_minute=100))]
    return s.createDataFrame(rows, "n int, start double, finish double")


@q()
def limiter_replay(s: SparkSession, d: str) -> DataFrame:
    """The log of events as requests of its types against a rate and four windows. Checked against one limiter a key on small logs."""
    kinds = bounded(table(s, d, "events").select("event_type").distinct(), 1000, "event types")
    number = F.array_position(F.array(*[F.lit(k) for k in sorted(r["event_type"] for r in kinds if r["event_type"])]), F.col("event_type"))
    e = table(s, d, "events").select(F.col("event_id").alias("id"), number.alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").cast("int").alias("tokens"), (F.col("value") / 2).cast("int").alias("input"))
    return limiter.replay(e, "kind", patience=600.0, every=2.0, burst=5, tokens_minute=2000, requests_day=5000)


@q("SELECT user_id, event_id, n > 5 OR gap < 60 AS throttled FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n, coalesce(date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts), 1000000) AS gap FROM events)")
def throttled_accounts(s: SparkSession, d: str) -> DataFrame:
    """More than five requests in an hour, or one within a minute of the last."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id")
    x = table(s, d, "events").withColumn("t", t).withColumn("n", F.count("*").over(w.orderBy("t").rangeBetween(-3_599_999_999, 0)))
    prev = F.lag("t").over(w.orderBy("t", "event_id"))
    gap = F.coalesce(F.floor(F.col("t") / 1_000_000) - F.floor(prev / 1_000_000), F.lit(1_000_000))
    return x.withColumn("gap", gap).select("user_id", "event_id", ((F.col("n") > 5) | (F.col("gap") < 60)).alias("throttled"))


_LRU = "(SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) <= 500 AS kept FROM events)"


@q(f"SELECT user_id, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped FROM {_LRU} GROUP BY 1")
def lru_of_every_user(s: SparkSession, d: str) -> DataFrame:
    """What a cache of bounded size keeps of each user's entries, the latest first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    x = table(s, d, "events").select("user_id", (F.sum("value").over(w) <= 500).alias("kept"))
    return x.groupBy("user_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


# ---- the state of an index, and of extraction

_NN = f"(SELECT q.vec_id AS question, e.vec_id AS id, e.label, q.label AS want, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cos('e.embedding::DOUBLE[]', 'q.embedding::DOUBLE[]')}, 9) DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)"


@q(f"SELECT question, min(rank) FILTER (label = want) AS first_good, count(*) FILTER (label = want) AS good, CASE WHEN min(rank) FILTER (label = want) = 1 THEN 'first' WHEN count(*) FILTER (label = want) > 0 THEN 'present' ELSE 'absent' END AS verdict FROM {_NN} WHERE rank <= 10 GROUP BY 1")
def judged_questions(s: SparkSession, d: str) -> DataFrame:
    """For every question the rank of the first right answer among ten, how many there are, and the verdict."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    near = batch_nearest(e, F.col("id") % 20 == 0, 10).join(e.select("id", "label"), "id").join(e.select(F.col("id").alias("query"), F.col("label").alias("want")), "query")
    g = near.groupBy(F.col("query").alias("question")).agg(F.min(F.when(F.col("label") == F.col("want"), F.col("rank"))).alias("first_good"), F.count_if(F.col("label") == F.col("want")).alias("good"))
    return g.withColumn("verdict", F.when(F.col("first_good") == 1, "first").when(F.col("good") > 0, "present").otherwise("absent"))


@q(f"SELECT k, round(avg(hits) / 1.0, 6) AS share FROM (SELECT question, k, count(*) FILTER (rank <= k AND label = want) * 1.0 / k AS hits FROM {_NN}, (VALUES (1), (5), (10)) w(k) WHERE rank <= 10 GROUP BY 1, 2) GROUP BY 1")
def recall_by_width(s: SparkSession, d: str) -> DataFrame:
    """How the share of right answers falls as more of the ranking is looked at."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    near = batch_nearest(e, F.col("id") % 20 == 0, 10).join(e.select("id", "label"), "id").join(e.select(F.col("id").alias("query"), F.col("label").alias("want")), "query")
    per = near.groupBy("query").agg(*[(F.count_if((F.col("rank") <= k) & (F.col("label") == F.col("want"))) / k).alias(f"k{k}") for k in (1, 5, 10)])
    one = per.agg(*[F.round(F.avg(f"k{k}"), 6).alias(f"k{k}") for k in (1, 5, 10)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("share")) for k in (1, 5, 10)])).alias("x")).select("x.k", "x.share")


@q(f"SELECT law_id, count(DISTINCT page_number) AS pages, round(sum(length(content)) * 1.0 / count(DISTINCT page_number), 4) AS density, count(*) FILTER (regexp_matches(number, '^[0-9]+$') AND CAST(nullif(regexp_extract(number, '^([0-9]{{1,9}})$', 1), '') AS INTEGER) > 150) AS invented, round(avg(len(list_filter({words('content')}, lambda w: length(w) >= 5)) * 1.0 / greatest(len({words('content')}), 1)), 6) AS anchoring FROM {A} WHERE page_number IS NOT NULL AND content IS NOT NULL AND law_id IS NOT NULL GROUP BY 1")
def extraction_measures(s: SparkSession, d: str) -> DataFrame:
    """Pages, signs a page, article numbers beyond what a text can have, and the share of long words."""
    w = text.words(F.col("content"))
    x = T.articles(s, d, "law_id", "page_number", "number", "content").where("page_number is not null and content is not null and law_id is not null")
    x = x.select("law_id", "page_number", F.length("content").alias("n"), F.coalesce(F.nullif(F.regexp_extract("number", "^([0-9]{1,9})$", 1), F.lit("")).cast("int") > 150, F.lit(False)).alias("far"), (F.size(F.filter(w, lambda v: F.length(v) >= 5)) / F.greatest(F.size(w), F.lit(1))).alias("long"))
    return x.groupBy("law_id").agg(F.count_distinct("page_number").alias("pages"), F.round(F.sum("n") / F.count_distinct("page_number"), 4).alias("density"), F.count_if("far").alias("invented"), F.round(F.avg("long"), 6).alias("anchoring"))


@q(f"SELECT vectors = articles AS no_drift, orphans = 0 AS no_orphans, vectors, articles, orphans FROM (SELECT (SELECT count(DISTINCT article_id) FROM articles_vecteurs) AS vectors, (SELECT count(*) FROM {A} WHERE embedding IS NOT NULL) AS articles, (SELECT count(DISTINCT article_id) FROM articles_vecteurs WHERE article_id NOT IN (SELECT id FROM articles)) AS orphans)")
def index_control(s: SparkSession, d: str) -> DataFrame:
    """Whether the copy that search reads agrees with its source, with the counts behind the verdict."""
    v = table(s, d, "articles_vecteurs").select("article_id").distinct()
    a = table(s, d, "articles").select(F.col("id").alias("article_id"), F.col("embedding").isNotNull().alias("has")).groupBy("article_id").agg(F.max("has").alias("has"))
    x = v.withColumn("v", F.lit(True)).join(a, "article_id", "full").agg(F.count("v").alias("vectors"), F.count_if("has").alias("articles"), F.count_if(F.col("v") & F.col("has").isNull()).alias("orphans"))
    return x.select((F.col("vectors") == F.col("articles")).alias("no_drift"), (F.col("orphans") == 0).alias("no_orphans"), "vectors", "articles", "orphans")
