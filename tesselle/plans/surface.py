"""Operators put together: navigation, anchors, support of claims, comparison, functions under SQL names, counters; with the oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tesselle.functions import legal, register, text, vectors
from tesselle.operators import links as K
from tesselle.operators import text_index as I
from tesselle.plans.analytics import A, C, L, M
from tesselle.plans.indexed import _AW, _holds
from tesselle.plans.retrieval import VEC, VSQL, cos, fold, words
from tesselle.plans.status import _BASE
from tesselle.plans.texts import values
from tesselle.session import table
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


ASKS = [(1, "article 3 de la pension de retraite", "3", "pension de retraite"), (2, "article premier du cadastre", "1", "cadastre"), (3, "le régime des permis", None, None)]
_N3 = "CASE WHEN upper(trim(a.number, ' .:-')) IN ('PREMIER', 'PREMIERE', 'PREMIÈRE', '1ER', '1ÈRE', '1ERE', 'FIRST', '1ST') THEN '1' ELSE upper(trim(a.number, ' .:-')) END"


@q(f"SELECT ask, law_id, article_id FROM (SELECT n.id AS ask, a.law_id, a.id AS article_id, row_number() OVER (PARTITION BY n.id ORDER BY length(l.title), l.id, a.id) AS r FROM {values([(a[0], a[2], a[3]) for a in ASKS if a[2]], 'id', 'number', 'hint')} n JOIN {L} l ON contains({fold('l.title')}, {fold('n.hint')}) JOIN {A} a ON a.law_id = l.id AND {_N3} = n.number) WHERE r = 1")
def navigation_target(s: SparkSession, d: str) -> DataFrame:
    """Where a question that names an article of a text leads: the first law, the shortest title first, that holds it."""
    asks = s.createDataFrame([a[:2] for a in ASKS], "ask int, q string").select("ask", legal.parse_reference(F.col("q")).alias("r")).where("r is not null and r.hint <> ''").select("ask", "r.number", text.fold(F.col("r.hint")).alias("hint"))
    l = T.laws(s, d, "title").where("title is not null").select(F.col("id").alias("law_id"), text.fold(F.col("title")).alias("t"), F.length("title").alias("n"))
    a = T.articles(s, d, "law_id", "number").select("law_id", F.col("id").alias("article_id"), legal.number_form(F.col("number")).alias("number"))
    found = l.join(F.broadcast(asks), F.contains("t", "hint")).join(a, ["law_id", "number"])  # a handful of questions
    best = found.groupBy("ask").agg(F.min(F.struct("n", "law_id", "article_id")).alias("b"))
    return best.select("ask", "b.law_id", "b.article_id")


@q(f"SELECT id FROM {_AW} WHERE id <= 300 AND {_holds(['licence', 'pilote'])} = 2")
def strict_terms_of_ids(s: SparkSession, d: str) -> DataFrame:
    """Which rows of a list of ids hold every one of at least two words."""
    return I.matches(I.index(s, d), "a", ["licence", "pilote"]).where("id <= 300").select(F.col("id").cast("int").alias("id"))


@q(f"WITH w AS (SELECT DISTINCT id, unnest({words('content')}) AS t FROM {A} WHERE content IS NOT NULL), f AS (SELECT t, count(*) AS n FROM w GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20) SELECT DISTINCT id FROM w WHERE t IN (SELECT t FROM f) AND t IN (SELECT unnest({words('title')}) FROM laws)")
def anchored_articles(s: SparkSession, d: str) -> DataFrame:
    """Articles that hold a distinctive word of some title: one in two to twenty articles."""
    post = T.articles(s, d, "content").where("content is not null").select("id", F.explode(F.array_distinct(text.words(F.col("content")))).alias("t"))
    rare = post.groupBy("t").agg(F.count("*").alias("n")).where("n between 2 and 20").select("t")
    named = T.laws(s, d, "title").select(F.explode(text.words(F.col("title"))).alias("t")).distinct()
    return post.join(rare.join(named, "t", "left_semi"), "t", "left_semi").select("id").distinct()


_OK = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


@q(f"SELECT inside, id, round(s, 6) AS similarity FROM (SELECT inside, id, s, row_number() OVER (PARTITION BY inside ORDER BY s DESC, id) AS r FROM (SELECT v.article_id AS id, coalesce(regexp_matches(l.title, '(?i)^(loi|law)'), false) AS inside, round({cos('v.embedding::DOUBLE[]', VSQL)}, 9) AS s FROM (SELECT DISTINCT ON (article_id) * FROM articles_vecteurs WHERE {_OK}) v LEFT JOIN {L} l ON l.id = v.law_id)) WHERE r <= 5")
def neighbours_inside_and_outside(s: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of a class of titles and outside it; titles are fetched for the key only, vectors stay in the scan's projection."""
    v = T.vectors(s, d).where(vectors.usable(F.col("embedding"), 64)).select(F.col("article_id").alias("id"), "law_id", F.round(vectors.cosine(F.col("embedding"), F.array(*map(F.lit, VEC))), 9).alias("s"))
    l = T.laws(s, d, "title").select(F.col("id").alias("law_id"), F.coalesce(F.col("title").rlike("(?i)^(loi|law)"), F.lit(False)).alias("inside"))
    x = v.join(l, "law_id", "left").select("id", "s", F.coalesce("inside", F.lit(False)).alias("inside"))
    w = Window.partitionBy("inside").orderBy(F.desc("s"), "id")
    return x.withColumn("r", F.row_number().over(w)).where("r <= 5").select("inside", "id", F.round("s", 6).alias("similarity"))


_SRC = f"(SELECT id, CAST(json_extract(j, '$.law_id') AS INTEGER) AS law_id, json_extract_string(j, '$.article_number') AS number FROM (SELECT id, unnest(json_extract(sources, '$[*]')) AS j FROM {M} WHERE sources IS NOT NULL AND json_valid(sources)))"


@q(f"SELECT m.id, count(DISTINCT w) AS unsupported FROM (SELECT id, unnest(list_distinct(list_filter({words('content')}, lambda w: length(w) > 5))) AS w FROM {M} WHERE content IS NOT NULL AND id IN (SELECT id FROM {_SRC})) m WHERE NOT EXISTS (SELECT 1 FROM {_SRC} c JOIN {A} a ON a.law_id = c.law_id AND a.number = c.number WHERE c.id = m.id AND list_contains({words('a.content')}, m.w)) GROUP BY 1")
def claims_without_support(s: SparkSession, d: str) -> DataFrame:
    """How many long words of an answer stand in none of its sources. A source's words are joined on (message, word)."""
    src = T.messages(s, d, "sources").where("sources is not null").select("id", F.explode(F.from_json("sources", "array<struct<law_id:int,article_number:string>>")).alias("r")).select("id", "r.law_id", F.col("r.article_number").alias("number"))
    a = T.articles(s, d, "law_id", "number", "content").where("content is not null").select("law_id", "number", F.explode(F.array_distinct(F.filter(text.words(F.col("content")), lambda w: F.length(w) > 5))).alias("w"))
    backed = src.distinct().join(a, ["law_id", "number"]).select("id", "w").distinct()
    said = T.messages(s, d, "content").where("content is not null").join(src.select("id").distinct(), "id", "left_semi").select("id", F.explode(F.array_distinct(F.filter(text.words(F.col("content")), lambda w: F.length(w) > 5))).alias("w"))
    return said.join(backed, ["id", "w"], "left_anti").groupBy("id").agg(F.count("*").alias("unsupported"))


NOTES = [(1, 1, "date", "missing"), (1, 2, "date", "missing"), (2, 1, "date", "missing"), (2, 2, "title", "short"), (2, 3, "date", "other")]


@q("SELECT CAST(pos AS INTEGER) AS pos, field, note FROM (VALUES (1, 'date', 'missing'), (2, 'title', 'short'), (3, 'date', 'other')) t(pos, field, note)")
def merged_notes(s: SparkSession, d: str) -> DataFrame:
    """Two lists of notes one after the other, each note once a field, order kept."""
    x = s.createDataFrame(NOTES, "list int, k int, field string, note string")
    g = x.groupBy("field", "note").agg(F.min(F.struct("list", "k")).alias("at"))
    return g.select(F.row_number().over(Window.orderBy("at")).alias("pos"), "field", "note")




@q(f"SELECT id, len(string_split(content, e'\\n')) AS lines, len(regexp_extract_all(content, '(?m)^[ ]*[(]?[0-9]{{1,2}}[)°.]')) AS passages FROM {A} WHERE content IS NOT NULL")
def passages_of_rows(s: SparkSession, d: str) -> DataFrame:
    """Numbered passages of every stored row."""
    x = T.articles(s, d, "content").where("content is not null")
    return x.select("id", F.size(F.split("content", "\n")).cast("bigint").alias("lines"), F.size(F.regexp_extract_all("content", F.lit(r"(?m)^[ ]*[(]?[0-9]{1,2}[)°.]"), 0)).cast("bigint").alias("passages"))


CELLS = [(1, "2, 3"), (2, "3, 99999"), (3, "")]


@q(f"SELECT c.axis, c.number, min(a.id) AS article_id FROM (SELECT id AS axis, unnest(regexp_extract_all(x, '([0-9]+)', 1)) AS number FROM {values(CELLS, 'id', 'x')}) c LEFT JOIN {A} a ON a.law_id = 2 AND {_BASE('a.number')} = c.number GROUP BY 1, 2")
def comparison_cells(s: SparkSession, d: str) -> DataFrame:
    """The article numbers cited in the cells of a comparison, resolved in one text; what it does not hold stays without an article."""
    c = s.createDataFrame(CELLS, "axis int, x string").select("axis", F.explode(F.regexp_extract_all("x", F.lit("([0-9]+)"), 1)).alias("number"))
    a = T.articles(s, d, "law_id", "number").where("law_id = 2").select(K.base_number(F.col("number")).alias("number"), "id").groupBy("number").agg(F.min("id").alias("article_id"))
    return c.join(a, "number", "left").select("axis", "number", "article_id")


@q(f"SELECT id, {fold('title')} AS folded, len({words('title')}) AS n, sha256(trim(regexp_replace(lower(content), '[ \\n\\t]+', ' ', 'g'), ' ')) AS hash FROM {L} WHERE title IS NOT NULL AND content IS NOT NULL")
def functions_under_sql_names(s: SparkSession, d: str) -> DataFrame:
    """The registered functions called from SQL."""
    register.register(s)
    T.laws(s, d, "title", "content").where("title is not null and content is not null").createOrReplaceTempView("_tesselle_laws")
    return s.sql("SELECT id, fold_text(title) AS folded, cast(size(text_words(title)) AS bigint) AS n, content_hash(content) AS hash FROM _tesselle_laws")


@q()
def chunks_under_a_sql_name(s: SparkSession, d: str) -> DataFrame:
    """The chunker as a table function of SQL. Its rows are those of ``chunks_keep_all_text``'s chunker."""
    register.register(s)
    T.laws(s, d, "content").where("content is not null").createOrReplaceTempView("_tesselle_texts")
    return s.sql("SELECT t.id, c.* FROM _tesselle_texts t, LATERAL document_chunks(t.content) c")


@q("SELECT count(*) AS rows, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 2) AS total FROM events")
def observed_counters(s: SparkSession, d: str) -> DataFrame:
    """Counters taken along while rows pass, without a second pass: the job here is a write that goes nowhere."""
    o = Observation("events")
    e = table(s, d, "events").observe(o, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 2).alias("total"))
    e.write.format("noop").mode("overwrite").save()
    return s.createDataFrame([(o.get["rows"], o.get["errors"], o.get["total"])], "rows bigint, errors bigint, total double")


@q("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_rollup_stream(s: SparkSession, d: str) -> DataFrame:
    """The daily roll-up as a stream over what is available: a day is written once its watermark has passed."""
    e = W.read_closed(s, f"{d}/events.parquet").withWatermark("ts", W.LATE)
    g = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")
    return W.run_available(g)


@q(f"SELECT c.persona, CAST(m.created_at AS DATE) AS day, count(*) AS messages, count(DISTINCT m.conversation_id) AS conversations FROM {M} m JOIN {C} c ON c.id = m.conversation_id WHERE CAST(m.created_at AS DATE) = (SELECT CAST(max(created_at) AS DATE) - 1 FROM messages) GROUP BY 1, 2")
def yesterday_of_every_profile(s: SparkSession, d: str) -> DataFrame:
    """The daily job: all profiles of the day before the last, in one aggregation; the day reaches the scan as a range of times."""
    last = table(s, d, "messages").agg(F.to_date(F.max("created_at")).alias("last")).first()["last"]
    if last is None:
        return s.createDataFrame([], "persona string, day date, messages bigint, conversations bigint")
    day = F.date_sub(F.lit(last), 1)
    m = T.messages(s, d, "conversation_id", "created_at").where((F.col("created_at") >= day.cast("timestamp_ntz")) & (F.col("created_at") < F.lit(last).cast("timestamp_ntz")))
    x = m.join(T.conversations(s, d, "persona").withColumnRenamed("id", "conversation_id"), "conversation_id")
    return x.groupBy("persona", F.to_date("created_at").alias("day")).agg(F.count("*").alias("messages"), F.count_distinct("conversation_id").alias("conversations"))
