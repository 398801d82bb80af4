"""The legal status of texts and articles from dated links, and the pieces of articles, with the oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselle.operators import links as K
from tesselle.plans.analytics import A, L
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


# Links read off the laws: every dated law changes another of its category, by designations of every shape.
_SRC = "(SELECT id, category_id, publication_date AS day, lag(id) OVER (PARTITION BY category_id ORDER BY publication_date, id) AS target FROM {L} WHERE category_id IS NOT NULL AND publication_date IS NOT NULL)".replace("{L}", L)
_LK = f"""(SELECT id AS link_id, CASE WHEN id % 10 = 0 THEN 1 ELSE target END AS text_id, id AS by_id, CASE id % 5 WHEN 0 THEN 'repeals' WHEN 1 THEN 'amends' WHEN 2 THEN 'replaces' WHEN 3 THEN 'completes' ELSE 'amends' END AS nature, day,
 CASE id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['2', '4 à 6'] WHEN 2 THEN ['1er', '3.2', '9 to 12'] ELSE ['5', '7 à 3'] END AS articles, CASE id % 3 WHEN 0 THEN []::VARCHAR[] ELSE ['1', '2 à 4'] END AS by_articles,
 CASE WHEN id % 7 = 0 THEN 'Chapitre' END AS section, CASE WHEN id % 6 = 0 THEN 'SECTION_1' END AS p_piece, CASE WHEN id % 6 = 0 THEN '6' END AS p_article, CASE WHEN id % 6 = 0 THEN 'a ' END AS p_mark, CASE WHEN id % 3 = 1 THEN '5' END AS x_piece, CASE WHEN id % 3 = 1 THEN 'talaris' END AS x_mark
 FROM {_SRC} WHERE (CASE WHEN id % 10 = 0 THEN 1 ELSE target END) IS NOT NULL AND id <> 1)"""


def _links(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("category_id").orderBy("publication_date", "id")
    x = T.laws(s, d, "category_id", "publication_date").where("category_id is not null and publication_date is not null").withColumn("target", F.lag("id").over(w))
    x = x.withColumn("text_id", F.when(F.col("id") % 10 == 0, 1).otherwise(F.col("target"))).where("text_id is not null and id <> 1")
    none = "cast(array() as array<string>)"
    return x.select(
        F.col("id").alias("link_id"), "text_id", F.col("id").alias("by_id"),
        F.expr("case id % 5 when 0 then 'repeals' when 1 then 'amends' when 2 then 'replaces' when 3 then 'completes' else 'amends' end").alias("nature"), F.col("publication_date").alias("day"),
        F.expr(f"case id % 4 when 0 then {none} when 1 then array('2', '4 à 6') when 2 then array('1er', '3.2', '9 to 12') else array('5', '7 à 3') end").alias("articles"),
        F.expr(f"case id % 3 when 0 then {none} else array('1', '2 à 4') end").alias("by_articles"), F.expr("case when id % 7 = 0 then 'Chapitre' end").alias("section"),
        F.expr("case when id % 6 = 0 then array(struct('SECTION_1' as piece, '6' as article, 'a ' as mark)) end").alias("pieces"), F.expr("case when id % 3 = 1 then array(struct('5' as piece, 'talaris' as mark)) end").alias("except"),
    )


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return T.articles(s, d, "law_id", "number", "section", "content").withColumnRenamed("id", "article_id")


_PSEUDO = "regexp_matches(trim({n}, ' '), '(?i)^(PREAMBULE|LEGAL_BASIS|SIGNATURE|ANNEXE|FULL_TEXT|SECTION_[0-9]+|PARA_[0-9]+)([.][0-9]+)?$')"
_BASE = lambda n: f"(CASE WHEN {n} IS NULL OR {_PSEUDO.format(n=n)} THEN NULL ELSE nullif(regexp_replace(trim(split_part(lower(trim({n}, ' ')), '.', 1), ' '), '^([0-9]+)(?:er|ère|ere)$', '\\1'), '') END)"
_RANGE = "'^[ ]*([0-9]+)[ ]*(?:à|a|to|-)[ ]*([0-9]+)[ ]*$'"
_N = lambda d, k: f"CAST(nullif(regexp_extract({d}, {_RANGE}, {k}), '') AS INTEGER)"
_KEYS = lambda a: f"list_distinct(flatten(list_transform({a}, lambda d: CASE WHEN regexp_matches(d, {_RANGE}) THEN list_transform(range({_N('d', 1)}, {_N('d', 2)} + 1), lambda n: CAST(n AS VARCHAR)) WHEN contains(d, '.') THEN []::VARCHAR[] ELSE [regexp_replace(lower(d), '^([0-9]+)(?:er|ère|ere)$', '\\1')] END)))"
_NORM = lambda c: f"lower(trim(regexp_replace(coalesce({c}, ''), '[ \\n\\t\\r]+', ' ', 'g'), ' '))"
_LC = f"(SELECT l.*, a.id AS article_id, a.number, {_BASE('a.number')} AS base, {_NORM('a.section')} AS sec, {_NORM('a.content')} AS body, {_KEYS('l.articles')} AS keys FROM {_LK} l JOIN {A} a ON a.law_id = l.text_id)"
_IN = f"starts_with(sec, {_NORM('section')})"
_NAMED = f"({_IN} AND (len(articles) = 0 OR list_contains(articles, trim(number, ' ')) OR coalesce(list_contains(keys, base), false)) AND NOT coalesce(x_piece = base AND contains(body, x_mark), false))"
_STORED = f"({_IN} AND coalesce(p_piece = trim(number, ' ') AND contains(body, trim(p_mark, ' ')), false))"
_TOUCH = f"(SELECT link_id, article_id, nature, day, by_id, CASE WHEN NOT coalesce({_NAMED}, false) THEN p_article END AS stored_as FROM {_LC} WHERE coalesce({_NAMED}, false) OR {_STORED})"


@q(f"SELECT link_id, article_id, stored_as FROM {_TOUCH}")
def link_touches_chunk(s: SparkSession, d: str) -> DataFrame:
    """Which chunks every link touches: by number, base number or range, unless excepted, or stored under another number."""
    return K.touches(_links(s, d), _chunks(s, d))


@q(f"SELECT link_id, array_to_string(list_sort({_KEYS('articles')}), ',') AS keys FROM {_LK}")
def designation_keys(s: SparkSession, d: str) -> DataFrame:
    return _links(s, d).select("link_id", F.array_join(F.array_sort(K.keys(F.col("articles"))), ",").alias("keys"))


_BYC = f"(SELECT l.link_id, a.id AS article_id, a.number, {_BASE('a.number')} AS base, by_articles, {_KEYS('l.by_articles')} AS keys FROM {_LK} l JOIN {A} a ON a.law_id = l.by_id WHERE a.number IS NOT NULL)"
_CARRY = "upper(trim(number, ' ')) NOT IN ('PREAMBULE', 'LEGAL_BASIS', 'SIGNATURE') AND (len(by_articles) = 0 OR list_contains(by_articles, trim(number, ' ')) OR coalesce(list_contains(keys, base), false))"


@q(f"SELECT link_id, article_id FROM {_BYC} WHERE {_CARRY}")
def chunks_that_carry_a_change(s: SparkSession, d: str) -> DataFrame:
    """The chunks of the amending text that carry its change: neither its visas nor its signature."""
    x = _links(s, d).select("link_id", F.col("by_id").alias("law_id"), "by_articles").join(_chunks(s, d).where("number is not null"), "law_id")
    head = F.upper(F.trim("number")).isin("PREAMBULE", "LEGAL_BASIS", "SIGNATURE")
    return x.where(~head & K.designates(F.col("by_articles"), F.col("number"))).select("link_id", "article_id")


@q(f"SELECT link_id, article_id FROM {_LC} WHERE {_IN} AND (x_piece = base OR p_piece = trim(number, ' '))")
def chunks_to_read(s: SparkSession, d: str) -> DataFrame:
    """The chunks whose content decides whether a link touches them: an exception or a stored piece names them."""
    return K.to_read(_links(s, d), _chunks(s, d))


_COV = f"(SELECT a.link_id, b.link_id AS by_link, b.day AS d FROM (SELECT *, {_KEYS('articles')} AS k FROM {_LK}) a JOIN (SELECT *, {_KEYS('articles')} AS k FROM {_LK} WHERE nature IN ('repeals', 'replaces')) b ON a.text_id = b.text_id AND b.day > a.day AND (b.section IS NULL OR b.section IS NOT DISTINCT FROM a.section) AND (len(b.articles) = 0 OR len(a.articles) > 0 AND len(list_filter(a.k, lambda x: NOT list_contains(b.k, x))) = 0))"
_OVER = f"(SELECT link_id, by_link FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY d DESC, by_link DESC) AS r FROM {_COV}) WHERE r = 1)"


@q(f"SELECT * FROM {_OVER}")
def overtaken_links(s: SparkSession, d: str) -> DataFrame:
    """For every link the last later repeal or replacement that covers all articles it touched."""
    return K.overtaken(_links(s, d))


@q(f"WITH t AS MATERIALIZED (SELECT * FROM {_TOUCH}), e AS (SELECT article_id, max(day) AS d FROM t WHERE nature IN ('repeals', 'replaces') GROUP BY 1) SELECT t.article_id, link_id, nature, day, by_id, stored_as FROM t LEFT JOIN e ON e.article_id = t.article_id WHERE e.d IS NULL OR t.day >= e.d")
def links_of_chunk(s: SparkSession, d: str) -> DataFrame:
    """The links that still say something of a chunk: those from its last repeal or replacement on."""
    x = _links(s, d)
    return K.current(K.touches(x, _chunks(s, d)), x)


_RANK = "list_position(['repeals', 'replaces', 'amends', 'completes', 'cites'], nature)"


@q(f"WITH t AS MATERIALIZED (SELECT * FROM {_TOUCH}), e AS (SELECT article_id, max(day) AS d FROM t WHERE nature IN ('repeals', 'replaces') GROUP BY 1) SELECT t.article_id, arg_min(nature, {_RANK}) AS state FROM t LEFT JOIN e ON e.article_id = t.article_id WHERE e.d IS NULL OR t.day >= e.d GROUP BY 1")
def strongest_state(s: SparkSession, d: str) -> DataFrame:
    return K.strongest_states(_links(s, d), _chunks(s, d))


_WAYS = f"(SELECT text_id AS law_id, by_id AS other_id, link_id, nature, day, 'changed by' AS way FROM {_LK} UNION ALL SELECT by_id, text_id, link_id, nature, day, 'changes' FROM {_LK} WHERE by_id <> text_id)"


@q(f"SELECT * FROM {_WAYS}")
def links_both_ways(s: SparkSession, d: str) -> DataFrame:
    return K.both_ways(_links(s, d))


_STATUS = f"(SELECT law_id, 'c' || row_number() OVER (PARTITION BY law_id ORDER BY first_day, other_id, way) AS change, other_id, way, first_day, natures, live FROM (SELECT law_id, other_id, way, min(day) AS first_day, array_to_string(list_sort(list_distinct(list(nature))), ',') AS natures, bool_or(o.link_id IS NULL) AS live FROM {_WAYS} w LEFT JOIN {_OVER} o ON o.link_id = w.link_id GROUP BY 1, 2, 3))"


@q(f"SELECT * FROM {_STATUS}")
def status_of_text(s: SparkSession, d: str) -> DataFrame:
    """A text's counterparts in order of date, numbered, with what they did and whether anything of it still holds."""
    return K.status(_links(s, d))


@q(f"WITH t AS MATERIALIZED (SELECT * FROM {_TOUCH}), st AS MATERIALIZED (SELECT * FROM {_STATUS} WHERE way = 'changed by') SELECT t.article_id, st.change, max(st.first_day) AS first_day, count(*) AS links FROM t JOIN {A} a ON a.id = t.article_id JOIN st ON st.law_id = a.law_id AND st.other_id = t.by_id GROUP BY 1, 2")
def status_of_article(s: SparkSession, d: str) -> DataFrame:
    """The changes that concern each article, under the numbers they have in its text."""
    return K.changes_of_chunks(_links(s, d), _chunks(s, d))


@q(f"SELECT w.law_id, w.other_id, coalesce(l.title, 'text ' || w.other_id) AS label, coalesce(l.publication_date, w.day) AS dated, l.id IS NOT NULL AND l.status = 'published' AS held FROM (SELECT law_id, other_id, min(day) AS day FROM {_WAYS} GROUP BY 1, 2) w LEFT JOIN {L} l ON l.id = w.other_id")
def linked_texts(s: SparkSession, d: str) -> DataFrame:
    """Every counterpart described by the corpus, else by the link."""
    w = K.both_ways(_links(s, d)).groupBy("law_id", "other_id").agg(F.min("day").alias("day"))
    l = T.laws(s, d, "title", "publication_date", "status").withColumnRenamed("id", "other_id").withColumn("there", F.lit(True))
    x = w.join(l, "other_id", "left")
    return x.select("law_id", "other_id", F.coalesce("title", F.concat(F.lit("text "), F.col("other_id").cast("string"))).alias("label"), F.coalesce("publication_date", "day").alias("dated"), F.coalesce(F.col("there") & (F.col("status") == "published"), F.lit(False)).alias("held"))


@q(f"SELECT count(*) FILTER (link_id NOT IN (SELECT link_id FROM {_TOUCH})) AS idle, count(*) AS links FROM {_LK}")
def idle_links(s: SparkSession, d: str) -> DataFrame:
    """Links that touch no chunk at all."""
    x = _links(s, d)
    hit = K.touches(x, _chunks(s, d)).select("link_id", F.lit(True).alias("hit")).distinct()
    return x.select("link_id").join(hit, "link_id", "left").agg(F.count_if(F.col("hit").isNull()).alias("idle"), F.count("*").alias("links"))


@q(f"WITH t AS (SELECT DISTINCT by_id, nature, article_id FROM {_TOUCH}) SELECT article_id, line, CASE WHEN r = 1 THEN line ELSE nature || ' (see ' || first || ')' END AS shown FROM (SELECT article_id, nature, nature || ' by ' || by_id AS line, row_number() OVER (PARTITION BY nature, by_id ORDER BY article_id) AS r, min(article_id) OVER (PARTITION BY nature, by_id) AS first FROM t)")
def lines_without_repeats(s: SparkSession, d: str) -> DataFrame:
    """A status line given in full where it first occurs and by reference after that."""
    t = K.lines(_links(s, d), _chunks(s, d))
    line = F.concat_ws(" by ", "nature", F.col("by_id").cast("string"))
    shown = F.when(F.col("article_id") == F.col("first"), line).otherwise(F.concat(F.col("nature"), F.lit(" (see "), F.col("first").cast("string"), F.lit(")")))
    return t.select("article_id", line.alias("line"), shown.alias("shown"))
