"""Names, numbers, dates and clean-up of the texts of acts, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselle.functions import legal, text
from tesselle.plans.analytics import A, L, M
from tesselle.plans.retrieval import fold, words
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


def quoted(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows: list[tuple], *names: str) -> str:
    """The rows as a table of SQL."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({', '.join(names)}))"


PLACES = [(1, "100%"), (2, "a_b"), (3, "back\\slash"), (4, None), (5, "")]


@q(f"SELECT id, replace(replace(replace(x, '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS escaped FROM {values(PLACES, 'id', 'x')} UNION ALL SELECT doc_id, replace(replace(replace(source, '\\', '\\\\'), '%', '\\%'), '_', '\\_') FROM documents")
def like_literals(s: SparkSession, d: str) -> DataFrame:
    x = s.createDataFrame(PLACES, "id bigint, x string").union(table(s, d, "documents").select("doc_id", "source"))
    return x.select("id", legal.escape_like(F.col("x")).alias("escaped"))


@q(f"SELECT id, coalesce(regexp_matches(trim(number, ' '), '(?i)^(PREAMBULE|LEGAL_BASIS|SIGNATURE|ANNEXE|FULL_TEXT|SECTION_[0-9]+|PARA_[0-9]+)([.][0-9]+)?$'), false) AS pseudo FROM {A}")
def pseudo_numbers(s: SparkSession, d: str) -> DataFrame:
    return T.articles(s, d, "number").select("id", legal.is_pseudo_number(F.col("number")).alias("pseudo"))


@q(f"SELECT id FROM {L} WHERE coalesce(publication_date >= DATE '2005-01-01' AND publication_date <= DATE '2012-06-30', false)")
def date_window(s: SparkSession, d: str) -> DataFrame:
    """From a year to a day; a text without a date is never inside a window."""
    day = F.col("publication_date")
    return T.laws(s, d, "publication_date").where(F.coalesce((day >= F.lit("2005-01-01").cast("date")) & (day <= F.lit("2012-06-30").cast("date")), F.lit(False))).select("id")


_BUDGET = "(^|[^a-z])(budget|finances?|impots?|tax(es)?|treasury|revenue|tresor|recettes?)([^a-z]|$)"


@q(f"SELECT id, regexp_matches({fold('content')}, '{_BUDGET}') AS about FROM {M} WHERE content IS NOT NULL AND lower(trim(role)) = 'user'")
def question_class(s: SparkSession, d: str) -> DataFrame:
    """Whether a question is of the class of its vocabulary, accents folded."""
    return T.messages(s, d, "content", "role").where("content is not null and lower(trim(role)) = 'user'").select("id", text.fold(F.col("content")).rlike(_BUDGET).alias("about"))


@q(f"SELECT id FROM {A} WHERE coalesce(regexp_matches(title, '(?i)^(champ|mesures|scope|measures)'), false) AND (regexp_matches(content, '(?m)^[|].*[0-9]') OR contains(lower(content), 'talaris') AND contains(lower(content), 'article') OR contains(lower(content), 'schedule'))")
def chunk_class(s: SparkSession, d: str) -> DataFrame:
    """A pattern on the title, and on the content a row of figures, or two phrases together, or a third."""
    low = F.lower("content")
    body = F.col("content").rlike(r"(?m)^[|].*[0-9]") | (low.contains("talaris") & low.contains("article")) | low.contains("schedule")
    return T.articles(s, d, "title", "content").where(F.coalesce(F.col("title").rlike("(?i)^(champ|mesures|scope|measures)"), F.lit(False)) & body).select("id")


@q("SELECT DISTINCT law_reference AS reference FROM documents WHERE law_reference IS NOT NULL")
def references_to_resolve(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("law_reference").alias("reference")).where("reference is not null").distinct().orderBy("reference")


@q(f"SELECT id, CASE WHEN suggested_categories IS NULL OR len(suggested_categories) = 0 THEN 'missing' WHEN language_confidence IS NULL OR language_confidence < 0.6 THEN 'uncertain' WHEN length(content) > 2000 THEN 'stale' END AS why FROM {L} WHERE content IS NOT NULL AND (suggested_categories IS NULL OR len(suggested_categories) = 0 OR language_confidence IS NULL OR language_confidence < 0.6 OR length(content) > 2000)")
def laws_to_classify(s: SparkSession, d: str) -> DataFrame:
    """Laws without a verdict, with an uncertain one, or with one made of a shorter excerpt than now."""
    x = T.laws(s, d, "content", "suggested_categories", "language_confidence").where("content is not null")
    why = F.when(F.expr("suggested_categories is null or size(suggested_categories) = 0"), "missing").when(F.expr("language_confidence is null or language_confidence < 0.6"), "uncertain").when(F.length("content") > 2000, "stale")
    return x.select("id", why.alias("why")).where("why is not null")


ASKED = [(1, "article 35 du code minier"), (2, "Art.35 de la Constitution."), (3, "article premier de la loi"), (4, "art. 12"), (5, "Article L 12-3 bis du code du travail"), (6, "le régime des permis"), (7, "article 1er"), (8, None), (9, "section 4 of the act"), (10, "article 9 of the mining act"), (11, "article 2 et 3")]
_REF = lambda k, g: "regexp_extract(trim(x, ' '), '" + legal.REFERENCES[k].replace("'", "''") + f"', {g})"
_HIT = lambda k: "regexp_matches(trim(x, ' '), '" + legal.REFERENCES[k].replace("'", "''") + "')"
_NUM = lambda n: f"(SELECT CASE {' '.join('WHEN w IN (' + ', '.join(quoted(o) for o in v.split()) + ') THEN ' + quoted(k) for k, v in legal.ORDINALS.items())} ELSE w END FROM (SELECT regexp_replace(regexp_replace(regexp_replace(trim(upper({n}), ' '), '^(ARTICLE|ART\\.?|SECTION)[ ]*', ''), '^[ .:-]+|[ .:-]+$', '', 'g'), '[ ]+', ' ', 'g') AS w))"
_PARSED = f"SELECT id, CASE {' '.join(f'WHEN {_HIT(k)} THEN {_NUM(_REF(k, 1))}' for k in range(4))} END AS number, CASE {' '.join(f'WHEN {_HIT(k)} THEN ' + 'regexp_replace(' + _REF(k, 2) + ', ' + quoted('^[ .,;:]+|[ .,;:]+$') + ', ' + quoted('') + ', ' + quoted('g') + ')' for k in range(4))} END AS hint"


@q(f"SELECT * FROM ({_PARSED} FROM (SELECT * FROM {values(ASKED, 'id', 'x')} UNION ALL SELECT id, content FROM {M} WHERE content IS NOT NULL)) WHERE number IS NOT NULL")
def article_reference_forms(s: SparkSession, d: str) -> DataFrame:
    """The article, and the document if it is named, that a question asks for: four forms in order."""
    x = s.createDataFrame(ASKED, "id int, x string").union(T.messages(s, d, "content").where("content is not null").select("id", "content"))
    return x.select("id", legal.parse_reference(F.col("x")).alias("r")).where("r is not null").select("id", "r.number", "r.hint")


@q(f"SELECT id, number, {_NUM('number')} AS form FROM {A} WHERE number IS NOT NULL")
def article_number_forms(s: SparkSession, d: str) -> DataFrame:
    return T.articles(s, d, "number").where("number is not null").select("id", "number", legal.number_form(F.col("number")).alias("form"))


SPELT = [(1, "premier", "1"), (2, "deuxième", "2"), (3, "SEIZIEME", "16"), (4, "quatre-vingt-dix-septième", "97"), (5, "trente-et-unième", "31"), (6, "cent-deuxieme", "102"), (7, "First", "1"), (8, "ten", "10"), (9, "1er", "1"), (10, "2ème", "2"), (11, "12.3", "12.3"), (12, "bis", "bis"), (13, "Préambule", "PREAMBULE"), (14, "neuvième", "9"), (15, "vingt et unième", "21"), (16, "soixante-quinzieme", "75"), (17, None, None)]


@q(f"SELECT id, x, want AS number FROM {values(SPELT, 'id', 'x', 'want')}")
def ordinals_to_numbers(s: SparkSession, d: str) -> DataFrame:
    """Spelt ordinals in French and English, simple and compound; the expected numbers are written out in the SQL."""
    return s.createDataFrame([r[:2] for r in SPELT], "id int, x string").select("id", "x", legal.ordinal_number(F.col("x")).alias("number"))


_ANY = lambda p: " ".join(f"WHEN regexp_matches({fold('title')}, '{p.format(w)}') THEN '{k}'" for w, k in legal.KINDS)


@q(f"SELECT id, CASE {_ANY('^[ ]*{}([^a-z0-9_]|$)')} {_ANY('(^|[^a-z0-9_]){}([^a-z0-9_]|$)')} ELSE 'autre' END AS kind FROM {L} WHERE title IS NOT NULL")
def kind_of_act(s: SparkSession, d: str) -> DataFrame:
    return T.laws(s, d, "title").where("title is not null").select("id", legal.kind_of_title(F.col("title")).alias("kind"))


TITLES = [(1, "Loi n° 2011/012 du 6 mai 2011 portant code", "2011-05-06", True), (2, "Décret n° 2009/056 du 1er février 2010", "2010-02-01", True), (3, "Arrêté n° 1999/019 du 3 mars 2008", "1999-01-01", False), (4, "Order n° 2000/001 dated 12/11/2000", "2000-11-12", True), (5, "Loi du 31 février 2000", None, None), (6, "Loi sur les mines", None, None), (7, None, None, None), (8, "Law n° 2003/4 of 29 february 2004", "2004-02-29", True)]


@q(f"SELECT id, CAST(day AS DATE) AS day, exact FROM {values(TITLES, 'id', 'x', 'day', 'exact')} UNION ALL SELECT id, make_date(CAST(y AS INTEGER), 1, 1), false FROM (SELECT id, regexp_extract(title, 'n[°o] ?([0-9]{{4}})/[0-9]+', 1) AS y FROM {L} WHERE title IS NOT NULL) WHERE y <> ''")
def date_of_title(s: SparkSession, d: str) -> DataFrame:
    """The day a title names, checked against the year of its act number; the titles of the laws name none, the fixed ones do."""
    own = s.createDataFrame([r[:2] for r in TITLES], "id int, x string").select("id", legal.date_of_title(F.col("x")).alias("r"))
    laws = T.laws(s, d, "title").where("title is not null").select("id", legal.date_of_title(F.col("title")).alias("r")).where("r is not null")
    return own.union(laws).select("id", "r.day", "r.exact")


@q(f"SELECT id, nullif(regexp_extract(regexp_extract(title, '^(.*?)(?: (?:concernant|regarding|betreffend|sobre) |$)', 1), 'n° ([0-9]+/[0-9]+)', 1), '') AS number FROM {L}")
def act_number_in_heading(s: SparkSession, d: str) -> DataFrame:
    """The act number in the heading, not one the subject names."""
    head = F.regexp_extract("title", "^(.*?)(?: (?:concernant|regarding|betreffend|sobre) |$)", 1)
    return T.laws(s, d, "title").select("id", F.nullif(F.regexp_extract(head, "n° ([0-9]+/[0-9]+)", 1), F.lit("")).alias("number"))


@q(f"SELECT id, array_to_string([CASE WHEN CAST(p[1] AS BIGINT) < 50 THEN CAST(p[1] AS BIGINT) + 2000 WHEN CAST(p[1] AS BIGINT) < 100 THEN CAST(p[1] AS BIGINT) + 1900 ELSE CAST(p[1] AS BIGINT) END, CAST(p[2] AS BIGINT)], ',') AS form FROM (SELECT id, regexp_extract_all(regexp_extract(x, '([0-9]+/[0-9]+)', 1), '([0-9]+)', 1) AS p FROM (SELECT id, title AS x FROM {L} UNION ALL SELECT * FROM (VALUES (1, '96/06'), (2, '07/011'))) WHERE regexp_matches(x, '[0-9]+/[0-9]+'))")
def comparable_act_numbers(s: SparkSession, d: str) -> DataFrame:
    x = T.laws(s, d, "title").select("id", "title").union(s.createDataFrame([(1, "96/06"), (2, "07/011")], "id int, x string"))
    x = x.select("id", F.nullif(F.regexp_extract("title", "([0-9]+/[0-9]+)", 1), F.lit("")).alias("n")).where("n is not null")
    return x.select("id", F.array_join(F.transform(legal.act_number_form(F.col("n")), lambda v: v.cast("string")), ",").alias("form"))


@q(f"SELECT id, CASE WHEN k <> '' AND s <> '' THEN 'the ' || lower(k) || ' of ' || s END AS subject FROM (SELECT id, regexp_extract(title, '^([^ ]+) n° [0-9]+/[0-9]+ (?:concernant|regarding|betreffend|sobre) ', 1) AS k, regexp_extract(title, ' (?:concernant|regarding|betreffend|sobre) (?:la |le |les |l''|the |die |der |das |el )?(.*)$', 1) AS s FROM {L})")
def nominal_subject(s: SparkSession, d: str) -> DataFrame:
    """The subject of a title as a noun phrase; null unless the heading is certain."""
    k = F.regexp_extract("title", "^([^ ]+) n° [0-9]+/[0-9]+ (?:concernant|regarding|betreffend|sobre) ", 1)
    o = F.regexp_extract("title", " (?:concernant|regarding|betreffend|sobre) (?:la |le |les |l'|the |die |der |das |el )?(.*)$", 1)
    return T.laws(s, d, "title").select("id", F.when((k != "") & (o != ""), F.concat(F.lit("the "), F.lower(k), F.lit(" of "), o)).alias("subject"))


_LINES = "list_slice(list_filter(list_transform(string_split(substring({c}, 1, 500), e'\\n'), lambda x: trim(x, ' ')), lambda x: x <> ''), 1, 3)"


@q(f"SELECT doc_id, CASE WHEN len(a) > 0 THEN a[1] WHEN length(f) > 10 AND length(f) < 200 AND regexp_matches(f, '^[A-ZÀ-Þ]') THEN f END AS title FROM (SELECT doc_id, ls[1] AS f, list_filter(ls, lambda x: regexp_matches(x, '(?i)^(loi|d[ée]cret|arr[êe]t[ée]|ordonnance|law|decree|order|decision|d[ée]cision|circulaire) ?(n|du|of|por)') AND length(x) <= 200) AS a FROM (SELECT doc_id, {_LINES.format(c='text')} AS ls FROM documents))")
def title_of_body(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", legal.title_of_body(F.col("text")).alias("title"))


@q(f"SELECT id, array_to_string(list_slice(list_filter(w, lambda x, i: NOT list_contains(list_slice(w, 1, i - 1), x)), 1, 8), ',') AS tags FROM (SELECT id, list_filter(string_split({fold('title')}, ' '), lambda x: x <> '') AS w FROM {L} WHERE title IS NOT NULL)")
def clean_tags(s: SparkSession, d: str) -> DataFrame:
    return T.laws(s, d, "title").where("title is not null").select("id", F.array_join(legal.tags(F.split(text.fold(F.col("title")), " ")), ",").alias("tags"))


MAILS = [(1, "Élise.Dupont+x@mail.test", "elise.dupontx"), (2, "@nobody", "user"), (3, "...@x", "user"), (4, "a_b-c@d", "a_b-c"), (5, "o" * 40 + "@x", "o" * 30)]


@q(f"SELECT id, name FROM {values(MAILS, 'id', 'mail', 'name')} UNION ALL SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9._-]+', '', 'g') FROM customer")
def usernames(s: SparkSession, d: str) -> DataFrame:
    x = s.createDataFrame([r[:2] for r in MAILS], "id bigint, mail string").union(table(s, d, "customer").select("c_custkey", F.concat("c_name", F.lit("@shop"))))
    return x.select("id", legal.username(F.col("mail")).alias("name"))


@q("SELECT doc_id, length(text) + length(regexp_replace(text, '[\\x{0}-\\x{FFFF}]', '', 'g')) AS units FROM documents UNION ALL SELECT -1, 4")
def utf16_lengths(s: SparkSession, d: str) -> DataFrame:
    """Length in UTF-16 units; a text with a sign beyond the basic plane stands beside the documents."""
    x = table(s, d, "documents").select("doc_id", "text").union(s.createDataFrame([(-1, "a😀b")], "doc_id bigint, text string"))
    return x.select("doc_id", legal.utf16_length(F.col("text")).cast("bigint").alias("units"))


@q(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({fold('title')}, '([a-z]+)', 1), lambda w: length(w) >= 5))), ' ') AS words FROM {L} WHERE title IS NOT NULL")
def long_words(s: SparkSession, d: str) -> DataFrame:
    return T.laws(s, d, "title").where("title is not null").select("id", F.array_join(legal.long_words(F.col("title")), " ").alias("words"))


NAMES = [(1, "Loi du 6 mai 2011 sur les mines", "loi sur mines"), (2, "la loi sur les  Mines", "loi sur mines"), (3, "Code de l'Impôt", "code impot"), (4, "The Act of 3 june 2001 on the ports", "act on ports"), (5, "", ""), (6, None, None)]


@q(f"SELECT id, name FROM {values(NAMES, 'id', 'x', 'name')}")
def text_names(s: SparkSession, d: str) -> DataFrame:
    """Names of texts in one form for comparison; the expected forms are written out in the SQL."""
    return s.createDataFrame([r[:2] for r in NAMES], "id int, x string").select("id", legal.text_name(F.col("x")).alias("name"))


# ---- clean-up

MARKED = [(1, "## ARTICLE 2.- Texte", "ARTICLE 2.- Texte"), (2, "- **Article 3** : texte", "Article 3 : texte"), (3, "Article ler.- x", "Article 1er.- x"), (4, "2. ARTICLE 41.- y", "ARTICLE 41.- y"), (5, "un article 5 cité", "un article 5 cité"), (6, "■ Article 7", "Article 7"), (7, None, None)]
DIRTY = [
    (1, "# Titre\n| www.site.test |\n|---|\ntexte\nwww.site.test\nfin", "Titre\ntexte\nfin"),
    (2, "| a | b |\n|---|---|\n| 1 | 2 |", "| a | b |\n|---|---|\n| 1 | 2 |"),
    (3, "CERTIFIED TRUE COPY\n\n\n\n\nArticle 1", "Article 1"),
    (4, "|---|\nseul", "seul"),
]
PLAIN = [(1, "**Article 1er** : x &amp; y", "Article 1er : x & y"), (2, "# A R R Ê T E :", "ARRÊTE :"), (3, "a<!-- note\nsur deux -->b", "ab"), (4, "un M. X et A", "un M. X et A")]
_CASES = lambda rows: f"SELECT id, want AS cleaned FROM {values(rows, 'id', 'x', 'want')}"


def _cleaned(s: SparkSession, rows: list, f) -> DataFrame:
    return s.createDataFrame([r[:2] for r in rows], "id int, x string").select("id", f(F.col("x")).alias("cleaned"))


@q(_CASES(MARKED))
def canonical_markers(s: SparkSession, d: str) -> DataFrame:
    return _cleaned(s, MARKED, legal.canonical_markers)


@q(_CASES(DIRTY))
def clean_markdown(s: SparkSession, d: str) -> DataFrame:
    """Watermark lines and rules left alone by them out, markers canonical; the expected texts are written out in the SQL."""
    return _cleaned(s, DIRTY, legal.clean_markdown)


@q(_CASES(PLAIN))
def plain_for_chunking(s: SparkSession, d: str) -> DataFrame:
    return _cleaned(s, PLAIN, legal.for_chunking)


@q(f"SELECT id, count(*) FILTER (x <> '') AS lines, count(*) FILTER (regexp_matches(x, '(?i)^((https?://)?www[.][a-z0-9./-]+|copie certifi[ée]e conforme|certified true copy)$')) AS marks FROM (SELECT id, trim(unnest(string_split(content, e'\\n')), ' ') AS x FROM {A} WHERE content IS NOT NULL) GROUP BY id")
def watermark_lines(s: SparkSession, d: str) -> DataFrame:
    lines = F.transform(F.split("content", "\n"), lambda x: F.trim(x))
    x = T.articles(s, d, "content").where("content is not null")
    return x.select("id", F.size(F.filter(lines, lambda y: y != "")).cast("bigint").alias("lines"), F.size(F.filter(lines, legal.is_watermark)).cast("bigint").alias("marks"))


_ADMIN = lambda c: "".join("regexp_replace(" for _ in legal.ADMINISTRATIVE) + c + "".join(f", '{p}', '', 'g')" for p in legal.ADMINISTRATIVE)
_ONE = "replace(replace(replace(replace(replace(replace(replace(translate(content, '’‘‚“”„–—−\xa0 \t', '''''''\"\"\"---   '), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), '…', '...')"
_TWO = f"regexp_replace(regexp_replace({_ADMIN(_ONE)}, '(?im)^[ ]*(?:- ?[0-9]{{1,4}} ?-|\\[[0-9]{{1,4}}\\]|page [0-9]{{1,4}}(?: ?/ ?[0-9]{{1,4}})?|[0-9]{{1,4}})[ ]*$', '', 'g'), '(?im)^[ ]*(?:https?://)?www\\.[a-z0-9./-]+[ ]*$', '', 'g')"
_THREE = f"regexp_replace(regexp_replace(regexp_replace({_TWO}, '[ ]+', ' ', 'g'), ' +([,.])', '\\1', 'g'), '([,;])([A-Za-zÀ-ÿ])', '\\1 \\2', 'g')"
_FOUR = f"regexp_replace(regexp_replace(regexp_replace({_THREE}, '(?m)^ +| +$', '', 'g'), '\\n{{3,}}', e'\\n\\n', 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


@q(f"SELECT id, {_FOUR} AS cleaned FROM {A} WHERE content IS NOT NULL")
def ocr_cleanup_text(s: SparkSession, d: str) -> DataFrame:
    """The cleaned texts themselves, through all four stages."""
    return T.articles(s, d, "content").where("content is not null").select("id", legal.clean_ocr_text(F.col("content")).alias("cleaned"))


@q(f"SELECT law_id, array_to_string(list_filter(list(c ORDER BY order_no NULLS LAST, id), lambda x: x <> ''), e'\\n\\n') AS merged FROM (SELECT law_id, order_no, id, {_FOUR} AS c FROM {A} WHERE content IS NOT NULL AND law_id <> 1 AND kind = 'boilerplate') GROUP BY law_id")
def merged_blocks(s: SparkSession, d: str) -> DataFrame:
    """The boilerplate articles of each law but the largest, cleaned and joined by blank lines."""
    x = T.articles(s, d, "law_id", "order_no", "content", "kind").where("content is not null and law_id <> 1 and kind = 'boilerplate'")
    x = x.groupBy("law_id").agg(F.array_sort(F.collect_list(F.struct(F.col("order_no").isNull().alias("n"), "order_no", "id", "content"))).alias("b"))
    return x.select("law_id", legal.merge_blocks(F.transform("b", lambda r: r["content"])).alias("merged"))


@q(f"SELECT law_id, round(count(page_number) FILTER (n >= 50) * 1.0 / count(*), 6) AS coverage, CASE WHEN count(page_number) FILTER (n >= 50) >= 0.98 * count(*) THEN 'native' ELSE 'hybrid' END AS source FROM (SELECT law_id, page_number, sum(length(content)) AS n FROM {A} WHERE page_number IS NOT NULL AND law_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def digital_or_scan(s: SparkSession, d: str) -> DataFrame:
    """Share of a law's pages that carry text; under 98 % it needs recognition."""
    a = T.once(table(s, d, "articles").where("page_number is not null and law_id is not null").select("id", "law_id", "page_number", F.length("content").alias("n")))
    p = a.groupBy("law_id", "page_number").agg(F.sum("n").alias("n"))
    g = p.groupBy("law_id").agg(F.count_if(F.col("n") >= 50).alias("k"), F.count("*").alias("pages"))
    return g.select("law_id", F.round(F.col("k") / F.col("pages"), 6).alias("coverage"), F.when(F.col("k") >= 0.98 * F.col("pages"), "native").otherwise("hybrid").alias("source"))


@q(f"SELECT id, substring(trim(regexp_replace(regexp_replace(content, '(?im)^[ \\t]*(?:article|art\\.|section)[ \\t]+[^ \\n]{{1,8}}[ \\t]*[.:-]*', ' ', 'g'), '[ \\n\\t]+', ' ', 'g'), ' '), 1, 5000) AS prepared FROM {L} WHERE content IS NOT NULL")
def text_for_language(s: SparkSession, d: str) -> DataFrame:
    return T.laws(s, d, "content").where("content is not null").select("id", legal.for_language(F.col("content")).alias("prepared"))


_V = "(SELECT id, language AS a, coalesce(language_confidence, 0.5) AS p, detected_language AS b, 0.7 AS q FROM {L})".replace("{L}", L)
_PICK = "CASE WHEN b IS NULL OR a = b THEN a WHEN a IS NULL OR q > p THEN b ELSE a END"
_SURE = "CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a = b THEN least(greatest(p, q) + 0.05, 0.99) WHEN a IS NULL THEN q WHEN b IS NULL THEN p ELSE greatest(p, q) END"


@q(f"SELECT id, CASE WHEN x IN ('fr', 'en') THEN x WHEN x IS NOT NULL THEN 'fr' END AS language, round(CASE WHEN x IN ('fr', 'en') THEN c ELSE c / 2 END, 4) AS confidence FROM (SELECT id, {_PICK} AS x, {_SURE} AS c FROM {_V})")
def two_detector_vote(s: SparkSession, d: str) -> DataFrame:
    x = T.laws(s, d, "language", "language_confidence", "detected_language")
    v = legal.language_vote(F.col("language"), F.coalesce("language_confidence", F.lit(0.5)), F.col("detected_language"), F.lit(0.7))
    return x.select("id", v.alias("v")).select("id", "v.language", "v.confidence")


@q(f"SELECT id, coalesce(detected_language, CASE WHEN regexp_matches(lower(content), ' (?:le|la|les|des|une|dans) ') THEN 'fr' ELSE 'en' END) AS language, CASE WHEN detected_language IS NULL THEN 0.75 ELSE 1.0 END AS confidence FROM {L} WHERE content IS NOT NULL")
def language_with_fallback(s: SparkSession, d: str) -> DataFrame:
    x = T.laws(s, d, "content", "detected_language").where("content is not null")
    return x.select("id", legal.language_or_guess(F.col("detected_language"), F.col("content")).alias("v")).select("id", "v.language", "v.confidence")


@q("SELECT doc_id, mode AS language, round(votes * 1.0 / total, 6) AS share FROM (SELECT doc_id, lang AS mode, n AS votes, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) AS r FROM (SELECT doc_id, w.lang, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-zà-ÿ]+)', 1)) AS word FROM documents) d JOIN common_words w ON w.word = d.word GROUP BY 1, 2)) WHERE r = 1")
def majority_vote(s: SparkSession, d: str) -> DataFrame:
    """The language most function words of a document vote for, and its share of the votes; ties to the first name."""
    from tesselle.session import broadcast_if_small

    x = table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]+)"), 1)).alias("word"))
    n = x.join(broadcast_if_small(table(s, d, "common_words"), 100_000), "word").groupBy("doc_id", "lang").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id")
    y = n.withColumn("total", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "lang"))).where("r = 1")
    return y.select("doc_id", F.col("lang").alias("language"), F.round(F.col("n") / F.col("total"), 6).alias("share"))
