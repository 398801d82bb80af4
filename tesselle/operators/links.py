"""Links between texts, article by article: what a link touches, what has overtaken it, and the status that follows.

links: link_id, text_id (the text touched), by_id (the text that touches), nature, day, articles (array of designations, empty for the whole
text), by_articles, section (prefix or null), pieces (array of struct<piece, article, mark>: articles stored under another number),
except (array of struct<piece, mark>). A designation is a number (``12``, ``1er``), a piece (``55.2``: that piece alone) or a range (``34 à 101``).
chunks: article_id, law_id, number, section, content.

Links of one text that name the same articles, section, pieces and exceptions form a class: what a class touches is decided once, whatever the
number of its links, and the classes' members are put in last. Designations are unfolded to one row a number, so classes and chunks meet by
equi-joins on (text, number); only a class on the whole text meets all chunks of its text, which is its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselle.functions.legal import is_pseudo_number
from tesselle.session import broadcast_if_small, cut

ENDS = ["repeals", "replaces"]
# Natures from the strongest state to the weakest.
STRENGTH = ["repeals", "replaces", "amends", "completes", "cites"]
RANGE = r"^[ ]*([0-9]+)[ ]*(?:à|a|to|-)[ ]*([0-9]+)[ ]*$"
WIDEST = 400
# Classes and members beyond so many rows are joined by shuffle, the chunks of a class spread over SALTS tasks.
BROADCAST_ROWS = 300_000
SALTS = 32
CLASS = ["class", "variant"]


def base_number(c: Column) -> Column:
    """The number an amending text would give: of a piece 55.2 it is 55, of 1er 1; null for a pseudo number or none."""
    b = F.trim(F.split_part(F.lower(F.trim(c)), F.lit("."), F.lit(1)))
    b = F.regexp_replace(b, r"^([0-9]+)(?:er|ère|ere)$", "$1")
    return F.when(c.isNull() | is_pseudo_number(c) | (b == ""), None).otherwise(b)


def keys(designations: Column) -> Column:
    """Base numbers of designations, ranges unfolded (up to WIDEST wide), each once, in order; pieces give none."""
    def one(d: Column) -> Column:
        lo, hi = F.regexp_extract(d, RANGE, 1).cast("int"), F.regexp_extract(d, RANGE, 2).cast("int")
        spread = F.transform(F.sequence(lo, F.least(hi, lo + WIDEST)), lambda n: n.cast("string"))
        single = F.when(~F.contains(d, F.lit(".")), F.array_compact(F.array(base_number(d)))).otherwise(F.array().cast("array<string>"))
        return F.when(d.rlike(RANGE) & (hi >= lo), spread).when(d.rlike(RANGE), F.array().cast("array<string>")).otherwise(single)

    return F.array_distinct(F.flatten(F.transform(F.coalesce(designations, F.array().cast("array<string>")), one)))


def normal(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \n\t\r]+", " ")))


def designates(designations: Column, number: Column) -> Column:
    """Whether the list designates a number: an empty list does, so does the number itself, and its base unless it is given as a piece."""
    return (F.size(designations) == 0) | F.coalesce(F.array_contains(designations, F.trim(number)), F.lit(False)) | F.coalesce(F.array_contains(keys(designations), base_number(number)), F.lit(False))


def classes(links: DataFrame, *carried: str) -> DataFrame:
    """(class, variant, text_id, articles, want, pieces, except, members): links alike in what they name; a class is known by its least link and a hash,
    members holds the different (link_id, *carried) of its links."""
    pieces = F.coalesce("pieces", F.array().cast("array<struct<piece:string,article:string,mark:string>>"))
    spared = F.coalesce("except", F.array().cast("array<struct<piece:string,mark:string>>"))
    x = links.select(
        "link_id", *carried, "text_id", "articles", normal(F.col("section")).alias("want"),
        F.transform(pieces, lambda p: F.struct(p["piece"].alias("piece"), p["article"].alias("article"), normal(p["mark"]).alias("mark"))).alias("pieces"),
        F.transform(spared, lambda e: F.struct(base_number(e["piece"]).alias("base"), normal(e["mark"]).alias("mark"))).alias("except"),
    )
    alike = ["text_id", "articles", "want", "pieces", "except"]
    g = x.groupBy(*alike).agg(F.min("link_id").alias("class"), F.collect_set(F.struct("link_id", *carried)).alias("members"))
    return cut(g.select("class", F.xxhash64(*alike).alias("variant"), *alike, "members"))


def members(cls: DataFrame) -> DataFrame:
    """(class, variant, link_id, ...): the links of each class."""
    return cls.select(*CLASS, F.explode("members").alias("m")).select(*CLASS, "m.*")


def _join_few(many: DataFrame, few: DataFrame, on: list[str], spread: str) -> DataFrame:
    """An equi-join whose result may be many times its inputs on one key: the small table is broadcast, or copied to SALTS tasks a key."""
    small = broadcast_if_small(few, BROADCAST_ROWS)
    if small is not few:
        return many.join(small, on)
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def expand(met: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of ``met`` (class, variant, article_id, ...) once for each row of ``of`` (class, variant, ...)."""
    return _join_few(met, of, CLASS, "article_id")


def met(cls: DataFrame, chunks: DataFrame) -> DataFrame:
    """(class, variant, article_id, stored_as): the chunks every class touches, each once, spread evenly over the tasks."""
    number, base = F.trim("number"), base_number(F.col("number"))
    c = chunks.select("article_id", F.col("law_id").alias("text_id"), number.alias("number"), base.alias("base"), normal(F.col("section")).alias("sec"), normal(F.col("content")).alias("body"))
    c = c.select("*", F.explode(F.array_compact(F.array(F.lit("a"), F.concat(F.lit("b"), "base"), F.concat(F.lit("n"), "number")))).alias("key"))
    tag = lambda t, k: F.transform(k, lambda n: F.concat(F.lit(t), n))
    named = F.when(F.size("articles") == 0, F.array(F.lit("a"))).otherwise(F.concat(tag("b", keys(F.col("articles"))), tag("n", F.col("articles"))))
    k = cls.select(*CLASS, "text_id", "want", "except", F.lit(None).cast("struct<piece:string,article:string,mark:string>").alias("p"), F.explode(F.array_distinct(named)).alias("key"))
    p = cls.select(*CLASS, "text_id", "want", "except", F.explode("pieces").alias("p")).withColumn("key", F.concat(F.lit("n"), "p.piece"))
    x = _join_few(c, k.unionByName(p).where("key is not null"), ["text_id", "key"], "article_id")
    spared = F.exists("except", lambda e: F.coalesce(e["base"] == F.col("base"), F.lit(False)) & F.contains(F.col("body"), e["mark"]))
    hit = F.when(F.col("p").isNull(), ~spared).otherwise(F.contains(F.col("body"), F.col("p.mark")))
    x = x.where(F.startswith(F.col("sec"), F.col("want")) & hit).select(*CLASS, "article_id", F.col("p").isNull().alias("named"), F.col("p.article").alias("article"))
    spark = chunks.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes here become many rows
    x = x.repartition(tasks, *CLASS, "article_id").groupBy(*CLASS, "article_id").agg(F.max("named").alias("n"), F.min("article").alias("s"))
    return x.select(*CLASS, "article_id", F.when(~F.col("n"), F.col("s")).alias("stored_as"))


def touches(links: DataFrame, chunks: DataFrame, *carried: str) -> DataFrame:
    """(link_id, article_id, stored_as, *carried): the chunks every link touches; stored_as is the article a chunk holds under another number."""
    cls = classes(links, *carried)
    return expand(met(cls, chunks), members(cls)).select("link_id", "article_id", "stored_as", *carried)


def to_read(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """(link_id, article_id): the chunks an exception or a stored piece of a link names, in its section."""
    cls = classes(links)
    c = chunks.select("article_id", F.col("law_id").alias("text_id"), F.trim("number").alias("number"), base_number(F.col("number")).alias("base"), normal(F.col("section")).alias("sec"), F.xxhash64(*chunks.columns).alias("row"))
    c = c.select("text_id", "article_id", "sec", "row", F.explode(F.array_compact(F.array(F.concat(F.lit("b"), "base"), F.concat(F.lit("n"), "number")))).alias("key"))
    key = F.concat(F.transform("except", lambda e: F.concat(F.lit("b"), e["base"])), F.transform("pieces", lambda p: F.concat(F.lit("n"), p["piece"])))
    k = cls.select(*CLASS, "text_id", "want", F.explode(F.array_distinct(key)).alias("key")).where("key is not null")
    x = _join_few(c, k, ["text_id", "key"], "article_id").where(F.startswith(F.col("sec"), F.col("want"))).select(*CLASS, "article_id", "row").distinct()
    return expand(x, members(cls)).select("link_id", "article_id")


def overtaken(links: DataFrame) -> DataFrame:
    """(link_id, by_link): for every link the last later one that ends all it touched (ties in day to the larger id)."""
    a = links.select("link_id", "text_id", "day", "section", "articles", keys(F.col("articles")).alias("k"))
    e = links.where(F.col("nature").isin(ENDS)).select(F.col("link_id").alias("by_link"), "text_id", F.col("day").alias("d"), F.col("section").alias("s"), F.col("articles").alias("ea"), keys(F.col("articles")).alias("ek"))
    covers = (F.size("ea") == 0) | ((F.size("articles") > 0) & (F.size(F.array_except("k", "ek")) == 0))
    x = a.join(e, "text_id").where((F.col("d") > F.col("day")) & (F.col("s").isNull() | F.col("s").eqNullSafe(F.col("section"))) & covers)
    return x.groupBy("link_id").agg(F.max(F.struct("d", "by_link")).alias("m")).select("link_id", F.col("m.by_link").alias("by_link"))


def current(touched: DataFrame, links: DataFrame) -> DataFrame:
    """The touching links of each chunk from its last repeal or replacement on: (article_id, link_id, nature, day, by_id, stored_as)."""
    x = touched.join(links.select("link_id", "nature", "day", "by_id"), "link_id")
    end = x.where(F.col("nature").isin(ENDS)).groupBy("article_id").agg(F.max("day").alias("end"))
    y = x.join(end, "article_id", "left").where("end is null or day >= end")
    return y.select("article_id", "link_id", "nature", "day", "by_id", "stored_as")


def strongest(rows: DataFrame, key: str) -> DataFrame:
    """(key, state): the nature that weighs most."""
    place = F.array_position(F.array(*map(F.lit, STRENGTH)), F.col("nature"))
    return rows.groupBy(key).agg(F.min_by("nature", F.when(place > 0, place)).alias("state"))


def strongest_states(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """(article_id, state): ``strongest`` of the ``current`` links of each chunk, from the last day of every nature in a class and not from every link."""
    cls = classes(links, "nature", "day")
    last = members(cls).groupBy(*CLASS, "nature").agg(F.max("day").alias("day"))
    ends = F.max(F.when(F.col("nature").isin(ENDS), F.col("day"))).alias("end")
    of = lambda n: F.col("nature") == n
    g = expand(met(cls, chunks), last).groupBy("article_id").agg(ends, *(a for n in STRENGTH for a in (F.max(of(n)).alias(f"has_{n}"), F.max(F.when(of(n), F.col("day"))).alias(f"day_{n}"))))
    holds = lambda n: F.col(f"has_{n}") & (F.col("end").isNull() | (F.col(f"day_{n}") >= F.col("end")))
    return g.select("article_id", F.coalesce(*(F.when(holds(n), n) for n in STRENGTH)).alias("state"))


def lines(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """(article_id, nature, by_id, first): every chunk a text touches in a nature once, with the least chunk it so touches."""
    cls = classes(links, "by_id", "nature")
    at = cut(met(cls, chunks))
    m = members(cls).select(*CLASS, "by_id", "nature").distinct()
    g = m.join(at.groupBy(*CLASS).agg(F.min("article_id").alias("first")), CLASS).groupBy("by_id", "nature").agg(F.min("first").alias("first"), F.count("*").alias("times"))
    # A line of one class has each chunk once; only lines of several classes need repeats taken out.
    x = cut(m.alias("m").join(g.alias("g"), F.col("m.by_id").eqNullSafe(F.col("g.by_id")) & F.col("m.nature").eqNullSafe(F.col("g.nature"))).select(*CLASS, "m.by_id", "m.nature", "first", "times"))
    rows = lambda y: expand(at, y.drop("times")).select("article_id", "nature", "by_id", "first")
    return rows(x.where("times = 1")).union(rows(x.where("times > 1")).distinct())


def changes_of_chunks(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """(article_id, change, first_day, links): the changes of a text that touch each chunk, numbered as in ``status``, and by how many links."""
    cls = classes(links, "by_id", "text_id")
    at = met(cls, chunks)
    m = members(cls).groupBy(*CLASS, "text_id", "by_id").agg(F.count("*").alias("links"))
    several = m.groupBy("text_id", "by_id").agg(F.count("*").alias("times"))
    st = status(links).where("way = 'changed by'").select(F.col("law_id").alias("text_id"), F.col("other_id").alias("by_id"), "change", "first_day")
    x = cut(m.join(several, ["text_id", "by_id"]).join(st, ["text_id", "by_id"]).select(*CLASS, "change", "first_day", "links", "times"))
    # An article of one text under a change of one class has one row; the others are added up.
    shared = chunks.groupBy("article_id").agg(F.count_distinct("law_id").alias("laws")).where("laws > 1").select("article_id", F.lit(True).alias("shared"))
    at = cut(at.join(shared, "article_id", "left").select(*CLASS, "article_id", "shared"))
    own, out = at.where("shared is null"), ["article_id", "change", "first_day", "links"]
    alone = expand(own, x.where("times = 1")).select(*out)
    added = expand(own, x.where("times > 1")).select(*out).union(expand(at.where("shared"), x).select(*out))
    return alone.union(added.groupBy("article_id", "change").agg(F.max("first_day").alias("first_day"), F.sum("links").alias("links")))


def both_ways(links: DataFrame) -> DataFrame:
    """(law_id, other_id, link_id, way, nature, day): every link from the text it touches and from the text that touches."""
    cols = ["link_id", "nature", "day"]
    one = links.select(F.col("text_id").alias("law_id"), F.col("by_id").alias("other_id"), *cols, F.lit("changed by").alias("way"))
    return one.union(links.where("by_id is not null and by_id <> text_id").select("by_id", "text_id", *cols, F.lit("changes")))


def status(links: DataFrame) -> DataFrame:
    """(law_id, change, other_id, way, first_day, natures, live): a text's counterparts in order of their first day, numbered c1, c2, ...; live is
    whether any of their links is not overtaken."""
    gone = overtaken(links).select("link_id", F.lit(True).alias("gone"))
    x = both_ways(links).join(gone, "link_id", "left")
    g = x.groupBy("law_id", "other_id", "way").agg(F.min("day").alias("first_day"), F.array_join(F.array_sort(F.collect_set("nature")), ",").alias("natures"), F.max(F.col("gone").isNull()).alias("live"))
    n = F.row_number().over(Window.partitionBy("law_id").orderBy("first_day", "other_id", "way"))
    return g.select("law_id", F.concat(F.lit("c"), n.cast("string")).alias("change"), "other_id", "way", "first_day", "natures", "live")
