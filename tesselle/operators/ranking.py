"""Re-ranking, grouping and placing of retrieved rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselle.functions import legal, text

# Weights of the lexical features, and the penalties.
FEATURES = {"fusion": 1.0, "article": 0.80, "density": 0.40, "phrase": 0.35, "law_title": 0.25, "section": 0.15}
PENALTY_BOILERPLATE, PENALTY_SHORT, SHORT_CHARS = 0.25, 0.10, 80
BOILERPLATE = r"(?:sera (?:enregistr|publi)|abroge|repealed|shall be published|takes effect|official gazette|journal officiel)"


def phrase_share(question: Column, content: Column) -> Column:
    """1 where the folded question stands in the folded content, else the share of its pairs of neighbouring words (over two letters) that do."""
    w = F.filter(F.split(question, r"[ ]+"), lambda x: F.length(x) > 2)
    pairs = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
    hits = F.size(F.filter(pairs, lambda p: F.contains(content, p)))
    return F.when((question == "") | (content == ""), 0.0).when(F.contains(content, question), 1.0).when(F.size(w) < 2, 0.0).otherwise(hits / F.size(pairs))


def features(question: str, article: str | None = None) -> Column:
    """The raw score of a row (relevance_score, number, content, law_title, reference, section) against a question."""
    q, asked = text.fold(F.lit(question)), text.content_words(F.lit(question))
    content = text.fold(F.coalesce("content", F.lit("")))
    density = F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, text.content_words(F.coalesce("content", F.lit(""))))) / F.size(asked))
    out = FEATURES["fusion"] * F.coalesce("relevance_score", F.lit(0.0))
    if article:
        out = out + F.when(legal.number_form(F.col("number")) == article, FEATURES["article"]).otherwise(0.0)
    out = out + FEATURES["density"] * density + FEATURES["phrase"] * phrase_share(q, content)
    out = out + FEATURES["law_title"] * text.jaccard(asked, text.content_words(F.concat_ws(" ", "law_title", "reference")))
    out = out + FEATURES["section"] * text.jaccard(asked, text.content_words(F.coalesce("section", F.lit(""))))
    return out - F.when(content.rlike(BOILERPLATE), PENALTY_BOILERPLATE).when(F.length(content) < SHORT_CHARS, PENALTY_SHORT).otherwise(0.0)


def rerank(rows: DataFrame, question: str, article: str | None = None, position: str = "pos") -> DataFrame:
    """The rows of a bounded batch with rerank_score spread over 0..1 (all 1 without a span) and new_pos; equal scores keep their order."""
    whole = Window.partitionBy()
    x = rows.withColumn("raw", F.round(features(question, article), 9))
    x = x.withColumns({"lo": F.min("raw").over(whole), "hi": F.max("raw").over(whole)})
    score = F.when(F.col("hi") - F.col("lo") < 1e-9, 1.0).otherwise((F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return x.withColumns({"rerank_score": score, "new_pos": F.row_number().over(Window.orderBy(F.desc("raw"), position))}).drop("lo", "hi", "raw")


def max_normalised(rows: DataFrame, column: str) -> DataFrame:
    """The column as a share of its maximum (at least .001), at most 1; null is 0."""
    top = rows.agg(F.greatest(F.max(column), F.lit(0.001)).alias("_top"))
    return rows.join(F.broadcast(top)).withColumn(column, F.least(F.coalesce(F.col(column), F.lit(0.0)) / F.col("_top"), F.lit(1.0))).drop("_top")  # one row


def blend(stage: str, model: str, share: float = 0.5) -> Column:
    """(1 - share) of the first score and share of a model's score out of ten; the first alone where the model gave none."""
    return F.when(F.col(model).isNull(), F.col(stage)).otherwise((1 - share) * F.col(stage) + share * F.least(F.greatest(F.col(model), F.lit(0.0)), F.lit(10.0)) / 10)


def to_documents(hits: DataFrame, matched: int = 3) -> DataFrame:
    """(law_id, article_id, score, scope, articles, pos): one row a law in the order title first, then score, then place.

    hits: law_id, article_id (null for a hit on the law itself), number, score, scope (title or body), pos. The first hit of a law is its best; one hit
    on the title makes the law a title hit with the higher of the scores, the article keeps the extract; of the first ``matched`` hits those with a real number are its articles."""
    w = Window.partitionBy("law_id").orderBy("pos")
    x = hits.withColumn("k", F.row_number().over(w))
    real = (F.col("k") <= matched) & F.col("article_id").isNotNull() & F.col("number").isNotNull() & (F.col("number") != "") & ~legal.is_pseudo_number(F.col("number"))
    g = x.groupBy("law_id").agg(
        F.coalesce(F.min_by("article_id", F.when(F.col("article_id").isNotNull(), F.col("k"))), F.lit(None)).alias("article_id"),
        F.max(F.when((F.col("k") == 1) | (F.col("scope") == "title"), F.col("score"))).alias("score"),
        F.max(F.col("scope") == "title").alias("t"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(real, F.struct("k", "article_id")))), lambda r: r["article_id"].cast("string")), ",").alias("articles"),
        F.min("pos").alias("first"),
    )
    pos = F.row_number().over(Window.orderBy(F.desc("t"), F.desc("score"), "first"))
    return g.select("law_id", "article_id", "score", F.when(F.col("t"), "title").otherwise("body").alias("scope"), "articles", pos.alias("pos"))


def typed_key(kind: str, column: str) -> Column:
    """A key in which an article and a law of one number differ."""
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def insert_after_group(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """(law_id, article_id, pos): the extra rows (law_id, article_id) placed right after the last row of their law that stands before another law's, a law without a row at the end."""
    w = Window.orderBy("pos")
    x = rows.withColumn("g", F.sum((F.lag("law_id").over(w) != F.col("law_id")).cast("int")).over(w)).withColumn("g", F.coalesce("g", F.lit(0)))
    first = x.groupBy("law_id").agg(F.min("g").alias("g")).join(x, ["law_id", "g"]).groupBy("law_id").agg(F.max("pos").alias("at"))
    add = extra.join(rows.select("article_id"), "article_id", "left_anti").join(first, "law_id", "left").select("law_id", "article_id", F.coalesce("at", F.lit(1 << 30)).alias("pos"), F.lit(1).alias("side"))
    both = rows.select("law_id", "article_id", "pos", F.lit(0).alias("side")).union(add)
    return both.select("law_id", "article_id", F.row_number().over(Window.orderBy("pos", "side", "article_id")).alias("pos"))


def pin(rows: DataFrame, wanted: Column, position: str = "pos") -> DataFrame:
    """The first row that meets ``wanted`` moved to the front, the others in their order."""
    w = Window.orderBy(position)
    x = rows.withColumn("_hit", wanted).withColumn("_n", F.sum(F.col("_hit").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn(position, F.row_number().over(Window.orderBy(F.when(F.col("_hit") & (F.col("_n") == 1), 0).otherwise(1), position))).drop("_hit", "_n")
