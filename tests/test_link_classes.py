"""Links alike are judged once: what they touch, and what follows from it, against the links one by one."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tesselle.operators import links as K

LINK = "link_id int, text_id int, by_id int, nature string, day date, articles array<string>, section string, pieces array<struct<piece:string,article:string,mark:string>>, except array<struct<piece:string,mark:string>>"
CHUNK = "article_id int, law_id int, number string, section string, content string"


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(3)
    rows = [(i, r.choice([1, 1, 2]), r.randrange(40), r.choice([*K.STRENGTH, "other"]), r.choice([None, dt.date(2000 + r.randrange(9), 1, 1)]), r.choice([[], ["2", "4 à 6"], ["1er", "3.2"]]), r.choice([None, "Titre"]), r.choice([None, [("SECTION_1", "6", "a ")]]), r.choice([None, [("5", "sauf")]])) for i in range(150)]
    chunks = [(i, 1 + i % 2, r.choice([None, "1er", "2", "3.2", "5", "6.1", "SECTION_1"]), r.choice([None, "TITRE I"]), r.choice(["sauf a", "texte", None])) for i in range(60)]
    return spark.createDataFrame(rows, LINK), spark.createDataFrame([*chunks, (0, 2, "2", "TITRE I", "texte")], CHUNK)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_touches(spark):
    x = spark.createDataFrame([(i, 1, i, "amends", None, [], None, None, [("5", "sauf")]) for i in range(300)], LINK)
    c = spark.createDataFrame([(i, 1, str(i), None, "sauf") for i in range(300)], CHUNK)
    assert K.met(K.classes(x), c).count() == 299  # and not 300 times that
    assert K.touches(x, c).count() == 300 * 299


def test_to_read(many):
    x, c = many
    y = x.join(c.withColumnRenamed("law_id", "text_id").withColumnRenamed("section", "own"), "text_id").where(F.startswith(K.normal(F.col("own")), K.normal(F.col("section"))))
    named = "coalesce(exists(except, e -> e.piece = base), false) or coalesce(exists(pieces, p -> p.piece = trim(number)), false)"
    assert rows(K.to_read(x, c)) == rows(y.withColumn("base", K.base_number(F.col("number"))).where(named).select("link_id", "article_id"))


def test_lines(many):
    x, c = many
    t = K.touches(x, c).join(x.select("link_id", "by_id", "nature"), "link_id").select("article_id", "nature", "by_id").distinct()
    first = t.groupBy("nature", "by_id").agg(F.min("article_id").alias("first"))
    assert rows(K.lines(x, c)) == rows(t.join(first, ["nature", "by_id"]).select("article_id", "nature", "by_id", "first"))


def test_strongest_states(many):
    x, c = many
    assert rows(K.strongest_states(x, c)) == rows(K.strongest(K.current(K.touches(x, c), x), "article_id"))


def test_changes_of_chunks(many):
    x, c = many
    t = K.touches(x, c).join(x.select("link_id", F.col("by_id").alias("other_id"), F.col("text_id").alias("law_id")), "link_id")
    st = K.status(x).where("way = 'changed by'")
    want = t.join(st, ["law_id", "other_id"]).groupBy("article_id", "change").agg(F.max("first_day").alias("first_day"), F.count("*").alias("links"))
    assert rows(K.changes_of_chunks(x, c)) == rows(want)
