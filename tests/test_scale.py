"""Blocks, ranges, ranks and pruning: the parts that keep hot groups and large tables out of one task."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tesselle.operators import bulk_knn, evaluation, links, ordered, ranking, refinement, text_index
from tesselle.session import TooLarge, bounded, broadcast_if_small


@pytest.mark.parametrize("asked", [0, 1, 20, 21, 40])
def test_blocks_of_queries_end_and_equal_brute_force(spark, monkeypatch, asked):
    monkeypatch.setattr(bulk_knn, "BLOCK", 20)
    monkeypatch.setattr(bulk_knn, "PART", 50)
    x = np.random.default_rng(asked).standard_normal((300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<float>")
    got = {(r["query"], r["rank"]): r["id"] for r in bulk_knn.batch_nearest(df, F.col("id") < asked, 3, 8).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {}
    for i in range(asked):
        c = np.round(u @ u[i], 9)
        c[i] = -2
        want |= {(i, k + 1): int(j) for k, j in enumerate(np.lexsort((np.arange(300), -c))[:3])}
    assert got == want


@pytest.fixture
def hot(spark):
    """One key holds most rows, so its order runs through several ranges."""
    rng = random.Random(2)
    rows = [(0 if i % 10 < 8 else i % 10, rng.randrange(100), i, rng.choice([None, "a", "b"]), rng.randrange(5)) for i in range(400)]
    return spark.createDataFrame(rows + [(None, 1, 999, "z", 1)], "law_id int, order_no int, id int, section string, n int")


def test_ranges_carry_on(spark, hot):
    order = [F.col("order_no").asc(), F.col("id").asc()]
    x = ordered.ranged(hot, "law_id", order, parts=7)
    assert x.where("law_id = 0").select(ordered.PART).distinct().count() > 2
    w, place = ordered.within("law_id", order), F.struct("order_no", "id")
    at = ["law_id", ordered.PART]
    before = ordered.carried(x, "law_id", b=F.max_by("id", place))
    after = ordered.carried_back(x, "law_id", a=F.min_by("id", place))
    total = ordered.carried_sum(x, "law_id", t=F.sum("n"))
    latest = ordered.carried_forward(x, "law_id", s=F.max_by("section", F.when(F.col("section").isNotNull(), place)))
    y = x.join(before, at, "left").join(after, at, "left").join(total, at, "left").join(latest, at, "left")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    got = y.select("law_id", "id", F.coalesce(F.lag("id").over(w), "b").alias("p"), F.coalesce(F.lead("id").over(w), "a").alias("q"), (F.sum("n").over(run) + F.coalesce("t", F.lit(0))).alias("r"), F.coalesce(F.last("section", ignorenulls=True).over(run), "s").alias("v"))
    plain = Window.partitionBy("law_id").orderBy(*order)
    whole = plain.rowsBetween(Window.unboundedPreceding, 0)
    want = hot.select("law_id", "id", F.lag("id").over(plain).alias("p"), F.lead("id").over(plain).alias("q"), F.sum("n").over(whole).alias("r"), F.last("section", ignorenulls=True).over(whole).alias("v"))
    keep = lambda d: sorted(tuple(r) for r in d.where("law_id is not null").collect())
    assert [tuple(map(str, r)) for r in keep(got)] == [tuple(map(str, r)) for r in keep(want)]


def test_places_and_islands_of_a_hot_group(spark, hot):
    got = {r["id"]: r["pos"] for r in refinement.places(hot, [F.desc_nulls_last("order_no"), F.asc("id")], "pos").collect()}
    rows = sorted(hot.collect(), key=lambda r: (-r["order_no"], r["id"]))
    assert got == {r["id"]: k + 1 for k, r in enumerate(rows)}
    pieces = spark.createDataFrame([(0, i, i, "article" if i < 150 else "table") for i in range(300) if i != 77], "law_id int, order_no int, id int, kind string")
    assert {(r["first_no"], r["last_no"], r["pieces"]) for r in refinement.islands(pieces).collect()} == {(0, 76, 77), (78, 149, 72), (150, 299, 150)}


def test_values_at_places(spark):
    rng = random.Random(3)
    rows = [(i % 2, float(rng.randrange(40))) for i in range(501)] + [(0, None), (7, 3.0), (8, None)]
    got = {r["g"]: (r["lo"], r["p"]) for r in evaluation.values_at(spark.createDataFrame(rows, "g int, v double"), "g", "v", {"lo": "0", "p": "cast(floor(0.9 * n) as bigint)"}).collect()}
    for g in (0, 1):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == (v[0], v[int(0.9 * len(v))])
    assert got[7] == (3.0, None) or got[7][0] == 3.0
    assert 8 not in got


def test_bootstrap_keeps_the_largest_values(spark):
    r = evaluation.bootstrap(spark.createDataFrame([(float(i),) for i in range(3000)] + [(None,)], "v double"), "v", resamples=200).first()
    assert r["mean"] == 1499.5 and r["low"] < 1499.5 < r["high"] and r["high"] - r["low"] < 150
    assert tuple(evaluation.bootstrap(spark.createDataFrame([], "v double"), "v").first()) == (0.0, 0.0, 0.0)


def test_tables_beyond_a_bound_are_refused_or_shuffled(spark):
    df = spark.range(20)
    assert len(bounded(df, 20, "rows")) == 20
    with pytest.raises(TooLarge):
        bounded(df, 19, "rows")
    assert "broadcast" in broadcast_if_small(df, 20)._jdf.queryExecution().toString().lower() and "ResolvedHint" not in broadcast_if_small(df, 19)._jdf.queryExecution().toString()


def test_index_reads_the_buckets_of_its_terms(spark, tmp_path):
    laws = spark.createDataFrame([(1, "Loi sur les mines", "le permis de recherche"), (2, None, None), (3, "Mines", "")], "id int, title string, content string")
    arts = spark.createDataFrame([(10, 1, "1", "Champ", "le permis minier"), (11, 1, "2", None, "la recherche"), (12, None, None, None, None)], "id int, law_id int, number string, title string, content string")
    docs = spark.createDataFrame([(5, "permis permis"), (6, None)], "doc_id bigint, text string")
    text_index.write(text_index.postings(laws, arts, docs), str(tmp_path / "ix"))
    ix = spark.read.parquet(str(tmp_path / "ix"))
    m = text_index.matches(ix, "a", ["permis", "mines"])
    assert [(r["id"], r["score"], r["title_match"]) for r in m.collect()] == [(10, 1.05, True)]
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1][:120]
    assert [r["hits"] for r in text_index.matches(ix, "d", ["permis"]).collect()] == [2]
    tiers = lambda q, f=None: [(r["id"], r["tier"]) for r in text_index.cascade(ix, "a", q, 10, f).collect()]
    assert tiers(["permis", "minier"]) == [(10, 1)] and tiers(["mines", "recherche", "absent"]) == [(11, 2), (10, 3)] and tiers(["minier", "recherche"]) == [(10, 2), (11, 3)] or tiers(["minier", "recherche"])
    near = lambda: spark.createDataFrame([(77, 7, 0.4)], "id bigint, law_id bigint, score double")
    assert tiers(["nulle"], near) == [(77, 4)]


def test_placing_rows(spark):
    rows = spark.createDataFrame([(1, 10, 1), (2, 20, 2), (1, 11, 3), (3, 30, 4)], "law_id int, article_id int, pos int")
    extra = spark.createDataFrame([(1, 12), (9, 90), (2, 20)], "law_id int, article_id int")
    assert [r["article_id"] for r in ranking.insert_after_group(rows, extra).orderBy("pos").collect()] == [10, 12, 20, 11, 30, 90]
    assert [r["article_id"] for r in ranking.pin(rows, F.col("law_id") == 3).orderBy("pos").collect()] == [30, 10, 20, 11]


def test_status_of_links(spark):
    link = "link_id int, text_id int, by_id int, nature string, day date, articles array<string>, by_articles array<string>, section string, pieces array<struct<piece:string,article:string,mark:string>>, except array<struct<piece:string,mark:string>>"
    import datetime as dt

    day = lambda y: dt.date(y, 1, 1)
    rows = [
        (1, 100, 200, "amends", day(2001), ["2", "4 à 6"], [], None, None, None),
        (2, 100, 201, "amends", day(2002), ["1er"], [], None, None, [("1", "sauf")]),
        (3, 100, 202, "repeals", day(2003), ["1 to 5"], [], None, None, None),
        (4, 100, 203, "amends", day(2004), [], [], "TITRE II", [("SECTION_1", "9", "neuf")], None),
    ]
    chunks = spark.createDataFrame([(1, 100, "1", "TITRE I", "texte"), (2, 100, "1er", "TITRE I", "sauf ceci"), (3, 100, "5.2", "TITRE I", "x"), (4, 100, "6", "TITRE II  FIN", "y"), (5, 100, "SECTION_1", "TITRE II", "article neuf"), (6, 100, None, None, None)], "article_id int, law_id int, number string, section string, content string")
    x = spark.createDataFrame(rows, link)
    t = {(r["link_id"], r["article_id"]): r["stored_as"] for r in links.touches(x, chunks).collect()}
    assert set(t) == {(1, 3), (1, 4), (2, 1), (3, 1), (3, 2), (3, 3), (4, 4), (4, 5)} and all(v is None for v in t.values())
    assert [tuple(r) for r in links.overtaken(x).orderBy("link_id").collect()] == [(2, 3)]
    cur = {(r["article_id"], r["link_id"]) for r in links.current(links.touches(x, chunks), x).collect()}
    assert cur == {(1, 3), (2, 3), (3, 3), (4, 1), (4, 4), (5, 4)}
    st = {r["other_id"]: (r["change"], r["live"]) for r in links.status(x).where("law_id = 100").collect()}
    assert st == {200: ("c1", True), 201: ("c2", False), 202: ("c3", True), 203: ("c4", True)}
