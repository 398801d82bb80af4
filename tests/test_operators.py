"""Operators on small fixtures: hand-computed values, empty input, nulls and ties."""

import math

from pyspark.sql import functions as F

from tesselle.functions import text, vectors
from tesselle.operators import etl, evaluation, refinement, relations, search
from tesselle.operators.bulk_knn import batch_nearest
from tesselle.operators.components import components
from tesselle.streaming import windows


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def test_text_functions(spark):
    x = F.col("x")
    assert one(spark, text.fold(x), "Élève Ñandú") == "eleve nandu"
    assert one(spark, text.words(x), "L'été n° 5") == ["l", "ete", "n", "5"]
    assert one(spark, text.content_words(x), "La pension de la retraite, pension") == ["pension", "retraite"]
    assert one(spark, text.trigrams(x), "cat") == ["  c", " ca", "cat", "at "]
    assert one(spark, text.jaccard(text.words(x), F.array().cast("array<string>")), "a") == 0.0
    assert one(spark, text.quality_score(x), "short") == 0.0
    assert one(spark, text.article_number(x), "Article premier.") == "1"
    assert one(spark, text.base_number(x), "SECTION_2") is None
    assert one(spark, text.word_shingles(x), "one two") == []
    assert one(spark, text.fold(x), None) is None


def test_vector_functions(spark):
    x = F.col("x")
    assert one(spark, vectors.norm(x), [3.0, 4.0], "array<float>") == 5.0
    assert one(spark, vectors.normalize(x), [0.0, 0.0], "array<float>") == [0.0, 0.0]
    assert one(spark, vectors.cosine(x, F.array(F.lit(0.0), F.lit(0.0))), [1.0, 0.0], "array<float>") == 0.0
    assert not one(spark, vectors.usable(x, 2), [math.nan, 1.0], "array<float>")


def test_components_chain_star_and_empty(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(2, 30)] + [(5, 5), (7, 1), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[k] for k in range(100, 141)} == {100} and {got[k] for k in range(1, 30)} == {1}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_rrf_and_min_max(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id int, rank int")
    got = {r["id"]: r["score"] for r in search.rrf(a, b, "id").collect()}
    assert math.isclose(got[2], 0.4 / 62 + 0.6 / 61) and math.isclose(got[1], 0.4 / 61)
    flat = search.min_max(spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, score double"), "score")
    assert {r["score"] for r in flat.collect()} == {1.0}


def test_first_pass_and_page(spark):
    none, some = spark.createDataFrame([], "id int"), spark.createDataFrame([(4,), (5,), (6,)], "id int")
    assert {(r["id"], r["pass"]) for r in refinement.first_pass([none, some]).collect()} == {(4, 2), (5, 2), (6, 2)}
    assert [(r["id"], r["total"]) for r in refinement.page(some, [F.asc("id")], 1, 1).collect()] == [(5, 3)]


def test_chunks_lose_no_text(spark):
    t = "Préambule.\nArticle 1. - Un texte.\nArticle 2 : Autre texte\nsur deux lignes."
    rows = etl.chunk_articles(spark.createDataFrame([(1, t), (2, "Sans titre.\n\nSuite."), (3, None), (4, "")], "id int, t string"), "id", "t").collect()
    assert [(r["number"], r["content"]) for r in rows if r["id"] == 1] == [("PREAMBULE", "Préambule."), ("1", "Un texte."), ("2", "Autre texte\nsur deux lignes.")]
    assert [r["number"] for r in rows if r["id"] == 2] == ["PARA_1", "PARA_2"]


def test_mentions_unfold_ranges(spark):
    d = spark.createDataFrame([(1, "articles 3 à 5 et article 9")], "id int, t string")
    assert {r["number"] for r in etl.mentions(d, "id", "t").collect()} == {3, 4, 5, 9}


def test_superseding(spark):
    links = spark.createDataFrame([(1, 7, "amends", "2000-01-01"), (2, 7, "repeals", "2001-01-01"), (3, 7, "amends", "2002-01-01"), (4, 8, "amends", "2000-01-01")], "link_id int, text_id int, nature string, day string")
    assert [(r["link_id"], r["by"]) for r in relations.superseding(links, ["repeals"]).collect()] == [(1, 2)]


def test_metrics_and_bootstrap(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, None)], "question int, rank int")
    assert {r["k"]: round(r["recall"], 4) for r in evaluation.recall_at(ranks, [1, 5]).collect()} == {1: 0.3333, 5: 0.6667}
    assert math.isclose(evaluation.mrr(ranks, 10).first()["mrr"], (1 + 0.25) / 3)
    assert evaluation.recall_at(ranks.limit(0), [1]).first()["recall"] == 0.0
    r = evaluation.bootstrap(spark.createDataFrame([(float(i % 2),) for i in range(200)], "v double"), "v").first()
    assert r["low"] < 0.5 < r["high"] and r["mean"] == 0.5


def test_batch_nearest_ties_and_bad_vectors(spark):
    v = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, [math.nan, 1.0]), (7, None)]
    got = batch_nearest(spark.createDataFrame(v, "id int, embedding array<float>"), F.col("id") == 1, 2, 2).collect()
    assert [(r["id"], r["similarity"]) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 1.0), (3, 1.0)]


def test_rate_limiter(spark):
    e = spark.createDataFrame([(i, 1, f"2024-01-01 00:{i:02d}:00") for i in range(8)] + [(9, 1, "2024-01-01 02:00:00")], "event_id bigint, user_id bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["event_id"]: r["admitted"] for r in windows.replay_limiter(e, limit=3).collect()}
    assert [k for k, ok in got.items() if ok] == [0, 1, 2, 9]


def test_filters_reach_the_scan(spark, sf):
    from tesselle.plans import registry

    plan = registry.queries()["law_filter_conjunctive"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(language,fr)" in plan and "content" not in plan


def test_sources(spark, tmp_path):
    import numpy as np

    from tesselle.sources import tables as T

    (tmp_path / "j.jsonl").write_text('{"id": 1, "line": 1, "verdict": "a"}\n{"id": 1, "line": 2, "verdict": "b"}\n{"id": 2, "li')
    j = T.json_lines(spark, str(tmp_path / "j.jsonl"), "id int, line int, verdict string").where("id is not null")
    assert [(r["id"], r["verdict"]) for r in T.latest_verdicts(j).collect()] == [(1, "b")]
    (tmp_path / "i.json").write_text('[{"doc_id": "7", "path": "x.pdf", "title": "T", "sha256": "s", "reference": "r"}]')
    assert T.json_index(spark, str(tmp_path / "i.json")).first()["path"] == "x.pdf"
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.pdf").write_bytes(b"%PDF-1.4")
    assert T.binary_files(spark, str(tmp_path / "b")).first()["type"] == "pdf"
    np.savez(tmp_path / "v.npz", ids=np.array([1, 2, 3, 3]), vectors=np.array([[1, 0], [3, 0], [0, 1], [0, 1]], np.float32))
    assert {(r["id"], r["reason"]) for r in T.vector_batches(spark, str(tmp_path), 2).collect()} == {(1, None), (2, "norm"), (3, "seen twice")}
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    T.replace_partitions(df, str(tmp_path / "p"), "k")
    T.replace_partitions(spark.createDataFrame([(1, "z")], "k int, v string"), str(tmp_path / "p"), "k")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, "z"), (2, "b")}
    T.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    T.append_events(spark.createDataFrame([("q" * 900,)], "query string"), str(tmp_path / "e"))
    assert len(spark.read.parquet(str(tmp_path / "e")).first()["query"]) == 500
