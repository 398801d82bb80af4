"""Sinks that change tables, and files to texts."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tesselle.sources import documents as D
from tesselle.sources import sinks as S


def rows(spark, path):
    return {tuple(r) for r in spark.read.parquet(path).collect()}


def test_upsert_expiry_and_purge(spark, tmp_path):
    p, t = str(tmp_path / "cache"), lambda x: F.lit(x).cast("timestamp")
    S.upsert_with_expiry(spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "0")], "key string, payload string"), p, t("2024-01-01 00:00:00"), 60)
    S.upsert_with_expiry(spark.createDataFrame([("a", "2")], "key string, payload string"), p, t("2024-01-01 00:01:30"), 60)
    assert {r["key"]: r["payload"] for r in S.alive(spark, p, t("2024-01-01 00:00:30")).collect()} == {"a": "2", "b": "1"}
    assert S.purge(spark, [p], t("2024-01-01 00:01:00")) == 1 and S.purge(spark, [p], t("2024-01-01 00:01:00")) == 0
    assert {r["key"] for r in spark.read.parquet(p).collect()} == {"a"}


def test_replace_and_sync(spark, tmp_path):
    p = str(tmp_path / "t")
    make = lambda x: spark.createDataFrame(x, "k int, v string")
    S.replace_for(make([(1, "a"), (1, "b"), (2, "c")]), p, "k")
    S.replace_for(make([(1, "z")]), p, "k")
    assert rows(spark, p) == {(1, "z"), (2, "c")}
    assert S.sync(make([(1, "z"), (3, None)]), p, "k", ["v"]) == {"inserted": 1, "changed": 0, "removed": 1}
    assert S.sync(make([(1, None), (3, None)]), p, "k", ["v"]) == {"inserted": 0, "changed": 1, "removed": 0}
    assert S.sync(make([(1, None), (3, None)]), p, "k", ["v"]) == {"inserted": 0, "changed": 0, "removed": 0} and rows(spark, p) == {(1, None), (3, None)}


def test_vectors_are_loaded_only_for_their_text(spark, tmp_path):
    import hashlib

    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    a = spark.createDataFrame([(1, True, "x"), (2, True, "new"), (3, False, "y"), (5, True, "z"), (6, True, "n")], "id int, embed boolean, content string")
    b = spark.createDataFrame([(1, [1.0, 0.0], h("x")), (2, [1.0, 0.0], h("old")), (3, [1.0, 0.0], h("y")), (4, [1.0, 0.0], h("q")), (5, [1.0], h("z")), (6, [3.0, 0.0], h("n")), (7, [1.0, 0.0], "h"), (7, [1.0, 0.0], "h")], "id int, vector array<float>, text_hash string")
    got = S.load_vectors(b, a, str(tmp_path / "v"), 2, "m/1")
    assert got == {"written": 1, "changed": 1, "not embeddable": 1, "unknown": 1, "dimension": 1, "norm": 1, "seen twice": 2}
    assert [(r["id"], r["model"]) for r in spark.read.parquet(str(tmp_path / "v")).collect()] == [(1, "m/1")]


def test_copy_and_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    assert S.copy_file(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")) and not S.copy_file(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt"))
    assert (tmp_path / "b.txt").read_text() == "hello" and not list(tmp_path.glob("*.part-*"))
    S.write_documents(spark.createDataFrame([(1, "é")], "id int, t string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()["value"] == '{"id":1,"t":"é"}'


@pytest.fixture
def folder(tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
        f.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + p("Article 1er") + p("Un texte assez long pour passer la longueur la plus petite.") + "</w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(z.getvalue())
    (tmp_path / "b.docx").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "c.txt").write_text("<<PAGE:2>>\nUn texte assez long pour passer.\n<<PAGE:3>>\n\n<<PAGE:4>>\nQuatre.")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4")
    return str(tmp_path)


def test_files_to_texts_and_pages(spark, folder):
    got = {r["path"].rsplit("/", 1)[1]: r for r in D.texts(spark, folder).collect()}
    assert got["a.docx"]["text"] == "Article 1er\nUn texte assez long pour passer la longueur la plus petite." and got["b.docx"]["error"] == "BadZipFile" and got["d.pdf"]["error"] == "no reader for pdf"
    docs = spark.createDataFrame([(1, got["c.txt"]["text"]), (2, "sans marque"), (3, None)], "id int, t string")
    p = D.pages(docs, "id", "t")
    assert {tuple(r) for r in p.collect()} == {(1, 2, "Un texte assez long pour passer."), (1, 4, "Quatre."), (2, 1, "sans marque")}
    wanted = spark.createDataFrame([(1, 4), (2, 1), (9, 0)], "id int, n_pages int")
    assert {r["id"]: r["failed"] for r in D.failed_pages(p, "id", wanted).collect()} == {1: [1, 3], 2: [], 9: []}
    res = spark.createDataFrame([(1, 1, False), (1, 1, True), (1, 2, False), (1, 3, True)], "doc_id int, page int, ok boolean")
    inv = D.inventory(res, spark.createDataFrame([(1, 5), (2, 2)], "doc_id int, n_pages int")).collect()
    assert {(r["doc_id"], r["done"], r["failed"], r["remaining"]) for r in inv} == {(1, 2, 1, 2), (2, 0, 0, 2)}
