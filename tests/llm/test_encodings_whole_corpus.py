"""The encodings' classifier learns from every text, not from some of them."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tesselle.llm import encodings as E


def test_trained_on_every_text(spark):
    lexicon = "école été époque élève état étude épine préfet délivre régie à où là décision".split()
    texts = [f"{i} {lexicon[i % 14]} {lexicon[i % 13]}, {lexicon[i % 11]}" for i in range(13000)]
    town = [f"le bourg de Úpice {i}" for i in range(3)]
    spoilt = E.spoil("une décision de l'état", "utf8>cp1252")
    odd = [None, "", "plain", texts[0], town[0], spoilt]
    df = spark.createDataFrame(list(enumerate(texts + town + odd)), "doc_id bigint, text string").repartition(5)
    model, whole = E.train(df), E.fit(sorted({t for t in texts + town + odd if t}))
    assert (model.weights == whole.weights).all() and (model.table == whole.table).all()
    for w in [*lexicon, "Úpice", *spoilt.split(), "époque,"]:
        assert model.judge(w) == whole.judge(w)
        assert all(model.better(w, c) == whole.better(w, c) for c in E.NAMES[1:])
    # Three texts of 13,000 attest a word that the weights alone would restore; two don't.
    assert model.judge("Úpice") == ("clean", None)
    assert E.Model(model.weights, model.table, {}).judge("Úpice")[1] == "épice"
    assert {r[0] for r in E.found(df).collect()} == {len(texts) + len(town) + len(odd) - 1}
    fewer = df.where(f"doc_id not in ({len(texts)}, {len(texts) + len(town) + 4})")
    assert E.train(fewer).judge("Úpice")[1] == "épice"


def test_partitions_and_flushes_make_no_difference(spark, monkeypatch):
    texts = [f"{i} l'été, à la régie{'é' * (i % 50)} de Zürich" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    one = E.train(df.coalesce(1))
    many = E.train(df.repartition(9))
    assert (one.weights == many.weights).all() and (one.table == many.table).all() and (one.refused == many.refused).all()
    bags = pa.RecordBatch.from_arrays([pa.array([" ".join(set(E.TOKEN.findall(t))) for t in texts])], names=["words"])

    def counts():
        total = Counter()
        for b in E._count(SimpleNamespace(value=None))(iter([bags.slice(i, 40) for i in range(0, 400, 40)])):
            for r in b.to_pylist():
                total[r["bare"], r["word"]] += r["n"]
        return total

    whole = counts()
    monkeypatch.setattr(E, "HELD", 20)
    assert whole and counts() == whole


def test_no_text(spark):
    m = E.train(spark.createDataFrame([(1, None), (2, "plain")], "doc_id bigint, text string"))
    assert len(m.refused) == 0 and np.isfinite(m.weights).all()
