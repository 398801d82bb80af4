"""Sentences, passages, snippets and batches on small texts."""

import random

import pytest

from tesselle.plans import answers as A


def test_sentences_keep_abbreviations():
    assert A.sentences("Voir art. 39 et al. 3. M. Dupont signe ! Fin\nNouvelle ligne. 12.\n\n") == ["Voir art. 39 et al. 3.", "M. Dupont signe !", "Fin", "Nouvelle ligne. 12."]
    assert A.sentences(None) == [] and A.sentences("...") == []


def test_passages_with_elisions():
    body = "Le préfet délivre le permis, après avis du conseil ; il en informe le maire."
    assert A.passage_stands("le PREFET délivre […] informe le maire", body) and not A.passage_stands("informe le maire [...] le préfet", body)
    assert not A.passage_stands("", body) and not A.passage_stands("permi", body)


def brute(body, query, width):
    import re

    roots = A.stems(query)
    hits = [(m.start(), m.end(), m.lastindex) for m in re.finditer(r"(?<!\w)(?:" + "|".join(f"({r})" for r in roots) + r")\w*", body)]
    best = (-1, -1), 0
    for b, _, _ in hits:
        start = max(0, b - width // 5)
        inside = [h for h in hits if h[0] >= start and h[1] <= start + width]
        best = max(best, ((len({h[2] for h in inside}), len(inside)), -start), key=lambda x: x[0])
    return best[0]


def test_snippet_window_is_the_best():
    rng = random.Random(3)
    for _ in range(100):
        body = " ".join(rng.choice(["licence", "pilote", "mot", "zone", "texte"]) for _ in range(300))
        got = A.snippet(body, "licence pilote", 120)
        most = brute(body, "licence pilote", 120)
        marks = got.count("<mark>")
        assert most[1] - 2 <= marks <= most[1] and (most[0] < 2 or "<mark>licence" in got and "<mark>pilote" in got)
    assert A.snippet("rien", "licence") is None and A.snippet(None, "licence") is None and A.snippet("x", "le 12 -mot") is None
    assert A.snippet("Les Licenciements abusifs", "licenciement") == "Les <mark>Licenciements</mark> abusifs"


def test_batches():
    assert A.batches([], 5) == [] and A.batches([5], 5) == [[0]]
    with pytest.raises(ValueError):
        A.batches([6], 5)
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 15))]
        got = A.batches(sizes, 6)
        assert [i for b in got for i in b] == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 6 for b in got)
