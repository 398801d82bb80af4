"""The training-data operators on small fixtures: brute force, round trips, held-out cases, and awkward input."""

import collections
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselle.llm import conversations, encodings, languages, leakage, mixing, near_duplicates, pages, quality, queries, scan_noise, subjects, vector_forest
from tesselle.llm.quality_holdout import HOLDOUT
from tesselle.session import table

ARTICLE = "id int, content string, id2 int, a string, b string"
FR = "le conseil communal de la ville délivre le permis de construire après avis du préfet et sans préjudice des recours prévus par la loi pour une durée de dix mois au plus tard"
EN = "the town council delivers the building permit upon the opinion of the prefect and without prejudice to the appeals that are provided by the law for a term of ten months"
DE = "der gemeinderat erteilt die genehmigung nach anhörung des ausschusses und ohne die vorgeschriebene bescheinigung darf niemand das gebäude übertragen bis zu einer höhe von zehn"
ES = "el concejo expide la licencia previo dictamen del comité y sin perjuicio de los recursos que se prevén por la ley en un plazo de diez meses desde la fecha de la decisión"


def articles(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], ARTICLE)


def common(spark):
    rows = [("fr", w) for w in "le la les un une des de du au aux et ou en dans par pour sur sous avec sans ne pas qui que dont".split()]
    rows += [("en", w) for w in "the a an of to in on by for with without and or not is are be it its this that which who any".split()]
    rows += [("de", w) for w in "der die das den dem des ein eine und oder in im am von zu mit ohne nicht ist sind wer nach vor bis".split()]
    rows += [("es", w) for w in "el la los las un una de del en por para con sin y o no que quien es son su sus se a al".split()]
    return spark.createDataFrame(rows, "lang string, word string")


# ---- p4


def brute_groups(rows, threshold=0.6, least=40):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= least:
            sets[i] = set(zip(w, w[1:], w[2:]))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            o = len(sets[i] & sets[j])
            if o >= threshold * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    size = collections.Counter(find(i) for i in ids)
    return {(i, find(i)) for i in ids if size[find(i)] > 1}


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(share * len(out))):
        k = rng.randrange(len(out))
        rng.choice([lambda: out.insert(k, rng.choice(words)), lambda: out.pop(k), lambda: out.__setitem__(k, f"w{rng.randrange(999)}")])()
    return " ".join(out)


@pytest.mark.parametrize("hot", [1000, 3])
def test_near_duplicates_equal_brute_force(spark, hot):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))]
        rows += [(len(rows) + 1 + k, edited(rng, base, rng.choice([0, 0.02, 0.05, 0.1, 0.15]))) for k in range(rng.randrange(1, 9))]
    rows += [(900, None), (901, ""), (902, "too short"), rows[0], (903, rows[0][1]), (904, "stock phrase " * 3000)]
    got = {tuple(r) for r in near_duplicates.groups(articles(spark, rows), hot=hot).collect()}
    assert got == brute_groups(dict(rows).items())


def test_near_duplicates_one_big_group_and_empty(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, edited(rng, base, 0.04)) for i in range(1, 200)]
    got = {tuple(r) for r in near_duplicates.groups(articles(spark, rows), hot=20).collect()}
    assert got == brute_groups(rows)
    assert near_duplicates.groups(articles(spark, [])).count() == 0


def test_near_duplicates_on_the_tables(spark, sf):
    rows = [(r["id"], r["content"]) for r in table(spark, sf, "articles").select("id", "content").distinct().collect()]
    assert {tuple(r) for r in near_duplicates.found(table(spark, sf, "articles")).collect()} == brute_groups(rows)


# ---- p5


def test_conversations(spark):
    m = [
        (1, 1, "User", "hi", "2024-01-01 10:00:00"), (2, 1, "bot", "yes", "2024-01-01 10:00:00"), (3, 1, "bot ", " yes ", "2024-01-01 10:01:00"), (9, 1, "system", None, None),
        (4, 2, "user", "hi", "2024-01-01 10:00:00"), (5, 2, "???", "yes", "2024-01-01 10:01:00"),
        (6, 3, "user", " \t", "2024-01-01 10:00:00"), (7, 3, "assistant", "yes", "2024-01-01 10:01:00"),
        (8, 4, "user", "hi", "2024-01-01 10:00:00"),
        (10, 5, "utilisateur", "a", "2024-01-01 10:00:00"), (11, 5, "IA", "b", "2024-01-01 10:00:30"), (12, 5, "human", "c", "2024-01-01 22:00:00"), (13, 5, "ai", "d", "2024-01-01 22:00:30"),
        (14, 99, "user", "a", "2024-01-01 10:00:00"), (15, None, "user", "a", "2024-01-01 10:00:00"), (16, 6, None, None, None),
    ]
    m = spark.createDataFrame([(*r, "x") for r in [*m, m[0]]], "id int, conversation_id int, role string, content string, created_at string, speaker string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    c = spark.createDataFrame([(i, "x") for i in range(1, 8)], "id int, turn_no string")
    assert sorted(tuple(r) for r in conversations.found(m, c).collect()) == [(1, 1, 1), (1, 2, 2), (5, 1, 10), (5, 2, 11), (5, 3, 12), (5, 4, 13)]
    assert {(r["conversation_id"], r["session_no"]) for r in conversations.rebuild(m, c, 3600).collect()} == {(1, 1), (5, 1), (5, 2)}
    assert conversations.calibrate_gap(m) >= 60 and conversations.calibrate_gap(m.limit(0)) == 1800
    assert conversations.found(m.limit(0), c).count() == 0 and conversations.found(m, c.limit(0)).count() == 0


# ---- p6


def brute_pairs(rows, k=5, least=0.9):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v)}
    ids = sorted(ok)
    x = np.stack([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    c = np.round(x @ x.T, 9)
    np.fill_diagonal(c, -2)
    out = set()
    for r, i in enumerate(ids):
        for j in np.lexsort((ids, -c[r]))[:k]:
            if c[r, j] >= least:
                out.add((min(i, ids[j]), max(i, ids[j])))
    return out


def test_vector_forest(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(60):
        base = rng.standard_normal(64)
        rows += [(len(rows) + k + 1, (base + rng.standard_normal(64) * rng.choice([0.02, 0.2, 0.4])).astype(np.float32).tolist()) for k in range(rng.integers(1, 9))]
    same = rng.standard_normal(64).astype(np.float32).tolist()
    rows += [(1000 + k, same) for k in range(20)] + [(2000, [0.0] * 64), (2001, [float("nan")] * 64), (2002, [1.0] * 32), (2003, None), rows[0]]
    df = spark.createDataFrame([(i, 1, v, "x") for i, v in rows], "article_id int, law_id int, embedding array<float>, id string")
    got = {tuple(r) for r in vector_forest.found(df).collect()}
    want = brute_pairs(rows)
    assert len(got & want) >= 0.99 * len(want) and got <= want
    assert vector_forest.found(df.limit(0)).count() == 0


def test_vector_forest_recall_without_threshold(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "article_id int, embedding array<float>")
    got = collections.defaultdict(set)
    for r in vector_forest.neighbours(df, k=5, every=20, trees=32, probes=8).collect():
        got[r["id"]].add(r["neighbour"])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = [len(got[i] & set(np.argsort(-(u @ u[i]) + 4 * (np.arange(3000) == i))[:5].tolist())) / 5 for i in range(0, 3000, 20)]
    assert len(got) == 150 and np.mean(hits) >= 0.9, np.mean(hits)


@pytest.mark.parametrize("spread", [0.175, 0.1, 0.032])  # pairwise cosine of about 0.97, 0.99, 0.999
def test_vector_forest_one_dense_cluster_of_a_third(spark, spread):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((9000, 64))
    x[:3000] = x[0] / np.linalg.norm(x[0]) * 8 + spread * x[:3000]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "article_id int, embedding array<float>")
    got = collections.defaultdict(list)
    for r in vector_forest.neighbours(df, k=5, every=10, least=0.9).orderBy("id", "rank").collect():
        got[r["id"]].append(r["neighbour"])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for i in range(0, 3000, 10):
        c = np.round(u @ u[i], 9)
        c[i] = -2
        assert got[i] == np.lexsort((np.arange(9000), -c))[:5].tolist()


# ---- p8


def test_leakage_equals_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(10, 60)))) for i in range(1, 30)]
    docs = []
    for i in range(1, 120):
        t = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1].split()
            n = min(len(w), rng.randrange(8, 22))
            at = rng.randrange(len(w) - n + 1)
            p = rng.randrange(len(t) + 1)
            t[p:p] = w[at : at + n]
        docs.append((i, " ".join(t).upper() if i % 3 else "é ".join(t)))
    docs += [(500, None), (501, ""), docs[0]]
    d = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id bigint, text string, item_id int")
    e = spark.createDataFrame([(i, t, 3) for i, t in [*items, (77, None), (78, "")]], "item_id bigint, text string, fp int")

    def runs(t):
        t = "".join(c for c in unicodedata.normalize("NFD", (t or "").lower()) if not unicodedata.combining(c))
        w = re.findall(r"[^\W_]+", t)
        return {tuple(w[k : k + 14]) for k in range(len(w) - 13)}

    want = {(i, j) for i, t in dict(docs).items() for j, u in items if runs(t) & runs(u)}
    got = {tuple(r) for r in leakage.found(d, e).collect()}
    assert got == want and want
    assert all(r["run_words"] >= 14 for r in leakage.leaks(d, e).collect())
    assert leakage.found(d.limit(0), e).count() == 0 and leakage.found(d, e.limit(0)).count() == 0


# ---- p10


def test_encodings_round_trip(spark):
    rng = random.Random(2)
    lexicon = "préfet délivre régie après l’école contrôle qualité é où là décision état à Zürich über größe año señor días création naïve cœur forêt – n° °".split()
    texts = [" ".join(rng.choice(lexicon + ["the", "de", "la"]) for _ in range(60)) for _ in range(300)]
    model = encodings.fit(texts)
    for chain in ("utf8>cp1252", "utf8>latin1", "utf8>cp1252 twice", "utf8>mac_roman", "utf8>cp850", "utf8>cp437", "utf8>cp1251", "cp1252>cp850", "cp1252>mac_roman"):
        clean = [t for t in texts[:40] if encodings.spoil(t, chain) is not None]
        assert clean
        for t in clean:
            assert encodings.restore(encodings.spoil(t, chain), chain) == t
    rows = [(i, t) for i, t in enumerate(texts[:100])]
    spoilt = [(1000 + i, encodings.spoil(t, "utf8>cp1252")) for i, t in enumerate(texts[100:150])]
    odd = [(2000, None), (2001, ""), (2002, "plain"), (2003, "lost d�lai"), (2004, "« ÂGE DU BRONZE »"), rows[0]]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows + spoilt + odd], "doc_id bigint, text string, chains string")
    got = {r["doc_id"]: r for r in encodings.repair(df, model).collect()}
    assert set(got) == {i for i, _ in spoilt} | {2003}
    assert all(got[1000 + i]["restored"] == t for i, t in enumerate(texts[100:150]))
    assert encodings.repair(df.limit(0), model).count() == 0


# ---- p7


def test_languages(spark):
    def law(i, text, label):
        return (i, text, label, None)

    rows = [law(i, (t + ". ") * 2, lab) for i, (t, lab) in enumerate([(FR, "fr"), (EN, "en"), (DE, "de"), (ES, "es")] * 6)]
    rows += [law(100, FR + ".", "en"), law(101, EN + ".", None), law(102, DE + ".", "xx"), law(103, f"{FR}.\n\n{EN}.\n\n\n{FR}.", "fr"), law(104, f"{FR} « Landwirtschaftsbank ».", "fr"), law(105, None, "fr"), law(106, " \n ", None), law(107, "12 34", None), law(100, FR + ".", "en")]
    df = spark.createDataFrame(rows, "id int, content string, language string, detected_language string")
    got = {tuple(r) for r in languages.found(df, common(spark)).collect()}
    assert got == {(100, 0, "fr"), (101, 0, "en"), (102, 0, "de"), (103, 1, "fr"), (103, 2, "en"), (103, 3, "fr")}
    assert languages.found(df.limit(0), common(spark)).count() == 0


def test_bloom_counts_are_corrected():
    b = languages.fit([FR, EN, DE, ES] * 3, {"fr": frozenset("le la de du des une".split()), "en": frozenset("the of to and".split()), "de": frozenset("der die das und des".split()), "es": frozenset("el la los de del que".split())})
    assert b.decide(FR)[0] == "fr" and b.decide("1 2 3") == (None, 0.0)
    assert (b.counts("zzzz qqqq")[0] < 1).all()


# ---- p1


def scanned(spark):
    rng = random.Random(4)
    names = "préfet conseil communal direction régionale autonome brigade volante gouverneur province registre délivre transmet contrôle examine refuse annule autorise évalue le la de du des pour dans avec".split()
    clean = [(i, "Le " + " ".join(rng.choice(names) for _ in range(80)) + " sous-directeur.") for i in range(1, 60)]
    heads = [(100 + i, f"Le préfet délivre le registre\n\n- {i} -\nRECUEIL OFFICIEL DE LA VILLE\n\nde la province au conseil communal\net transmet le registre à la régionale.") for i in range(1, 9)]
    noisy = [
        (201, "Le conseil communal exa-\nmine le registre de la province\net le sous-\ndirecteur refuse la demande au préfet."),
        (202, "Le gouvcrneur de la province exarnine le registre du conseil communal."),
        (203, "Le préfet de la province refuse le re¬\nRECUEIL OFFICIEL DE LA V1LLE   44\ngistre du conseil communal."),
        (204, "- le registre\n- le conseil com-\nmunal\n- 12 -\n- la province\n- le préfet"),
        (205, None), (206, ""), (207, "x" * 5000),
    ]
    laws = [(1, "Le préfet contr0le le registre.\n[12]\nLe conseil refuse."), (2, None)]
    return articles(spark, clean + heads + noisy + [noisy[0]]), articles(spark, laws)


WANT = {("article", 201, "hyphen"), ("article", 202, "misread"), ("article", 203, "hyphen"), ("article", 203, "header"), ("article", 203, "page_number"), ("law", 1, "misread"), ("law", 1, "page_number")}


@pytest.mark.parametrize("bound", [200_000, 0])
def test_scan_noise(spark, bound, monkeypatch):
    monkeypatch.setattr(scan_noise, "BROADCAST_ROWS", bound)
    if not bound:
        monkeypatch.setattr(scan_noise, "_small", lambda df: False)
        monkeypatch.setattr(scan_noise, "BROADCAST_ROWS", 1000)
    a, b = scanned(spark)
    got = {tuple(r) for r in scan_noise.found(a, b).collect()}
    assert got == WANT | {("article", 100 + i, k) for i in range(1, 9) for k in ("header", "page_number")}
    text = {(r["record_type"], r["record_id"]): r["text"] for r in scan_noise.mend(a, b).collect()}
    assert text["article", 201] == "Le conseil communal examine le registre de la province et le sous-directeur refuse la demande au préfet."
    assert text["article", 202] == "Le gouverneur de la province examine le registre du conseil communal."
    assert text["article", 203] == "Le préfet de la province refuse le registre du conseil communal."
    assert text["article", 204].startswith("- le registre\n") and ("article", 205) not in text and text["article", 206] == ""


def test_more_compounds_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(scan_noise, "BROADCAST_ROWS", 1)
    pairs = ["sous-directeur", "vice-gouverneur", "porte-registre", "avant-conseil"]
    rows = [(10 * k + j, f"Le {w} de la ville transmet le registre au conseil.") for k, w in enumerate(pairs) for j in range(3)]
    rows += [(100 + k, f"Le conseil de la ville transmet au {w.replace('-', f'-{chr(10)}')} la demande.") for k, w in enumerate(pairs)]
    a, none = articles(spark, rows), articles(spark, [])
    assert scan_noise.found(a, none).count() == 0
    text = {r["record_id"]: r["text"] for r in scan_noise.mend(a, none).collect()}
    assert all(w in text[100 + k] for k, w in enumerate(pairs))


def test_misreadings_commoner_than_one_in_a_thousand(spark):
    """A third of the records is scanned; dale is a word of its own, exarnine is not."""
    rng = random.Random(5)
    fill = "préfet conseil communal registre province autorise refuse la de du des pour dans avec".split()
    rows = []
    for i in range(900):
        words = [rng.choice(fill) for _ in range(12)]
        more = ["examine", "examine", "date", "date", "dale" if i % 20 == 0 else "avec"]
        if i % 3 == 0:
            more[0] = "exarnine" if i % 18 == 0 else "examine"
            words[5] = "con-\nseil"
        rows.append((i, "Le " + " ".join(words + more) + " préfet."))
    got = {r["record_id"] for r in scan_noise.found(articles(spark, rows), articles(spark, [])).where("noise = 'misread'").collect()}
    assert got == set(range(0, 900, 18))


def test_scan_noise_empty(spark):
    assert scan_noise.found(articles(spark, []), articles(spark, [])).count() == 0


def test_furniture():
    f = pages.Furniture(["RECUEILOFFICIELDELAVILLE"])
    assert f.kinds("— 12 —") == ("page_number",) and f.kinds("Recueil officiel de la ville / 1999") == ("header",)
    assert f.kinds("RECUEIL OFFIC1EL DE LA VILLE   Page 3 / 9") == ("header", "page_number") and f.kinds("registre 12.") == ()


def test_spellings_of_heads_equal_every_pair():
    rng = random.Random(6)
    titles = ["".join(rng.choice("ABCDE") for _ in range(rng.randint(12, 20))) for _ in range(60)]
    heads = pages.Heads(titles)
    for _ in range(3000):
        k = list(rng.choice(titles))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(k))
            k[at : at + 1] = rng.choice([[], ["F"], [k[at], "F"]])
        k = "".join(k)
        assert heads.like(k) == (k in titles or any(pages._within(k, t, 2) for t in titles if k[:3] == t[:3] or k[-3:] == t[-3:]))


def test_every_head_of_many_is_learned(spark):
    rng = random.Random(7)
    titles = [" ".join("".join(rng.choice("ABCDEFGHIJ") for _ in range(6)) for _ in range(3)) for _ in range(2500)]
    df = spark.createDataFrame([(f"Le conseil\n- {j} -\n{t}\nrefuse la demande.",) for t in titles for j in range(1, 7)], "t string")
    assert set(pages.learn_titles(df)) == {pages.key(t) for t in titles}


def test_confidence_of_a_language_is_calibrated(spark, sf):
    """On segments the model never saw: short pieces, whose share of right verdicts must follow their confidence."""
    words = languages.common_sets(table(spark, sf, "common_words"))
    rows = [r["t"] for r in table(spark, sf, "documents").select(F.col("text").alias("t")).where("t is not null").distinct().collect()]
    rng = random.Random(8)
    rng.shuffle(rows)
    model = languages.fit(rows[: len(rows) // 2], words)
    bins = collections.defaultdict(list)
    for piece, language in languages.pieces(languages.labelled(rows[len(rows) // 2 :], words)):
        got, sure = model.judge(model.packed(piece))
        bins[min(9, int(sure * 10))].append((sure, got == language))
    n = sum(map(len, bins.values()))
    error = sum(abs(sum(p for p, _ in b) - sum(ok for _, ok in b)) for b in bins.values()) / n
    assert n > 200 and error < 0.05, (n, error)


def test_more_languages_than_a_byte_has_bits():
    common = {f"x{k}": frozenset({f"w{chr(97 + k)}ord", f"q{chr(97 + k)}z"}) for k in range(11)}
    m = languages.fit([], common)
    assert m.slots.dtype == np.uint16 and m.decide("wkord qkz wkord")[0] == "x10"
    with pytest.raises(ValueError):
        languages.fit([], {f"x{k}": frozenset({f"w{k}"}) for k in range(65)})


# ---- p2


def test_quality_on_the_holdout(spark):
    rng = random.Random(9)
    words = frozenset("le la de du des une dans pour sur avec the of to and in is for a".split())
    pick = lambda n: " ".join(rng.choice(FR.split()) for _ in range(n))
    prose = [pick(60).capitalize() + "." for _ in range(40)] + [pick(8).capitalize() + "." for _ in range(15)] + ["\n".join(pick(9) for _ in range(8)) + "." for _ in range(15)]
    lists = ["\n".join(f"{m} le {pick(2)} {i} ;" for i in range(rng.randrange(5, 12))) for m in "-•–" for _ in range(15)] + ["\n".join(pick(rng.randrange(2, 5)) for _ in range(8)) for _ in range(20)] + ["\n".join(f"{i + 1}. {pick(3)}" for i in range(7)) for _ in range(15)]
    tables = ["\n".join(f"| {rng.randrange(999)} | le {pick(1)} | {rng.randrange(9999)} |" for _ in range(6)) for _ in range(20)]
    tables += ["\n".join(f"<tr><td>{rng.randrange(999)}</td><td>{pick(2)}</td></tr>" for _ in range(5)) for _ in range(20)] + ["\n".join(f"{rng.randrange(99)}\t{pick(1)}\t{rng.randrange(999)}" for _ in range(5)) for _ in range(10)]
    junk = ["".join(rng.choice("0123456789/.-\n") for _ in range(90)) for _ in range(20)] + [" ".join("".join(rng.choice("bcdfghjk") for _ in range(5)) for _ in range(15)) for _ in range(20)]
    junk += [" ".join(rng.choice("~'`|.,-ilrst1") for _ in range(60)) for _ in range(15)] + ["\n".join("." * rng.randrange(10, 50) + f" {i}" for i in range(5)) for _ in range(10)] + ["\n".join(rng.choice(["n", "re", "la", "o", "t"]) for _ in range(25)) for _ in range(15)]
    m = quality.fit(prose + lists + tables + junk, words)
    x = np.array([quality.statistics(t, words) for _, t in HOLDOUT])
    right = [quality.FORMS[k] == f for k, (f, _) in zip(m.probabilities(x).argmax(axis=1), HOLDOUT)]
    assert np.mean(right) >= 0.8, [t for r, (_, t) in zip(right, HOLDOUT) if not r]
    odd = articles(spark, [(1, None), (2, ""), (3, " \n "), (4, prose[0]), (4, prose[0]), (5, "mot " * 60_000)])
    got = {r["article_id"]: r["form"] for r in quality.judge(odd, common(spark), m).collect()}
    assert set(got) == {2, 3, 4, 5} and got[2] == got[3] == "junk" and got[4] == "prose"
    assert quality.found(articles(spark, []), common(spark)).count() == 0


def test_quality_is_calibrated_on_texts_never_fitted():
    from tesselle.llm.quality_holdout import CHECKED

    words = frozenset("le la de du des une dans pour sur avec the of to and in is for a".split())
    m = quality.fit([t for _, t in HOLDOUT], words)
    x = np.array([quality.statistics(t, words) for _, t in CHECKED])
    y = np.array([quality.FORMS.index(f) for f, _ in CHECKED])
    p = m.probabilities(x)
    loss = -np.log(np.maximum(1e-9, p[np.arange(len(y)), y])).mean()
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    assert not {t for _, t in CHECKED} & {t for _, t in HOLDOUT} and right.mean() >= 0.8, [t for r, (_, t) in zip(right, CHECKED) if not r]
    assert loss < 0.6 and abs(top.mean() - right.mean()) < 0.15, (loss, top.mean(), right.mean())


def test_a_table_of_function_words_beyond_the_bound_is_refused(spark):
    with pytest.raises(ValueError):
        quality.common_set(common(spark), most=5)


# ---- p3


def test_subjects(spark):
    rng = random.Random(6)
    terms = {1: ["prison sentence", "police custody"], 2: ["income tax", "customs duty"], 3: ["football cup", "match referee"]}
    stock = ["complete file", "written request"]

    def text(mix):
        return " ".join(f"The town council of Place{rng.randrange(50)} {rng.choice(['renews', 'controls', 'refuses'])} the {rng.choice(terms[c] if c else stock)} within the jurisdiction." for c in mix)

    laws = []
    for i in range(1, 121):
        c = i % 3 + 1
        laws.append((i, text([c] * 6 + [0] * 2), c, [c] if i % 4 else [c % 3 + 1]))
    laws += [(500, text([1] * 4 + [2] * 4), 3, None), (501, text([0] * 8), 2, [2]), (502, text([1] * 9 + [2]), None, None), (503, None, 1, [1]), (504, "", 1, None), laws[0]]
    df = spark.createDataFrame([(*r, "z") for r in laws], "id int, content string, category_id int, suggested_categories array<int>, c string")
    cats = spark.createDataFrame([(1, "Justice"), (2, "Budget"), (3, "Sport"), (13, "Textes divers")], "id int, name string")
    got = {tuple(r) for r in subjects.found(df, cats, common(spark)).collect()}
    assert got == {(i, i % 3 + 1) for i in range(1, 121)} | {(500, 1), (500, 2), (502, 1)}
    assert subjects.found(df.limit(0), cats, common(spark)).count() == 0


# ---- p9


def test_budget_is_met_to_the_token():
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(5, 400, 60))
    counts = rng.integers(1, 50, len(lengths))
    for share in (0.1, 0.37, 0.9):
        budget = int((lengths * counts).sum() * share)
        take = mixing.fit_budget(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all() and budget - 2 <= (take * lengths).sum() <= budget
    assert (mixing.fit_budget(lengths, counts, 10**9) == counts).all()
    assert mixing.fit_budget(np.array([10]), np.array([3]), 9).sum() == 0


def test_mixing(spark):
    docs = [(i, "mot " * (i % 7 + 1), s) for i, s in enumerate(["Big_Source"] * 300 + ["big source"] * 30 + ["small"] * 20 + [None, "other"])]
    docs += [(900, None, "small"), (901, "", "small"), docs[0]]
    d = spark.createDataFrame([(*r, 5) for r in docs], "doc_id bigint, text string, source string, tokens int")
    t = spark.createDataFrame([("big_source", 0.5, 1), ("small", 0.3, 4), ("absent", 0.2, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    rows = mixing.mix(d, t).collect()
    size = collections.Counter()
    for r in rows:
        size[r["source"]] += r["tokens"] * r["copies"]
        assert r["copies"] <= {"big_source": 1, "small": 4}[r["source"]]
    assert abs(size["big_source"] / sum(size.values()) - 0.625) < 0.01 and len({r["doc_id"] for r in rows}) == len(rows)
    got = {r["source"]: r for r in mixing.shares(d, t).collect()}
    assert got["absent"]["tokens"] == 0 and abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-5
    assert sorted(mixing.mix(d, t).collect()) == sorted(rows)
    assert mixing.mix(d.limit(0), t).count() == 0 and mixing.mix(d, t.limit(0)).count() == 0


# ---- the query list


def test_found_queries_have_the_given_columns(spark, sf):
    columns = {
        "p1_found": ["record_type", "record_id", "noise"], "p2_found": ["article_id", "form"], "p3_found": ["law_id", "category_id"], "p4_found": ["article_id", "group_id"], "p5_found": ["conversation_id", "turn_no", "message_id"],
        "p6_found": ["article_id_a", "article_id_b"], "p7_found": ["law_id", "segment_no", "language"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
    }
    for name, want in columns.items():
        assert queries.queries()[name](spark, sf).columns == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(name, spark, sf, con):
    import oracle

    assert oracle.compare(queries.queries()[name](spark, sf), con, queries.oracle_sql()[name]) is None


def test_joins_without_broadcast_give_the_same(spark, sf, monkeypatch):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "eval_items")
    want = {tuple(r) for r in leakage.found(docs, items).collect()}
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(leakage, "BROADCAST_ITEMS", 0)
    assert {tuple(r) for r in leakage.found(docs, items).collect()} == want and want
    a = table(spark, sf, "articles")
    want = {tuple(r) for r in near_duplicates.found(a).collect()}
    monkeypatch.setattr(near_duplicates, "BROADCAST_IDS", 0)
    assert {tuple(r) for r in near_duplicates.found(a).collect()} == want and want
    laws, cats, words = table(spark, sf, "laws"), table(spark, sf, "categories"), table(spark, sf, "common_words")
    want = {tuple(r) for r in subjects.found(laws, cats, words).collect()}
    monkeypatch.setattr(subjects, "MOST_PHRASES", 0)
    assert {tuple(r) for r in subjects.found(laws, cats, words).collect()} == want and want
