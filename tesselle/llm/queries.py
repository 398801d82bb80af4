"""Queries and oracle SQL of the training-data operators, by the driver's names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tesselle.llm import conversations, encodings, languages, leakage, mixing, near_duplicates, quality, scan_noise, subjects, vector_forest
from tesselle.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _conversations(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(s, d, "messages"), table(s, d, "conversations")


def _sessions(s: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild(*_conversations(s, d))


def _neighbours(s: SparkSession, d: str) -> DataFrame:
    return vector_forest.neighbours(table(s, d, "articles_vecteurs"), k=5, every=20, trees=vector_forest.WIDE_TREES, probes=vector_forest.PROBES)


def _composition(s: SparkSession, d: str) -> DataFrame:
    laws, cats = table(s, d, "laws"), table(s, d, "categories")
    got = subjects.subjects(laws, cats, table(s, d, "common_words"))
    total = laws.select("id").where("id is not null").distinct().count()
    n = got.groupBy("category_id").agg(F.count("*").alias("laws"), F.sum("sentences").alias("sentences"))
    return n.join(cats.select(F.col("id").alias("category_id"), "name"), "category_id").withColumn("share_of_laws", F.round(F.col("laws") / total, 6))


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: scan_noise.found(table(s, d, "articles"), table(s, d, "laws")),
        "p1_repaired": lambda s, d: scan_noise.mend(table(s, d, "articles"), table(s, d, "laws")),
        "p2_found": lambda s, d: quality.found(table(s, d, "articles"), table(s, d, "common_words")),
        "p2_statistics": lambda s, d: quality.judge(table(s, d, "articles"), table(s, d, "common_words")),
        "p3_found": lambda s, d: subjects.found(table(s, d, "laws"), table(s, d, "categories"), table(s, d, "common_words")),
        "p3_composition": _composition,
        "p4_found": lambda s, d: near_duplicates.found(table(s, d, "articles")),
        "p5_found": lambda s, d: conversations.found(*_conversations(s, d)),
        "p5_sessions": _sessions,
        "p6_found": lambda s, d: vector_forest.found(table(s, d, "articles_vecteurs")),
        "p6_neighbours": _neighbours,
        "p7_found": lambda s, d: languages.found(table(s, d, "laws"), table(s, d, "common_words")),
        "p7_segments": lambda s, d: languages.detect(table(s, d, "laws"), table(s, d, "common_words")),
        "p7_labels": lambda s, d: languages.labels(table(s, d, "laws"), table(s, d, "common_words")),
        "p8_found": lambda s, d: leakage.found(table(s, d, "documents"), table(s, d, "eval_items")),
        "p8_runs": lambda s, d: leakage.leaks(table(s, d, "documents"), table(s, d, "eval_items")),
        "p9_mix": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_shares": lambda s, d: mixing.shares(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p10_found": lambda s, d: encodings.found(table(s, d, "documents")),
        "p10_restored": lambda s, d: encodings.repair(table(s, d, "documents")),
    }


# The roles as this SQL reads them, spelt out here and not taken from the operator.
_ROLE = """CASE WHEN r IN ('user', 'utilisateur', 'utilisatrice', 'usager', 'usuario', 'benutzer', 'nutzer', 'human', 'humain', 'humano', 'mensch', 'client', 'customer', 'visiteur', 'visitor', 'question', 'me') THEN 'user'
 WHEN r IN ('assistant', 'assistante', 'asistente', 'assistent', 'bot', 'chatbot', 'ai', 'ia', 'ki', 'agent', 'gpt', 'model', 'modell', 'modelo', 'modèle', 'answer') THEN 'assistant'
 WHEN r IN ('system', 'systeme', 'système', 'sistema', 'developer') THEN 'system' END"""

_BLANK = r"[\s\p{Z}\p{C}]"

P5 = f"""WITH m AS (SELECT DISTINCT id, conversation_id, created_at, lower(regexp_replace(role, '^{_BLANK}+|{_BLANK}+$', '', 'g')) AS r, regexp_replace(content, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS said FROM messages WHERE conversation_id IN (SELECT id FROM conversations)),
t AS (SELECT *, {_ROLE} AS speaker FROM m),
u AS (SELECT * FROM t WHERE speaker IS NULL OR speaker <> 'system'),
good AS (SELECT conversation_id FROM u GROUP BY 1 HAVING bool_and(coalesce(speaker IS NOT NULL AND created_at IS NOT NULL AND said <> '', false))),
k AS (SELECT *, lag(speaker) OVER w AS s0, lag(said) OVER w AS c0 FROM u WHERE conversation_id IN (SELECT conversation_id FROM good) WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, id)),
n AS (SELECT conversation_id, id, speaker, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS turn_no, count(*) OVER (PARTITION BY conversation_id) AS turns FROM k WHERE s0 IS NULL OR s0 <> speaker OR c0 <> said),
ok AS (SELECT conversation_id FROM n GROUP BY 1 HAVING bool_and(speaker = CASE WHEN turn_no % 2 = 1 THEN 'user' ELSE 'assistant' END) AND max(turns) % 2 = 0)
SELECT conversation_id, CAST(turn_no AS INTEGER) AS turn_no, id AS message_id FROM n WHERE conversation_id IN (SELECT conversation_id FROM ok)"""

P6 = """WITH v AS (SELECT DISTINCT ON (article_id) article_id AS id, embedding::DOUBLE[] AS e FROM articles_vecteurs WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT id, e, sqrt(list_inner_product(e, e)) AS n FROM v),
c AS (SELECT a.id AS a, b.id AS b, round(list_inner_product(a.e, b.e) / (a.n * b.n), 9) AS s FROM u a JOIN u b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM c)
SELECT DISTINCT least(a, b) AS article_id_a, greatest(a, b) AS article_id_b FROM r WHERE k <= 5 AND s >= 0.9"""


def _runs(key: str, table_name: str) -> str:
    w = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"
    return f"(SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 12), lambda i: array_to_string(list_slice(w, i, i + 13), ' '))) AS run FROM (SELECT {key}, {w} AS w FROM {table_name}) WHERE len(w) >= 14)"


P8 = f"SELECT DISTINCT doc_id, item_id FROM {_runs('doc_id', 'documents')} d JOIN {_runs('item_id', 'eval_items')} e ON d.run = e.run"


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same; the other operators are tested against brute force, exact round trips and held-out cases."""
    return {"p5_found": P5, "p6_found": P6, "p8_found": P8}
