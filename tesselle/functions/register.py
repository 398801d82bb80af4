"""The library's functions under names of SQL: scalar ones as SQL functions the optimizer sees through, the chunker as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tesselle.functions.text import ACCENTED, PLAIN
from tesselle.operators import chunking

# Name, arguments, result, body.
SCALAR = [
    ("fold_text", "t STRING", "STRING", f"translate(lower(t), '{ACCENTED}', '{PLAIN}')"),
    ("text_words", "t STRING", "ARRAY<STRING>", f"regexp_extract_all(translate(lower(t), '{ACCENTED}', '{PLAIN}'), '([a-z0-9]+)', 1)"),
    ("content_hash", "t STRING", "STRING", r"sha2(trim(regexp_replace(lower(t), '[ \\n\\t]+', ' ')), 256)"),
    ("set_similarity", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
    ("base_number", "n STRING", "STRING", "nullif(regexp_extract(upper(n), '^([0-9]+)', 1), '')"),
]


class Chunks:
    """A text's chunks as rows."""

    def eval(self, text: str):
        for c in chunking.chunks(text or ""):
            yield c["position"], c["number"], c["section"], c["page"], c["content"]


def register(s: SparkSession) -> list[str]:
    """Registers all of them in the session and gives their names."""
    for name, args, result, body in SCALAR:
        s.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    s.udtf.register("document_chunks", udtf(Chunks, returnType="position int, number string, section string, page int, content string"))
    return [x[0] for x in SCALAR] + ["document_chunks"]
