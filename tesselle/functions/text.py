"""String functions as native column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and what they fold to.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüçñýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"
# French and English words that carry no content (folded).
STOP_WORDS = "le la les un une des de du au aux et ou en dans par pour sur sous avec sans ne pas qui que dont il elle est sont ce cette son sa ses apres avant si the a an of to in on by for with without and or not is are be it its this that which who any no if as at from under before after may shall within".split()


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def words(c: Column) -> Column:
    """Folded words of letters and digits, in order."""
    return F.regexp_extract_all(fold(c), F.lit("([a-z0-9]+)"), 1)


def content_words(c: Column, min_length: int = 3) -> Column:
    """Distinct folded words longer than ``min_length`` that are no stop words, in order of first occurrence."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(words(c), lambda w: (F.length(w) > min_length) & ~F.array_contains(stop, w)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / either)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words padded by two blanks before and one behind."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words(c), grams)))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def word_similarity(query: Column, text: Column) -> Column:
    """Best trigram similarity of the query with any word of the text."""
    return F.coalesce(F.array_max(F.transform(words(text), lambda w: trigram_similarity(query, w))), F.lit(0.0))


def word_shingles(c: Column, n: int = 3) -> Column:
    """Distinct runs of n words; empty for fewer words."""
    w = words(c)
    return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))


def keywords(c: Column, most: int = 10) -> Column:
    """The first ``most`` letter words over two letters that are no stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    letters = F.regexp_extract_all(fold(c), F.lit("([a-z]+)"), 1)
    return F.slice(F.filter(letters, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)), 1, most)


def language_vote(c: Column) -> Column:
    """fr or en by function words; null when even."""
    french = F.array(*[F.lit(w) for w in "le la les des du une dans pour qui que est".split()])
    english = F.array(*[F.lit(w) for w in "the of and to in is for that which any".split()])
    w = words(c)
    nf, ne = F.size(F.filter(w, lambda x: F.array_contains(french, x))), F.size(F.filter(w, lambda x: F.array_contains(english, x)))
    return F.when(nf > ne, "fr").when(ne > nf, "en")


def quality_score(c: Column) -> Column:
    """0.4 share of letters + 0.3 share of words of 2 to 20 letters + 0.3 common hits, up to five; 0 under ten characters."""
    tokens = F.filter(F.split(c, r"[ \n\t]+"), lambda t: t != "")
    alpha = F.length(F.regexp_replace(c, r"[^A-Za-zÀ-ÿ]", "")) / F.length(c)
    good = F.size(F.filter(tokens, lambda t: (F.length(t) >= 2) & (F.length(t) <= 20))) / F.greatest(F.size(tokens), F.lit(1))
    low = F.lower(c)
    hits = sum((F.instr(low, f" {w} ") > 0).cast("int") for w in ("le", "la", "de", "et", "the", "of", "and", "to"))
    return F.when(F.length(c) < 10, 0.0).otherwise(0.4 * alpha + 0.3 * good + 0.3 * F.least(hits / 5, F.lit(1.0)))


def clean_ocr(c: Column) -> Column:
    """Page marks out, quotes and dashes unified, ligatures spelt out, spacing and blank lines collapsed."""
    c = F.regexp_replace(c, r"(?m)^[ \t]*(?:[-–—] ?[0-9]{1,4} ?[-–—]|\[[0-9]{1,4}\]|[Pp]age [0-9]{1,4}(?: / [0-9]{1,4})?)[ \t]*$", "")
    c = F.translate(c, "’‘“”–—", "''\"\"--")
    c = F.replace(F.replace(c, F.lit("ﬁ"), F.lit("fi")), F.lit("…"), F.lit("..."))
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def content_hash(c: Column) -> Column:
    """SHA-256 of the lower-cased text with its white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(c), r"[ \n\t]+", " ")), 256)


def article_number(c: Column) -> Column:
    """Article numbers in one spelling: label and outer punctuation dropped, upper case, first ordinals as 1."""
    n = F.regexp_replace(F.upper(c), r"^(?:ARTICLE|ART\.?)[ ]+", "")
    n = F.regexp_replace(n, r"^[ .:'-]+|[ .:'-]+$", "")
    return F.when(n.isin("PREMIER", "1ER", "FIRST", "1ST"), "1").otherwise(n)


def base_number(c: Column) -> Column:
    """Digits an article number begins with; null for section and paragraph marks."""
    return F.nullif(F.regexp_extract(article_number(c), r"^([0-9]+)", 1), F.lit(""))


def highlight(c: Column, word: str) -> Column:
    """The text with every occurrence of a word marked."""
    return F.regexp_replace(c, rf"(?i)({word})", "<mark>$1</mark>")
