"""Functions over the texts of acts, references and names, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesselle.functions.text import fold

# Numbers the chunker gives to text outside articles.
PSEUDO = r"(?i)^(?:PREAMBULE|LEGAL_BASIS|SIGNATURE|ANNEXE|FULL_TEXT|SECTION_[0-9]+|PARA_[0-9]+)(?:\.[0-9]+)?$"
# How a question names an article of a document, in the order they are tried; group 1 the number, group 2 the document.
REFERENCES = [
    r"(?i)\bart(?:icle|\.)?[ ]*((?:[LRD][ ]*)?[0-9]+(?:[-.][0-9]+)*(?:[ ]*(?:bis|ter|quater))?)[ ]+(?:de la |de l['’][ ]*|du |de |des |of the |of )(.+)",
    r"(?i)\bart(?:icle|\.)?[ ]+(premier|première|1er|1ère|first)[ ]+(?:de la |de l['’][ ]*|du |de |des |of the |of )(.+)",
    r"(?i)\bart(?:icle|\.)?[ ]*((?:[LRD][ ]*)?[0-9]+(?:[-.][0-9]+)*)[ ]*()$",
    r"(?i)\bart(?:icle|\.)?[ ]+(premier|première|1er|1ère|first)[ ]*()$",
]
# Spelt ordinals as article numbers.
ORDINALS = {"1": "PREMIER PREMIERE PREMIÈRE 1ER 1ÈRE 1ERE FIRST 1ST", "2": "DEUXIEME DEUXIÈME SECOND SECONDE", "3": "TROISIEME TROISIÈME THIRD"}
# French and English month names, by what they begin with (folded).
MONTHS = {"jan": 1, "fev": 2, "feb": 2, "mars": 3, "mar": 3, "avr": 4, "apr": 4, "mai": 5, "may": 5, "juin": 6, "jun": 6, "juil": 7, "jul": 7, "aou": 8, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
# Kinds of acts by the word a title begins with (folded).
KINDS = [("loi", "law"), ("law", "law"), ("decret", "decree"), ("decree", "decree"), ("arrete", "order"), ("order", "order"), ("ordonnance", "ordinance"), ("vertrag", "treaty"), ("tratado", "treaty"), ("circulaire", "circular"), ("circular", "circular"), ("decision", "decision"), ("code", "code")]


def escape_like(c: Column) -> Column:
    """A text that a LIKE pattern takes literally."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


def is_pseudo_number(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(PSEUDO), F.lit(False))


def number_form(c: Column) -> Column:
    """An article number as stored: label and outer punctuation dropped, upper case, one blank, spelt ordinals as digits; '' for none."""
    n = F.regexp_replace(F.trim(F.upper(F.coalesce(c, F.lit("")))), r"^(?:ARTICLE|ART\.?|SECTION)[ ]*", "")
    n = F.regexp_replace(F.regexp_replace(n, r"^[ .:-]+|[ .:-]+$", ""), r"[ ]+", " ")
    out = n
    for number, words in ORDINALS.items():
        out = F.when(n.isin(words.split()), number).otherwise(out)
    return out


def parse_reference(c: Column) -> Column:
    """struct(number, hint) of the article a question asks for; null where it asks for none."""
    t, out = F.trim(c), F.lit(None).cast("struct<number:string,hint:string>")
    for p in reversed(REFERENCES):
        hint = F.regexp_replace(F.regexp_extract(t, p, 2), r"^[ .,;:]+|[ .,;:]+$", "")
        out = F.when(t.rlike(p), F.struct(number_form(F.regexp_extract(t, p, 1)).alias("number"), hint.alias("hint"))).otherwise(out)
    return out


def french_ordinals(most: int = 199) -> dict[str, int]:
    """Spelt French ordinals (folded, hyphens) up to ``most``, built by the rules of French numerals."""
    ones = "zero un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf".split()
    tens = {20: "vingt", 30: "trente", 40: "quarante", 50: "cinquante", 60: "soixante", 80: "quatre-vingt"}

    def cardinal(n: int) -> str:
        if n >= 100:
            head = "cent" if n < 200 else f"{ones[n // 100]}-cent"
            return head if n % 100 == 0 else f"{head}-{cardinal(n % 100)}"
        if n < 20:
            return ones[n]
        base = max(t for t in tens if t <= n)
        rest = n - base
        if not rest:
            return tens[base]
        return f"{tens[base]}-{'et-' if rest in (1, 11) and base != 80 else ''}{ones[rest]}"

    out = {"premier": 1, "premiere": 1, "second": 2, "seconde": 2}
    for n in range(2, most + 1):
        w = cardinal(n)
        w = w[:-1] if w.endswith("e") else w
        w = w[:-1] + "v" if w.endswith("f") else w
        out[(w + "u" if w.endswith("cinq") else w) + "ieme"] = n
    return out


def ordinal_number(c: Column) -> Column:
    """The number a spelt ordinal or an ordinal with its ending stands for, as text; other numbers stay as they are."""
    english = "one first two second three third four fourth five fifth six sixth seven seventh eight eighth nine ninth ten tenth".split()
    known = {w: k // 2 + 1 for k, w in enumerate(english)} | french_ordinals()
    table = F.create_map(*[F.lit(x) for w, n in known.items() for x in (w, str(n))])
    key = F.regexp_replace(fold(F.trim(c)), r"[ -]+", "-")
    bare = F.regexp_extract(fold(F.trim(c)), r"^([0-9]+(?:\.[0-9]+)*)(?:er|ere|eme)$", 1)
    return F.coalesce(F.element_at(table, key), F.nullif(bare, F.lit("")), F.when(key.isin("preambule", "preamble"), "PREAMBULE"), c)


def kind_of_title(c: Column) -> Column:
    """The kind of act by the first word of a title, else by any word, else ``autre``."""
    t = fold(c)
    out = F.lit("autre")
    for word, kind in reversed(KINDS):
        out = F.when(t.rlike(rf"\b{word}\b"), kind).otherwise(out)
    for word, kind in reversed(KINDS):
        out = F.when(t.rlike(rf"^[ ]*{word}\b"), kind).otherwise(out)
    return out


def month(c: Column) -> Column:
    """1 to 12 of a month's name, by its beginning; null for another word."""
    t, out = fold(c), F.lit(None).cast("int")
    for name, n in sorted(MONTHS.items(), key=lambda x: len(x[0])):
        out = F.when(t.startswith(name), n).otherwise(out)
    return out


def date_of_title(c: Column) -> Column:
    """struct(day, exact): a written or numeric date in a title whose year is within one of the act number's year; else the first of
    January of that year; null without either."""
    act = F.nullif(F.regexp_extract(c, r"n[°o] ?([0-9]{4})/[0-9]+", 1), F.lit("")).cast("int")
    p, q = r"(?i)([0-9]{1,2})(?:er)? ([a-zà-ÿ]{3,9})\.? ([0-9]{4})", r"([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})"
    part = lambda r, k: F.nullif(F.regexp_extract(c, r, k), F.lit("")).cast("int")
    legal = lambda d, m, y: F.when((d <= F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1))))) & (d >= 1) & m.between(1, 12), F.make_date(y, m, d))
    written = legal(part(p, 1), month(F.regexp_extract(c, p, 2)), part(p, 3))
    m = part(q, 2)
    numeric = F.when(m.between(1, 12), legal(part(q, 1), F.when(m.between(1, 12), m), part(q, 3)))
    found = F.coalesce(written, numeric)
    near = act.isNull() | (F.abs(F.year(found) - act) <= 1)
    return F.when(found.isNotNull() & near, F.struct(found.alias("day"), F.lit(True).alias("exact"))).when(act.isNotNull(), F.struct(F.make_date(act, F.lit(1), F.lit(1)).alias("day"), F.lit(False).alias("exact")))


def title_of_body(c: Column) -> Column:
    """A title from the first three lines of the first 500 characters: a line that begins like an act (up to 200 characters), else the
    first line if it has 11 to 199 characters and a capital; else null."""
    lines = F.slice(F.filter(F.transform(F.split(F.substring(c, 1, 500), "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 3)
    acts = F.filter(lines, lambda x: x.rlike(r"(?i)^(?:loi|d[ée]cret|arr[êe]t[ée]|ordonnance|law|decree|order|decision|d[ée]cision|circulaire) ?(?:n|du|of|por)") & (F.length(x) <= 200))
    first = F.get(lines, F.lit(0))
    return F.coalesce(F.get(acts, F.lit(0)), F.when((F.length(first) > 10) & (F.length(first) < 200) & first.rlike(r"^[A-ZÀ-Þ]"), first))


def tags(c: Column, most: int = 8) -> Column:
    """Tags cleaned: blanks collapsed, empty ones and repeats (by their folded form) out, at most ``most`` in order."""
    clean = F.filter(F.transform(c, lambda x: F.trim(F.regexp_replace(x, r"[ \t\n]+", " "))), lambda x: x != "")
    first = F.filter(clean, lambda x, i: ~F.exists(F.slice(clean, F.lit(1), i), lambda y: fold(y) == fold(x)))
    return F.slice(first, 1, most)


def username(c: Column) -> Column:
    """The local part of an e-mail address, folded, other signs out; ``user`` if nothing remains."""
    local = F.regexp_replace(fold(F.split_part(c, F.lit("@"), F.lit(1))), r"[^a-z0-9._-]+", "")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(local, r"^[._-]+|[._-]+$", ""), 1, 30), F.lit("")), F.lit("user"))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters, and one more for each beyond the basic plane."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[\x{0}-\x{FFFF}]", ""))


def long_words(c: Column, least: int = 5) -> Column:
    """Distinct folded words of at least ``least`` letters."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(fold(c), F.lit("([a-z]+)"), 1), lambda w: F.length(w) >= least)))


def act_number_form(c: Column) -> Column:
    """A number such as 2011/45 or 96/06 as an array of integers, a year of two digits completed; null for no number."""
    parts = F.transform(F.regexp_extract_all(c, F.lit("([0-9]+)"), 1), lambda x: x.cast("bigint"))
    year = F.element_at(parts, 1)
    whole = F.when(F.size(parts) < 2, parts).when(year < 100, F.concat(F.array(F.when(year < 50, year + 2000).otherwise(year + 1900)), F.slice(parts, 2, 10))).otherwise(parts)
    return F.when(F.size(parts) > 0, whole)


def text_name(c: Column) -> Column:
    """A text's name for comparison: folded, dates and articles out, words apart by one blank."""
    n = F.regexp_replace(fold(c), r"\b(?:du|of) [0-9]{1,2}(?:er)? [a-z]+ [0-9]{4}", " ")
    n = F.regexp_replace(n, r"[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), n, F.lit(" ")), r" (?:(?:le|la|les|l|du|de|des|d|the|of|a|an|et|and) )+", " "), r" +", " "))


def canonical_markers(c: Column) -> Column:
    """Article markers at the beginning of a line without heading marks, bullets, numbering or emphasis, and with 1er for ler."""
    c = F.regexp_replace(c, r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", "")
    c = F.regexp_replace(c, r"(?im)^(?:[ \t]*(?:[-*•■>]|[0-9]{1,3}\.)[ \t]+)?(?:\*\*)?(article|art\.)[ \t]*", "$1 ")
    c = F.regexp_replace(c, r"(?im)^(article|art\.) l(er|ère)\b", "$1 1$2")
    return F.regexp_replace(c, r"(?im)^((?:article|art\.) [0-9]+(?:er|bis|ter)?)\*\*", "$1")


def is_watermark(c: Column) -> Column:
    """A line that holds nothing but an address on the web or a copy notice, bare or as the only cells of a table row."""
    mark = r"(?i)^(?:(?:https?://)?www\.[a-z0-9./-]+|copie certifi[ée]e conforme|certified true copy)$"
    cells = F.filter(F.transform(F.split(F.regexp_replace(F.trim(c), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce((F.size(cells) > 0) & F.forall(cells, lambda x: x.rlike(mark)), F.lit(False))


RULE = r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$"


def without_orphan_rules(lines: Column) -> Column:
    """Table rules without a table row right before or after them dropped."""
    row = lambda x: F.coalesce(F.ltrim(x).startswith("|") & ~x.rlike(RULE), F.lit(False))
    near = lambda i: row(F.get(lines, i - 1)) | row(F.get(lines, i + 1))
    return F.filter(lines, lambda x, i: ~x.rlike(RULE) | near(i))


def clean_markdown(c: Column) -> Column:
    """Watermark lines and orphan rules out, markers canonical, three blank lines at most."""
    kept = without_orphan_rules(F.filter(F.split(c, "\n"), lambda x: ~is_watermark(x)))
    return F.regexp_replace(F.regexp_replace(canonical_markers(F.array_join(kept, "\n")), r"\n{4,}", "\n\n\n"), r"^\s+|\s+$", "")


def for_chunking(c: Column) -> Column:
    """Markdown made plain: comments, heading marks and emphasis out, the commonest entities decoded, spaced capitals joined."""
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    c = F.regexp_replace(c, r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", "")
    c = F.regexp_replace(c, r"(\*\*|__)([^*_\n]+)(?:\*\*|__)", "$2")
    return F.regexp_replace(c, r"(?<=(?<![A-Za-zÀ-ÿ])[A-ZÀ-Þ]) (?=[A-ZÀ-Þ](?![A-Za-zÀ-ÿ]))", "")


# Lines of a printed volume that carry no law.
ADMINISTRATIVE = [r"(?im)^[ \t]*(?:copie certifi[ée]e conforme|certified true copy).*$", r"(?im)^[ \t]*(?:visa n°|le visa|visa de|enregistr[ée] sous le n°).*$", r"(?im)^[ \t]*(?:ampliations?|copies?)[ \t]*:.*$", r"(?im)^[ \t]*(?:tel|t[ée]l|fax|b\.?p\.?|e-?mail)[ .:°].*$"]


def clean_ocr_text(c: Column) -> Column:
    """All four stages: signs unified, administrative lines, page marks and watermarks out, spacing and punctuation mended."""
    c = F.translate(c, "’‘‚“”„–—−  \t", "'''\"\"\"---   ")
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("…", "...")):
        c = F.replace(c, F.lit(a), F.lit(b))
    for p in ADMINISTRATIVE:
        c = F.regexp_replace(c, p, "")
    c = F.regexp_replace(c, r"(?im)^[ ]*(?:- ?[0-9]{1,4} ?-|\[[0-9]{1,4}\]|page [0-9]{1,4}(?: ?/ ?[0-9]{1,4})?|[0-9]{1,4})[ ]*$", "")
    c = F.regexp_replace(c, r"(?im)^[ ]*(?:https?://)?www\.[a-z0-9./-]+[ ]*$", "")
    c = F.regexp_replace(c, r"[ ]+", " ")
    c = F.regexp_replace(c, r" +([,.])", "$1")
    c = F.regexp_replace(c, r"([,;])([A-Za-zÀ-ÿ])", "$1 $2")
    c = F.regexp_replace(F.regexp_replace(c, r"(?m)^ +| +$", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^[ \n]+|[ \n]+$", "")


def merge_blocks(blocks: Column) -> Column:
    """Every block cleaned, blank ones left out, joined by a blank line."""
    return F.array_join(F.filter(F.transform(blocks, clean_ocr_text), lambda x: x != ""), "\n\n")


def for_language(c: Column) -> Column:
    """A text as language detection reads it: article numbers out, white space collapsed, the first 5000 characters."""
    c = F.regexp_replace(c, r"(?im)^[ \t]*(?:article|art\.|section)[ \t]+[^ \n]{1,8}[ \t]*[.:-]*", " ")
    return F.substring(F.trim(F.regexp_replace(c, r"[ \n\t]+", " ")), 1, 5000)


def language_vote(first: Column, p: Column, second: Column, q: Column, other: str = "fr") -> Column:
    """struct(language, confidence) of two detectors: agreement takes the higher confidence and .05 (up to .99), else the surer, the first on a tie;
    a language other than fr and en counts as ``other`` at half the confidence."""
    agreed = F.least(F.greatest(p, q) + 0.05, F.lit(0.99))
    picked = F.when(second.isNull() | (first == second), first).when(first.isNull() | (q > p), second).otherwise(first)
    sure = F.when(first.isNull() & second.isNull(), F.lit(0.0)).when(first == second, agreed).when(first.isNull(), q).when(second.isNull(), p).otherwise(F.greatest(p, q))
    return F.struct(F.when(picked.isin("fr", "en"), picked).when(picked.isNotNull(), F.lit(other)).alias("language"), F.round(F.when(picked.isin("fr", "en"), sure).otherwise(sure / 2), 4).alias("confidence"))


def language_or_guess(detected: Column, text: Column) -> Column:
    """struct(language, confidence): the detector's, else fr where one of a few French words stands in the text, else en, both at .75."""
    french = F.lower(text).rlike(r" (?:le|la|les|des|une|dans) ")
    return F.when(detected.isNotNull(), F.struct(detected.alias("language"), F.lit(1.0).alias("confidence"))).otherwise(F.struct(F.when(french, "fr").otherwise("en").alias("language"), F.lit(0.75).alias("confidence")))
