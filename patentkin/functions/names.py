"""Applicant names brought to one spelling."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from patentkin.functions.text import present

# Legal-form words taken out of a name, as patterns. Forms that end in a dot
# are left out where a word has to end on a letter.
LEGAL_FORMS = (
    "inc", "incorporated", "corp", "corporation", "company", r"co\.?\s*ltd\.?", "co", "ltd", "limited",
    "llc", "llp", "plc", "gmbh", "mbh", "ag", "kg", "ohg",
    "sarl", "sas", "sa", "bv", "nv", "oy", "oyj", "ab", "as",
    "spa", r"s\.p\.a", "bvba", "aps", "kft",
    "sro", r"sp\.?\s*z\.?\s*o\.?\s*o\.?",
    "zao", "oao", "ooo",
    "pte", r"pte\.?\s*ltd", "ltda",
    "sl", "slu",
    "kk", r"kabushiki\s+kaisha",
    "holdings?", "group",
    r"sa\s*de\s*cv", r"s\.a\.\s*de\s*cv",
)

# Letters without a Unicode decomposition.
PLAIN_LETTERS = {"ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ł": "l", "ŋ": "n", "ŧ": "t"}
LETTER_PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij"}


def _accented_letters() -> dict[str, str]:
    """Lower-case Latin letters whose decomposition is one ASCII letter plus marks."""
    plain = dict(PLAIN_LETTERS)
    for point in [*range(0x00E0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(point)
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))
        if letter == letter.lower() and base != letter and len(base) == 1 and base.isascii():
            plain[letter] = base
    return plain


def unaccent(text: Column) -> Column:
    """Lower-case text with Latin letters in plain ASCII."""
    plain = _accented_letters()
    out = F.translate(text, "".join(plain), "".join(plain.values()))
    for letter, pair in LETTER_PAIRS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def _legal_form_pattern() -> str:
    # Java takes the first alternative that fits, so the longest ones come first.
    words = "|".join(sorted(LEGAL_FORMS, key=len, reverse=True))
    return rf"(?iU)(?<!\w)(?=\w)(?:{words})(?<=\w)(?!\w)"


def normalize_applicant(name: Column) -> Column:
    """Name in lower-case ASCII without legal forms and punctuation, NULL where nothing is left."""
    out = unaccent(F.lower(present(name)))
    out = F.replace(out, F.lit("&"), F.lit(" and "))
    out = F.regexp_replace(out, _legal_form_pattern(), " ")
    out = F.regexp_replace(out, r"(?U)^the\s+", "")
    out = F.regexp_replace(out, r"(?U)[^\p{Alnum}\s]+", " ")
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    return present(out)


def trigrams(name: Column) -> Column:
    """Distinct three-letter pieces of every word, padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(name), r"(?U)[^\p{Alnum}]+"), lambda w: w != "")

    def pieces(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        starts = F.sequence(F.lit(1), F.length(padded) - 2)
        return F.transform(starts, lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, pieces)))


def name_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both names."""
    ta, tb = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(ta, tb)) / F.nullif(F.size(F.array_union(ta, tb)), F.lit(0))
