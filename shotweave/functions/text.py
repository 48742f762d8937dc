"""Text expressions: folding, lexemes, trigrams, distinctive query words."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _plain_letters() -> dict[str, str]:
    """Lower-case Latin letters with marks and the letter below the marks, by canonical decomposition."""
    ranges = [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]
    parts = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in ranges}
    return {c: p for c, p in parts.items() if p.isascii() and p.isalpha() and c == c.lower()}


# Letters that have no decomposition, and those that fold to two letters.
STROKED, PAIRS = {"ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ŧ": "t", "ı": "i"}, {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
_LETTERS = _plain_letters() | STROKED
ACCENTED, PLAIN = "".join(_LETTERS), "".join(_LETTERS.values())
MARKS = "[\u0300-\u036f]"
# Query words without content.
STOP_WORDS = """
a an the and or of in on at to for with by from
is are was were be been being as that this these those
it its he she they them his her their there here
some someone somebody something person people man woman men women
shows showing shown seen sees video shot scene frame clip
while during then into onto over under near next past up
down out off about very more most also not no
""".split()
MIN_TOKEN = 3


def fold_text(s: Column) -> Column:
    """Lower case without accents: marks go, letters with marks and ligatures become plain ones.

    A text of as many bytes as characters is ASCII, where lower case is all there is to do.
    """
    out = F.translate(F.regexp_replace(F.lower(s), MARKS, ""), ACCENTED, PLAIN)
    for letter, two in PAIRS.items():
        out = F.replace(out, F.lit(letter), F.lit(two))
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(out)


def lexemes(s: Column) -> Column:
    """Folded words of letters and digits, in order."""
    return F.regexp_extract_all(fold_text(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def cover_rank(n: Column) -> Column:
    """r / (r + 1) with r = 0.1 per occurrence: 1 gives 0.0909, 2 give 0.1667."""
    return n * 0.1 / (n * 0.1 + 1)


def trigrams(s: Column) -> Column:
    """Distinct 3-grams of the folded words, each padded by two blanks before and one after; a word is cut once, however often it stands."""
    padded = F.transform(F.array_distinct(lexemes(s)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared ones of all different trigrams of both; 0 without any."""
    x, y = trigrams(a), trigrams(b)
    both = F.array_size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both, F.array_size(x) + F.array_size(y) - both), F.lit(0.0))


def distinctive_tokens(s: Column) -> Column:
    """Capitalised words after the first, or else all words of three or more characters; never stop words."""
    words = F.regexp_extract_all(s, F.lit(r"[\p{L}]+|[0-9]+"), F.lit(0))
    stop = F.array(*map(F.lit, STOP_WORDS))
    useful = lambda w: ~F.array_contains(stop, F.lower(w))
    proper = F.filter(words, lambda w, i: (i > 0) & w.rlike(r"^\p{Lu}") & useful(w))
    plain = F.filter(words, lambda w: (F.length(w) >= MIN_TOKEN) & useful(w))
    return F.array_distinct(F.transform(F.when(F.size(proper) > 0, proper).otherwise(plain), F.lower))
