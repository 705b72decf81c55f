"""Normal forms of text and of names, and how alike two of them are, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Fixed values.
ENDINGS = ("ami", "ach", "owi", "ego", "emu", "ich", "ymi", "iej", "ą", "ę", "em", "om", "ie", "im", "ym", "y", "i", "a", "e", "u", "o")
DIACRITICS = ("ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "acelnoszzACELNOSZZ")
STEM = 4
DIGIT_TYPES = ("PESEL", "NIP", "REGON", "POLISH_BANK_ACCOUNT")
NAME_TYPES = ("PERSON", "LOCATION")


def nfc(c: Column) -> Column:
    """For sources that may hold decomposed letters; nothing built in composes them."""

    def composed(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    composed.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return pandas_udf(composed, "string")(c)


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]+", "")


def strip_separators(c: Column) -> Column:
    return F.regexp_replace(c, "[ -]", "")


def collapse(c: Column) -> Column:
    # a single space stays as it is, so that a text is not put together anew word by word
    return F.trim(F.regexp_replace(c, r"(?U)[^\S ]\s*| \s+", " "))


#: Decomposed Polish letters: a letter, its mark, and both in one.
COMPOSED = tuple((b, m, x) for m, pairs in (("\u0328", "aąeęAĄEĘ"), ("\u0301", "cćnńoósśzźCĆNŃOÓSŚZŹ"), ("\u0307", "zżZŻ")) for b, x in zip(pairs[::2], pairs[1::2], strict=True))


def composed_polish(c: Column) -> Column:
    """Polish letters as single characters, whatever form they came in; `nfc` does so for all letters, in Python."""
    out = c
    for base, mark, letter in COMPOSED:
        out = F.replace(out, F.lit(base + mark), F.lit(letter))
    return F.when(has_marks(c), out).otherwise(c)


def has_marks(c: Column) -> Column:
    """Whether there may be something for `composed_polish` to compose."""
    return c.rlike("[\u0301\u0307\u0328]")


def normalize(c: Column) -> Column:
    return collapse(F.lower(composed_polish(c)))


def fold_diacritics(c: Column) -> Column:
    return F.translate(normalize(c), *DIACRITICS)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+"), 0)


def stem(c: Column) -> Column:
    """Without the longest ending that leaves four letters at least; no two of a length fit one word."""
    return F.regexp_replace(normalize(c), f"(?s)^(.{{{STEM},}}?)(?:{'|'.join(ENDINGS)})$", "$1")


def stems_shared(a: Column, b: Column) -> Column:
    """The shorter stem begins the longer; below four letters the forms must be equal."""
    x, y = stem(a), stem(b)
    short = (F.length(x) < STEM) | (F.length(y) < STEM)
    return F.when(short, normalize(a) == normalize(b)).otherwise(F.when(F.length(x) <= F.length(y), F.startswith(y, x)).otherwise(F.startswith(x, y)))


def similarity(a: Column, b: Column) -> Column:
    x, y = normalize(a), normalize(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(x, y) / longest)


def bounded_distance(a: Column, b: Column, most: int = 2) -> Column:
    """Edit distance of the lower-cased forms, null beyond the bound."""
    return F.nullif(F.levenshtein(F.lower(a), F.lower(b), most), F.lit(-1))


def title_words(c: Column) -> Column:
    """First letters raised, the rest as they are."""
    return F.array_join(F.transform(F.split(collapse(c), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def mapping_key(kind: Column, text: Column, lemma: Column) -> Column:
    """Names go by lemma, numbers by digits, all else by collapsed lower-case text."""
    return F.when(kind.isin(*NAME_TYPES), F.lower(F.trim(F.coalesce(lemma, text)))).when(kind.isin(*DIGIT_TYPES), digits_only(text)).otherwise(normalize(text))


def token_subset(a: Column, b: Column) -> Column:
    """Whether the words of one are among the words of the other; never for a text without words."""
    x, y = (F.filter(F.split(normalize(c), " "), lambda w: w != "") for c in (a, b))
    either = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return (F.size(x) > 0) & (F.size(y) > 0) & either
