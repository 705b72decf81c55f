"""Polish declension of names and cities by fixed endings, once as a table and twice read: for columns and for state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CASES = ("nom", "gen", "dat", "acc", "ins", "loc")
VOWELS = "aeiouyąęó"
#: For each pattern: how a word ends in the nominative, and the endings that stand in its place in the order of CASES. The
#: first that fits holds. Fixed values.
ENDINGS = {
    "ADJ_M": (("i", ("i", "iego", "iemu", "iego", "im", "im")),),
    "ADJ_F": (("a", ("a", "iej", "iej", "ą", "ą", "iej")),),
    "NOUN_F_A": (
        ("ka", ("ka", "ki", "ce", "kę", "ką", "ce")),
        ("ga", ("ga", "gi", "dze", "gę", "gą", "dze")),
        ("ńa", ("ńa", "ńy", "nie", "ńę", "ńą", "nie")),
        ("a", ("a", "y", "ie", "ę", "ą", "ie")),
    ),
    "NOUN_M_CONS": (
        ("ek", ("ek", "ka", "kowi", "ka", "kiem", "ku")),
        ("k", ("k", "ka", "kowi", "ka", "kiem", "ku")),
        ("g", ("g", "ga", "gowi", "ga", "giem", "gu")),
        ("ch", ("ch", "cha", "chowi", "cha", "chem", "chu")),
        ("ń", ("ń", "nia", "ńowi", "nia", "ńem", "niu")),
        ("", ("", "a", "owi", "a", "em", "ie")),
    ),
    "CITY_M": (
        ("ów", ("ów", "owa", "owowi", "ów", "owem", "owie")),
        ("k", ("k", "ka", "kowi", "k", "kiem", "ku")),
        ("g", ("g", "ga", "gowi", "g", "giem", "gu")),
        ("ch", ("ch", "cha", "chowi", "ch", "chem", "chu")),
        ("ń", ("ń", "ńa", "ńowi", "ń", "ńem", "niu")),
        ("", ("", "a", "owi", "", "em", "ie")),
    ),
    "CITY_F": (
        ("ka", ("ka", "ki", "ce", "kę", "ką", "ce")),
        ("ga", ("ga", "gi", "dze", "gę", "gą", "dze")),
        ("a", ("a", "y", "ie", "ę", "ą", "ie")),
    ),
    "INDECLINABLE": (("", ("", "", "", "", "", "")),),
}
ADJECTIVES = (("ADJ_M", ("ski", "cki", "dzki")), ("ADJ_F", ("ska", "cka", "dzka")))


def pattern_of(word: str, gender: str | None = None, kind: str = "person") -> str:
    low = word.lower()
    if not low:
        return "INDECLINABLE"
    if kind == "city":
        return "CITY_F" if low.endswith("a") else "CITY_M" if low.endswith("ów") or low[-1] not in VOWELS else "INDECLINABLE"
    for name, ends in ADJECTIVES:
        if low.endswith(ends):
            return name
    if low.endswith("a"):
        return "NOUN_F_A"
    return "INDECLINABLE" if gender == "female" or low[-1] in VOWELS else "NOUN_M_CONS"


def decline(word: str, pattern: str, case: str) -> str:
    if case == "nom":
        return word
    low = word.lower()
    for ending, by_case in ENDINGS[pattern]:
        if low.endswith(ending):
            return word[: len(word) - len(ending)] + by_case[CASES.index(case)]
    return word


def forms(word: str, pattern: str) -> dict[str, str]:
    return {c: decline(word, pattern, c) for c in CASES}


def person_forms(first: str, last: str, gender: str | None) -> dict[str, str]:
    """First name and surname decline each by its own pattern."""
    a, b = pattern_of(first, gender), pattern_of(last, gender)
    return {c: f"{decline(first, a, c)} {decline(last, b, c)}" for c in CASES}


# ---------------------------------------------------------------- the same table over columns


def pattern_col(word: Column, gender: Column | None = None, kind: str = "person") -> Column:
    low, last = F.lower(word), F.lower(F.substring(word, -1, 1))
    vowel = last.isin(*VOWELS)
    out = F.when(F.coalesce(F.length(word), F.lit(0)) == 0, "INDECLINABLE")
    if kind == "city":
        return out.when(last == "a", "CITY_F").when(low.endswith("ów") | ~vowel, "CITY_M").otherwise("INDECLINABLE")
    for name, ends in ADJECTIVES:
        hit = F.lit(False)
        for e in ends:
            hit = hit | low.endswith(e)
        out = out.when(hit, name)
    female = F.lit(False) if gender is None else F.coalesce(gender == "female", F.lit(False))
    return out.when(last == "a", "NOUN_F_A").when(female | vowel, "INDECLINABLE").otherwise("NOUN_M_CONS")


def decline_col(word: Column, pattern: Column, case: str) -> Column:
    if case == "nom":
        return word
    low, out = F.lower(word), None
    for name, rows in ENDINGS.items():
        for ending, by_case in rows:
            made = F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(by_case[CASES.index(case)]))
            hit = (pattern == name) & low.endswith(ending)
            out = F.when(hit, made) if out is None else out.when(hit, made)
    return out.otherwise(word)


def forms_col(word: Column, pattern: Column) -> Column:
    return F.create_map(*[x for c in CASES for x in (F.lit(c), decline_col(word, pattern, c))])
