"""The Polish numbering plan: what kind of number a prefix stands for. Numbers outside of the plan are possible ones still."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilworks.functions.surface import digits_only

#: Prefixes of national numbers of nine digits, longest match first. Fixed values.
PLAN = {
    "geographic": "12 13 14 15 16 17 18 22 23 24 25 29 32 33 34 41 42 43 44 46 48 52 54 55 56 58 59 61 62 63 65 67 68 71 74 75 76 77 81 82 83 84 85 86 87 89 91 94 95",
    "mobile": "45 50 51 53 57 60 66 69 72 73 78 79 88",
    "premium": "70",
    "toll_free": "800",
    "shared_cost": "801 804",
    "voip": "39",
    "corporate": "26 47",
}
LENGTH = 9


def national(text: Column) -> Column:
    """The digits without the country's prefix."""
    return F.regexp_replace(digits_only(text), r"^(?:00)?48(?=[0-9]{9}$)", "")


def is_possible(text: Column) -> Column:
    return F.length(national(text)) == LENGTH


def kind(text: Column) -> Column:
    """Name of the plan's range, `possible` for a number of the right length in none; null for another length."""
    held = {prefix: name for name, prefixes in PLAN.items() for prefix in prefixes.split()}
    table = F.create_map(*[F.lit(x) for pair in held.items() for x in pair])
    number = national(text)
    found = [F.try_element_at(table, F.substring(number, 1, n)) for n in sorted({len(p) for p in held}, reverse=True)]
    return F.when(is_possible(text), F.coalesce(*found, F.lit("possible")))
