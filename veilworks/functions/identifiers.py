"""Checksums, parts and generators of Polish identifiers, as column expressions over strings of digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public weights of each number.
PESEL_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
NIP_WEIGHTS = (6, 5, 7, 2, 3, 4, 5, 6, 7)
REGON9_WEIGHTS = (8, 9, 2, 3, 4, 5, 6, 7)
REGON14_WEIGHTS = (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8)
#: Country letters PL as digits, after which stand the check digits.
COUNTRY = "2521"


def _digit(d: Column, i: int) -> Column:
    return F.substring(d, i + 1, 1).try_cast("int")


def weighted_sum(d: Column, weights: tuple[int, ...]) -> Column:
    """Sum of digit times weight: a plain sum, so that it stays in generated code."""
    out = F.lit(0)
    for i, w in enumerate(weights):
        out = out + _digit(d, i) * w
    return out


def _shaped(d: Column, n: int) -> Column:
    return F.coalesce(d.rlike(f"^[0-9]{{{n}}}$"), F.lit(False))


def _valid(d: Column, n: int, control: Column) -> Column:
    return F.when(_shaped(d, n), control == _digit(d, n - 1)).otherwise(F.lit(False))


def pesel_control(d: Column) -> Column:
    return (F.lit(10) - weighted_sum(d, PESEL_WEIGHTS) % 10) % 10


def nip_control(d: Column) -> Column:
    """10 means that no such number exists."""
    return weighted_sum(d, NIP_WEIGHTS) % 11


def regon9_control(d: Column) -> Column:
    return weighted_sum(d, REGON9_WEIGHTS) % 11 % 10


def regon14_control(d: Column) -> Column:
    return weighted_sum(d, REGON14_WEIGHTS) % 11 % 10


def pesel_valid(d: Column) -> Column:
    return _valid(d, 11, pesel_control(d))


def nip_valid(d: Column) -> Column:
    return _valid(d, 10, nip_control(d))


def regon9_valid(d: Column) -> Column:
    return _valid(d, 9, regon9_control(d))


def regon14_valid(d: Column) -> Column:
    return _valid(d, 14, regon14_control(d))


def regon_valid(d: Column) -> Column:
    return F.when(F.length(d) == 14, regon14_valid(d)).otherwise(regon9_valid(d))


def mod97(d: Column) -> Column:
    return d.try_cast("decimal(38,0)") % F.lit(97).cast("decimal(38,0)")


def account_valid(d: Column) -> Column:
    moved = F.concat(F.substring(d, 3, 24), F.lit(COUNTRY), F.substring(d, 1, 2))
    return F.when(_shaped(d, 26), mod97(moved) == 1).otherwise(F.lit(False))


def account_check_digits(d24: Column) -> Column:
    rest = mod97(F.concat(d24, F.lit(COUNTRY + "00"))).cast("int")
    return F.lpad(F.pmod(F.lit(1) - rest, F.lit(97)).cast("string"), 2, "0")


def pesel_gender(d: Column) -> Column:
    return F.when(_shaped(d, 11), F.when(_digit(d, 9) % 2 == 0, "female").otherwise("male"))


def pesel_birth_date(d: Column) -> Column:
    """The month carries the century, 20 for each beyond 1900 and 80 for 1800; null if there is no such day."""
    code = F.substring(d, 3, 2).try_cast("int")
    century = F.element_at(F.array(*[F.lit(c) for c in (1900, 2000, 2100, 2200, 1800)]), (F.floor(code / 20) + 1).cast("int"))
    year = century + F.substring(d, 1, 2).try_cast("int")
    text = F.concat_ws("-", year.cast("string"), F.lpad((code % 20).cast("string"), 2, "0"), F.substring(d, 5, 2))
    return F.when(_shaped(d, 11) & (code % 20 >= 1) & (code % 20 <= 12), F.try_to_date(text, "yyyy-MM-dd"))


def make_pesel(year: Column, month: Column, day: Column, serial: Column, female: Column) -> Column:
    """serial: 0 to 9999; its last digit is made even for women and odd for men."""
    shift = F.when(year.between(1800, 1899), 80).when(year.between(2000, 2099), 20).when(year.between(2100, 2199), 40).when(year.between(2200, 2299), 60).otherwise(0)
    last = serial - serial % 2 + F.when(female, 0).otherwise(1)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    ten = F.concat(two(year % 100), two(month + shift), two(day), F.lpad(last.cast("string"), 4, "0"))
    return F.concat(ten, pesel_control(ten).cast("string"))
