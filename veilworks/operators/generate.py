"""Synthetic values that are functions of seed, session and original, so that a rerun or a lost task changes nothing.

The generator draws from a keyed hash. The same rules exist as column expressions for values that need no session.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Container
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilworks.functions import identifiers as ids
from veilworks.functions.declension import forms, pattern_of, person_forms

MEN = "Jan Piotr Tomasz Adam Paweł Michał Rafał Robert Artur Konrad Wiktor Oskar Filip Igor Damian Kamil".split()
WOMEN = "Anna Ewa Maria Zofia Hanna Alicja Marta Joanna Barbara Irena Monika Beata Dorota Renata Iwona Wanda".split()
SURNAMES = "Nowak Wójcik Kowalczyk Mazur Krawczyk Pawlak Walczak Baran Szewczyk Pietrzak Wróbel Jasiński Sadowski Zawadzki Bielecki Malinowski Jaworski Górski Dudek Kubiak".split()
CITIES = "Kraków Gdańsk Poznań Wrocław Szczecin Lublin Toruń Olsztyn Rzeszów Warszawa Częstochowa Bydgoszcz Białystok Radom Gdynia".split()
STREETS = "Długa Krótka Polna Leśna Słoneczna Ogrodowa Lipowa Szkolna Kwiatowa Zielona".split()
DIGIT_LENGTHS = {"PESEL": 11, "NIP": 10, "REGON": 9, "POLISH_BANK_ACCOUNT": 26}


@dataclass
class Fake:
    kind: str
    base: str
    forms: dict[str, str] = field(default_factory=dict)


class Draw:
    """A stream of numbers from a key."""

    def __init__(self, *key: object):
        self.key, self.n = "\x1f".join(map(str, key)), 0

    def below(self, n: int) -> int:
        self.n += 1
        return int.from_bytes(hashlib.sha256(f"{self.key}\x1f{self.n}".encode("utf-8", "surrogatepass")).digest()[:8], "big") % n

    def of(self, values: list[str]) -> str:
        return values[self.below(len(values))]

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))


def _total(digits: str, weights: tuple[int, ...]) -> int:
    return sum(int(d) * w for d, w in zip(digits, weights, strict=True))


def _pesel(draw: Draw, gender: str | None) -> str:
    year, month, day = 1940 + draw.below(71), 1 + draw.below(12), 1 + draw.below(28)
    female = draw.below(2) == 0 if gender is None else gender == "female"
    ten = f"{year % 100:02d}{month + (20 if year >= 2000 else 0):02d}{day:02d}{draw.digits(3)}{2 * draw.below(5) + (0 if female else 1)}"
    return ten + str(-_total(ten, ids.PESEL_WEIGHTS) % 10)


def _nip(draw: Draw) -> str:
    while True:
        nine = str(1 + draw.below(9)) + draw.digits(8)
        if (last := _total(nine, ids.NIP_WEIGHTS) % 11) < 10:
            return nine + str(last)


def _regon(draw: Draw, long: bool) -> str:
    nine = draw.digits(8)
    nine += str(_total(nine, ids.REGON9_WEIGHTS) % 11 % 10)
    if not long:
        return nine
    more = nine + draw.digits(4)
    return more + str(_total(more, ids.REGON14_WEIGHTS) % 11 % 10)


def _account(draw: Draw) -> str:
    rest = draw.digits(24)
    return f"{(1 - int(rest + ids.COUNTRY + '00')) % 97:02d}{rest}"


def _date(draw: Draw, text: str) -> str:
    """The year moves by up to ten, never by none; the day fits every month."""
    year = re.search(r"[0-9]{4}", text)
    parts = re.search(r"([0-9]{1,2})[.\-/]([0-9]{1,2})[.\-/][0-9]{4}", text)
    day, month = (int(parts[1]), int(parts[2])) if parts else (1 + draw.below(28), 1 + draw.below(12))
    shift = draw.below(20) - 10
    moved = (int(year[0]) if year else 1960 + draw.below(51)) + (shift if shift < 0 else shift + 1)
    return f"{min(max(day, 1), 28):02d}.{min(max(month, 1), 12):02d}.{moved:04d}"


def generate(kind: str, draw: Draw, text: str = "", gender: str | None = None) -> Fake:
    """A value of the kind; an unknown kind gives the original back."""
    if kind == "PERSON":
        female = draw.below(2) == 0
        first, last = draw.of(WOMEN if female else MEN), draw.of(SURNAMES)
        if female and last.endswith(("ski", "cki", "dzki")):
            last = last[:-1] + "a"
        return Fake(kind, f"{first} {last}", person_forms(first, last, None if not female else "female"))
    if kind == "LOCATION":
        city = draw.of(CITIES)
        return Fake(kind, city, forms(city, pattern_of(city, None, "city")))
    if kind in ("POLISH_ADDRESS", "ADDRESS"):
        return Fake(kind, f"ul. {draw.of(STREETS)} {1 + draw.below(150)}, {draw.digits(2)}-{draw.digits(3)} {draw.of(CITIES)}")
    if kind == "EMAIL_ADDRESS":
        return Fake(kind, f"user{draw.digits(6)}@example.org")
    if kind == "PHONE_NUMBER":
        d = str(5 + draw.below(4)) + draw.digits(8)
        return Fake(kind, f"+48 {d[:3]} {d[3:6]} {d[6:]}")
    if kind == "DATE_TIME":
        return Fake(kind, _date(draw, text))
    if kind == "PESEL":
        return Fake(kind, _pesel(draw, gender))
    if kind == "NIP":
        return Fake(kind, _nip(draw))
    if kind == "REGON":
        return Fake(kind, _regon(draw, len(re.sub(r"\D", "", text)) == 14))
    if kind in ("POLISH_BANK_ACCOUNT", "BANK_ACCOUNT"):
        return Fake(kind, _account(draw))
    return Fake(kind, text)


#: Makes a value of (kind, draw, hint, gender); it may call `generate` for kinds that it doesn't know.
Builder = Callable[[str, Draw, str, str | None], Fake]


def mint(kind: str, key: str, used: Container[str], seed: str, text: str = "", gender: str | None = None, draws: int = 64, build: Builder = generate) -> Fake:
    """A value of `build` none of whose forms is used. Further draws come first; a forced suffix, which breaks forms, only last."""
    for n in range(draws):
        fake = build(kind, Draw(seed, kind, key, n), text, gender)
        if not any(form in used for form in (fake.base, *fake.forms.values())):
            return fake
    n = 2
    while f"{fake.base}{n}" in used:
        n += 1
    return Fake(kind, f"{fake.base}{n}")


# ---------------------------------------------------------------- over columns


def _hashed(key: Column, seed: int, salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), key), F.lit(n))


def phone_col(key: Column, seed: int = 0) -> Column:
    d = F.concat((F.lit(5) + _hashed(key, seed, "p0", 4)).cast("string"), F.lpad(_hashed(key, seed, "p1", 10**8).cast("string"), 8, "0"))
    return F.concat(F.lit("+48 "), F.substring(d, 1, 3), F.lit(" "), F.substring(d, 4, 3), F.lit(" "), F.substring(d, 7, 3))


def pesel_col(key: Column, seed: int = 0, female: Column | None = None) -> Column:
    female = _hashed(key, seed, "sex", 2) == 0 if female is None else female
    return ids.make_pesel(_hashed(key, seed, "y", 71) + 1940, _hashed(key, seed, "m", 12) + 1, _hashed(key, seed, "d", 28) + 1, _hashed(key, seed, "s", 10**4), female)


def account_col(key: Column, seed: int = 0) -> Column:
    rest = F.concat(*[F.lpad(_hashed(key, seed, f"a{i}", 10**8).cast("string"), 8, "0") for i in range(3)])
    return F.concat(ids.account_check_digits(rest), rest)
