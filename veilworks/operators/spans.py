"""Detection of personal data: typed character spans from patterns, with scores, context, overlaps and thresholds.

Everything up to the resolved spans of a document is one projection over its row; nothing is shuffled. Offsets are
code points, [start, end).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from veilworks.functions import identifiers as ids
from veilworks.functions import phones
from veilworks.functions.surface import digits_only, strip_separators
from veilworks.sources.shared import small_batches

SPAN = (
    "struct<entity_type:string,start:int,end:int,score:double,text:string,"
    "metadata:struct<gender:string,birth_date:date,variant:string,format:string,mod97_valid:boolean,normalized:string,"
    "checksum_valid:boolean,has_street:boolean,postal_code:string,kind:string>,lemma:string,case:string>"
)
META = ("gender", "birth_date", "variant", "format", "mod97_valid", "normalized", "checksum_valid", "has_street", "postal_code", "kind")

# Scores and labels.
VALID, INVALID = 0.80, 0.30
CONTEXT_BONUS, CEILING, CONTEXT_WORDS = 0.20, 0.99, 5
NAME_SCORE = 0.85
THRESHOLDS = {"PESEL": 0.25, "NIP": 0.25, "REGON": 0.25, "POLISH_BANK_ACCOUNT": 0.25, "POLISH_ADDRESS": 0.35, "DATE_TIME": 0.30, "PERSON": 0.40, "LOCATION": 0.40, "EMAIL_ADDRESS": 0.40, "PHONE_NUMBER": 0.40}
DEFAULT_THRESHOLD = 0.30
#: Characters before a span in which context words are looked for first.
NEAR = 120
#: Canonical names, and the labels that mean them.
CANONICAL = ("PERSON", "LOCATION", "ADDRESS", "PESEL", "NIP", "REGON", "BANK_ACCOUNT", "EMAIL_ADDRESS", "PHONE_NUMBER", "DATE_TIME")
ALIASES = {**{c: c for c in CANONICAL}, "POLISH_ADDRESS": "ADDRESS", "POLISH_BANK_ACCOUNT": "BANK_ACCOUNT", "NRB": "BANK_ACCOUNT", "IBAN": "BANK_ACCOUNT", "IBAN_CODE": "BANK_ACCOUNT"}
STRUCTURED = ("PESEL", "NIP", "REGON", "BANK_ACCOUNT", "EMAIL_ADDRESS", "PHONE_NUMBER")
MONTHS = "stycznia|lutego|marca|kwietnia|maja|czerwca|lipca|sierpnia|września|października|listopada|grudnia"


@dataclass(frozen=True)
class Recognizer:
    """One type of span. score and metadata are made from the matched text."""

    kind: str
    patterns: Sequence[tuple[str, float]]
    context: Sequence[str] = ()
    valid: Callable[[Column], Column] | None = None
    metadata: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    guard: str = ""  # without a match of this there is none of the patterns
    keep: Callable[[Column], Column] | None = None
    digits: int = 0  # matches lie in runs of digits and SEPARATORS and have so many digits at least; 0: they may lie anywhere


#: What may stand between the digits of a number, and letters that may stand in front of it.
SEPARATORS, PREFIX = r"().+\- ", 3


# The patterns of addresses, here and in the table below those of all types.
_W = r"[A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż.\-]+"
_CITY_WORD = r"[A-ZĄĆĘŁŃÓŚŹŻ][A-Za-ząćęłńóśźżĄĆĘŁŃÓŚŹŻ\-]+"
_POSTAL = r"\d{2}-\d{3}"
_STREET = r"(?:ul\.|al\.|pl\.|os\.)"
_CITY = rf"{_CITY_WORD}(?:\s+{_CITY_WORD})?"


def _number(kind: str, patterns: Sequence[str], context: Sequence[str], valid: Callable[[Column], Column], **more: Callable[[Column], Column]) -> Recognizer:
    meta = {"normalized": digits_only, "checksum_valid": lambda t: valid(digits_only(t)), **more}
    return Recognizer(kind, [(p, INVALID) for p in patterns], context, lambda t: valid(digits_only(t)), meta, r"[0-9]{2}", digits=9)


RECOGNIZERS: tuple[Recognizer, ...] = (
    _number("PESEL", [r"\b\d{11}\b"], ["pesel"], ids.pesel_valid, gender=lambda t: ids.pesel_gender(t), birth_date=lambda t: ids.pesel_birth_date(t)),
    _number("NIP", [r"\b\d{10}\b", r"\b\d{3}-\d{3}-\d{2}-\d{2}\b", r"\b\d{3}-\d{2}-\d{2}-\d{3}\b"], ["nip", "vat"], ids.nip_valid),
    _number("REGON", [r"\b\d{14}\b", r"\b\d{9}\b"], ["regon"], ids.regon_valid, variant=lambda t: F.length(digits_only(t)).cast("string")),
    _number(
        "POLISH_BANK_ACCOUNT", [r"\b(?:PL)?\d{26}\b", r"\b(?:PL[ ]?)?\d{2}(?:[ ]\d{4}){6}\b"], ["rachunek", "konto", "iban", "nr"], ids.account_valid,
        format=lambda t: F.when(F.upper(strip_separators(t)).startswith("PL"), "IBAN").otherwise("NRB"), mod97_valid=lambda t: ids.account_valid(digits_only(t)),
    ),
    Recognizer(
        "POLISH_ADDRESS",
        [(rf"{_STREET}\s+{_W}(?:\s+{_W}){{0,3}}\s+\d+[A-Za-z]?(?:\s*/\s*\d+)?(?:[,\s]+{_POSTAL}\s+{_CITY})?", 0.60), (rf"\b{_POSTAL}\s+{_CITY}", 0.40)],
        ["adres", "zamieszkały", "siedziba", "ulica"],
        metadata={"has_street": lambda t: t.rlike(rf"^{_STREET}"), "postal_code": lambda t: F.nullif(F.regexp_extract(t, _POSTAL, 0), F.lit(""))},
        guard=r"(?i)ul\.|al\.|pl\.|os\.|[0-9]{2}-[0-9]{3}",
    ),
    Recognizer(
        "DATE_TIME",
        [(r"\b\d{1,2}[.\-]\d{1,2}[.\-]\d{4}\b", 0.60)],
        ["data", "dnia"],
        metadata={"kind": lambda t: F.lit("numeric")},
        digits=6,
    ),
    Recognizer(
        "DATE_TIME",
        [(rf"\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}(?:\s*r\.)?", 0.55)],
        ["data", "dnia"],
        metadata={"kind": lambda t: F.lit("worded")},
        guard=rf"(?i){MONTHS}",
    ),
    Recognizer("EMAIL_ADDRESS", [(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}\b", 0.99)], (), guard="@"),
    # digits and separators that can be a Polish number: nine digits, or more with the country's prefix
    Recognizer(
        "PHONE_NUMBER", [(r"(?<![\w+])(?:(?:\+48|0048)[ \-]?)?\(?\d{2,3}\)?(?:[ \-]?\d{2,3}){2,3}(?!\w)", 0.40)], ["tel", "telefon", "kom"], digits=9,
        keep=phones.is_possible, metadata={"normalized": phones.national, "kind": phones.kind},
    ),
)


def with_suffixes(suffixes: Sequence[str], recognizers: Sequence[Recognizer] = RECOGNIZERS) -> tuple[Recognizer, ...]:
    """The recognizers, of which that of mail addresses asks for a domain under one of the suffixes, such as those of a public list."""
    held = F.array(*[F.lit(x.lower().lstrip(".")) for x in suffixes]) if suffixes else F.array().cast("array<string>")
    labels = lambda t: F.split(F.lower(F.substring_index(t, "@", -1)), r"\.")
    # what is behind each dot of the domain
    ends = lambda t: F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels(t)), F.lit(2))), lambda i: F.array_join(F.slice(labels(t), i, F.size(labels(t))), "."))
    return tuple(replace(r, keep=lambda t: F.arrays_overlap(ends(t), held)) if r.kind == "EMAIL_ADDRESS" else r for r in recognizers)


def _bind(value: str, name: str, body: str) -> str:
    """SQL: body, in which name stands for the value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: SQL: where the matches z.m end, that lie between the pieces z.b. Sums run in blocks of about the root of their number, because
#: an array that a fold appends to is copied each time.
_ENDS = _bind(
    "named_struct('l', transform(z.m, (x, i) -> length(z.b[i]) + length(x)), 'k', cast(ceil(sqrt(size(z.m))) as int))", "y",
    _bind(
        """aggregate(sequence(0, cast((size(y.l) - 1) div y.k as int)), named_struct('p', 0, 'o', cast(array() as array<int>)), (a, j) -> named_struct(
            'p', a.p + aggregate(slice(y.l, j * y.k + 1, y.k), 0, (s, v) -> s + v), 'o', concat(a.o, array(a.p)))).o""", "f",
        """flatten(transform(f, (p, j) -> aggregate(slice(y.l, j * y.k + 1, y.k), named_struct('p', p, 'o', cast(array() as array<int>)), (a, v) -> named_struct(
            'p', a.p + v, 'o', concat(a.o, array(a.p + v)))).o))""",
    ),
)


def _pieces(text: str, pattern: str) -> str:
    """SQL: m, all matches, and b, what lies before, between and behind them."""
    p = "r'(?imsuU)" + pattern.replace("'", r"\x27") + "'"
    return f"named_struct('m', regexp_extract_all({text}, {p}, 0), 'b', split({text}, {p}))"


def _matches(text: str, pattern: str, guard: str) -> str:
    """SQL: places and texts of all matches. What lies between matches and the matches add up to the offsets."""
    made = _bind(_ENDS, "e", "transform(z.m, (x, i) -> named_struct('start', e[i] - length(x), 'end', e[i], 'text', x))")
    none = "cast(array() as array<struct<start:int,end:int,text:string>>)"
    inner = _bind(_pieces(text, pattern), "z", f"if(size(z.m) = 0, {none}, {made})")
    g = "r'" + guard.replace("'", r"\x27") + "'"
    return f"if({text} is null{f' or not {text} rlike {g}' if guard else ''}, {none}, {inner})"


def regex_spans(text: str, pattern: str, guard: str = "") -> Column:
    """Array of (start, end, text) of every match in the named column; null text has none."""
    return F.expr(_matches(f"`{text}`", pattern, guard))


def clamp(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(CEILING))


def _words_before(text: Column, start: Column) -> Column:
    """The last words before the place."""
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), 0)
    near = tokens(F.substring(text, F.greatest(start - NEAR, F.lit(0)) + 1, F.least(start, F.lit(NEAR))))
    # of more words than are asked for, the last are whole; if so few are near, all that stands before is read
    found = F.when((start <= NEAR) | (F.size(near) > CONTEXT_WORDS), near).otherwise(tokens(F.substring(text, F.lit(1), start)))
    return F.slice(F.concat(F.array(*[F.lit("")] * CONTEXT_WORDS), found), -CONTEXT_WORDS, CONTEXT_WORDS)


def context_near(text: Column, start: Column, words: Sequence[str]) -> Column:
    """Whether one of the last words before the place holds one of the given."""
    return F.exists(_words_before(text, start), lambda t: _any(t, words)) if words else F.lit(False)


def _any(token: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(token, F.lit(w))
    return out


_FOUND = "array<struct<r:int,base:double,start:int,end:int,text:string>>"


def numbers(text: str, recognizers: Sequence[tuple[int, Recognizer]]) -> Column:
    """Matches of all recognizers of numbers, as _FOUND, from one scan for runs of digits and separators.

    A run has as many digits as it has; only patterns that ask for no more are tried, and only there. A pattern's matches
    are those that it has in the whole text, since none reaches beyond a run but for letters in front.
    """
    least = min(r.digits for _, r in recognizers)
    tried = [(i, r.digits, pattern, base) for i, r in recognizers for pattern, base in r.patterns]

    def scan(texts: pd.Series) -> pd.Series:
        run = re.compile(rf"[+(]?\d[\d{SEPARATORS}]*")
        patterns = [(i, n, re.compile(p, re.IGNORECASE | re.MULTILINE | re.DOTALL), base) for i, n, p, base in tried]

        def one(t: str | None) -> list[dict]:
            out, before = [], 0
            for m in run.finditer(t or ""):
                digits = sum(map(str.isdecimal, m[0]))
                if digits >= least:
                    where = max(before, m.start() - PREFIX), min(len(t), m.end() + 2)
                    out += [{"r": i, "base": base, "start": x.start(), "end": x.end(), "text": x[0]} for i, n, p, base in patterns if n <= digits for x in p.finditer(t, *where)]
                before = m.end()
            return out

        return pd.Series([one(t) for t in texts], dtype=object)

    scan.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return pandas_udf(scan, _FOUND)(F.col(text))


def recognized(text: str, recognizers: Sequence[Recognizer]) -> Column:
    """Array of SPAN of all recognizers, scored and clamped."""

    def marked(i: int, base: float) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(i).alias("r"), F.lit(base).alias("base"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))

    named = list(enumerate(recognizers))
    lexed = [(i, r) for i, r in named if r.digits]
    found = [numbers(text, lexed)] if lexed else []
    for i, r in named:
        if not r.digits:
            found += [F.transform(regex_spans(text, p, r.guard), marked(i, base)).cast(_FOUND) for p, base in r.patterns]
    both = F.concat(*found) if found else F.array().cast(_FOUND)

    def choose(x: Column, values: list[tuple[int, Column]], otherwise: Column) -> Column:
        out = None
        for i, v in values:
            out = F.when(x["r"] == i, v) if out is None else out.when(x["r"] == i, v)
        return otherwise if out is None else out.otherwise(otherwise)

    kept = [(i, r) for i, r in named if r.keep is not None]
    if kept:
        both = F.filter(both, lambda x: choose(x, [(i, r.keep(x["text"])) for i, r in kept], F.lit(True)))

    def make(x: Column) -> Column:
        t = x["text"]
        score = choose(x, [(i, F.when(r.valid(t), F.lit(VALID)).otherwise(F.lit(INVALID))) for i, r in named if r.valid], x["base"])
        known = [(i, r.context) for i, r in named if r.context]
        near = F.exists(_words_before(F.col(text), x["start"]), lambda w: choose(x, [(i, _any(w, words)) for i, words in known], F.lit(False))) if known else F.lit(False)
        score = score + F.when(near, CONTEXT_BONUS).otherwise(0.0)
        meta = F.struct(*[choose(x, [(i, r.metadata[m](t)) for i, r in named if m in r.metadata], F.lit(None)).alias(m) for m in META])
        kind = F.element_at(F.array(*[F.lit(r.kind) for r in recognizers]), x["r"] + 1)
        return F.struct(kind.alias("entity_type"), x["start"].alias("start"), x["end"].alias("end"), clamp(score).alias("score"), t.alias("text"), meta.alias("metadata"), F.lit(None).alias("lemma"), F.lit(None).alias("case")).cast(SPAN)

    return F.transform(both, make) if recognizers else F.array().cast(f"array<{SPAN}>")


def resolve_overlaps(spans: Column) -> Column:
    """Without those that lie inside another; containment is transitive, so one pass in order of start suffices.

    Of equal places the higher score, then the lesser type stays. Partial overlaps stay.
    """
    order = F.transform(spans, lambda x: F.struct(x["start"].alias("a"), (-x["end"]).alias("b"), (-x["score"]).alias("c"), x["entity_type"].alias("d"), x.alias("x")))
    held = F.struct(F.array_sort(order).alias("s"), F.ceil(F.sqrt(F.size(order))).cast("int").alias("k"))
    return F.transform(F.array(held), lambda y: F.when(y["k"] <= 0, F.array().cast(f"array<{SPAN}>")).otherwise(_not_inside(y["s"], y["k"])))[0]


def _not_inside(ordered: Column, k: Column) -> Column:
    """Of ordered spans those that end behind all before them: greatest ends are carried from block to block of about the
    root of their number, because an array that a fold appends to is copied each time."""
    block = lambda j: F.slice(ordered, j * k + 1, k)
    blocks = F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / k).cast("int"))
    ends = F.transform(blocks, lambda j: F.array_max(F.transform(block(j), lambda y: y["x"]["end"])))
    start = F.struct(F.lit(-1).alias("m"), F.array().cast("array<int>").alias("o"))
    reach = F.aggregate(ends, start, lambda acc, e: F.struct(F.greatest(acc["m"], e).alias("m"), F.concat(acc["o"], F.array(acc["m"])).alias("o")))["o"]

    def kept(before: Column, j: Column) -> Column:
        first = F.struct(before.alias("m"), F.array().cast(f"array<{SPAN}>").alias("o"))
        return F.aggregate(block(j), first, lambda acc, y: F.struct(F.greatest(acc["m"], y["x"]["end"]).alias("m"), F.when(y["x"]["end"] > acc["m"], F.concat(acc["o"], F.array(y["x"]))).otherwise(acc["o"]).alias("o")))["o"]

    return F.flatten(F.transform(reach, kept))


def merge_partial(spans: Column) -> Column:
    """A further mode: of spans that overlap in part, in order, the later is dropped, so that splices can't clash."""
    start = F.struct(F.lit(-1).alias("m"), F.array().cast(f"array<{SPAN}>").alias("o"))
    return F.aggregate(spans, start, lambda acc, x: F.when(x["start"] >= acc["m"], F.struct(x["end"].alias("m"), F.concat(acc["o"], F.array(x)).alias("o"))).otherwise(acc))["o"]


def above_threshold(spans: Column, table: dict[str, float] | None = None, default: float = DEFAULT_THRESHOLD) -> Column:
    """0 keeps all; 1 keeps none, since no score reaches it."""
    table = THRESHOLDS if table is None else table
    least = F.create_map(*[F.lit(v) for kv in table.items() for v in kv]) if table else F.create_map(F.lit(""), F.lit(0.0))
    return F.filter(spans, lambda x: x["score"] >= F.coalesce(F.try_element_at(least, x["entity_type"]), F.lit(default)))


def in_order(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] < b["end"], -1).when(a["end"] > b["end"], 1).otherwise(0))


def detect(df: DataFrame, text: str = "text", out: str = "entities", extra: Column | None = None, thresholds: dict[str, float] | None = None, default: float = DEFAULT_THRESHOLD, mode: str = "reference", recognizers: Sequence[Recognizer] = RECOGNIZERS) -> DataFrame:
    """Adds the array of spans. extra: further spans of SPAN, such as names; mode: "reference" or "merge".

    Overlaps go before thresholds: a long span of low score can remove a short one and then go itself.
    """
    small_batches(df.sparkSession)
    found = recognized(text, recognizers)
    df = df.withColumn("_spans", found if extra is None else F.concat(found, extra))
    blank = F.coalesce(F.col(text), F.lit("")).rlike(r"(?U)^\s*$")
    df = df.withColumn(out, F.when(blank, F.array().cast(f"array<{SPAN}>")).otherwise(in_order(above_threshold(resolve_overlaps(F.col("_spans")), thresholds, default))))
    if mode == "merge":
        df = df.withColumn(out, merge_partial(F.col(out)))
    return df.drop("_spans")


#: Slots of the sketch of first words. A gazetteer that fills them all leaves all runs to the join, as without it.
SLOTS = 1 << 16


def _slot(word: str) -> str:
    return f"pmod(xxhash64({word}), {SLOTS}L)"


def _first_words(gazetteer: DataFrame) -> DataFrame:
    """One row: _bits, an array of longs with a bit for the slot of each word that begins a surface."""
    words = gazetteer.select(F.regexp_extract("surface", r"^(?imsuU)\w+", 0).alias("w")).select(F.expr(_slot("w")).alias("slot")).distinct()
    parts = words.groupBy((F.col("slot") / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    held = parts.agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("m"))
    return held.select(F.transform(F.sequence(F.lit(0), F.lit(SLOTS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("_bits"))


def names_from_gazetteer(df: DataFrame, gazetteer: DataFrame, key: str, text: str = "text", words: int = 3) -> DataFrame:
    """key and spans of names: runs of up to `words` words that a gazetteer (surface, entity_type, lemma, case) holds.

    Runs are cut where a word begins a surface, by a sketch of those words. The stand-in for a language model; any DataFrame of (key, names: array of SPAN) can take its place. The planner
    chooses the join by the gazetteer's size.
    """
    run = lambda n: "concat(z.m[i]" + "".join(f", z.b[i + {k}], z.m[i + {k}]" for k in range(1, n)) + ")"
    runs = ", ".join(f"if(i + {n} <= size(z.m), named_struct('s', e[i] - length(z.m[i]), 'surface', {run(n)}), null)" for n in range(1, words + 1))
    # only runs whose first word begins a surface are made
    begins = f"(_bits[cast({_slot('z.m[i]')} div 64 as int)] & shiftleft(1L, cast({_slot('z.m[i]')} % 64 as int))) <> 0L"
    made = _bind(_ENDS, "e", f"flatten(transform(y, i -> filter(array({runs}), r -> r is not null)))")
    none = "cast(array() as array<struct<s:int,surface:string>>)"
    found = _bind(f"filter(sequence(0, size(z.m) - 1), i -> {begins})", "y", f"if(size(y) = 0, {none}, {made})")
    rows = df.select(key, text).join(F.broadcast(_first_words(gazetteer)), how="cross")  # one row of 8 KB
    grams = rows.select(key, F.explode(F.expr(_bind(_pieces(f"`{text}`", r"\w+"), "z", f"if(coalesce(size(z.m), 0) <= 0, {none}, {found})"))).alias("r"))
    grams = grams.select(key, F.col("r.s").alias("s"), F.col("r.surface").alias("surface"))
    hit = grams.join(gazetteer, "surface")
    span = F.struct(F.col("entity_type"), F.col("s").alias("start"), (F.col("s") + F.length("surface")).alias("end"), F.lit(NAME_SCORE).alias("score"), F.col("surface").alias("text"), F.struct(*[F.lit(None).alias(m) for m in META]).alias("metadata"), "lemma", "case").cast(SPAN)
    return hit.groupBy(key).agg(F.collect_list(span).alias("names"))


def words_of(text: str, words: int = 3) -> Column:
    """Array of (s, surface, before) of all runs of up to `words` capitalized words with spaces between them: where a run
    starts, its text, and the word in front of it, if only spaces lie between."""
    gap = lambda i: f"z.b[{i}] rlike r'(?U)^\\s+$'"
    capital = lambda i: f"z.m[{i}] rlike r'^\\p{{Lu}}'"
    run = lambda n: "concat(z.m[i]" + "".join(f", z.b[i + {k}], z.m[i + {k}]" for k in range(1, n)) + ")"
    fits = lambda n: " and ".join([f"i + {n} <= size(z.m)", *[f"{gap(f'i + {k}')} and {capital(f'i + {k}')}" for k in range(1, n)]])
    before = f"if(i > 0 and {gap('i')}, z.m[i - 1], null)"
    runs = ", ".join(f"if({fits(n)}, named_struct('s', e[i] - length(z.m[i]), 'surface', {run(n)}, 'before', {before}), null)" for n in range(1, words + 1))
    none = "cast(array() as array<struct<s:int,surface:string,before:string>>)"
    made = _bind(_ENDS, "e", f"flatten(transform(filter(sequence(0, size(z.m) - 1), i -> {capital('i')}), i -> filter(array({runs}), r -> r is not null)))")
    return F.expr(_bind(_pieces(f"`{text}`", r"\w+"), "z", f"if(coalesce(size(z.m), 0) <= 0, {none}, {made})"))


def canonical(label: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv]), label)


def exploded(df: DataFrame, *keep: str, spans: str = "entities") -> DataFrame:
    """Rows of spans. An inner explode would have its array tested, and so detected, once more in a filter below it."""
    return df.select(*keep, F.posexplode_outer(spans).alias("span_id", "x")).filter("span_id is not null").select(*keep, "span_id", "x.*")
