"""Text rewriting: splices, restoration of originals, masks and templates.

Splices, restorations and blanked values are one pass over a text in Arrow batches: pieces are put together once, and an
automaton over all forms finds every place at which one stands. The rest are row-local expressions.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Fixed values.
MASKS = {"PERSON": "[OSOBA]", "LOCATION": "[MIEJSCOWOSC]", "ADDRESS": "[ADRES]", "PESEL": "[PESEL]", "NIP": "[NIP]", "REGON": "[REGON]", "BANK_ACCOUNT": "[NR_RACHUNKU]", "EMAIL_ADDRESS": "[EMAIL]", "PHONE_NUMBER": "[TELEFON]", "DATE_TIME": "[DATA]"}
OTHER_MASK = "[DANE]"


# ---------------------------------------------------------------- splices


def spliced(text: str, parts: Sequence[tuple[int, int, str]]) -> str:
    """The text with each (start, end, value) put in, by the offsets of the text; pieces are joined once. Where parts
    overlap, each is put in from the last to the first."""
    parts = sorted(parts)
    if all(a[1] <= b[0] for a, b in zip(parts, parts[1:])):  # noqa: B905
        out, at = [], 0
        for start, end, value in parts:
            out += (text[at:start], value)
            at = end
        return "".join((*out, text[at:]))
    for start, end, value in reversed(parts):
        text = text[:start] + value + text[end:]
    return text


def splice(text: str, parts: str) -> Column:
    """The named text with each (start, end, fake) of the named array put in; a null text, part or fake leaves null."""

    def put(texts: pd.Series, starts: pd.Series, ends: pd.Series, values: pd.Series) -> pd.Series:
        def one(t, a, b, v):
            if t is None or a is None or any(x is None for x in v):
                return None
            return spliced(t, list(zip(map(int, a), map(int, b), v, strict=True)))

        return pd.Series([one(*x) for x in zip(texts, starts, ends, values, strict=True)], dtype=object)

    put.__annotations__ = {"texts": pd.Series, "starts": pd.Series, "ends": pd.Series, "values": pd.Series, "return": pd.Series}
    field = lambda c: F.expr(f"transform({parts}, p -> p.{c})")
    return pandas_udf(put, "string")(F.col(text), field("start"), field("end"), field("fake"))


# ---------------------------------------------------------------- one pass over many forms


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Forms:
    """Values to be put in for forms, in order: what one form brings in, a later one may match.

    One pass of an automaton finds all places of all forms; by order, and in a form from the left, those are taken that
    overlap none taken before. That equals one substitution after another unless a value brings in, or completes, a
    later form, or changes what stands at the edge of its neighbours; forms of which this cannot be ruled out are `active`, and a
    text with such a form is rewritten form after form, of those that it holds.
    """

    def __init__(self, forms: Sequence[str], values: Sequence[str], whole: bool = True):
        self.whole, self.forms, self.values = whole, [], []
        place: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for form, value in zip(forms, values, strict=True):
            if form and form not in place:
                place[form] = len(self.forms)
                self.automaton.add_word(form, len(self.forms))
                self.forms.append(form)
                self.values.append(value)
        if self.forms:
            self.automaton.make_automaton()
        self._heads: set[str] | None = None
        self._tails: set[str] = set()
        self._active: dict[int, bool] = {}

    def places(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(form, start, end) of each place."""
        if not self.forms:
            return
        for last, i in self.automaton.iter(text):
            start, end = last + 1 - len(self.forms[i]), last + 1
            if not self.whole or ((start == 0 or not _in_word(text[start - 1])) and (end == len(text) or not _in_word(text[end]))):
                yield i, start, end

    def active(self, i: int) -> bool:
        if i not in self._active:
            if self._heads is None:
                # beginnings and ends of forms, cut where a word ends or starts
                cut = lambda f: [k for k in range(1, len(f)) if not (_in_word(f[k - 1]) and _in_word(f[k]))]
                self._heads = {f[:k] for f in self.forms for k in cut(f)}
                self._tails = {f[k:] for f in self.forms for k in cut(f)}
            form, value = self.forms[i], self.values[i]
            self._active[i] = (
                not value or _in_word(form[0]) != _in_word(value[0]) or _in_word(form[-1]) != _in_word(value[-1])
                or any(True for _ in self.places(value)) or any(value[k:] in self._heads or value[:k] in self._tails for k in range(len(value) + 1))
                or any(value in f for f in self.forms)
            )
        return self._active[i]

    def put(self, text: str) -> str:
        found = sorted(self.places(text))
        taken, chosen = bytearray(len(text)), []
        for i, start, end in found:
            if taken.find(1, start, end) < 0:
                taken[start:end] = b"\1" * (end - start)
                chosen.append((start, end, self.values[i]))
                if self.whole and self.active(i):
                    return self.one_by_one(text)
        return spliced(text, chosen)

    def one_by_one(self, text: str) -> str:
        todo, known = [], set()

        def look(after: int) -> None:
            for i, _, _ in self.places(text):
                if i > after and i not in known:
                    known.add(i)
                    heapq.heappush(todo, i)

        look(-1)
        while todo:
            i = heapq.heappop(todo)
            value = self.values[i]
            text = re.sub(rf"(?<!\w){re.escape(self.forms[i])}(?!\w)", lambda _, v=value: v, text)
            look(i)
        return text


class _Kept:
    """Automata of the last few arrays of forms: rows of a session mostly come together."""

    def __init__(self, most: int = 16):
        self.most, self.held = most, {}

    def of(self, forms: tuple[str, ...], values: tuple[str, ...]) -> Forms:
        key = (forms, values)
        if key not in self.held:
            if len(self.held) >= self.most:
                self.held.pop(next(iter(self.held)))
            self.held[key] = Forms(forms, values)
        return self.held[key]


def restore(text: str, forms: str) -> Column:
    """Forms of the named array of (form, original), in its order, each where it stands as a whole word.

    In sequence: what one form restores a later, shorter one may match again. A null array leaves the text as it is.
    """

    def put(texts: pd.Series, names: pd.Series, values: pd.Series) -> pd.Series:
        kept = _Kept()
        return pd.Series([t if t is None or n is None or not len(n) else kept.of(tuple(n), tuple(v)).put(t) for t, n, v in zip(texts, names, values, strict=True)], dtype=object)

    put.__annotations__ = {"texts": pd.Series, "names": pd.Series, "values": pd.Series, "return": pd.Series}
    known = f"filter({forms}, x -> x.form is not null and x.original is not null)"
    return pandas_udf(put, "string")(F.col(text), F.expr(f"transform({known}, x -> x.form)"), F.expr(f"transform({known}, x -> x.original)"))


def lowered(text: str) -> str:
    """Lower case, letter by letter, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def mask_values(text: str, values: str) -> Column:
    """The named text with each of the named values blanked, whatever its case, the longest first."""

    def put(texts: pd.Series, values: pd.Series) -> pd.Series:
        def one(t, v):
            v = sorted({lowered(x) for x in v if x}, key=lambda x: (-len(x), x)) if t is not None and v is not None else []
            if not v:
                return t
            forms, taken, chosen = Forms(v, v, whole=False), bytearray(len(t)), []
            for i, start, end in sorted(forms.places(lowered(t))):
                if taken.find(1, start, end) < 0:
                    taken[start:end] = b"\1" * (end - start)
                    chosen.append((start, end, "\0" * (end - start)))
            return spliced(t, chosen)

        return pd.Series([one(t, v) for t, v in zip(texts, values, strict=True)], dtype=object)

    put.__annotations__ = {"texts": pd.Series, "values": pd.Series, "return": pd.Series}
    return pandas_udf(put, "string")(F.col(text), F.expr(f"filter({values}, x -> x is not null)"))


# ---------------------------------------------------------------- words near to stored forms

#: A word's least length, the share of the shorter word that both begin with, and the greatest distance.
LEAST, PREFIX, DISTANCE = 4, 0.6, 2


def deletions(word: str, keep: int = 0, most: int = DISTANCE) -> str:
    """SQL: the word and all it becomes without up to `most` of its letters behind the first `keep`.

    Two words whose distance is at most `most`, and that begin with the same `keep` letters, have one of these in common.
    """
    without = lambda w: f"if(length({w}) > {keep}, transform(sequence({keep + 1}, length({w})), i -> concat(substring({w}, 1, i - 1), substring({w}, i + 1))), array())"
    out, layer = f"array({word})", f"array({word})"
    for _ in range(most):
        layer = f"array_distinct(flatten(transform({layer}, d -> {without('d')})))"
        out = f"concat({out}, {layer})"
    return f"array_distinct({out})"


def _shared(a: str, b: str) -> str:
    """SQL: length of the common prefix."""
    return f"size(filter(sequence(1, greatest(1, least(length({a}), length({b})))), n -> substring({a}, 1, n) = substring({b}, 1, n)))"


def near_tokens(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """session, word and original for words (session, word) near to tokens (session, token, original), both lower-cased.

    Both sides are keyed by session and what is left of them without up to two letters, and joined by that key: a word
    meets those tokens only that may be near, whatever the size of the session. Those that share too little of their beginning go; of
    the nearest that are left all have to agree on the original. The bounds imply that both begin with the same two letters.
    """
    keyed = lambda df, c: df.select("*", F.explode(F.expr(deletions(c, 2))).alias("_key"))
    left = keyed(words.select("session", "word").distinct().filter(F.length("word") >= LEAST), "word")
    right = keyed(tokens.select(F.col("session").alias("_of"), "token", F.col("original")).distinct(), "token")
    met = left.join(right, left["session"].eqNullSafe(right["_of"]) & (left["_key"] == right["_key"])).select("session", "word", "token", "original").distinct()
    near = met.withColumn("d", F.expr(f"levenshtein(word, token, {DISTANCE})")).filter("d >= 0").filter(F.expr(f"{_shared('word', 'token')} / least(length(word), length(token)) >= {PREFIX}"))
    by = near.groupBy("session", "word", "d").agg(F.min("original").alias("original"), F.max("original").alias("other"))
    best = by.groupBy("session", "word").agg(F.min_by(F.struct("original", "other"), "d").alias("b"))
    return best.filter("b.original = b.other").select("session", "word", "b.original")


def fuzzy_restore(texts: DataFrame, tokens: DataFrame, text: str = "text") -> DataFrame:
    """texts, in which words near to a token of their session (session, token, original) became its original.

    Only distinct words meet tokens; what they become comes back by session.
    """
    as_text = texts.withColumn("_own", F.col("session").cast("string"))
    words = as_text.select(F.col("_own").alias("session"), F.explode(F.expr(rf"array_distinct(transform(regexp_extract_all({text}, r'(?U)\w+', 0), w -> lower(w)))")).alias("word")).filter(r"word rlike '^\\p{L}'")
    found = near_tokens(words, tokens).groupBy(F.col("session").alias("_of")).agg(F.map_from_entries(F.collect_list(F.struct("word", "original"))).alias("_near"))
    both = as_text.join(found, F.col("_own").eqNullSafe(F.col("_of")), "left")

    def put(texts: pd.Series, near: pd.Series) -> pd.Series:
        word = re.compile(r"\w+")
        return pd.Series([t if t is None or not m else word.sub(lambda w, m=m: m.get(w[0].lower(), w[0]), t) for t, m in zip(texts, (dict(m) if m is not None else None for m in near), strict=True)], dtype=object)

    put.__annotations__ = {"texts": pd.Series, "near": pd.Series, "return": pd.Series}
    return both.withColumn(text, pandas_udf(put, "string")(F.col(text), F.col("_near"))).drop("_own", "_of", "_near")


# ---------------------------------------------------------------- masks and templates


def mask(text: str, spans: str, kind: str = "entity_type") -> Column:
    """Every span becomes the label of its type: pieces between spans and labels are joined once, in built-in functions.
    Where spans overlap, each is put in from the last to the first."""
    table = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in MASKS.items()) + ")"
    put = f"array_sort(transform({spans}, p -> named_struct('start', p.start, 'end', p.end, 'fake', coalesce(try_element_at({table}, p.{kind}), '{OTHER_MASK}'))))"
    pieces = f"""concat(transform(q, (p, i) -> concat(substring({text}, if(i = 0, 0, q[i - 1].end) + 1, p.start - if(i = 0, 0, q[i - 1].end)), p.fake)), array(substring({text}, q[size(q) - 1].end + 1)))"""
    apart = "forall(transform(q, (p, i) -> i = 0 or q[i - 1].end <= p.start), x -> x)"
    one_by_one = f"aggregate(reverse(q), {text}, (t, p) -> concat(substring(t, 1, p.start), p.fake, substring(t, p.end + 1)))"
    return F.expr(f"transform(array({put}), q -> if(size(q) <= 0, {text}, if({apart}, array_join({pieces}, ''), {one_by_one})))[0]")


def token_masks(spans: DataFrame, *key: str, kind: str = "entity_type") -> DataFrame:
    """Adds token, [LABEL_n], to exploded spans (key, type, start, end, text): values number in order of appearance."""
    first = spans.withColumn("_first", F.min("start").over(Window.partitionBy(*key, kind, "text")))
    n = F.dense_rank().over(Window.partitionBy(*key, kind).orderBy("_first", "text"))
    table = F.create_map(*[F.lit(x) for k, v in MASKS.items() for x in (k, v.strip("[]"))])
    label = F.coalesce(F.try_element_at(table, F.col(kind)), F.lit(OTHER_MASK.strip("[]")))
    return first.withColumn("token", F.concat(F.lit("["), label, F.lit("_"), n.cast("string"), F.lit("]"))).drop("_first")


def row_tokens(spans: str, kind: str = "entity_type") -> Column:
    """The named array of (type, start, end, text), each with its token as of `token_masks`: of a row's own spans, with no shuffle.

    The distinct values of a row are read for each of its spans; for texts of very many spans, explode them for `token_masks`.
    """
    labels = "map(" + ", ".join(f"'{k}', '{v.strip('[]')}'" for k, v in MASKS.items()) + ")"
    first = f"array_distinct(transform(array_sort(transform({spans}, x -> named_struct('start', x.start, 'text', x.text, 'kind', x.{kind}))), x -> named_struct('kind', x.kind, 'text', x.text)))"
    number = f"size(filter(slice(f, 1, cast(array_position(f, named_struct('kind', x.{kind}, 'text', x.text)) as int)), y -> y.kind <=> x.{kind}))"
    token = f"concat('[', coalesce(try_element_at({labels}, x.{kind}), '{OTHER_MASK.strip('[]')}'), '_', {number}, ']')"
    return F.expr(f"transform(array({first}), f -> transform({spans}, x -> named_struct('{kind}', x.{kind}, 'start', x.start, 'end', x.end, 'text', x.text, 'token', {token})))[0]")


def restore_tokens(text: str, pairs: str) -> Column:
    """Tokens of the named array of (token, value) back to values, whatever their case, the longest first."""
    order = f"transform(array_sort(transform({pairs}, p -> named_struct('n', -length(p.token), 'token', p.token, 'value', p.value))), p -> p)"
    return F.expr(rf"""aggregate({order}, {text}, (t, p) -> regexp_replace(t, concat(r'(?iu)\Q', p.token, r'\E'), regexp_replace(p.value, r'([\\$])', r'\\$1')))""")


def fill_template(template: str, values: str) -> Column:
    """text and entities of a template with slots {{TYPE:role}}; values: map from TYPE:role to text.

    A slot that recurs has the same value; offsets are those in the filled text.
    """
    slot = r"r'\\{\\{([A-Z_]+:[^}]+)\\}\\}'".replace("\\\\", "\\")
    acc = "named_struct('text', '', 'entities', cast(array() as array<struct<type:string,start:int,end:int,text:string>>))"
    return F.expr(
        f"""transform(array(named_struct('g', split({template}, {slot}), 's', regexp_extract_all({template}, {slot}, 1))), z ->
        aggregate(sequence(0, size(z.g) - 1), {acc}, (a, i) -> if(i < size(z.s), named_struct(
            'text', concat(a.text, z.g[i], {values}[z.s[i]]),
            'entities', concat(a.entities, array(named_struct('type', split(z.s[i], ':')[0], 'start', length(a.text) + length(z.g[i]),
                'end', length(a.text) + length(z.g[i]) + length({values}[z.s[i]]), 'text', {values}[z.s[i]])))),
          named_struct('text', concat(a.text, z.g[i]), 'entities', a.entities))))[0]"""
    )
