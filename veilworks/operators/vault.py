"""Session-consistent mapping of originals to fakes: keyed state, ordered within a session, without an original in it.

A mention's key becomes a keyed hash and its surfaces are sealed where the row is, before anything is shuffled to a
session. The state machine sees hashes, sealed values and what a fake has to copy from its original: a date, the
length of a number. It looks up a mention's hash; a name that is not known reuses the fake of the one person whose hashed words
contain, or are contained in, its own; all else is minted, unused in the session, drawn by the keyed hash, so that
without the key no fake confirms a guess. The state machine is plain Python over tables that are read and written by
key: dictionaries for a session's mentions in `applyInArrow`, map states in the stream.

State is rows (STATE): fwd, a hash and its fake; face, a fake and its forms by case; rev, a form and the sealed
original; who, a name's hashed words and its fake. Views open them with the key.

Messages whose session is null make one session, whose name stays null. A null turn comes before all others; messages
of one turn follow each other in the order of their rows.
"""

from __future__ import annotations

from collections.abc import Iterable, MutableMapping
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from veilworks.functions import crypto
from veilworks.functions.declension import decline, forms, pattern_of
from veilworks.functions.surface import NAME_TYPES, collapse, mapping_key, title_words
from veilworks.operators.generate import Builder, generate, mint
from veilworks.sources.shared import written



class Noted(dict):
    """A dictionary that knows which of its keys were written."""

    def __init__(self, *held: object) -> None:
        super().__init__(*held)
        self.fresh: dict = {}

    def __setitem__(self, key: object, value: object) -> None:
        super().__setitem__(key, value)
        self.fresh[key] = None


@dataclass
class Tables:
    """What a session's mapping is kept in; each may be a view of other storage."""

    forward: MutableMapping = field(default_factory=Noted)  # keyed hash -> fake base
    reverse: MutableMapping = field(default_factory=Noted)  # fake form -> {n, sealed, kind, case, exact}
    faces: MutableMapping = field(default_factory=Noted)  # fake base -> {n, forms}
    people: MutableMapping = field(default_factory=Noted)  # number -> {words, fake, kind}
    words: MutableMapping = field(default_factory=dict)  # hashed word -> numbers of the people who bear it
    size: MutableMapping = field(default_factory=lambda: {"people": 0, "n": 0})


class Used:
    """Forms that are taken."""

    def __init__(self, tables: Tables) -> None:
        self.tables = tables

    def __contains__(self, form: str) -> bool:
        return form in self.tables.reverse or form in self.tables.faces


class Vault:
    """The state machine of one session."""

    def __init__(self, session: str, tables: Tables | None = None, build: Builder = generate) -> None:
        self.session, self.tables, self.build = session, Tables() if tables is None else tables, build
        self.used = Used(self.tables)

    def _next(self, what: str) -> int:
        n = self.tables.size[what]
        self.tables.size[what] = n + 1
        return n

    def _same_name(self, words: list[str]) -> str | None:
        """The part of a known fake that stands for this mention, if exactly one known fake fits."""
        t, hits = self.tables, []
        for i in sorted({i for w in words for i in t.words.get(w) or ()}):
            theirs = t.people[i]["words"]
            if set(words) <= set(theirs) or set(theirs) <= set(words):
                hits.append((t.people[i]["fake"], theirs))
        if len({fake for fake, _ in hits}) != 1:
            return None
        fake, theirs = hits[0]
        parts, places = fake.split(), [theirs.index(w) for w in words if w in theirs]
        return " ".join(parts[i] for i in places if i < len(parts)) or None

    def _put(self, form: str, sealed: str, kind: str, case: str | None, exact: bool) -> None:
        held = self.tables.reverse.get(form)
        self.tables.reverse[form] = {"n": held["n"] if held else self._next("n"), "sealed": sealed, "kind": kind, "case": case, "exact": exact}

    def _write(self, m: dict, fake: str, cases: dict[str, str]) -> None:
        t = self.tables
        t.forward[m["field"]] = fake
        if m["entity_type"] not in NAME_TYPES:
            self._put(fake, m["sealed"], m["entity_type"], None, True)
            return
        held = t.faces.get(fake)
        t.faces[fake] = {"n": held["n"] if held else self._next("n"), "forms": dict(cases) or {"nom": fake}}
        for case, form in t.faces[fake]["forms"].items():
            if form not in t.reverse:
                self._put(form, m["sealed_base"], m["entity_type"], case, False)
        i = self._next("people")
        t.people[i] = {"words": m["words"], "fake": fake, "kind": m["entity_type"]}
        for w in dict.fromkeys(m["words"]):
            t.words[w] = [*(t.words.get(w) or ()), i]

    def get_or_create(self, m: dict) -> str:
        """The fake's form for a mention of MENTION."""
        t, kind = self.tables, m["entity_type"]
        name = kind in NAME_TYPES
        fake = t.forward.get(m["field"])
        if fake is None and name:
            fake = self._same_name(m["words"])
            if fake is not None:
                held = t.faces.get(fake)
                self._write(m, fake, forms(fake, pattern_of(fake, m["gender"])) if " " not in fake else held["forms"] if held else {})
        if fake is None:
            made = mint(kind, f"{self.session}|{m['field']}", self.used, "", m["hint"] or "", m["gender"], build=self.build)
            fake = made.base
            self._write(m, fake, made.forms)
        if not name:
            return fake
        held = t.faces.get(fake)
        form = (held["forms"] if held else {}).get(m["case"] or "nom", fake)
        self._put(form, m["sealed"], kind, m["case"], True)  # the surface that this form stood in for
        return form


# ---------------------------------------------------------------- mentions


#: field: the keyed hash; words: keyed hashes of a name's words; hint: what the fake has to copy; sealed, sealed_base: the
#: surface and, of names, the lemma with first letters raised, each opened by its session only.
MENTION = "session string, ord long, entity_type string, field string, words array<string>, hint string, case string, gender string, sealed string, sealed_base string"
MAPPED = "session string, ord long, fake string"
#: Beside MENTION in batch: the message's row and the mention's place in it, which name a mention.
PLACE = ("row", "i")
#: n: order of arrival. part fwd: name is the hash, fake its fake. face: name is the fake, forms its forms. rev: name is
#: the form. who: name is the number, words the hashes, fake the fake. meta: name is what is counted, n the number.
STATE = "session string, part string, name string, n long, fake string, kind string, case string, exact boolean, sealed string, words array<string>, forms array<struct<case:string,form:string>>"
_FIELDS = [c.split()[0] for c in STATE.split(", ")]
#: What a session's group gives back: a mention's fake by its place, or a row of STATE.
_MADE = pa.schema(
    [("session", pa.string()), ("row", pa.int64()), ("i", pa.int32()), *[(c, pa.string()) for c in ("mapped", "part", "name")], ("n", pa.int64()), *[(c, pa.string()) for c in ("fake", "kind", "case")]]
    + [("exact", pa.bool_()), ("sealed", pa.string()), ("words", pa.list_(pa.string())), ("forms", pa.list_(pa.struct([("case", pa.string()), ("form", pa.string())])))]
)


def is_name(kind: Column) -> Column:
    return kind.isin(*NAME_TYPES)


def hidden(rows: DataFrame, key: bytes) -> DataFrame:
    """Rows of (session, ..., entity_type, text, lemma, case, gender and perhaps key) with field, words, hint and sealed values in place of the texts."""
    kind, text, lemma = F.col("entity_type"), F.col("text"), F.col("lemma")
    plain = F.col("key") if "key" in rows.columns else mapping_key(kind, text, lemma)
    known = kind.isin(*NAME_TYPES, "PESEL", "NIP", "POLISH_BANK_ACCOUNT", "BANK_ACCOUNT", "EMAIL_ADDRESS", "PHONE_NUMBER", "ADDRESS", "POLISH_ADDRESS")
    hint = F.when(kind == "REGON", F.repeat(F.lit("0"), F.length(F.regexp_replace(text, "[^0-9]", "")))).when(~known, text)
    words = F.when(is_name(kind), F.transform(F.filter(F.split(collapse(F.lower(F.col("_plain"))), " "), lambda w: w != ""), lambda w: crypto.keyed_hash(F.concat(kind, F.lit("|word|"), w)))).otherwise(F.array().cast("array<string>"))
    base = F.when(is_name(kind), F.coalesce(title_words(lemma), text))
    sealed = lambda c: F.base64(crypto.sealed(c, F.col("session")))
    out = crypto.with_key(rows.withColumn("_plain", F.coalesce(plain, F.lit(""))), key)
    out = out.withColumn("field", F.concat(F.lit("fwd:"), crypto.keyed_hash(F.concat_ws("|", kind, "_plain")))).withColumn("words", words).withColumn("hint", hint).withColumn("sealed", sealed(F.coalesce(text, F.lit("")))).withColumn("sealed_base", sealed(base))
    return out.drop("_plain", "key", "text", "lemma", *crypto.KEY_COLUMNS)


def mentions(messages: DataFrame, key: bytes, spans: str = "entities") -> DataFrame:
    """Rows for `run`, from (session, turn, spans) and row, if there is one; ord is the order in the session."""
    place = PLACE if "row" in messages.columns else ()
    x = messages.select(F.col("session").cast("string").alias("session"), "turn", *place[:1], F.posexplode_outer(spans).alias("i", "x")).filter("i is not null")
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 40)))
    rows = x.select("session", (turn * F.lit(1 << 20) + F.col("i")).alias("ord"), *place, "x.entity_type", "x.text", "x.lemma", "x.case", F.col("x.metadata.gender").alias("gender"))
    return hidden(rows, key).select(*[c.split()[0] for c in MENTION.split(", ")][:2], *place, *[c.split()[0] for c in MENTION.split(", ")][2:])


def _none(v: object) -> object:
    return None if v is None or (isinstance(v, float) and v != v) else v


def mention_of(row: dict) -> dict:
    return {**{c: _none(row[c]) for c in ("entity_type", "field", "hint", "case", "gender", "sealed", "sealed_base")}, "words": list(row["words"]) if row["words"] is not None else []}


def replay(vault: Vault, rows: Iterable[dict]) -> list[tuple[str, int, str]]:
    return [(vault.session, int(r["ord"]), vault.get_or_create(mention_of(r))) for r in rows]


# ---------------------------------------------------------------- state as rows


def tables_of(rows: Iterable[dict]) -> Tables:
    """A session's tables from its rows of STATE, in any order."""
    t = Tables()
    for r in sorted(rows, key=lambda r: (int(r["n"]), str(r["name"]))):
        name, n = r["name"], int(r["n"])
        if r["part"] == "fwd":
            dict.__setitem__(t.forward, name, r["fake"])
        elif r["part"] == "rev":
            dict.__setitem__(t.reverse, name, {"n": n, "sealed": r["sealed"], "kind": r["kind"], "case": _none(r["case"]), "exact": bool(r["exact"])})
        elif r["part"] == "face":
            dict.__setitem__(t.faces, name, {"n": n, "forms": {f["case"]: f["form"] for f in r["forms"]}})
        elif r["part"] == "who":
            i = int(name)
            dict.__setitem__(t.people, i, {"words": list(r["words"]), "fake": r["fake"], "kind": r["kind"]})
            for w in dict.fromkeys(r["words"]):
                t.words.setdefault(w, []).append(i)
    numbers = [x["n"] for table in (t.reverse, t.faces) for x in table.values()]
    t.size.update(people=len(t.people), n=max(numbers, default=-1) + 1)
    return t


def rows_of(session: str | None, t: Tables) -> list[tuple]:
    """Rows of STATE for what was written since the tables were made."""
    made = [("fwd", f, 0, t.forward[f], None, None, None, None, None, None) for f in t.forward.fresh]
    made += [("face", b, t.faces[b]["n"], None, None, None, None, None, None, [{"case": c, "form": f} for c, f in t.faces[b]["forms"].items()]) for b in t.faces.fresh]
    made += [("rev", f, r["n"], None, r["kind"], r["case"], r["exact"], r["sealed"], None, None) for f in t.reverse.fresh for r in (t.reverse[f],)]
    made += [("who", str(i), i, p["fake"], p["kind"], None, None, None, p["words"], None) for i in t.people.fresh for p in (t.people[i],)]
    return [(session, *m) for m in made]


@dataclass(frozen=True)
class State:
    """Rows of STATE, sealed, and the key that opens them."""

    rows: DataFrame
    key: bytes

    def with_rows(self, rows: DataFrame) -> State:
        return State(rows, self.key)


def run(rows: DataFrame, held: DataFrame | None = None, build: Builder = generate) -> tuple[DataFrame, DataFrame]:
    """(session, row, i, fake) of the mentions (with row and i), and what they add to the state, as rows of STATE.

    held: the state before. build: makes the values. A session's mentions depend on each other in order, so a session is one group; that is the
    only shuffle.
    """
    schema = "session string, row long, i int, mapped string, " + STATE.split(", ", 1)[1]

    def states(session: str | None, mine: list[dict], before: list[dict]) -> pa.Table:
        vault = Vault("" if session is None else session, tables_of(before), build)
        mine.sort(key=lambda r: (r["ord"] // (1 << 20), r["row"], r["i"]))
        made = [(session, r["row"], r["i"], fake, *[None] * (len(_FIELDS) - 1)) for r, (_, _, fake) in zip(mine, replay(vault, mine), strict=True)]
        made += [(session, -1, -1, None, *x[1:]) for x in rows_of(session, vault.tables)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _MADE, strict=True)], schema=_MADE)

    # plain rows: a session mostly has few, and a data frame for each costs more than its mentions
    def alone(rows: pa.Table) -> pa.Table:
        mine = rows.to_pylist()
        return states(mine[0]["session"], mine, [])

    def beside(rows: pa.Table, before: pa.Table) -> pa.Table:
        mine = rows.to_pylist()
        return states(mine[0]["session"], mine, before.to_pylist()) if mine else _MADE.empty_table()

    alone.__annotations__ = {"rows": pa.Table, "return": pa.Table}
    beside.__annotations__ = {"rows": pa.Table, "before": pa.Table, "return": pa.Table}
    if held is None:
        made = rows.groupBy("session").applyInArrow(alone, schema)
    else:
        made = rows.groupBy("session").cogroup(held.groupBy("session")).applyInArrow(beside, schema)
    both = written(made, "vault")  # read for fakes and for states; no original is in it
    fakes, state = both.filter("i >= 0").select("session", "row", "i", F.col("mapped").alias("fake")), both.filter("i < 0").select(*_FIELDS)
    fakes.written_to = state.written_to = both.written_to
    return fakes, state


# ---------------------------------------------------------------- views


def _restored(record: Column, of: Column) -> Column:
    """An original as it is written: exact, or declined to the case of the fake's form."""

    def surface(originals: pd.Series, kinds: pd.Series, cases: pd.Series, exact: pd.Series) -> pd.Series:
        def one(original, kind, case, literal):
            if original is None or literal or kind not in NAME_TYPES or case in (None, "nom"):
                return original
            place = "city" if kind == "LOCATION" else "person"
            return " ".join(decline(w, pattern_of(w, None, place), case) for w in original.split())

        return pd.Series([one(*x) for x in zip(originals, kinds, cases, exact, strict=True)], dtype=object)

    surface.__annotations__ = {c: pd.Series for c in ("originals", "kinds", "cases", "exact", "return")}
    return pandas_udf(surface, "string")(crypto.opened(F.unbase64(record["sealed"]), of), record["kind"], record["case"], record["exact"])


def reverse(state: State) -> DataFrame:
    """session, n, form, kind and original, as it is put back for the form."""
    rows = crypto.with_key(state.rows.filter("part = 'rev'"), state.key)
    record = F.struct("sealed", "kind", "case", "exact")
    return rows.select("session", "n", F.col("name").alias("form"), "kind", _restored(record, F.col("session")).alias("original"))


def _bases(state: State) -> DataFrame:
    """session, base, forms, kind and original of each name's fake: the original of the first of its forms that has one."""
    face = state.rows.filter("part = 'face'").select("session", F.col("name").alias("base"), "n", "forms")
    form = face.select("session", "base", F.posexplode("forms").alias("at", "x")).select("session", "base", "at", F.col("x.form").alias("form"))
    rev = state.rows.filter("part = 'rev'").select(F.col("session").alias("_of"), F.col("name").alias("form"), "kind", "sealed")
    hit = form.join(rev, form["session"].eqNullSafe(rev["_of"]) & (form["form"] == rev["form"])).groupBy("session", "base").agg(F.min_by(F.struct("kind", "sealed"), "at").alias("r"))
    hit = crypto.with_key(hit, state.key).select(F.col("session").alias("_of"), F.col("base").alias("_base"), "r.kind", crypto.opened(F.unbase64(F.col("r.sealed")), F.col("session")).alias("original"))
    return face.join(hit, face["session"].eqNullSafe(hit["_of"]) & (face["base"] == hit["_base"])).select("session", "base", "n", "forms", "kind", "original")


def mappings(state: State) -> DataFrame:
    """session, entity_type, original, fake: the distinct pairs."""
    names = _bases(state).select("session", F.col("kind").alias("entity_type"), "original", F.col("base").alias("fake"))
    rest = crypto.with_key(state.rows.filter("part = 'rev'").filter(~is_name(F.col("kind"))), state.key)
    rest = rest.select("session", F.col("kind").alias("entity_type"), crypto.opened(F.unbase64(F.col("sealed")), F.col("session")).alias("original"), F.col("name").alias("fake"))
    return names.unionByName(rest).distinct()


def restorations(state: State) -> DataFrame:
    """session and an array of (form, original, kind), in the order in which they are to be put back: the longest form first."""
    rows = reverse(state).groupBy("session").agg(F.array_sort(F.collect_list(F.struct((-F.length("form")).alias("l"), "n", "form", "original", "kind"))).alias("forms"))
    return rows.select("session", F.transform("forms", lambda x: F.struct(x["form"].alias("form"), x["original"].alias("original"), x["kind"].alias("kind"))).alias("forms"))


def name_tokens(state: State) -> DataFrame:
    """session, token and original: words of stored name forms and the original word, or whole name, that each stands for."""
    bases = _bases(state).withColumn("original", title_words(F.col("original")))
    rows = bases.select("session", "base", "original", F.explode("forms").alias("x")).select("session", "original", F.split("original", " ").alias("words"), F.split("base", " ").alias("fakes"), F.split("x.form", " ").alias("parts"))
    aligned = (F.size("fakes") == F.size("words")) & (F.size("fakes") == F.size("parts"))
    each = rows.select("session", "original", "words", aligned.alias("aligned"), F.posexplode("parts").alias("i", "part"))
    return each.select("session", F.lower("part").alias("token"), F.when(F.col("aligned"), F.get("words", F.col("i"))).otherwise(F.col("original")).alias("original")).distinct()


def summary(state: State, activity: DataFrame | None = None) -> DataFrame:
    """session, entity_count and entities_by_type over distinct pairs; with activity (session, ts), first and last."""
    pairs = mappings(state)
    by = pairs.groupBy("session", "entity_type").agg(F.count(F.lit(1)).alias("n")).groupBy("session").agg(F.sum("n").alias("entity_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("entities_by_type"))
    if activity is None:
        return by
    seen = activity.groupBy(F.col("session").cast("string").alias("session")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_activity"), F.count(F.lit(1)).alias("message_count"))
    return seen.join(by, "session")


def delete(state: State, sessions: DataFrame) -> tuple[State, DataFrame]:
    """The state without the sessions, and (session, existed) for each that was named."""
    named = sessions.select(F.col("session").cast("string").alias("session")).distinct()
    there = state.rows.select("session").distinct().withColumn("existed", F.lit(True))
    return state.with_rows(state.rows.join(named, "session", "left_anti")), named.join(there, "session", "left").na.fill({"existed": False})


def original_of(forms_: DataFrame, fake: str = "fake") -> DataFrame:
    """Adds original to rows (session, fake, forms): the exact form's, else the nearest form's within distance 2."""
    near = F.expr(f"array_min(transform(filter(forms, x -> levenshtein(lower(x.form), lower({fake}), 2) >= 0), (x, i) -> named_struct('d', levenshtein(lower(x.form), lower({fake}), 2), 'i', i, 'o', x.original)))")
    exact = F.expr(f"filter(forms, x -> x.form = {fake})")
    return forms_.withColumn("original", F.when(F.size(exact) > 0, exact[0]["original"]).otherwise(near["o"]))
