"""The sealed session store: versions, keyed lookup, deletion, expiry, and no original at rest."""

import pytest
from pyspark.sql import functions as F

from veilworks.functions import crypto
from veilworks.operators import conversation as chat
from veilworks.operators import spans, vault
from veilworks.operators.store import SessionStore
from veilworks.sources.shared import shared_dir

KEY = bytes(range(32))
SPAN = spans.SPAN


def named(spark, *rows):
    """Messages with spans: (session, turn, [(kind, text, lemma, case)])."""
    made = []
    for session, turn, found in rows:
        text, at = "", []
        for kind, x, lemma, case in found:
            at.append((kind, len(text), len(text) + len(x), 0.9, x, None, lemma, case))
            text += x + ", "
        made.append((session, turn, "user", text, at))
    return spark.createDataFrame(made, f"session string, turn int, role string, text string, names array<{SPAN}>")


def through(messages, store):
    return chat.pseudonymize(messages, KEY, store, recognizers=[], extra=F.col("names"))


def files(path):
    return b"".join(p.read_bytes() for p in path.rglob("*") if p.is_file())


def test_versions(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "store"), KEY)
    assert store.versions() == [] and store.state().rows.count() == 0
    jan, pesel = ("PERSON", "Jana Kowalskiego", "jan kowalski", "gen"), ("PESEL", "44051401359", None, None)
    first, state = through(named(spark, ("a", 1, [jan, pesel]), ("b", 1, [pesel]), (None, 1, [pesel]), ("c", 1, [])), store)
    one = {(r.session, p.original): p.fake for r in first.collect() for p in r.replacements}
    assert store.versions() == [1]
    again, state = through(named(spark, ("a", 2, [pesel, jan, ("PERSON", "Kowalski", "kowalski", "nom")]), ("b", 2, [pesel]), ("b", 3, [pesel, ("NIP", "1234563218", None, None)]), (None, 2, [pesel])), store)
    two = {(r.session, p.original): p.fake for r in again.collect() for p in r.replacements}
    assert all(two[k] == f for k, f in one.items() if k in two) and len({one["a", pesel[1]], one["b", pesel[1]], one[None, pesel[1]]}) == 3
    pairs = {(r.session, r.entity_type, r.original) for r in vault.mappings(state).collect()}
    assert pairs >= {("a", "PERSON", "Jan Kowalski"), ("a", "PESEL", pesel[1]), ("b", "NIP", "1234563218"), (None, "PESEL", pesel[1])}
    back = chat.depseudonymize(again.select("session", "text", "fake_text"), state, text="fake_text")
    assert back.filter("restored <> text").count() == 0
    # a state of before knows what was known then
    assert ("b", "NIP", "1234563218") not in {(r.session, r.entity_type, r.original) for r in vault.mappings(store.state(1)).collect()}
    # messages are counted where there is a mapping
    counts = {r.session: (r.message_count, r.entity_count) for r in store.summary().collect()}
    assert counts == {"a": (2, 3), "b": (3, 2), None: (2, 1)}

    base = store.compact()
    held = sorted(map(repr, store.state(base - 1).rows.collect()))
    assert sorted(map(repr, store.state().rows.collect())) == held
    store.vacuum()
    assert store.versions() == [base] and sorted(map(repr, store.state().rows.collect())) == held

    gone = {r.session: r.existed for r in store.forget(spark.createDataFrame([("a",), ("nobody",)], "session string")).collect()}
    assert gone == {"a": True, "nobody": False}
    assert {r.session for r in store.state().rows.select("session").distinct().collect()} == {"b", None}
    store.compact()
    store.vacuum()
    assert one["a", pesel[1]].encode() not in files(tmp_path / "store") and one["b", pesel[1]].encode() in files(tmp_path / "store")
    fresh, _ = through(named(spark, ("a", 9, [pesel])), store)
    assert fresh.first().replacements[0].fake == one["a", pesel[1]]  # drawn by key, session and hash, so the same again
    assert {r.session: r.message_count for r in store.summary().collect()}["a"] == 1


def test_known_hashes_meet_no_state_machine(spark, tmp_path, monkeypatch):
    store = SessionStore(spark, str(tmp_path / "store"), KEY)
    rows = [(f"s{i}", 1, [("PESEL", f"4405140135{i}", None, None)]) for i in range(6)]
    first = {r.session: r.fake_text for r in through(named(spark, *rows), store)[0].collect()}
    met = []
    run = vault.run
    monkeypatch.setattr(vault, "run", lambda rows, held=None, *build: met.append(rows.count()) or run(rows, held, *build))
    second = {r.session: r.fake_text for r in through(named(spark, *rows, ("new", 1, rows[0][2])), store)[0].collect()}
    assert met == [1] and {s: second[s] for s in first} == first


def test_nothing_at_rest_in_the_clear(spark, tmp_path):
    """Neither the store nor the tables that a run leaves in the shared folder hold an original."""
    from pathlib import Path

    folder = Path(shared_dir(spark).removeprefix("file://"))
    store = SessionStore(spark, str(tmp_path / "store"), KEY)
    originals = ["Wincentego Zabłockiego", "wincenty zabłocki", "Wincenty Zabłocki", "wincenty.z@poczta.pl", "90010112349"]
    messages = named(spark, ("q", 1, [("PERSON", originals[0], originals[1], "gen"), ("EMAIL_ADDRESS", originals[3], None, None), ("PESEL", originals[4], None, None)]))
    messages = messages.withColumn("note", F.lit(originals[0]))
    hidden, state = through(messages, store)
    assert hidden.first().note == originals[0] and originals[0] not in hidden.first().fake_text
    assert {r.original for r in vault.mappings(state).collect()} >= {"Wincenty Zabłocki", originals[3], originals[4]}
    held = files(tmp_path / "store") + files(folder)
    assert len(held) > 1000 and not any(x.encode() in held for x in originals)
    assert KEY.hex() not in hidden._jdf.queryExecution().toString() and "X'0001" not in hidden._jdf.queryExecution().toString()


def test_values_open_in_their_session_only(spark):
    df = crypto.with_key(spark.createDataFrame([("a", "x"), ("b", None)], "s string, v string"), KEY)
    sealed = df.withColumn("c", crypto.sealed(F.col("v"), F.col("s")))
    assert [r.o for r in sealed.select(crypto.opened(F.col("c"), F.col("s")).alias("o")).collect()] == ["x", None]
    with pytest.raises(Exception, match="(?i)tag|decrypt|aes|crypt"):
        sealed.select(crypto.opened(F.col("c"), F.lit("other"))).collect()
    with pytest.raises(ValueError, match="32"):
        crypto.with_key(df, b"short")


def test_expiry(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "store"), KEY)
    pesel = ("PESEL", "44051401359", None, None)
    for now, rows in ((1000, [("a", 1, [pesel]), ("b", 1, [pesel])]), (9000, [("b", 2, [pesel])])):
        found = spans.detect(named(spark, *rows).withColumn("row", F.monotonically_increasing_id()), recognizers=[], extra=F.col("names"))
        store.assign(vault.mentions(found, KEY), found.select("session"), now)
    seen = {r.session: (r.created_at, r.last_activity, r.message_count) for r in store.summary().collect()}
    assert seen == {"a": (1000, 1000, 1), "b": (1000, 9000, 2)}
    assert [(r.session, r.existed) for r in store.expire(5000, 10000).collect()] == [("a", True)]
    assert {r.session for r in store.summary().collect()} == {"b"}


def test_without_the_key_a_fake_confirms_nothing(spark):
    """The same mention under another key has another hash and, mostly, another fake."""
    rows = named(spark, *[(f"s{i}", 1, [("PESEL", "44051401359", None, None)]) for i in range(8)])
    fakes = []
    for key in (KEY, KEY[::-1]):
        hidden, state = chat.pseudonymize(rows, key, recognizers=[], extra=F.col("names"))
        fakes.append({r.fake_text for r in hidden.collect()})
    assert len(fakes[0]) == 8 and not fakes[0] & fakes[1]


def test_groups_are_plain_rows(spark, monkeypatch):
    """A session's mentions meet the state machine as Arrow rows, in order of turn, row and place; no data frame is made for each."""
    seen = []
    monkeypatch.setattr(vault, "written", lambda df, tag, held=vault.written: (seen.append(df), held(df, tag))[1])
    rows = [(s, turn << 20 | i, r, i, "PERSON", f"fwd:{name}", [f"h{w}" for w in name.split()], None, "nom", None, "x", "y") for s in ("a", None) for r, turn, i, name in ((7, 2, 0, "Kowalski"), (5, 1, 1, "Jan Kowalski"), (5, 1, 0, "Ewa Lis"))]
    df = spark.createDataFrame(rows, "session string, ord long, row long, i int, entity_type string, field string, words array<string>, hint string, case string, gender string, sealed string, sealed_base string")
    fakes, state = vault.run(df)
    got = {(r.session, r.row, r.i): r.fake for r in fakes.collect()}
    assert len(got) == 6 and all(got[s, 7, 0] == got[s, 5, 1].split()[-1] for s in ("a", None))
    again, more = vault.run(df, held=state)
    assert {(r.session, r.row, r.i): r.fake for r in again.collect()} == got
    assert all("InArrow" in x._jdf.queryExecution().toString() and "InPandas" not in x._jdf.queryExecution().toString() for x in seen) and len(seen) == 2
