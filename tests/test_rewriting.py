import random
import re

from pyspark.sql import functions as F

from veilworks.functions import identifiers as ids
from veilworks.operators import conversation as chat
from veilworks.operators import generate as gen
from veilworks.operators import rewrite, vault

KEY = bytes(range(32))


def test_splice_like_python(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("abcł😀 ") for _ in range(30))
        rows.append((i, text, [{"start": a, "end": a + rng.randint(0, 6), "fake": rng.choice(["X", "$1", ""])} for a in rng.sample(range(25), rng.randint(0, 5))]))
    df = spark.createDataFrame(rows, "i int, text string, p array<struct<start:int,end:int,fake:string>>")
    got = {r.i: r.t for r in df.select("i", rewrite.splice("text", "p").alias("t")).collect()}
    for i, text, parts in rows:
        for p in sorted(parts, key=lambda p: p["start"], reverse=True):
            text = text[: p["start"]] + p["fake"] + text[p["end"] :]
        assert got[i] == text


def test_restore(spark):
    df = spark.createDataFrame([("Marek Nowak i Nowak, Nowakiem $1", [("Marek Nowak", "Jan $1 Kowal\\ski"), ("Nowak", "Kowalski")])], "t string, f array<struct<form:string,original:string>>")
    assert df.select(rewrite.restore("t", "f").alias("r")).first().r == "Jan $1 Kowal\\ski i Kowalski, Nowakiem $1"


def test_fuzzy_restore(spark):
    tokens = [("nowak", "Kowalski"), ("nowaka", "Kowalski"), ("marek", "Jan"), ("marko", "Ewa")]
    held = spark.createDataFrame([(s, *t) for s in ("a", None) for t in tokens], "session string, token string, original string")
    df = spark.createDataFrame([("a", "Nowakach, Nowela; Marekk! Mark to"), ("b", "Nowakach"), (None, ""), (None, "nowakm"), ("a", None)], "session string, t string")
    got = {(r.session, r.t) for r in rewrite.fuzzy_restore(df, held, "t").collect()}
    assert got == {("a", "Kowalski, Nowela; Jan! Mark to"), ("b", "Nowakach"), (None, ""), (None, "Kowalski"), ("a", None)}


def test_masks_and_templates(spark):
    df = spark.createDataFrame([("Ewa ma 123", [("PERSON", 0, 3), ("X", 7, 10)])], "t string, s array<struct<entity_type:string,start:int,end:int>>")
    assert df.select(rewrite.mask("t", "s").alias("m")).first().m == "[OSOBA] ma [DANE]"
    df = spark.createDataFrame([("{{PERSON:a}} i {{PESEL:b}}, {{PERSON:a}}", {"PERSON:a": "Żak", "PESEL:b": "9"}), ("brak", {"X:y": "z"})], "t string, v map<string,string>")
    first, second = (r.f for r in df.select(rewrite.fill_template("t", "v").alias("f")).collect())
    assert first.text == "Żak i 9, Żak" and [(e.type, e.start, e.end, e.text) for e in first.entities] == [("PERSON", 0, 3, "Żak"), ("PESEL", 6, 7, "9"), ("PERSON", 9, 12, "Żak")]
    assert second.text == "brak" and not second.entities


def digits_valid(spark, values, check):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return df.select(check(F.col("v")).alias("ok")).filter("not ok").count() == 0


def test_generators(spark):
    make = lambda kind, text="": [gen.generate(kind, gen.Draw("s", i), text).base for i in range(60)]
    assert digits_valid(spark, make("PESEL"), ids.pesel_valid) and digits_valid(spark, make("NIP"), ids.nip_valid)
    assert digits_valid(spark, make("REGON"), ids.regon9_valid) and digits_valid(spark, make("REGON", "12345678500002"), ids.regon14_valid)
    assert digits_valid(spark, make("POLISH_BANK_ACCOUNT"), ids.account_valid)
    assert all(re.fullmatch(r"\+48 [5-8]\d\d \d{3} \d{3}", p) for p in make("PHONE_NUMBER"))
    assert all(d != "12.01.2024" and re.fullmatch(r"12\.01\.20[123]\d", d) for d in make("DATE_TIME", "12.01.2024"))
    assert make("ODD", "as it is")[0] == "as it is" and make("PERSON") == make("PERSON")
    df = spark.range(50).select(gen.pesel_col(F.col("id")).alias("p"), gen.account_col(F.col("id")).alias("a"), gen.phone_col(F.col("id")).alias("t"))
    assert df.filter(~ids.pesel_valid(F.col("p")) | ~ids.account_valid(F.col("a")) | ~F.col("t").rlike(r"^\+48 [5-8]\d\d \d{3} \d{3}$")).count() == 0


def test_mint_avoids_used():
    used: set[str] = set()
    for i in range(len(gen.CITIES) + 3):
        fake = gen.mint("LOCATION", str(i), used, "s")
        assert not used & {fake.base, *fake.forms.values()}
        used |= {fake.base, *fake.forms.values()}


def mention(kind, key, text, lemma=None, case=None, gender=None):
    """A row as vault.hidden makes it, with plain marks in place of hashes and seals."""
    words = [f"h({w})" for w in key.split()] if kind in ("PERSON", "LOCATION") else []
    return {"entity_type": kind, "field": f"f({kind}|{key})", "words": words, "hint": text, "case": case, "gender": gender, "sealed": f"<{text}>", "sealed_base": f"<{lemma or text}>"}


def test_vault_names():
    v = vault.Vault("s")
    make = lambda *m: v.get_or_create(mention(*m))
    a = make("PERSON", "jan kowalski", "Janem Kowalskim", "jan kowalski", "ins")
    assert make("PERSON", "jan kowalski", "Janem Kowalskim", "jan kowalski", "ins") == a
    b = make("PERSON", "kowalski", "Kowalski", "kowalski", "nom")
    whole = v.tables.forward["f(PERSON|jan kowalski)"]
    assert b == whole.split()[1]
    other = make("PERSON", "anna nowak", "Anna Nowak", "anna nowak", "nom")
    assert other != whole
    # two persons share a name: no guess
    make("PERSON", "ewa kowalski", "Ewa Kowalski", "ewa kowalski", "nom")
    columns = ["session", *vault._FIELDS[1:]]
    rows = [dict(zip(columns, r, strict=True)) for r in vault.rows_of("s", v.tables)]
    again = vault.Vault("s", vault.tables_of(rows[::-1]))
    assert again.get_or_create(mention("PERSON", "jan kowalski", "Jan Kowalski", "jan kowalski", "nom")) == whole
    assert again.get_or_create(mention("PERSON", "kowalski", "Kowalski", "kowalski", "nom")) == v.get_or_create(mention("PERSON", "kowalski", "Kowalski", "kowalski", "nom"))
    assert v.tables.reverse[a]["sealed"] == "<Janem Kowalskim>" and v.tables.reverse[whole]["sealed"] == "<jan kowalski>"
    assert [r["name"] for r in map(lambda x: dict(zip(columns, x, strict=True)), vault.rows_of("s", again.tables))]  # what was written since
    assert not vault.rows_of("s", vault.tables_of(rows))


def test_chat(spark):
    rows = [("a", 1, "system", "Bądź krótki"), ("a", 2, "user", "PESEL 44051401359, tel. +48 601 234 567"), ("a", 3, "assistant", "PESEL 44051401359"), ("a", 4, "user", "jan@x.pl i 44051401359 $1 \\x"), ("b", 1, "user", "NIP 1234563218"), ("b", 2, "user", "hej"), ("c", 1, "assistant", "x")]
    m = spark.createDataFrame(rows, "session string, turn int, role string, text string")
    hidden, state = chat.pseudonymize(m, KEY)
    got = hidden.collect()
    assert not any(x in r.fake_text for r in got for x in ("44051401359", "jan@x.pl", "601 234 567", "1234563218"))
    assert len({p.fake for r in got for p in r.replacements if p.original == "44051401359"}) == 1
    back = chat.depseudonymize(hidden.select("session", "text", "fake_text"), state, text="fake_text")
    assert back.filter("restored <> text").count() == 0
    trips = {r.session: r for r in chat.round_trip(m, KEY).collect()}
    assert trips["a"].answer == rows[3][3] and trips["a"].entities == 5 and trips["b"].answer == "hej"
    own = lambda kind, draw, text, gender: gen.Fake(kind, f"<{kind} {draw.digits(4)}>") if kind == "PESEL" else gen.generate(kind, draw, text, gender)
    shout = lambda rows: chat.echo(rows).withColumn("answer", F.concat(F.lit("Odp.: "), "answer"))
    trips = {r.session: r for r in chat.round_trip(m, KEY, provider=shout, build=own).collect()}
    assert trips["a"].answer == "Odp.: " + rows[3][3] and "<PESEL " in trips["a"].sent
    assert {r.session: r.violation for r in chat.validate(m).collect()} == {"a": None, "b": None, "c": "last_role"}
    assert [(r.role, r.content) for r in chat.merge_roles(m).filter("session = 'b'").collect()] == [("user", "NIP 1234563218\n\nhej")]
    assert {r.session: r.entity_count for r in vault.summary(state).collect()} == {"a": 3, "b": 1}
    left, gone = vault.delete(state, spark.createDataFrame([("a",), ("zz",)], "session string"))
    assert {r.session for r in left.rows.collect()} == {"b"} and {r.session: r.existed for r in gone.collect()} == {"a": True, "zz": False}


def test_original_of(spark):
    forms = [("Nowakiem", "Kowalskim"), ("Nowak", "Kowalski")]
    df = spark.createDataFrame([("Nowak", forms), ("nowakim", forms), ("Zupa", forms)], "fake string, forms array<struct<form:string,original:string>>")
    assert [r.original for r in vault.original_of(df).collect()] == ["Kowalski", "Kowalskim", None]


def test_row_tokens(spark):
    """Tokens made in the row are those of token_masks over exploded spans, and make no shuffle."""
    rows = [(1, [("PERSON", 9, 10, "b"), ("PERSON", 0, 1, "b"), ("PERSON", 4, 5, "a"), ("PESEL", 2, 3, "a"), ("ODD", 6, 7, "c"), ("PERSON", 4, 6, "aa")]), (2, [("PERSON", 1, 2, "z")]), (3, [])]
    df = spark.createDataFrame(rows, "k int, spans array<struct<entity_type:string,start:int,end:int,text:string>>")
    want = rewrite.token_masks(df.select("k", F.explode("spans").alias("x")).select("k", "x.*"), "k")
    made = df.select("k", rewrite.row_tokens("spans").alias("t"))
    pick = lambda d: sorted((r.k, r.entity_type, r.start, r.end, r.text, r.token) for r in d.collect())
    assert pick(made.select("k", F.explode("t").alias("x")).select("k", "x.*")) == pick(want)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
