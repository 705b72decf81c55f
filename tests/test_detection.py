import random
import re

from pyspark.sql import functions as F

from veilworks.operators import spans as sp


def found(spark, text, **options):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [(r.entity_type, r.start, r.end, round(r.score, 2), r.text) for r in sp.exploded(sp.detect(df, **options), "id").collect()]


def test_offsets_like_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("a1 😀ł2-") for _ in range(rng.randint(0, 40))) for _ in range(150)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for pattern in (r"\d+", r"[a-ł]\d"):
        got = {r.id: [(x.start, x.end, x.text) for x in r.s] for r in df.select("id", sp.regex_spans("text", pattern).alias("s")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t or "", re.I)], (pattern, t)


def test_all_types(spark):
    text = "😀 PESEL: 44051401359 tel. +48 601 234 567, mail a.b@c.pl, dnia 12.01.2024 i 12 stycznia 2024 r. ul. Długa 5/3, 00-950 Warszawa; konto 61 1090 1014 0000 0712 1981 2874"
    got = found(spark, text)
    assert [g[0] for g in got] == ["PESEL", "PHONE_NUMBER", "EMAIL_ADDRESS", "DATE_TIME", "DATE_TIME", "POLISH_ADDRESS", "POLISH_BANK_ACCOUNT"]
    assert all(text[s:e] == t for _, s, e, _, t in got)
    assert got[0][3] == 0.99 and got[4][3] == 0.75 and got[5][3] == 0.6


def test_scores_and_edges(spark):
    assert found(spark, "44051401358") == [("PESEL", 0, 11, 0.3, "44051401358")]
    assert found(spark, "pesel 44051401358")[0][3] == 0.5
    assert found(spark, "ą123456785") == []  # no word boundary after a letter
    assert found(spark, "  \n ") == [] and found(spark, None) == []
    assert found(spark, "44051401359", thresholds={"PESEL": 1.0}) == []


def test_metadata(spark):
    df = spark.createDataFrame([(1, "44051401359 PL61109010140000071219812874 ul. Krótka 7")], "id int, text string")
    meta = [x.metadata for x in sp.detect(df).first().entities]
    assert meta[0].gender == "male" and str(meta[0].birth_date) == "1944-05-14" and meta[0].checksum_valid
    assert meta[1].format == "IBAN" and meta[1].mod97_valid
    assert meta[2].has_street and meta[2].postal_code is None


def spans_of(spark, *rows):
    empty = {m: None for m in sp.META}
    return spark.createDataFrame([([dict(zip(("entity_type", "start", "end", "score"), r, strict=True), text="", metadata=empty, lemma=None, case=None) for r in rows],)], f"x array<{sp.SPAN}>")


def kept(df, c):
    return [(x.entity_type, x.start, x.end) for x in df.select(c.alias("y")).first().y]


def test_overlaps(spark):
    c = sp.resolve_overlaps(F.col("x"))
    assert kept(spans_of(spark, ("PESEL", 0, 11, 0.8), ("NIP", 0, 10, 0.8)), c) == [("PESEL", 0, 11)]
    assert kept(spans_of(spark, ("POLISH_ADDRESS", 0, 30, 0.6), ("LOCATION", 20, 28, 0.99)), c) == [("POLISH_ADDRESS", 0, 30)]
    assert kept(spans_of(spark, ("A", 0, 5, 0.5), ("B", 3, 9, 0.5)), c) == [("A", 0, 5), ("B", 3, 9)]
    assert kept(spans_of(spark, ("B", 0, 5, 0.5), ("A", 0, 5, 0.5), ("C", 0, 5, 0.9)), c) == [("C", 0, 5)]
    assert kept(spans_of(spark, ("A", 0, 5, 0.5), ("B", 3, 9, 0.5)), sp.merge_partial(c)) == [("A", 0, 5)]


def test_overlaps_against_greedy(spark):
    rng = random.Random(8)
    for _ in range(12):
        rows = [(rng.choice("ABC"), a, a + rng.randint(1, 9), rng.random()) for a in (rng.randint(0, 25) for _ in range(rng.randint(0, 14)))]
        want: list[tuple] = []
        for r in sorted(rows, key=lambda r: (-(r[2] - r[1]), r[1], -r[3], r[0])):
            if not any(k[1] <= r[1] and r[2] <= k[2] for k in want):
                want.append(r)
        assert sorted(kept(spans_of(spark, *rows), sp.resolve_overlaps(F.col("x")))) == sorted((r[0], r[1], r[2]) for r in want)


def test_gazetteer(spark):
    docs = spark.createDataFrame([(1, "Widział Janem Kowalskim w Łodzi."), (2, "nic")], "id int, text string")
    gaz = spark.createDataFrame([("Janem Kowalskim", "PERSON", "jan kowalski", "ins"), ("Łodzi", "LOCATION", "łódź", "loc")], "surface string, entity_type string, lemma string, case string")
    joined = docs.join(sp.names_from_gazetteer(docs, gaz, "id"), "id", "left").withColumn("names", F.coalesce("names", F.array().cast(f"array<{sp.SPAN}>")))
    rows = {(r.id, r.text, r.lemma, r.case) for r in sp.exploded(sp.detect(joined, extra=F.col("names")), "id").collect()}
    assert rows == {(1, "Janem Kowalskim", "jan kowalski", "ins"), (1, "Łodzi", "łódź", "loc")}


def test_labels(spark):
    df = spark.createDataFrame([("IBAN",), ("POLISH_ADDRESS",), ("ORG",)], "l string")
    assert [r[0] for r in df.select(sp.canonical(F.col("l"))).collect()] == ["BANK_ACCOUNT", "ADDRESS", None]


def test_suffixes_of_mail_addresses(spark):
    df = spark.createDataFrame([("a@b.pl, c@d.co.uk, e@f.invalid, g@uk.example",)], "text string")
    mails = lambda suffixes: [x.text for x in sp.detect(df, recognizers=[r for r in sp.with_suffixes(suffixes) if r.kind == "EMAIL_ADDRESS"]).first().entities]
    assert mails(["pl", ".CO.UK"]) == ["a@b.pl", "c@d.co.uk"] and mails(["uk"]) == ["c@d.co.uk"] and mails([]) == []
