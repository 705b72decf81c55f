import random

import pytest
from pyspark.sql import functions as F

from veilworks.operators import scoring as sc

SPANS = "array<struct<type:string,start:int,end:int,text:string>>"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, f"doc_id int, gold {SPANS}, predicted {SPANS}")


def greedy(gold, predicted, policy):
    cand = []
    for g, a in enumerate(gold):
        for p, b in enumerate(predicted):
            o = min(a[2], b[2]) - max(a[1], b[1])
            if a[0] == b[0] and (o > 0 if policy == "overlap" else a[1:3] == b[1:3]):
                cand.append((-o, g, p))
    used_g, used_p, out = set(), set(), []
    for _, g, p in sorted(cand):
        if g not in used_g and p not in used_p:
            used_g.add(g)
            used_p.add(p)
            out.append((g, p))
    return out


@pytest.mark.parametrize("policy", ["overlap", "exact"])
def test_alignment_against_greedy(spark, policy):
    rng = random.Random(4)
    span = lambda: (rng.choice("AB"), a := rng.randint(0, 20), a + rng.randint(1, 8), "t")
    rows = [(i, [span() for _ in range(rng.randint(0, 6))], [span() for _ in range(rng.randint(0, 6))]) for i in range(80)]
    got = {r.doc_id: [(x.g, x.p) for x in r.pairs] for r in sc.align(docs_of(spark, rows), policy=policy).collect()}
    for i, gold, predicted in rows:
        assert got[i] == greedy(gold, predicted, policy)


def test_report_and_confusion(spark):
    rows = [(1, [("PERSON", 0, 5, "Kowal"), ("PESEL", 10, 21, "x")], [("PERSON", 0, 4, "Kowa"), ("NIP", 12, 20, "y"), ("PERSON", 30, 33, "z")]), (2, [], [])]
    aligned = sc.align(docs_of(spark, rows))
    found = sc.outcomes(aligned)
    report = {r.type: r for r in sc.detection_report(found, unmapped=1).collect()}
    assert (report["PERSON"].tp, report["PERSON"].fp, report["PERSON"].precision) == (1, 1, 0.5)
    assert (report["__micro__"].tp, report["__micro__"].fp, report["__micro__"].fn) == (1, 3, 1) and report["__micro__"].precision == 0.25
    assert (report["__macro__"].precision, report["__macro__"].recall, report["__macro__"].support) == (0.25, 0.5, 2)
    assert report["REGON"].support == 0 and len(report) == 12
    cells = {(r.gold, r.predicted): r.n for r in sc.confusion(aligned, unmapped=2).collect()}
    assert cells == {("PERSON", "PERSON"): 1, ("PESEL", "NIP"): 1, ("SPURIOUS", "PERSON"): 1, ("SPURIOUS", "MISS"): 2}
    assert sorted(r.line for r in sc.error_spans(found).collect()) == ["NIP@12", "PERSON@30", "PESEL: x"]


def leaks(spark, text, *gold, fakes=()):
    rows = [(1, text, [(t, 0, 0, v) for t, v in gold], list(fakes))]
    df = spark.createDataFrame(rows, f"doc_id int, outbound string, gold {SPANS}, fakes array<string>")
    return [(r.type, r.form_found, r.match_mode, r.start) for r in sc.leaks(df, fakes="fakes").orderBy("type", "start").collect()]


def test_leaks(spark):
    assert leaks(spark, "Widziano Kowalskiego.", ("PERSON", "Kowalski")) == [("PERSON", "Kowalskiego", "stem", 9)]
    assert leaks(spark, "Pan Kowalczyk", ("PERSON", "Kowalski")) == []
    assert leaks(spark, "Kowalski, Kowalski", ("PERSON", "Kowalski"), ("PERSON", "Kowalski")) == [("PERSON", "Kowalski", "exact", 0)]
    assert leaks(spark, "nr 440-514", ("PESEL", "440514")) == [("PESEL", "440514", "exact_id", 0)]
    assert leaks(spark, "w Lodzi", ("LOCATION", "Łódź")) == [("LOCATION", "lodz", "diacritic_fold", 0)]
    assert leaks(spark, "Janek", ("PERSON", "Jan")) == [] and leaks(spark, "to Jan!", ("PERSON", "Jan")) == [("PERSON", "Jan", "exact", 3)]
    assert leaks(spark, "Pan KOWALSKI", ("PERSON", "Kowalski"), fakes=["Kowalski"]) == []
    assert leaks(spark, "dnia 12.01.2025", ("DATE_TIME", "12.01.2024")) == []
    df = spark.createDataFrame([(1, "PERSON"), (1, "NIP"), (2, "NIP")], "doc_id int, type string")
    assert {(r.by, r.name, r.n) for r in sc.leak_totals(df).collect()} == {("type", "PERSON", 1), ("type", "NIP", 2), ("doc", "1", 2), ("doc", "2", 1), ("all", "", 3)}


def outcome(spark, text, kind, original, start=0):
    df = spark.createDataFrame([(1, text, [(kind, start, start + len(original), original)])], f"doc_id int, restored string, gold {SPANS}")
    r = sc.restoration(df).first()
    return r.outcome, r.surface, r.in_place


def test_restoration(spark):
    assert outcome(spark, "Kowalski był", "PERSON", "Kowalski") == ("exact", "Kowalski", True)
    assert outcome(spark, "pan Kowalski", "PERSON", "Kowalski") == ("exact", "Kowalski", False)
    assert outcome(spark, "pan Kowalskiego", "PERSON", "Kowalski") == ("correct_inflection", "Kowalskiego", False)
    assert outcome(spark, "pan Kawalski", "PERSON", "Kowalski") == ("fuzzy_recovered", "Kawalski", False)
    assert outcome(spark, "nic", "PERSON", "Kowalski") == ("missed", None, False)
    assert outcome(spark, "nr 44-05", "PESEL", "4405") == ("exact", "4405", False)
    details = spark.createDataFrame([(1, "A", "exact", True), (1, "B", "exact", True), (2, "A", "missed", False)], "doc_id int, type string, outcome string, in_place boolean")
    by, rate = sc.restoration_totals(details)
    assert rate.first().rate == 0.5 and {(r.type, r.outcome): r.n for r in by.collect()}[(None, "exact")] == 2


def test_latency_and_answers(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", 5.0)], "channel string, ms double")
    got = {r.channel: (r.p50, r.p90, r.p99, r["mean"], r.n) for r in sc.latency(df, "channel").collect()}
    assert got == {"a": (2.5, 3.7, 3.97, 2.5, 4), "b": (5.0, 5.0, 5.0, 5.0, 1)}
    odd = spark.createDataFrame([(None, 3.0), (None, 5.0), ("c", None)], "channel string, ms double")
    got = {r.channel: (r.p50, r.p99, r["mean"], r.n) for r in sc.latency(odd, "channel").collect()}
    assert got == {None: (4.0, 4.98, 4.0, 2), "c": (None, None, None, 0)}
    row = sc.latency(odd).first()
    assert (row.p50, row.n) == (4.0, 2)
    assert sc.latency(odd.limit(0), "channel").count() == 0
    pairs = spark.createDataFrame([("a b c d", "a c d"), ("", "x"), ("a b", "c")], "a string, b string")
    assert [r[0] for r in pairs.select(sc.rouge_l(F.col("a"), F.col("b"))).collect()] == [0.8571, 0.0, 0.0]
    values = spark.createDataFrame([(["Jan Kowalski", "44051401359", "brak"], "to Kowalski 440-514-01359"), ([], "x")], "v array<string>, a string")
    got = [r[0] for r in values.select(sc.factual_score(F.col("v"), F.col("a"))).collect()]
    assert abs(got[0] - 2 / 3) < 1e-12 and got[1] is None
    assert [r[0] for r in values.select(sc.reconstructs(F.col("v"), F.col("a"))).collect()] == [False, True]


@pytest.mark.parametrize("value", ["rand(3) * 1000", "floor(rand(3) * 40)", "if(id % 3 = 0, 7, rand(3))", "exp(rand(3) * 20)"])
def test_latency_in_bands(spark, monkeypatch, value):
    """Large groups are read in bands only; a third of all values may be one."""
    monkeypatch.setattr(sc, "SKETCH", 500)
    monkeypatch.setattr(sc, "EXACT_ROWS", 5000)
    df = spark.range(30000).selectExpr("if(id < 40, 'small', 'large') as channel", f"cast({value} as double) as ms")
    got = {r.channel: (r.p50, r.p90, r.p99, r.n) for r in sc.latency(df, "channel").collect()}
    for channel, mine in df.toPandas().groupby("channel")["ms"]:
        assert got[channel] == (*[pytest.approx(mine.quantile(q), abs=6e-4) for q in sc.QUANTILES], len(mine))


def test_corpus(spark):
    rows = [("b", "synthetic", "t2", [("PERSON", 0, 1, "t")]), ("a", "real", "t1", [])]
    df = spark.createDataFrame(rows, f"doc_id string, source string, text string, entities {SPANS}")
    stats = sc.corpus_stats(df)
    row = stats.first()
    assert (row.n_docs, row.n_entities, row.by_type, row.synthetic_ratio, row.all_types_present) == (2, 1, {"PERSON": 1}, 0.5, False)
    assert sc.target_warnings(stats).count() == 3
    version = sc.corpus_hash(df).first().version
    assert len(version) == 16 and version == sc.corpus_hash(df.repartition(3)).first().version
    assert version != sc.corpus_hash(df.withColumn("text", F.lit("x"))).first().version
    assert version != sc.corpus_hash(df.union(df.limit(1))).first().version
    assert len(sc.corpus_hash(df.limit(0)).first().version) == 16


def test_few_words_are_compared(spark):
    """What near_words drops shares no stem and is not as alike; of a long text without such words nothing is left."""
    words = "kowalski Kowalskiego KOWALSKĄ kowal kow Kawalski kowalsk Kowalewski kówalski İowa kańem Kań KAŃEM jan Jana Janowi żółw żółw Wyszogrodzki wyszogrodzkich wiszogrodzky abcdefghij abcdefghxy abcdefgxyz nowak"
    rows = [(words, t) for t in [*words.split(), "...", "", "a b"]] + [(None, "kowalski"), ("", "kowalski"), ("słowo i zdanie " * 500, "Kowalski"), ("kowalski", None)]
    df = spark.createDataFrame(rows, "text string, target string")
    same, alike = lambda w: sc.su.stems_shared(w, F.col("target")), lambda w: sc.su.similarity(w, F.col("target")) >= sc.FUZZY
    for least, tests in ((None, [same]), (sc.FUZZY, [same, alike])):
        near = df.withColumn("near", sc.near_words(F.col("text"), F.col("target"), least)).withColumn("all", sc.su.tokens(F.col("text")))
        for test in tests:
            for r in near.select("target", F.filter("all", test).alias("want"), F.filter("near", test).alias("got")).collect():
                assert (r.got or []) == (r.want or []), r.target
        assert near.filter("text like 'słowo%'").first().near == []


def test_spaces_and_digits(spark):
    texts = ["a b", "  a\t b ", "a b", "a   b\n\nc", "\n", " ", "", "a  b   c", "x\r\ny"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(sc.su.collapse(F.col("t")).alias("got"), F.trim(F.regexp_replace("t", r"(?U)\s+", " ")).alias("want")).collect()
    assert all(r.got == r.want for r in got)
    assert spark.createDataFrame([("a1-22 x3",)], "t string").select(sc.su.digits_only(F.col("t"))).first()[0] == "1223"
