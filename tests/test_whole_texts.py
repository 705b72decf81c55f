"""Registered queries over whole texts, against brute force on small tables whose bodies hold identifiers at every depth."""

import re

from veilworks.functions import identifiers as ids
from veilworks.operators import rewrite
from veilworks.operators import spans as sp
from veilworks.plans import registry

FAR = "zdanie bez danych. " * 2000
BODIES = [
    "nic tu nie ma", "", None, "jan@poczta.pl na początku",
    FAR + "PESEL 44051401359, NIP 526-000-12-46, REGON 123456785 i 12345678512347, tel. 601 234 567 lub +48 601 234 567, " + FAR + "konto 61 1090 1014 0000 0712 1981 2874, ul. Długa 5/3, 00-950 Warszawa",
    "słowa 😀 " * 40 + "mail a.b@c.pl, dnia 12.01.2024 i 12 stycznia 2024 r.; PL61109010140000071219812874 44051401358 5260001246",
]


def weighed(d, weights):
    return sum(int(c) * w for c, w in zip(d, weights, strict=False))


def valid(kind, d):
    if kind == "PESEL":
        return -weighed(d, ids.PESEL_WEIGHTS) % 10 == int(d[10])
    if kind == "NIP":
        return weighed(d, ids.NIP_WEIGHTS) % 11 == int(d[9])
    if kind == "REGON":
        return weighed(d, ids.REGON9_WEIGHTS if len(d) == 9 else ids.REGON14_WEIGHTS) % 11 % 10 == int(d[-1])
    return int(d[2:] + "2521" + d[:2]) % 97 == 1


def brute_spans(text):
    """(type, start, end, score, text), without those inside others and those below their type's threshold."""
    found = []
    for r in sp.RECOGNIZERS:
        for pattern, base in r.patterns:
            for m in re.finditer(pattern, text, re.I | re.M | re.S):
                digits = re.sub("[^0-9]", "", m[0])
                if r.kind == "PHONE_NUMBER" and len(re.sub(r"^(?:00)?48(?=[0-9]{9}$)", "", digits)) != 9:
                    continue
                score = base if r.valid is None else sp.VALID if valid(r.kind, digits) else sp.INVALID
                words = re.findall(r"\w+", text[max(0, m.start() - 120) : m.start()].lower())[-sp.CONTEXT_WORDS :]
                score += sp.CONTEXT_BONUS if any(c in w for w in words for c in r.context) else 0
                found.append((r.kind, m.start(), m.end(), round(min(score, sp.CEILING), 2), m[0]))
    out, reach = [], -1
    for x in sorted(found, key=lambda x: (x[1], -x[2], -x[3], x[0])):
        if x[2] > reach:
            out.append(x)
            reach = x[2]
    return [x for x in out if x[3] >= sp.THRESHOLDS[x[0]]]


def brute_masked(text, spans):
    out, at = "", 0
    for kind, a, b, *_ in spans:
        if a >= at:
            out, at = out + text[at:a] + rewrite.MASKS[sp.ALIASES[kind]], b
    return out + text[at:]


def planted(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(BODIES)), "doc_id long, text string").write.parquet(path)
    return {r.doc_id: r.text for r in registry._planted(spark, str(tmp_path)).collect()}


def rows_of(spark, tmp_path, name):
    out = {}
    for r in registry.queries()[name](spark, str(tmp_path)).collect():
        out.setdefault(r.doc_id, []).append(tuple(r)[1:])
    return {k: sorted(v, key=lambda x: x[1:3]) for k, v in out.items()}


def test_documents(spark, tmp_path):
    texts = planted(spark, tmp_path)
    want = {i: brute_spans(t) for i, t in texts.items() if t is not None}
    assert {x[0] for x in want[4] if x[1] > 30000} == {"PESEL", "NIP", "REGON", "PHONE_NUMBER", "POLISH_BANK_ACCOUNT", "POLISH_ADDRESS"}
    assert rows_of(spark, tmp_path, "detect_documents") == want
    sure = {i: [x for x in v if x[0] in ("PESEL", "REGON", "DATE_TIME") and x[3] > 0.55] for i, v in want.items()}
    assert len(sure[4]) > 3 and len(sure[5]) > 3 and rows_of(spark, tmp_path, "detect_planted") == sure
    masked = {r.doc_id: r.masked for r in registry.queries()["mask_documents"](spark, str(tmp_path)).collect()}
    assert masked == {i: None if t is None else brute_masked(t, want[i]) for i, t in texts.items()}


def test_many_matches_and_distant_context(spark):
    many = " ".join(f"w{i}" for i in range(30000))
    far = "pesel" + " " * 500 + "44051401359"
    rows = spark.createDataFrame([(1, many), (2, far), (3, None), (4, ""), (5, "pesel a b c d e 44051401359")], "doc_id long, text string")
    words = {r.doc_id: r.w for r in rows.select("doc_id", sp.regex_spans("text", r"\w+").alias("w")).collect()}
    assert [(x.start, x.end, x.text) for x in words[1]] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"\w+", many)]
    assert words[3] == [] and words[4] == []
    found = {r.doc_id: r.score for r in sp.exploded(sp.detect(rows.filter("doc_id in (2, 5)"), recognizers=sp.RECOGNIZERS[:1]), "doc_id").collect()}
    assert round(found[2], 2) == 0.99 and round(found[5], 2) == 0.8


def test_gazetteer_runs_of_words(spark):
    rows = spark.createDataFrame([(1, "Anna Maria Nowak, Gdynia"), (2, None), (3, "")], "doc_id long, text string")
    gazetteer = spark.createDataFrame([("Anna Maria Nowak", "PERSON", "x", "nom"), ("Nowak, Gdynia", "PERSON", "y", "nom"), ("Gdynia", "LOCATION", "z", "nom")], "surface string, entity_type string, lemma string, case string")
    got = {r.doc_id: sorted((x.start, x.end, x.text) for x in r.names) for r in sp.names_from_gazetteer(rows, gazetteer, "doc_id").collect()}
    assert got == {1: [(0, 16, "Anna Maria Nowak"), (11, 24, "Nowak, Gdynia"), (18, 24, "Gdynia")]}


def test_addresses_behind_texts(spark, tmp_path):
    """A sentence of the text that the pattern takes for a street is no address behind the text; it is found with all spans."""
    rows = [(1, "de bocirr os.\nLicensed under CC BY-NC 4.0."), (2, "ul. Krótka 3, 30-001 Kraków"), (3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.address, r.postal_code, r.score) for r in registry.queries()["detect_addresses"](spark, str(tmp_path)).collect()}
    assert got == {(i, f"ul. Polna {i + 1}, 00-950 Warszawa", "00-950", 0.8) for i in (1, 2, 3)}
    found = {(r.doc_id, r.text) for r in registry.queries()["detect_documents"](spark, str(tmp_path)).collect() if r.entity_type == "POLISH_ADDRESS"}
    assert found == {(1, "os.\nLicensed under CC BY-NC 4"), (2, "ul. Krótka 3, 30-001 Kraków")}
