"""The index of forms and names in inflected texts."""

import pytest
from pyspark.sql import functions as F

from veilworks.functions import declension
from veilworks.operators import names

BASES = [("Jan  Kowalski", "PERSON", "male"), ("Jan Kowalski", "PERSON", "male"), ("Anna Nowak", "PERSON", "female"), ("Marek Mark", "PERSON", "male"), ("Kraków", "LOCATION", None), ("", "PERSON", None), (None, "LOCATION", None)]


@pytest.fixture
def index(spark):
    return names.form_index(spark.createDataFrame(BASES, "base string, entity_type string, gender string"))


def test_index(index):
    rows = {(r.form, r.lemma): list(r.cases) for r in index.collect()}
    assert rows["jana kowalskiego", "jan kowalski"] == ["gen", "acc"] and rows["kowalskim", "kowalski"] == ["ins", "loc"]
    assert rows["annie nowak", "anna nowak"] == ["dat", "loc"] and rows["nowak", "nowak"] == list(declension.CASES)
    assert rows["kraków", "kraków"] == ["nom", "acc"] and not any(f == "" for f, _ in rows)


def test_names(spark, index):
    texts = ["Do Krakowa z Janem Kowalskim", "o Annie  Nowak, ku Annie\nNowak", "panem Kowalskim i przy Kowalskim", "jana kowalskiego, KRAKOWEM", None, "", "Marka", "Kraków; Kraków, w Kraków", "x " * 30000 + "bez Anny Nowak"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "id long, text string, form string")
    got = {r.id: sorted((x.start, x.text, x.lemma, x.case, x.entity_type) for x in r.names) for r in names.names_in_texts(df, index, "id").collect()}
    assert got[0] == [(3, "Krakowa", "kraków", "gen", "LOCATION"), (13, "Janem", "jan", "ins", "PERSON"), (13, "Janem Kowalskim", "jan kowalski", "ins", "PERSON"), (19, "Kowalskim", "kowalski", "ins", "PERSON")]
    assert [(x[1], x[3]) for x in got[1] if " " in x[1] or "\n" in x[1]] == [("Annie  Nowak", "loc"), ("Annie\nNowak", "dat")]
    assert [x[3] for x in got[2]] == ["ins", "loc"] and [x[1:4] for x in got[3]] == [("KRAKOWEM", "kraków", "ins")]
    assert 4 not in got and 5 not in got
    assert [x[2] for x in got[6]] == ["marek"]  # of Marek and of Mark: the lesser lemma
    assert [x[3] for x in got[7]] == ["nom", "nom", "nom"] and (60004, "Anny Nowak", "anna nowak", "gen", "PERSON") in got[8]
    assert names.names_in_texts(df, index.limit(0), "id").count() == 0 and names.names_in_texts(df.filter(F.lit(False)), index, "id").count() == 0
