import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from veilworks.functions import crypto, declension, dialog
from veilworks.functions import identifiers as ids
from veilworks.functions import surface as su


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def results(df, c):
    return [r[0] for r in df.select(c.alias("r")).collect()]


V = None


@pytest.fixture(autouse=True)
def value(spark):
    global V
    V = F.col("v")


def test_pesel(spark):
    df = column(spark, ["44051401359", "44051401358", "4405140135", None, "4405140135x"])
    assert results(df, ids.pesel_valid(V)) == [True, False, False, False, False]
    df = column(spark, ["44051401340", "44051401359", "44"])
    assert results(df, ids.pesel_gender(V)) == ["female", "male", None]
    df = column(spark, ["44051401359", "02211012345", "00993199999"])
    assert [str(x) for x in results(df, ids.pesel_birth_date(V))] == ["1944-05-14", "2002-01-10", "None"]


def test_nip_regon_account(spark):
    assert results(column(spark, ["1234563218", "0123456789", "1234567890", "9000000000"]), ids.nip_valid(V)) == [True, True, False, False]
    assert results(column(spark, ["123456785", "123456789", "12345678500002", "12345678500009", ""]), ids.regon_valid(V)) == [True, False, True, False, False]
    good = "61109010140000071219812874"
    assert results(column(spark, [good, good[:-1] + "5", None]), ids.account_valid(V)) == [True, False, False]
    assert results(column(spark, [good[2:]]), ids.account_check_digits(V)) == ["61"]


def test_crypto(spark):
    key = bytes(range(32))
    df = column(spark, ["PERSON|jan", "", "zażółć 😀"])
    assert results(df, crypto.hmac_sha256(key, V)) == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in ("PERSON|jan", "", "zażółć 😀")]
    assert results(df, crypto.unseal(crypto.seal(V, key), key)) == ["PERSON|jan", "", "zażółć 😀"]
    assert results(column(spark, ["abc"]), F.length(crypto.seal(V, key))) == [31]
    assert crypto.checked_key(base64.b64encode(key).decode()) == key
    with pytest.raises(ValueError):
        crypto.checked_key(base64.b64encode(key[:16]).decode())


WORDS = ["Kowalski", "Kowalska", "Anna", "Anka", "Nowak", "Marek", "Jan", "Kuba", "Kraków", "Gdańsk", "Warszawa", "Zakopane", "", "Olga", "Wojciech", "Poznań", "Iwo", "Zawadzki", "Ń", "Bańa"]


@pytest.mark.parametrize("kind", ["person", "city"])
@pytest.mark.parametrize("gender", [None, "female"])
def test_columns_decline_as_python(spark, kind, gender):
    df = column(spark, WORDS)
    p = declension.pattern_col(V, F.lit(gender), kind)
    for row in df.select("v", p.alias("p"), declension.forms_col(V, p).alias("f")).collect():
        want = declension.pattern_of(row.v, gender, kind)
        assert row.p == want and dict(row.f) == declension.forms(row.v, want), row


def test_known_forms():
    assert declension.forms("Kowalski", "ADJ_M") == {"nom": "Kowalski", "gen": "Kowalskiego", "dat": "Kowalskiemu", "acc": "Kowalskiego", "ins": "Kowalskim", "loc": "Kowalskim"}
    assert declension.forms("Anka", "NOUN_F_A")["gen"] == "Anki" and declension.forms("Olga", "NOUN_F_A")["dat"] == "Oldze"
    assert declension.forms("Marek", "NOUN_M_CONS")["ins"] == "Markiem"
    assert declension.forms("Kraków", "CITY_M")["loc"] == "Krakowie"
    assert declension.person_forms("Jan", "Kowalski", "male")["ins"] == "Janem Kowalskim"


def test_surface(spark):
    df = column(spark, ["  Łódź \n  MIASTO ", ""])
    assert results(df, su.normalize(V)) == ["łódź miasto", ""]
    assert results(df, su.fold_diacritics(V)) == ["lodz miasto", ""]
    assert results(df, su.tokens(V)) == [["Łódź", "MIASTO"], []]
    assert results(column(spark, ["Kowalskiego", "Nowak", "Anna", "domami", "kota"]), su.stem(V)) == ["kowalski", "nowak", "anna", "domam", "kota"]
    pairs = spark.createDataFrame([("Kowalski", "Kowalskiego"), ("Kowalski", "Kowalczyk"), ("Jan", "jan"), ("Jan", "Jana")], "a string, b string")
    assert [r[0] for r in pairs.select(su.stems_shared(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]
    assert [r[0] for r in pairs.select(su.bounded_distance(F.col("a"), F.col("b"))).collect()] == [None, None, 0, 1]
    assert [r[0] for r in pairs.select(su.token_subset(F.lit("jan kowalski"), F.col("a"))).collect()] == [True, True, True, True]
    assert results(column(spark, ["jan mcDonald  x"]), su.title_words(V)) == ["Jan McDonald X"]
    assert results(column(spark, ["é"]), su.nfc(V)) == ["é"]


def test_mapping_keys(spark):
    rows = spark.createDataFrame([("PERSON", "Janem Kowalskim", "Jan Kowalski "), ("LOCATION", "Łodzi", None), ("NIP", "123-456-32-18", None), ("DATE_TIME", " 12  MAJA ", None)], "k string, t string, l string")
    assert [r[0] for r in rows.select(su.mapping_key(F.col("k"), F.col("t"), F.col("l"))).collect()] == ["jan kowalski", "łodzi", "1234563218", "12 maja"]


def test_dialog(spark):
    assert results(column(spark, ["end_turn", None, "max_tokens", "x"]), dialog.finish_reason(V)) == ["stop", "stop", "length", "stop"]
    df = column(spark, ["gpt-4", "ollama/llama3", "echo/x", "mistral"])
    assert results(df, dialog.provider(V)) == ["openai", "ollama", "echo", "unknown_model"]
    assert results(df, dialog.sent_model(V)) == ["gpt-4", "llama3", "echo/x", "mistral"]
    assert results(column(spark, [0, 499, 500, 3000], "int"), dialog.bucket(V, [500, 1500, 3000])) == ["<500", "<500", "500-1499", ">=3000"]
    assert dialog.providers(spark, {"openai": True, "ollama": True}).filter("key_configured").count() == 1
