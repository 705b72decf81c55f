"""Queries over the tables and the SQL that gives the same rows.

The tables hold no Polish identifiers, so texts that carry them are built from keys: the same expression in both
engines puts identifiers at known places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.functions import crypto, declension, dialog
from veilworks.functions import identifiers as ids
from veilworks.functions import surface as su
from veilworks.operators import conversation as chat
from veilworks.operators import rewrite, scoring, vault
from veilworks.operators import spans as sp
from veilworks.sources.shared import spread

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
KEY = bytes(range(32))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weighted_sql(d: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"CAST(substr({d}, {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights)) + ")"


# ---------------------------------------------------------------- detection on the tables' own texts

_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+\.[A-Za-z]{2,}"


@query(
    r"""
WITH d AS (SELECT doc_id, lang, regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}') AS m FROM documents)
SELECT lang, 'EMAIL_ADDRESS' AS entity_type, count(*) AS n, count(DISTINCT x) AS n_distinct, CAST(sum(length(x)) AS BIGINT) AS chars
FROM (SELECT lang, unnest(m) AS x FROM d) GROUP BY lang"""
)
def detect_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails by language: spans, overlaps, threshold, count. The flagship."""
    only = [r for r in sp.RECOGNIZERS if r.kind == "EMAIL_ADDRESS"]
    found = sp.exploded(sp.detect(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), recognizers=only), "lang")
    return found.groupBy("lang", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("n_distinct"), F.sum(F.length("text")).alias("chars"))


@query(
    r"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') AS m, string_split_regex(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') AS b FROM documents),
s AS (SELECT doc_id, m, b, unnest(range(1, len(m) + 1)) AS i FROM p WHERE len(m) > 0)
SELECT doc_id, CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start_at,
       m[i] AS text FROM s"""
)
def regex_span_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of every match, in code points."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", F.explode(sp.regex_spans("text", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")).alias("x"))
    return found.select("doc_id", F.col("x.start").alias("start_at"), F.col("x.text").alias("text"))


# ---------------------------------------------------------------- identifiers from keys


def _nine(c: str) -> Column:
    return F.lpad((F.col(c) * 7919 % 1000000000).cast("string"), 9, "0")


@query(
    f"""
WITH d AS (SELECT lpad(CAST(o_orderkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS r FROM orders),
e AS (SELECT r, r || CAST({weighted_sql("r", ids.NIP_WEIGHTS)} % 11 AS VARCHAR) AS n, '4' || r || '1' AS p FROM d)
SELECT count(*) AS n, CAST(sum(CASE WHEN {weighted_sql("r", ids.REGON9_WEIGHTS)} % 11 % 10 = CAST(substr(r, 9, 1) AS INTEGER) THEN 1 ELSE 0 END) AS BIGINT) AS regon_valid,
       CAST(sum(CASE WHEN length(n) = 10 THEN 1 ELSE 0 END) AS BIGINT) AS nip_valid,
       CAST(sum(CASE WHEN (10 - {weighted_sql("p", ids.PESEL_WEIGHTS)} % 10) % 10 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pesel_valid
FROM e"""
)
def checksum_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(_nine("o_orderkey").alias("r"))
    d = d.select("r", F.concat("r", ids.nip_control(F.col("r")).cast("string")).alias("n"), F.concat(F.lit("4"), "r", F.lit("1")).alias("p"))
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    return d.agg(F.count(F.lit(1)).alias("n"), count(ids.regon9_valid(F.col("r")), "regon_valid"), count(ids.nip_valid(F.col("n")), "nip_valid"), count(ids.pesel_valid(F.col("p")), "pesel_valid"))


@query(
    f"""
WITH d AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS r FROM orders),
e AS (SELECT o_orderkey, r || '0123' AS t13, '12345678' || r || '1234567' AS a24 FROM d)
SELECT o_orderkey, t13 || CAST({weighted_sql("t13", ids.REGON14_WEIGHTS)} % 11 % 10 AS VARCHAR) AS regon14, true AS regon14_ok,
       lpad(CAST((98 - CAST(CAST(a24 || '252100' AS HUGEINT) % 97 AS INTEGER)) % 97 AS VARCHAR), 2, '0') || a24 AS account, true AS account_ok
FROM e"""
)
def control_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated numbers pass their own checks."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(_nine("o_orderkey"), F.lit("0123")).alias("t"), F.concat(F.lit("12345678"), _nine("o_orderkey"), F.lit("1234567")).alias("a"))
    d = d.select("o_orderkey", F.concat("t", ids.regon14_control(F.col("t")).cast("string")).alias("regon14"), F.concat(ids.account_check_digits(F.col("a")), "a").alias("account"))
    return d.select("o_orderkey", "regon14", ids.regon14_valid(F.col("regon14")).alias("regon14_ok"), "account", ids.account_valid(F.col("account")).alias("account_ok"))


@query(
    f"""
WITH d AS (SELECT c_custkey, CAST(1800 + c_custkey % 500 AS INTEGER) AS y, CAST(1 + c_custkey % 12 AS INTEGER) AS m, CAST(1 + c_custkey % 28 AS INTEGER) AS dd, CAST(c_custkey * 37 % 10000 AS INTEGER) AS s, c_custkey % 2 = 0 AS f FROM customer),
e AS (SELECT *, CASE WHEN y < 1900 THEN 80 WHEN y < 2000 THEN 0 WHEN y < 2100 THEN 20 WHEN y < 2200 THEN 40 ELSE 60 END AS k, s - s % 2 + CASE WHEN f THEN 0 ELSE 1 END AS t FROM d),
g AS (SELECT *, lpad(CAST(y % 100 AS VARCHAR), 2, '0') || lpad(CAST(m + k AS VARCHAR), 2, '0') || lpad(CAST(dd AS VARCHAR), 2, '0') || lpad(CAST(t AS VARCHAR), 4, '0') AS ten FROM e)
SELECT c_custkey, ten || CAST((10 - {weighted_sql("ten", ids.PESEL_WEIGHTS)} % 10) % 10 AS VARCHAR) AS pesel, true AS valid, CASE WHEN f THEN 'female' ELSE 'male' END AS gender, CAST(make_date(y, m, dd) AS VARCHAR) AS born
FROM g"""
)
def pesel_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built from date and gender, and read back: five centuries."""
    k = F.col("c_custkey")
    made = ids.make_pesel((k % 500 + 1800).cast("int"), (k % 12 + 1).cast("int"), (k % 28 + 1).cast("int"), (k * 37 % 10000).cast("int"), k % 2 == 0)
    d = table(spark, sf_dir, "customer").select("c_custkey", made.alias("pesel"))
    p = F.col("pesel")
    return d.select("c_custkey", "pesel", ids.pesel_valid(p).alias("valid"), ids.pesel_gender(p).alias("gender"), ids.pesel_birth_date(p).cast("string").alias("born"))


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with identifiers of their keys in front of the text."""
    nine = F.lpad((F.col("doc_id") * 7919 % 100000000).cast("string"), 8, "0")
    regon = F.concat(nine, ids.regon9_control(nine).cast("string"))
    ten = F.concat(F.lit("44051"), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"))
    pesel = F.concat(ten, ids.pesel_control(ten).cast("string"))
    text = F.concat(F.lit("PESEL "), pesel, F.lit(" oraz REGON "), regon, F.lit(" i "), F.lit("000000001"), F.lit(" dnia 12.01.2024. "), F.col("text"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.alias("text"), pesel.alias("pesel"), regon.alias("regon"))


_PLANTED = f"""
n AS (SELECT doc_id, lpad(CAST(doc_id * 7919 % 100000000 AS VARCHAR), 8, '0') AS e, '44051' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') AS t FROM documents),
v AS (SELECT doc_id, e || CAST({weighted_sql("e", ids.REGON9_WEIGHTS)} % 11 % 10 AS VARCHAR) AS regon, t || CAST((10 - {weighted_sql("t", ids.PESEL_WEIGHTS)} % 10) % 10 AS VARCHAR) AS pesel FROM n)"""
_SURE, _LEAST = ("PESEL", "REGON", "DATE_TIME"), 0.55


@query(
    f"""
WITH {_PLANTED}
SELECT doc_id, 'PESEL' AS entity_type, 6 AS start_at, 17 AS end_at, 0.99::DOUBLE AS score, pesel AS text FROM v
UNION ALL SELECT doc_id, 'REGON', 29, 38, 0.99, regon FROM v
UNION ALL SELECT doc_id, 'DATE_TIME', 56, 66, 0.8, '12.01.2024' FROM v"""
)
def detect_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksum, label in front and threshold decide the score; a bad number without a label stays below others."""
    found = sp.exploded(sp.detect(_planted(spark, sf_dir).select("doc_id", "text")), "doc_id")
    return found.filter(F.col("entity_type").isin(*_SURE) & (F.col("score") > _LEAST)).select("doc_id", "entity_type", F.col("start").alias("start_at"), F.col("end").alias("end_at"), F.round("score", 2).alias("score"), "text")


@query(
    f"""
WITH {_PLANTED}
SELECT v.doc_id, 'PESEL [PESEL] oraz REGON [REGON] i 000000001 dnia [DATA]. ' || substr(d.text, 1, 50) AS masked FROM v JOIN documents d USING (doc_id)"""
)
def mask_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected and masked in the whole text; the SQL states the lead-in and 50 characters. mask_documents has the rest."""
    rows = sp.detect(_planted(spark, sf_dir).select("doc_id", "text"), mode="merge")
    sure = F.filter("entities", lambda x: x["entity_type"].isin(*_SURE) & (x["score"] > _LEAST))
    masked = rows.withColumn("s", sure).select("doc_id", rewrite.mask("text", "s").alias("masked"))
    lead = len("PESEL [PESEL] oraz REGON [REGON] i 000000001 dnia [DATA]. ")
    return masked.select("doc_id", F.substring("masked", 1, lead + 50).alias("masked"))


@query()
def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of every recognizer in the whole planted text. SQL has no such patterns; a test has brute force."""
    found = sp.exploded(sp.detect(_planted(spark, sf_dir).select("doc_id", "text")), "doc_id")
    return found.select("doc_id", "entity_type", F.col("start").alias("start_at"), F.col("end").alias("end_at"), F.round("score", 2).alias("score"), "text")


@query()
def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole planted text with every span of every recognizer masked."""
    rows = sp.detect(_planted(spark, sf_dir).select("doc_id", "text"), mode="merge")
    named = F.transform("entities", lambda x: F.struct(sp.canonical(x["entity_type"]).alias("entity_type"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.withColumn("s", named).select("doc_id", rewrite.mask("text", "s").alias("masked"))


# ---------------------------------------------------------------- overlaps, thresholds, windows


def _made_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by arithmetic of line items: some lie inside others, some overlap in part."""
    k = F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17
    kinds = F.array(*[F.lit(t) for t in ("PERSON", "NIP", "PESEL")])
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.element_at(kinds, (k % 3 + 1).cast("int")).alias("entity_type"), (k % 40).cast("int").alias("start"), (k % 40 + 1 + (k * 7) % 25).cast("int").alias("end"),
        ((k % 10) / F.lit(10.0)).alias("score"),
    )


_MADE = """s AS (SELECT l_orderkey AS doc_id, CASE k % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'NIP' ELSE 'PESEL' END AS entity_type, CAST(k % 40 AS INTEGER) AS start_at, CAST(k % 40 + 1 + (k * 7) % 25 AS INTEGER) AS end_at, (k % 10) / 10.0::DOUBLE AS score
  FROM (SELECT l_orderkey, l_orderkey * 31 + l_linenumber * 17 AS k FROM lineitem))"""


@query(
    f"""
WITH {_MADE},
o AS (SELECT *, max(end_at) OVER (PARTITION BY doc_id ORDER BY start_at, end_at DESC, score DESC, entity_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT doc_id, entity_type, start_at, end_at, score FROM o WHERE (reach IS NULL OR end_at > reach) AND score >= CASE entity_type WHEN 'PERSON' THEN 0.4 ELSE 0.25 END"""
)
def overlaps_then_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.struct(*[F.lit(None).alias(m) for m in sp.META])
    one = F.struct("entity_type", "start", "end", "score", F.lit("").alias("text"), empty.alias("metadata"), F.lit(None).alias("lemma"), F.lit(None).alias("case")).cast(sp.SPAN)
    rows = _made_spans(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(one).alias("x"))
    out = sp.exploded(rows.select("doc_id", sp.above_threshold(sp.resolve_overlaps(F.col("x"))).alias("entities")), "doc_id")
    return out.select("doc_id", "entity_type", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "score")


# ---------------------------------------------------------------- scalar functions


@query(
    r"""
SELECT c_custkey, trim(regexp_replace(lower('  ' || c_name || '   ' || c_mktsegment || ' '), '\s+', ' ', 'g')) AS normal, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits,
       regexp_replace(c_name, '[ \-]', '', 'g') AS stripped, translate(lower('Łódź ' || c_name), 'ąćęłńóśźż', 'acelnoszz') AS folded, levenshtein(lower(c_mktsegment), 'automobile') AS distance,
       CASE WHEN levenshtein(lower(c_mktsegment), 'buildings') <= 2 THEN levenshtein(lower(c_mktsegment), 'buildings') ELSE -1 END AS bounded
FROM customer"""
)
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", su.normalize(F.concat(F.lit("  "), name, F.lit("   "), seg, F.lit(" "))).alias("normal"), su.digits_only(name).alias("digits"), su.strip_separators(name).alias("stripped"),
        su.fold_diacritics(F.concat(F.lit("Łódź "), name)).alias("folded"), F.levenshtein(F.lower(seg), F.lit("automobile")).cast("long").alias("distance"), F.coalesce(su.bounded_distance(seg, F.lit("buildings")), F.lit(-1)).cast("long").alias("bounded"),
    )


@query("SELECT doc_id, CASE WHEN n_chars < 500 THEN '<500' WHEN n_chars < 1500 THEN '500-1499' WHEN n_chars < 3000 THEN '1500-2999' ELSE '>=3000' END AS bucket FROM documents")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", dialog.bucket(F.col("n_chars"), [500, 1500, 3000]).alias("bucket"))


_MODELS = ("gpt-4o", "claude-x", "ollama/llama", "echo/", "other")


@query(
    """
WITH m AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-x' WHEN 2 THEN 'ollama/llama' WHEN 3 THEN 'echo/' ELSE 'other' END AS model,
  CASE o_orderkey % 6 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' WHEN 2 THEN 'end_turn' WHEN 3 THEN 'max_tokens' WHEN 4 THEN 'odd' END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN model LIKE 'gpt-%' THEN 'openai' WHEN model LIKE 'claude-%' THEN 'anthropic' WHEN model LIKE 'ollama/%' THEN 'ollama' WHEN model LIKE 'echo/%' THEN 'echo' ELSE 'unknown_model' END AS provider,
       CASE WHEN model LIKE 'ollama/%' THEN substr(model, 8) ELSE model END AS sent, CASE WHEN raw IN ('length', 'max_tokens') THEN 'length' ELSE 'stop' END AS finish,
       CASE WHEN model = 'other' THEN 400 ELSE 503 END AS status
FROM m"""
)
def model_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    model = F.element_at(F.array(*[F.lit(m) for m in _MODELS]), (k % 5 + 1).cast("int"))
    raw = F.element_at(F.array(*[F.lit(m) for m in ("stop", "length", "end_turn", "max_tokens", "odd", None)]), (k % 6 + 1).cast("int"))
    m = table(spark, sf_dir, "orders").select("o_orderkey", model.alias("model"), raw.alias("raw"))
    kind = F.when(dialog.provider(F.col("model")) == "unknown_model", "unknown_model").otherwise("auth")
    return m.select("o_orderkey", dialog.provider(F.col("model")).alias("provider"), dialog.sent_model(F.col("model")).alias("sent"), dialog.finish_reason(F.col("raw")).alias("finish"), dialog.error_status(kind).alias("status"))


@query("SELECT s_suppkey, true AS same_key, true AS opened, 40 AS sealed_bytes FROM supplier")
def keyed_and_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed hashes repeat; a sealed value opens and is longer by nonce and tag. Nonces differ, so bytes aren't compared."""
    name = F.lpad(F.col("s_suppkey").cast("string"), 12, "0")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("v"))
    sealed = crypto.seal(F.col("v"), KEY)
    same = crypto.hmac_sha256(KEY, F.col("v")) == F.substring(crypto.forward_field(KEY, F.lit(None), F.col("v")), 5, 64)
    return rows.select("s_suppkey", same.alias("same_key"), (crypto.unseal(sealed, KEY) == F.col("v")).alias("opened"), F.length(sealed).alias("sealed_bytes"))


_NAMES = ("Kowalski", "Kowalska", "Anna", "Olga", "Marek", "Nowak", "Wojciech", "Kruk", "Kań", "Iwo")


@query(
    """
SELECT c_custkey, CASE c_custkey % 10 WHEN 0 THEN 'Kowalskiego' WHEN 1 THEN 'Kowalskiej' WHEN 2 THEN 'Anny' WHEN 3 THEN 'Olgi' WHEN 4 THEN 'Marka' WHEN 5 THEN 'Nowaka' WHEN 6 THEN 'Wojciecha' WHEN 7 THEN 'Kruka' WHEN 8 THEN 'Kania' ELSE 'Iwo' END AS gen,
       CASE c_custkey % 10 WHEN 0 THEN 'Kowalskim' WHEN 1 THEN 'Kowalską' WHEN 2 THEN 'Anną' WHEN 3 THEN 'Olgą' WHEN 4 THEN 'Markiem' WHEN 5 THEN 'Nowakiem' WHEN 6 THEN 'Wojciechem' WHEN 7 THEN 'Krukiem' WHEN 8 THEN 'Kańem' ELSE 'Iwo' END AS ins,
       CASE c_custkey % 10 WHEN 0 THEN 'Kowalskim' WHEN 1 THEN 'Kowalskiej' WHEN 2 THEN 'Annie' WHEN 3 THEN 'Oldze' WHEN 4 THEN 'Marku' WHEN 5 THEN 'Nowaku' WHEN 6 THEN 'Wojciechu' WHEN 7 THEN 'Kruku' WHEN 8 THEN 'Kaniu' ELSE 'Iwo' END AS loc
FROM customer"""
)
def declined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("c_custkey") % 10 + 1).cast("int"))
    d = table(spark, sf_dir, "customer").select("c_custkey", word.alias("w"))
    w, p = F.col("w"), declension.pattern_col(F.col("w"))
    return d.select("c_custkey", *[declension.decline_col(w, p, c).alias(c) for c in ("gen", "ins", "loc")])


# ---------------------------------------------------------------- conversations


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text")


@query(
    """
WITH t AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS fresh FROM conversations WHERE role <> 'system'),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)
SELECT conv_id AS session, CAST(run AS BIGINT) AS run, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM r GROUP BY conv_id, run, role"""
)
def merged_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.merge_roles(_messages(spark, sf_dir))


@query("SELECT conv_id AS session, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id")
def system_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.system_text(_messages(spark, sf_dir))


@query("SELECT conv_id AS session, max(turn) AS turn, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.last_user(_messages(spark, sf_dir))


@query("SELECT conv_id AS session, coalesce(max_by(text, turn) FILTER (WHERE role = 'user'), max_by(text, turn)) AS answer FROM conversations GROUP BY conv_id")
def echo_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.echo(_messages(spark, sf_dir))


@query("SELECT conv_id AS session, CASE WHEN bool_and(role IN ('system', 'user', 'assistant')) THEN CASE WHEN max_by(role, turn) <> 'user' THEN 'last_role' END ELSE 'role' END AS violation FROM conversations GROUP BY conv_id")
def chat_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.validate(_messages(spark, sf_dir))


def _private_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole messages, each with its session's PESEL in front, and every third with its email."""
    ten = F.concat(F.lit("44051"), F.lpad((F.col("session") % 100000).cast("string"), 5, "0"))
    pesel = F.concat(ten, ids.pesel_control(ten).cast("string"))
    mail = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" napisz: u"), F.col("session").cast("string"), F.lit("@poczta.pl"))).otherwise(F.lit(""))
    return spread(_messages(spark, sf_dir)).withColumn("text", F.concat(F.lit("PESEL "), pesel, mail, F.lit(". "), F.col("text")))


@query(
    """
SELECT CAST(conv_id AS VARCHAR) AS session, count(*) AS messages, count(*) + CAST(sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS entities, true AS hidden, true AS restored
FROM conversations GROUP BY conv_id"""
)
def pseudonymize_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No original is left in what is sent, and every message comes back whole."""
    hidden, state = chat.pseudonymize(_private_chat(spark, sf_dir), KEY)
    back = chat.depseudonymize(hidden.select("session", "text", "fake_text", "entities"), state, text="fake_text")
    gone = F.forall("entities", lambda x: ~F.contains(F.col("fake_text"), x["text"]))
    return back.groupBy("session").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.size("entities")).cast("long").alias("entities"), F.bool_and(gone).alias("hidden"), F.bool_and(F.col("restored") == F.col("text")).alias("restored"))


@query(
    """
SELECT CAST(conv_id AS VARCHAR) AS session, 'PESEL' AS entity_type, CAST(1 AS BIGINT) AS n, true AS one_fake FROM conversations GROUP BY conv_id
UNION ALL SELECT CAST(conv_id AS VARCHAR), 'EMAIL_ADDRESS', 1, true FROM conversations GROUP BY conv_id HAVING bool_or(turn % 3 = 0)"""
)
def session_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One original has one fake through all turns of its session."""
    _, state = chat.pseudonymize(_private_chat(spark, sf_dir), KEY)
    return vault.mappings(state).groupBy("session", "entity_type").agg(F.countDistinct("original").alias("n"), (F.countDistinct("fake") == F.countDistinct("original")).alias("one_fake"))


@query(
    """
SELECT CAST(conv_id AS VARCHAR) AS session, CASE WHEN k = 0 THEN 'PESEL' ELSE 'EMAIL_ADDRESS' END AS entity_type, count(*) AS n
FROM (SELECT conv_id, turn, unnest([0, 1]) AS k FROM conversations) WHERE k = 0 OR turn % 3 = 0 GROUP BY conv_id, k"""
)
def counts_over_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.counts_by_type(sp.detect(_private_chat(spark, sf_dir).withColumn("session", F.col("session").cast("string"))))


@query()
def chat_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole round trip with the echo provider. Fakes are this engine's own, so there is no SQL for it."""
    return chat.round_trip(_private_chat(spark, sf_dir), KEY)


@query(
    f"""
WITH m AS (SELECT conv_id, turn, role, text, '44051' || lpad(CAST(conv_id % 100000 AS VARCHAR), 5, '0') AS ten FROM conversations),
w AS (SELECT conv_id, turn, role, 'PESEL ' || ten || CAST((10 - {weighted_sql("ten", ids.PESEL_WEIGHTS)} % 10) % 10 AS VARCHAR) || CASE WHEN turn % 3 = 0 THEN ' napisz: u' || CAST(conv_id AS VARCHAR) || '@poczta.pl' ELSE '' END || '. ' || text AS text FROM m)
SELECT CAST(conv_id AS VARCHAR) AS session, count(*) + CAST(sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS entities, true AS hidden,
  md5(coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), arg_max(text, turn))) AS answer
FROM w GROUP BY conv_id"""
)
def answers_of_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The echoed answer comes back as the whole last user message, and what was sent holds none of its originals."""
    trip = chat.round_trip(_private_chat(spark, sf_dir), KEY)
    sent = lambda pattern: F.contains("sent", F.nullif(F.regexp_extract("answer", pattern, 0), F.lit("")))
    left = [F.coalesce(sent(p), F.lit(False)) for p in ("[0-9]{11}", r"u[0-9]+@poczta\.pl")]
    return trip.select("session", "entities", (~(left[0] | left[1])).alias("hidden"), F.md5(F.col("answer").cast("binary")).alias("answer"))


# ---------------------------------------------------------------- evaluation


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted spans by arithmetic: shifted, mistyped, missing and made up."""
    d = F.col("doc_id")
    gold = F.expr("""transform(sequence(0, 3), i -> named_struct('type', element_at(array('PERSON', 'PESEL', 'NIP', 'LOCATION'), cast((doc_id + i) % 4 + 1 as int)), 'start', cast(i * 20 as int), 'end', cast(i * 20 + 8 as int), 'text', concat('g', i)))""")
    pred = F.expr("""transform(filter(sequence(0, 4), i -> (doc_id + i) % 5 <> 0), i -> named_struct('type', element_at(array('PERSON', 'PESEL', 'NIP', 'LOCATION'), cast((doc_id + i + if((doc_id * 3 + i) % 7 = 0, 1, 0)) % 4 + 1 as int)),
        'start', cast(i * 20 + doc_id % 3 as int), 'end', cast(i * 20 + 8 as int), 'text', concat('p', i)))""")
    return table(spark, sf_dir, "documents").select(d.alias("doc_id"), gold.alias("gold"), pred.alias("predicted"))


_GOLD = """
t AS (SELECT doc_id, i, ['PERSON', 'PESEL', 'NIP', 'LOCATION'][CAST((doc_id + i) % 4 + 1 AS INTEGER)] AS g FROM documents, (SELECT unnest(range(0, 4)) AS i)),
q AS (SELECT doc_id, i, ['PERSON', 'PESEL', 'NIP', 'LOCATION'][CAST((doc_id + i + CASE WHEN (doc_id * 3 + i) % 7 = 0 THEN 1 ELSE 0 END) % 4 + 1 AS INTEGER)] AS p FROM documents, (SELECT unnest(range(0, 5)) AS i) WHERE (doc_id + i) % 5 <> 0),
j AS (SELECT doc_id, i, g, p FROM t FULL JOIN q USING (doc_id, i))"""


@query(
    f"""
WITH {_GOLD},
c AS (SELECT g AS type, CASE WHEN g = p THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN p IS NULL OR g <> p THEN 1 ELSE 0 END AS fn FROM j WHERE g IS NOT NULL
      UNION ALL SELECT p, 0, CASE WHEN g IS NULL OR g <> p THEN 1 ELSE 0 END, 0 FROM j WHERE p IS NOT NULL),
k AS (SELECT type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY type),
a AS (SELECT unnest(['{"', '".join(sp.CANONICAL)}']) AS type),
x AS (SELECT a.type, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM a LEFT JOIN k USING (type) UNION ALL SELECT '__micro__', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM k),
y AS (SELECT type, tp, fp, fn, tp + fn AS support, CAST(round(10000 * CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END) AS BIGINT) AS precision_e4, CAST(round(10000 * CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END) AS BIGINT) AS recall_e4 FROM x)
SELECT * FROM y
UNION ALL SELECT '__macro__', 0, 0, 0, CAST(sum(support) AS BIGINT), CAST(round(avg(precision_e4)) AS BIGINT), CAST(round(avg(recall_e4)) AS BIGINT) FROM y WHERE support > 0 AND type <> '__micro__'"""
)
def detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = scoring.detection_report(scoring.outcomes(scoring.align(_gold(spark, sf_dir))))
    e4 = lambda c: F.round(F.col(c) * 10000).cast("long").alias(f"{c}_e4")
    return report.select("type", "tp", "fp", "fn", "support", e4("precision"), e4("recall"))


@query(
    f"""
WITH {_GOLD}, c AS (SELECT coalesce(g, 'SPURIOUS') AS gold, coalesce(p, 'MISS') AS predicted, count(*) AS n FROM j GROUP BY ALL),
l AS (SELECT unnest(['{"', '".join((*sp.CANONICAL, scoring.MISS, scoring.SPURIOUS))}']) AS label)
SELECT a.label AS gold, b.label AS predicted, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.gold = a.label AND c.predicted = b.label"""
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 144 cells."""
    return scoring.confusion_grid(scoring.confusion(scoring.align(_gold(spark, sf_dir))))


@query(f"WITH {_GOLD} SELECT doc_id, count(*) AS n FROM j WHERE g = p AND doc_id % 3 = 0 GROUP BY doc_id")
def exact_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the exact policy only unshifted spans of one type match."""
    pairs = scoring.align(_gold(spark, sf_dir), policy="exact")
    return pairs.select("doc_id", F.size("pairs").cast("long").alias("n")).filter("n > 0")


@query(
    f"""
WITH {_GOLD}
SELECT doc_id, 'fn' AS match_kind, g || ': g' || i AS line FROM j WHERE g IS NOT NULL AND (p IS NULL OR g <> p)
UNION ALL SELECT doc_id, 'fp', p || '@' || (i * 20 + doc_id % 3) FROM j WHERE p IS NOT NULL AND (g IS NULL OR g <> p)"""
)
def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.error_spans(scoring.outcomes(scoring.align(_gold(spark, sf_dir))))


@query(
    """
WITH c AS (SELECT event_type AS channel, value AS ms FROM events)
SELECT channel, round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.9), 3) AS p90, round(quantile_cont(ms, 0.99), 3) AS p99, round(avg(ms), 3) AS mean, count(*) AS n FROM c GROUP BY channel"""
)
def latency_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), F.col("value").alias("ms"))
    return scoring.latency(samples, "channel")


@query(
    """
WITH c AS (SELECT event_type AS channel, CASE WHEN user_id < 10 THEN '<10' WHEN user_id < 50 THEN '10-49' ELSE '>=50' END AS bucket, value AS ms FROM events)
SELECT bucket, channel, round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.9), 3) AS p90, round(quantile_cont(ms, 0.99), 3) AS p99, round(avg(ms), 3) AS mean, count(*) AS n FROM c GROUP BY ALL"""
)
def latency_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), dialog.bucket(F.col("user_id"), [10, 50]).alias("bucket"), F.col("value").alias("ms"))
    return scoring.latency(samples, "bucket", "channel")


@query(
    """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'PESEL' ELSE 'PERSON' END AS type, CASE WHEN doc_id % 3 = 1 THEN 'stem' WHEN doc_id % 3 = 0 THEN 'exact_id' ELSE 'exact' END AS match_mode,
       CASE WHEN doc_id % 3 = 0 THEN '44051401359' WHEN doc_id % 3 = 1 THEN 'Kowalskiego' ELSE 'Kowalski' END AS form_found
FROM documents"""
)
def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identifier, an inflected name and a verbatim name behind whole texts, each found once however often gold has it."""
    d = F.col("doc_id") % 3
    planted = F.when(d == 0, "numer 44051401359 tu").when(d == 1, "widziano Kowalskiego, nie Kowalczyka").otherwise("oto Kowalski i Nowela")
    person = "named_struct('type', 'PERSON', 'start', 0, 'end', 8, 'text', 'Kowalski')"
    gold = F.expr(f"if(doc_id % 3 = 0, array(named_struct('type', 'PESEL', 'start', 0, 'end', 11, 'text', '44051401359')), array({person}, {person}))")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" | "), planted).alias("outbound"), gold.alias("gold"))
    return scoring.leaks(rows).select("doc_id", "type", "match_mode", "form_found")


@query(
    """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'correct_inflection' WHEN 2 THEN 'fuzzy_recovered' WHEN 3 THEN 'missed' ELSE 'correct_inflection' END AS outcome, doc_id % 5 = 0 AS in_place FROM documents"""
)
def restoration_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name in front of whole texts: in its place, inflected, misspelt, gone."""
    planted = F.element_at(F.array(*[F.lit(t) for t in ("Kowalski jest", "pan Kowalskiego", "pan Kawalski", "nikogo tu", "pan kowalską")]), (F.col("doc_id") % 5 + 1).cast("int"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = docs.select("doc_id", F.concat(planted, F.lit(" | "), F.coalesce("text", F.lit(""))).alias("restored"), F.expr("array(named_struct('type', 'PERSON', 'start', 0, 'end', 8, 'text', 'Kowalski'))").alias("gold"))
    return scoring.restoration(rows).select("doc_id", "outcome", "in_place")


@query(
    """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8571 WHEN 2 THEN 0.0 ELSE 0.3333 END AS rouge, CASE doc_id % 4 WHEN 2 THEN 0.0::DOUBLE ELSE 1.0 END AS factual FROM documents"""
)
def answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = F.element_at(F.array(*[F.lit(t) for t in ("a b c d", "a c d", "x y", "d c b a w z a d")]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", answers.alias("answer"))
    return rows.select("doc_id", scoring.rouge_l(F.lit("a b c d"), F.col("answer")).alias("rouge"), scoring.factual_score(F.array(F.lit("a"), F.lit("d"), F.lit("a")), F.col("answer")).alias("factual"))


@query(
    """
SELECT l_orderkey, '[OSOBA_1] zna [OSOBA_2], a [OSOBA_1] ma [PESEL_1].' AS masked, true AS same FROM (SELECT DISTINCT l_orderkey FROM lineitem)"""
)
def reversible_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values number in order of appearance; tokens go back to values whatever their case."""
    text = F.concat(F.lit("Ewa zna Jan"), F.col("k").cast("string"), F.lit(", a Ewa ma 44051401359."))
    docs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("text", text).withColumn("n", F.length(F.col("k").cast("string")))
    spans = F.expr("""transform(array(array(0, 3), array(8, 11 + n), array(15 + n, 18 + n), array(22 + n, 33 + n)), (p, i) -> named_struct('entity_type', if(i < 3, 'PERSON', 'PESEL'), 'start', p[0], 'end', p[1], 'text', substring(text, p[0] + 1, p[1] - p[0])))""")
    tokens = docs.select("k", F.col("text").alias("whole"), spans.alias("spans")).select("k", "whole", rewrite.row_tokens("spans").alias("tokens"))
    per = tokens.select("k", "whole", F.expr("transform(tokens, x -> named_struct('start', x.start, 'end', x.end, 'fake', x.token))").alias("parts"), F.expr("array_distinct(transform(tokens, x -> named_struct('token', x.token, 'value', x.text)))").alias("pairs"))
    per = per.withColumn("masked", rewrite.splice("whole", "parts")).withColumn("_low", F.lower("masked"))
    return per.select(F.col("k").alias("l_orderkey"), "masked", (F.lower(rewrite.restore_tokens("_low", "pairs")) == F.lower("whole")).alias("same"))


@query(
    """
SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS n_docs, CAST((SELECT count(*) FROM documents) * 4 AS BIGINT) AS n_entities, false AS all_types_present,
       round((SELECT count(*) FROM documents WHERE doc_id % 4 <> 0) / (SELECT count(*) FROM documents)::DOUBLE, 3) AS synthetic_ratio"""
)
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _gold(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 4 == 0, "real").otherwise("synthetic").alias("source"), F.col("gold").alias("entities"))
    return scoring.corpus_stats(docs).select("n_docs", "n_entities", "all_types_present", "synthetic_ratio")


@query("SELECT doc_id, toxic, CASE WHEN n > 0 THEN 1 ELSE 0 END AS predicted FROM labels JOIN (SELECT doc_id, len(regexp_extract_all(text, '[|]')) AS n FROM documents) USING (doc_id)")
def labels_against_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's verdicts beside labels, the input of a two-class report."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.contains("text", F.lit("|")).cast("int").alias("predicted"))
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").join(docs, "doc_id")


from veilworks.plans import further  # noqa: E402, F401  registers its queries here
