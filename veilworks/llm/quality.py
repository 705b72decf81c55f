"""Quality rules: a table of thresholds compiled into projections of counts and ratios, built-in functions only.

Every rule compares two integers that are counted once per text, `count * per <= most * of` or `>=`, so that no
rounding is involved. Words are the runs of bytes other than space and U+0009 to U+000D.

Cases: null text counts as empty and fails for its few words; an empty table gives an empty result; rows are judged
one by one, so repeated rows are judged alike; further columns are ignored by `measure` and kept by `judge`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.llm.common import documents

WINDOW = 5
#: Function words of the languages looked for: English, French, German and Spanish. Fixed values.
STOP_WORDS = (
    "the of and to in that is was for it with as on be at by this are from or an a he not "
    "le la les de des et un une en que qui dans pour pas sur est avec au ce il "
    "der die das und ist nicht von mit den ein eine zu im auf sich dem des "
    "el los las y del que se por con una para su al lo como es no"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Kept while count * per <= most * of (bound 'most') or >= (bound 'least')."""

    name: str
    count: str
    of: str
    bound: str
    parts: int
    per: int


#: name, counted, of, bound, parts, per: e.g. at most 40 parts of 100.
RULES = (
    Rule("long_enough", "n_words", "one", "least", 10, 1),
    Rule("mean_word_not_short", "word_chars", "n_words", "least", 2, 1),
    Rule("mean_word_not_long", "word_chars", "n_words", "most", 15, 1),
    Rule("few_symbols", "n_symbols", "n_words", "most", 60, 100),
    Rule("stop_words", "n_stop", "n_words", "least", 2, 100),
    Rule("few_repeated_lines", "n_dup_lines", "n_lines", "most", 40, 100),
    Rule("few_bullet_lines", "n_bullets", "n_lines", "most", 90, 100),
    Rule("few_open_ends", "n_open_ends", "n_lines", "most", 50, 100),
)


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns of `keep` and the counts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop, n_bullets and n_open_ends.

    Words in windows that are found twice: hashes of all windows are counted, and only a text in which one occurs
    again has its windows put in order to find the places.
    """
    spaces = r"concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    held = [F.col(f"`{c}`") for c in keep]
    t = docs.select(*held, F.expr("coalesce(text, '')").alias("_t")).select(*held, "_t", F.expr(f"trim(BOTH {spaces} FROM _t)").alias("_b"))
    t = t.select(
        *held,
        F.expr(r"if(_b = '', array(), split(_b, r'[\x20\x09-\x0D]+'))").alias("_w"),
        F.expr(r"filter(split(_t, r'\n'), l -> l rlike r'[^\x20\x09-\x0D]')").alias("_l"),
        F.expr(r"cast(length(regexp_replace(_b, r'[\x20\x09-\x0D]+', '')) as bigint)").alias("word_chars"),
        F.expr(f"cast(length(_t) - length(translate(_t, '{SYMBOLS}', '')) as bigint)").alias("n_symbols"),
    )
    t = t.select(
        *held, "word_chars", "n_symbols",
        F.expr("cast(size(_w) as bigint)").alias("n_words"),
        F.expr("cast(size(_l) as bigint)").alias("n_lines"),
        F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)").alias("n_dup_lines"),
        F.expr(r"cast(size(filter(_l, l -> l rlike r'^[\x20\x09]*[*\x{2022}-]')) as bigint)").alias("n_bullets"),
        F.expr(r"cast(size(filter(_l, l -> l rlike r'(\.\.\.|\x{2026})[\x20\x09-\x0D]*$')) as bigint)").alias("n_open_ends"),
        F.expr(f"cast(size(filter(_w, w -> w in ({stop}))) as bigint)").alias("n_stop"),
        F.expr("transform(_w, w -> xxhash64(w))").alias("_h"),
    )
    counts = ["word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_bullets", "n_open_ends", "n_stop"]
    window = ", ".join(f"_h[i + {j}]" for j in range(WINDOW))
    t = t.select(*held, *counts, F.expr(f"if(n_words < {WINDOW}, array(), transform(sequence(0, size(_h) - {WINDOW}), i -> xxhash64({window})))").alias("_g"))
    t = t.select(*held, *counts, F.expr("if(size(array_distinct(_g)) < size(_g), array_sort(transform(_g, (g, i) -> struct(g, i))), array())").alias("_s"))
    again = "(j > 0 and e.g = _s[j - 1].g) or (j < size(_s) - 1 and e.g = _s[j + 1].g)"
    t = t.select(*held, *counts, F.expr(f"array_sort(transform(filter(_s, (e, j) -> {again}), e -> e.i))").alias("_p"))
    repeat = f"aggregate(transform(_p, (p, j) -> if(j < size(_p) - 1, least({WINDOW}, _p[j + 1] - p), {WINDOW})), 0L, (a, x) -> a + x)"
    return t.select(*held, *counts, F.expr(repeat).alias("n_repeat_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> F.Column:
    """The table as one condition."""
    out = F.lit(True)
    for r in rules:
        of = F.lit(1) if r.of == "one" else F.col(r.of)
        left, right = F.col(r.count) * F.lit(r.per), F.lit(r.parts) * of
        out &= (left <= right) if r.bound == "most" else (left >= right)
    return out


def judge(docs: DataFrame, *keep: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    base = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    return measure(docs, *keep).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir), "doc_id")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop", "n_bullets", "n_open_ends")


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    rules = " AND ".join(f"{r.count} * {r.per} {'<=' if r.bound == 'most' else '>='} {r.parts} * {'1' if r.of == 'one' else r.of}" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT k, i, w[i:i + 4] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
cover AS (SELECT k, CAST(count(DISTINCT i + j) AS BIGINT) AS n FROM again, (SELECT unnest(range(0, 5)) AS j) GROUP BY k),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(list_filter(w, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop,
             CAST(len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[*\x{{2022}}-]'))) AS BIGINT) AS n_bullets,
             CAST(len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_open_ends
      FROM d LEFT JOIN cover USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND ({rules}) AS kept FROM b
"""


ORACLE_SQL = _oracle()
