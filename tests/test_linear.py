"""Linear passes against the rules they stand for: greedy alignment, substitution in sequence, near words, overlaps."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veilworks.operators import rewrite, scoring, spans


def greedy(gold, predicted, policy, by_type):
    """All pairs, by overlap and places."""
    rest = []
    for g, (a, b, k) in enumerate(zip(*gold, strict=True)):
        for p, (c, d, m) in enumerate(zip(*predicted, strict=True)):
            o = min(b, d) - max(a, c)
            if (not by_type or k == m) and ((a, b) == (c, d) if policy == "exact" else o > 0):
                rest.append((-o, g, p))
    out, used = [], (set(), set())
    for o, g, p in sorted(rest):
        if g not in used[0] and p not in used[1]:
            used[0].add(g)
            used[1].add(p)
            out.append((g, p, -o))
    return out


@pytest.mark.parametrize("policy", ["overlap", "exact"])
@pytest.mark.parametrize("by_type", [True, False])
def test_alignment_is_greedy(policy, by_type):
    rng = random.Random(3)

    def some():
        rows = [(s, s + rng.randrange(0, 9), rng.choice("abc")) for s in (rng.randrange(60) for _ in range(rng.randrange(25)))]
        return tuple(map(list, zip(*rows, strict=True))) if rows else ([], [], [])

    for _ in range(300):
        gold, predicted = some(), some()
        assert scoring.matched(gold, predicted, policy, by_type) == greedy(gold, predicted, policy, by_type)


def test_many_spans_of_one_document(spark):
    n = 20000
    spans_ = lambda shift: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.lit("NIP").alias("type"), (i * 10 + shift).alias("start"), (i * 10 + 8 + shift).alias("end"), F.lit("x").alias("text")))
    docs = spark.range(1).select(F.col("id").alias("doc_id"), spans_(0).alias("gold"), spans_(3).alias("predicted"))
    began = time.time()
    by = {r.match_kind: r["count"] for r in scoring.outcomes(scoring.align(docs)).groupBy("match_kind").count().collect()}
    assert by == {"overlap": n} and time.time() - began < 60
    none = docs.withColumn("predicted", F.expr("filter(predicted, x -> false)"))
    assert {r.match_kind for r in scoring.outcomes(scoring.align(none)).select("match_kind").distinct().collect()} == {"fn"}


def test_many_overlapping_spans(spark):
    """10^5 spans, of which every fourth lies inside the one before."""
    n = 100_000
    rows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.lit("NIP").alias("entity_type"), F.when(i % 4 == 3, i * 10 - 9).otherwise(i * 10).alias("start"), F.when(i % 4 == 3, i * 10 - 7).otherwise(i * 10 + 8).alias("end"), F.lit(0.5).alias("score"), F.lit("").alias("text"), F.struct(*[F.lit(None).alias(m) for m in spans.META]).alias("metadata"), F.lit(None).alias("lemma"), F.lit(None).alias("case")))
    df = spark.range(1).select(F.shuffle(rows).cast(f"array<{spans.SPAN}>").alias("s"))
    began = time.time()
    out = df.select(spans.resolve_overlaps(F.col("s")).alias("o")).select(F.size("o").alias("n"), F.aggregate("o", F.lit(0), lambda a, x: F.when((a >= 0) & (x["start"] >= a), x["start"]).otherwise(-1)).alias("rising")).first()
    assert out.n == n - n // 4 and out.rising > 0 and time.time() - began < 60
    assert spark.sql(f"select cast(array() as array<{spans.SPAN}>) s").select(F.size(spans.resolve_overlaps(F.col("s")))).first()[0] == 0


def in_sequence(text, forms, values):
    for form, value in zip(forms, values, strict=True):
        text = re.sub(rf"(?<!\w){re.escape(form)}(?!\w)", lambda _, v=value: v, text)
    return text


def test_restoring_in_one_pass():
    """Forms that hold each other, values that bring in or complete later forms, values whose edges are no letters."""
    rng = random.Random(7)
    parts = ["Jan", "Nowak", "Nowaka", "+48 5", "ul. Długa 5", "a", "5", "(x)", "Ewa", "_", "Jan Nowak"]
    gaps = [" ", "", ", ", ".", "  ", "\n"]
    some = lambda most: "".join(rng.choice(parts) + rng.choice(gaps) for _ in range(1 + rng.randrange(most)))
    for _ in range(3000):
        forms = sorted({some(2).strip() for _ in range(rng.randrange(1, 7))} - {""}, key=lambda f: (-len(f), f))
        values = [rng.choice([some(2), some(2).strip(), "Q", "Zed Zed"]) or "Q" for _ in forms]
        text = some(12)
        assert rewrite.Forms(forms, values).put(text) == in_sequence(text, forms, values), (text, forms, values)


def test_restoring_long_texts():
    forms = [f"Osoba{i:04d}" for i in range(2000)]
    values = [f"Imię{i}" for i in range(2000)]
    text = " ".join(f"{f}, i Osoba{i:04d}x" for i, f in enumerate(forms)) + " "
    text *= 5
    began = time.time()
    got = rewrite.Forms(forms, values).put(text)
    assert time.time() - began < 5 and got.count("Imię") == 10000 and got.count("x") == 10000


def test_splices():
    assert rewrite.spliced("abcdef", [(4, 5, "Y"), (1, 3, "XX")]) == "aXXdYf" and rewrite.spliced("ab", []) == "ab"
    assert rewrite.spliced("abcdef", [(1, 4, "X"), (3, 5, "Y")]) == "aX" + "abcYf"[4:]  # from the last to the first


def test_masks_of_values(spark):
    df = spark.createDataFrame([("Łódź i ŁÓDŹ, Łódźka", ["łódź", "Łódźka", ""]), (None, ["a"]), ("abc", None), ("İx x", ["x"])], "t string, v array<string>")
    got = [r.m for r in df.select(rewrite.mask_values("t", "v").alias("m")).collect()]
    assert got == ["\0\0\0\0 i \0\0\0\0, " + "\0" * 6, None, "abc", "İ\0 \0"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def best(word, tokens):
    """The rule of the fuzzy pass, token by token."""
    found = []
    for token, original in tokens:
        least = min(len(word), len(token))
        shared = next((i for i in range(least) if word[i] != token[i]), least)
        if least and shared / least >= rewrite.PREFIX and (d := distance(word, token)) <= rewrite.DISTANCE:
            found.append((d, original))
    nearest = {o for d, o in found if d == min(found)[0]}
    return nearest.pop() if len(nearest) == 1 else None


def test_near_tokens(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aąb") for _ in range(rng.randrange(1, 9)))
    tokens = [("s", word(), rng.choice("XYZ")) for _ in range(60)]
    words = [("s", word()) for _ in range(300)] + [("t", "aabb")]
    held = spark.createDataFrame(tokens, "session string, token string, original string")
    got = {(r.session, r.word): r.original for r in rewrite.near_tokens(spark.createDataFrame(words, "session string, word string"), held).collect()}
    want = {("s", w): o for s, w in words if s == "s" and len(w) >= rewrite.LEAST and (o := best(w, [t[1:] for t in tokens])) is not None}
    assert got == want and len(want) > 20


def test_common_subsequences():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
        assert scoring.common_length(a, b) == row[-1]
    many = [str(i % 997) for i in range(20000)]
    assert scoring.common_length(many, many[5:]) == 19995
