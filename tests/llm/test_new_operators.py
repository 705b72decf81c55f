"""Decontamination, hard negatives and whitening against brute force, with nulls, empty and long texts, ties, repeats, empty
tables and clashing names."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilworks.llm import decontaminate, hardneg, whitening
from veilworks.llm.common import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# ---------------------------------------------------------------- 11


def brute_hits(docs, items):
    held = {}
    for item, text in items:
        w = words(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            held.setdefault(tuple(w[i : i + m]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(p) for p in held}:
            for i in range(len(w) - m + 1):
                if (p := tuple(w[i : i + m])) in held:
                    hit.update(range(i, i + m))
                    found |= held[p]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def test_decontamination(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(["Ab", "ab", "c", "d1", "é", "漢字", "x.y", "I'm"]) for _ in range(n))
    items = [(i, some(rng.randrange(0, 30))) for i in range(40)] + [(7, some(12)), (None, some(11)), (50, None), (51, "..."), (52, "Ab c"), (53, "ZQ"), (54, "a " * 40), (10, "q " * 10 + some(20))]
    items += [(60 + i, items[0][1]) for i in range(5)] + [items[3]]
    docs = [(i, some(rng.randrange(0, 60))) for i in range(60)] + [(100 + i, some(15) + ", " + (t or "").upper().replace("É", "é") + "; " + some(9)) for i, (_, t) in enumerate(items)]
    docs += [(None, None), (900, ""), (901, "\n\t"), (902, some(20000) + " " + items[5][1]), (903, "a " * 3000), (904, "zq-ZQ_zq"), docs[70], docs[70], (None, docs[71][1])]
    d = spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id long, text string, items string, n_words int")
    b = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, hits string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute_hits(docs, items)
    assert sorted(map(repr, map(tuple, decontaminate.query(spark, str(tmp_path)).collect()))) == want
    monkeypatch.setattr(decontaminate, "SEGMENT", 16)
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    whole = key(decontaminate.contamination(d, b).collect())
    assert key(decontaminate.contamination(d, b, most=300).collect()) == whole  # several shards of the benchmark
    assert {r.doc_id for r in decontaminate.clean(d, b).collect() if r.doc_id} == {x for x, *_ in docs if x and f"({x}, " and any(w.startswith(f"({x},") and w.endswith("False)") for w in want)}
    assert all(not r.hits and not r["items"] for r in decontaminate.contamination(d, b.limit(0)).collect())
    assert decontaminate.contamination(d.limit(0), b).count() == 0


def test_runs_of_words(spark):
    d = spark.createDataFrame([(1, "x a b c d e f g h i j k y a b c d e f g h i j")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "y")], "item_id long, text string")
    got = decontaminate.contamination(d, b).first()
    assert [(h.start, h.end) for h in got.hits] == [(1, 23)] and got["items"] == ["1", "2"]


# ---------------------------------------------------------------- 12


def brute_negatives(rows):
    vecs = []
    for i, v, y in rows:
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vecs.append((i, np.floor(256 * np.array(v, float)).astype(np.int64), (y + 1) % 10 if i is not None and i % 7 == 0 else y))
    width = max((len(v) for _, v, _ in vecs), default=0)
    vecs = [(i, np.pad(v, (0, width - len(v))), y) for i, v, y in vecs]
    rank = lambda x: (-x[0], 1 << 63 if x[1] is None else x[1])
    out = []
    for n, (a, q, y) in enumerate(vecs):
        if a is None or a % 50:
            continue
        scored = [(int(v @ q), i, z == y) for m, (i, v, z) in enumerate(vecs) if m != n]
        for p, pid, _ in sorted((s for s in scored if s[2]), key=rank)[:5]:
            fits = sorted((s for s in scored if not s[2] and 50 * p <= 100 * s[0] <= 95 * p), key=rank)[:3]
            out += [(a, pid, r, i, p, s) for r, (s, i, _) in enumerate(fits, 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("scale", [0.2, 1e6])
def test_hard_negatives(spark, tmp_path, monkeypatch, scale):
    for name, value in (("SHARD", 60), ("ANCHORS", 3), ("LEAF", 8), ("STALLED", 4)):
        monkeypatch.setattr(hardneg, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    rows = [(i, (scale * (centres[i % 12] + 0.3 * rng.normal(size=6))).tolist(), int(rng.integers(0, 9))) for i in range(400)]
    rows += [(i, rows[0][1], 3) for i in range(1000, 1060)] + [rows[50], rows[51], (50, rows[7][1], 2), (None, rows[100][1], 4), (None, rows[100][1], 4)]  # ties, repeats, no id
    rows += [(2000, None, 1), (2050, [1.0, None], 1), (2100, [math.nan] * 6, 1), (2150, [math.inf] * 6, 1), (2200, rows[3][1], None), (2250, [], 1), (2300, [0.0] * 6, 2), (2350, [scale] * 3, 5), (-50, rows[9][1], 5)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, label int, rank string, row int")
    df.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(repr, map(tuple, hardneg.query(spark, str(tmp_path)).collect()))) == brute_negatives(rows)


def test_hard_negatives_of_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    with Scratch() as scratch:
        assert hardneg.mine(scratch.write(hardneg.coded(none), "v"), scratch).count() == 0
        one = spark.createDataFrame([(50, [1.0], 1)], none.schema)
        assert hardneg.mine(scratch.write(hardneg.coded(one), "v"), scratch).count() == 0


def test_cover_tree_bounds():
    """What a node holds lies within its radius of its centre, each member is in one leaf, and bounds hold for its products."""
    rng = np.random.default_rng(1)
    codes = np.vstack([rng.integers(-50, 50, (700, 5)), np.repeat([[1, 2, 3, 4, 5]], 400, 0), rng.normal(0, 2, (500, 5)).astype(int) + 90])
    tree = hardneg.CoverTree(codes, np.arange(len(codes)) % 3, codes.astype(float))
    under = lambda n: tree.members[n] if tree.children[n] is None else np.concatenate([under(k) for k in tree.children[n]])
    assert sorted(under(0).tolist()) == list(range(len(codes)))
    for q in rng.integers(-60, 60, (5, 5)):
        low, high = hardneg.bounds(tree.centres @ q, tree.radii, float(np.sqrt(q @ q)), tree.norm)
        for n in range(len(tree.centre)):
            got = codes[under(n)] @ q
            assert low[n] <= got.min() and got.max() <= high[n]
            assert tree._distance(under(n), tree.centre[n]).max() <= tree.radius[n] + 1e-9


# ---------------------------------------------------------------- 13


def brute_whitened(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v in kept)
    x = np.array([np.floor(64 * np.pad(np.array(v, float), (0, width - len(v)))) for _, v in kept]).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    z = (n * x - s) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    keep = e[::-1] > 1e-9 * e.max()
    e, u = e[::-1][keep], u[:, ::-1][:, keep]
    return kept, n, ((n * x - s) ** 2).sum(1), z @ u / np.sqrt(e), e / np.trace(z.T @ z / n)


def test_whitening(spark, tmp_path):
    rng = np.random.default_rng(9)
    mixed = rng.normal(size=(300, 9)) @ np.diag([9, 5, 4, 2.5, 2, 1, 1e-1, 5, 3]) @ rng.normal(size=(9, 9))
    rows = [(i, [*v, 7.0, v[0]]) for i, v in enumerate(mixed.tolist())]  # one dimension is constant, one occurs twice
    rows += [(1000, None), (1001, [1.0, None]), (1002, [math.nan]), (1003, [-math.inf]), (1004, [1.0, 2.0]), (1005, []), (None, rows[0][1]), rows[1], rows[1]]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "vec_id long, embedding array<double>, whitened string, i int, n int")
    df.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.query(spark, str(tmp_path)).toPandas()
    kept, n, deviation, want, explained = brute_whitened(rows)
    assert (got.n == n).all() and got.identity_error.max() < 1e-9 and len(got) == len(kept) * want.shape[1] and got.component.max() == want.shape[1] == 11
    for c in range(want.shape[1]):
        own = got[got.component == c + 1]
        ids = own.vec_id.astype(object).where(own.vec_id.notna(), None)
        by = sorted(zip([-1 if i is None else int(i) for i in ids], own.deviation, own.whitened, strict=True))
        w = want[:, c] * np.sign(own[own.vec_id == 5].whitened.iloc[0] * want[5, c])
        ref = sorted(zip([-1 if i is None else i for i, _ in kept], deviation, w, strict=True))
        assert [(i, d) for i, d, _ in by] == [(i, d) for i, d, _ in ref]
        assert np.allclose([x for *_, x in by], [x for *_, x in ref], atol=1e-7) and np.allclose(own.explained, explained[c], rtol=1e-9)


def test_whitening_without_variance(spark, tmp_path):
    for k, rows in enumerate(([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)])):
        spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        assert whitening.query(spark, f"{tmp_path}/{k}").count() == 0


def test_factors():
    rng = np.random.default_rng(2)
    for d, r in ((1, 1), (7, 3), (20, 20), (33, 12)):
        x = rng.normal(size=(60, r)) @ rng.normal(size=(r, d)) * rng.choice([1e-4, 1.0, 1e4], d)
        a = x.T @ x
        factor, order = whitening.pivoted_cholesky(a)
        assert factor.shape == (d, r) and np.allclose(factor @ factor.T, a[order][:, order], rtol=1e-9, atol=1e-9 * a.max())
        e, v = whitening.one_sided_jacobi(factor)
        assert np.allclose(v @ v.T, np.eye(r), atol=1e-9) and (np.diff(e) <= 0).all() and np.allclose(e.sum(), np.trace(a))


def test_large_deviations():
    x = np.array([[1 << 40, 5], [7, 1 << 41]], np.int64)
    big = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, (1 << 41, 12), strict=True)) for row in x]
    assert whitening.deviations(x, 3, np.array([1 << 41, 12])).to_pylist() == [v if v < 1 << 63 else None for v in big]
