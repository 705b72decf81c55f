"""Hard negatives by best-first descent of cover trees over norm-augmented vectors.

A candidate gets one more coordinate, so that all have the greatest norm M and lie on a sphere; a query gets 0 there, and
inner products stay. The greater the inner product, the smaller the angle. A node of a cover tree has a centre and holds
candidates within its covering radius, that of its level; the angle of the query to the centre, more or less the angle of the radius,
bounds the inner products of all that it holds. The descent takes the node of the greatest upper bound first, leaves out
nodes that lie outside of every window of scores that is still open, or that hold only the anchor's own label, and
counts a leaf's scores in integers. A window closes when its best are found and no node left can reach the last of them.

Positives are searched label by label, negatives over all rows. Candidates are dealt into cells around pivots, chosen
far apart from a sample of bounded size, and cells into shards of bounded size; an anchor goes only to shards of cells
whose bounds meet one of its windows. Every row is in exactly one shard, a tree is built in each, and results are
merged by anchor and positive, so that they are exact whatever the pivots.

Cases: a row whose label or vector is null, or that holds a null or non-finite component, takes no part; rows that share
a vec_id are rows of their own, ties go to the smaller vec_id, a null one last; shorter vectors end with zeros; an anchor without a
positive, or a positive without a negative (any whose score is below 0), gives no row; empty tables give empty
results; further columns, of whatever name, are ignored.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilworks.llm.common import Scratch, finite_vectors, list_matrix

SCALE, EVERY, SHIFTED, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: Percent of a positive's score between which its negatives' scores lie.
LOWEST, HIGHEST = 50, 95
#: Rows of a tree and anchors of a block; cells at most, and rows of which their pivots are chosen.
SHARD, ANCHORS, PIVOTS, SAMPLE = 8192, 8192, 256, 4096
#: Candidates of a leaf, ratio of the covering radii of two levels, members below which a child is pooled with others,
#: and such children in a row after which the rest of a level is pooled: so few are near each other that no bound parts them.
LEAF, BASE, SMALL, STALLED = 256, 1.3, 8, 32
_FAR = (1 << 63) - 1  # stands for a null vec_id


def augmented(codes: np.ndarray, norm2: float) -> np.ndarray:
    """codes with the coordinate that makes every squared norm norm2."""
    x = codes.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(norm2 - (x * x).sum(1), 0.0))[:, None]])


def bounds(dots: np.ndarray, radius: np.ndarray, q_norm: float, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of a query with what lies within each radius of centres of the given products."""
    most = q_norm * norm
    if not most:
        return np.zeros(len(dots)), np.zeros(len(dots))
    angle = np.arccos(np.clip(dots / most, -1.0, 1.0))
    wide = 2 * np.arcsin(np.minimum(radius / (2 * norm), 1.0))
    slack = 1e-6 * most + 1e-6
    return most * np.cos(np.minimum(angle + wide, np.pi)) - slack, most * np.cos(np.maximum(angle - wide, 0.0)) + slack


class CoverTree:
    """Nodes by number: radius, children or members, and the label that all members share, if they do.

    codes count bounds, `scored` (the same numbers) scores, in a kind that is exact.
    """

    def __init__(self, codes: np.ndarray, labels: np.ndarray, scored: np.ndarray):
        self.norm = float(np.sqrt((codes.astype(np.float64) ** 2).sum(1).max(initial=0.0)))
        self.points = augmented(codes, self.norm**2)
        self.labels = labels
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.members: list[np.ndarray | None] = []
        self.only: list[int | None] = []
        if len(codes):
            everyone = np.arange(len(codes))
            self._grow(self._node(0, everyone, self._distance(everyone, 0)), everyone)
        self.centres = codes[self.centre].astype(np.float64) if len(codes) else np.zeros((0, codes.shape[1]))
        self.radii = np.array(self.radius)
        self.leaves = {i: (m, np.ascontiguousarray(scored[m]), labels[m]) for i, m in enumerate(self.members) if m is not None}

    def _distance(self, members: np.ndarray, centre: int) -> np.ndarray:
        away = self.points[members] - self.points[centre]
        return np.sqrt((away * away).sum(1))

    def _node(self, centre: int, members: np.ndarray, away: np.ndarray) -> int:
        own = self.labels[members]
        self.centre.append(centre)
        self.radius.append(float(away.max()))
        self.only.append(int(own[0]) if (own == own[0]).all() else None)
        self.children.append(None)
        self.members.append(None)
        return len(self.centre) - 1

    def _grow(self, root: int, everyone: np.ndarray) -> None:
        todo = [(root, everyone)]
        while todo:
            node, members = todo.pop()
            if len(members) <= LEAF or self.radius[node] == 0:
                self.members[node] = members
                continue
            made, pooled = self._level(node, members)
            kids = []
            for centre, own, away in made:
                kids.append(self._node(centre, own, away))
                todo.append((kids[-1], own))
            for i in range(0, len(pooled), LEAF):
                own = pooled[i : i + LEAF]
                kids.append(self._node(self.centre[node], own, self._distance(own, self.centre[node])))
                self.members[kids[-1]] = own
            self.children[node] = np.array(kids)

    def _level(self, node: int, members: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]:
        """The next level below: centres more than its covering radius apart, each with those it covers. What few are
        covered by is pooled in order of the centres."""
        reach = self.radius[node] / BASE
        made, few, stalled = [], [], 0
        centre, rest = self.centre[node], members
        while len(rest) and stalled < STALLED:
            away = self._distance(rest, centre)
            near = away <= reach
            own = rest[near]
            if len(own) < SMALL:
                few.append(own)
                stalled += 1
            else:
                made.append((centre, own, away[near]))
                stalled = 0
            rest = rest[~near]
            if len(rest):
                centre = int(rest[0])
        return made, np.concatenate([*few, rest])

    def search(self, query: np.ndarray, ids: np.ndarray, k: int, low: np.ndarray, high: np.ndarray, label: int | None = None, skip: int = -1) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window from low to high the k best members and their scores, by score and then by id.

        label: members of it don't count; skip: a member that doesn't count either.
        """
        best: list[list[tuple[float, int, int]]] = [[] for _ in low]  # (-score, id, member), rising
        if self.centre:
            q = query.astype(np.float64)
            q_norm = float(np.sqrt(q @ q))
            exact = query.dtype.kind == "f"
            need, most_of, open_ = [float(x) for x in low], [float(x) for x in high], [j for j in range(len(low)) if low[j] <= high[j]]
            least, most = bounds(self.centres @ q, self.radii, q_norm, self.norm)
            heap = [(-float(most[0]), 0, float(least[0]))]
            while heap:
                upper, node, lower = heapq.heappop(heap)
                open_ = [j for j in open_ if need[j] <= -upper]  # all that is left is below
                if not open_:
                    break
                from_, to = min(need[j] for j in open_), max(most_of[j] for j in open_)
                if lower > to or (label is not None and self.only[node] == label):
                    continue
                kids = self.children[node]
                if kids is not None:
                    for i in kids[(most[kids] >= from_) & (least[kids] <= to)].tolist():
                        heapq.heappush(heap, (-float(most[i]), i, float(least[i])))
                    continue
                own, rows, labels = self.leaves[node]
                got = rows @ query
                for i in ((got >= from_) & (got <= to)).nonzero()[0].tolist():
                    member, score = int(own[i]), float(got[i]) if exact else int(got[i])
                    if member == skip or (label is not None and labels[i] == label):
                        continue
                    one = (-score, int(ids[member]), member)
                    for j in open_:
                        if need[j] <= score <= most_of[j] and (len(best[j]) < k or one < best[j][-1]):
                            insort(best[j], one)
                            del best[j][k:]
                            if len(best[j]) == k:
                                need[j] = max(need[j], -best[j][-1][0])
        return [(np.array([m for _, _, m in b], np.int64), np.array([-s for s, _, _ in b], query.dtype)) for b in best]


# ---------------------------------------------------------------- rows, cells and shards


def coded(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label and codes, floor(256 * x), of the rows that take part; row names a row in the written table."""
    label = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long")
    codes = F.expr(f"transform(embedding, x -> cast(floor({SCALE}D * cast(x as double)) as bigint))")
    rows = finite_vectors(vectors.filter("label is not null"))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), codes.alias("codes"))


def _kind(*sides: np.ndarray) -> type:
    """The least of float32, float64 and int64 that holds every partial sum of the inner products exactly."""
    most = sides[0].shape[1]
    for x in sides:
        most *= float(np.abs(x).max(initial=0))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(_FAR).to_numpy()


def _both(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    a, b = (list_matrix(t.column("codes"), np.int64) for t in (left, right))
    width = max(a.shape[1], b.shape[1], 1)
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


_POSITIVE = "anchor long, row long, positive_id long, positive_score long"


def _positives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """The best of one part of a label's rows for one block of its anchors."""
    out = {c.split()[0]: [] for c in _POSITIVE.split(", ")}
    if anchors.num_rows and rows.num_rows:
        q, d = _both(anchors, rows)
        kind = _kind(q, d)
        tree, ids, names = CoverTree(d, np.zeros(len(d), np.int64), d.astype(kind)), _ids(rows.column("vec_id")), rows.column("row").to_numpy()
        place = {r: i for i, r in enumerate(names.tolist())}
        whole = np.array([-(1 << 62)]), np.array([1 << 62])
        for x, own in zip(q.astype(kind), anchors.column("row").to_pylist(), strict=True):
            got, score = tree.search(x, ids, POSITIVES, *whole, skip=place.get(own, -1))[0]
            out["anchor"] += [own] * len(got)
            out["row"] += names[got].tolist()
            out["positive_id"] += [None if i == _FAR else i for i in ids[got].tolist()]
            out["positive_score"] += [int(s) for s in score]
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def positives(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor (its row), place (from 1), positive_id and positive_score: the first rows of each anchor's label but itself.

    A label's rows are dealt into parts and its anchors into blocks, each of bounded size.
    """
    size = lambda df, name, most: df.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    dealt = size(rows, "parts", SHARD).join(size(anchors, "blocks", ANCHORS), "label")
    part = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = anchors.join(dealt, "label").select("row", "codes", "label", part("blocks", 2).alias("block"), each("parts").alias("part"))
    r = rows.join(dealt, "label").select("row", "vec_id", "codes", "label", part("parts", 1).alias("part"), each("blocks").alias("block"))
    key = ("label", "part", "block")
    met = a.groupBy(*key).cogroup(r.groupBy(*key)).applyInArrow(_positives, _POSITIVE)
    order = Window.partitionBy("anchor").orderBy(F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last(), "row")
    return met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= POSITIVES).select("anchor", "place", "positive_id", "positive_score")


def pivots(rows: DataFrame, n: int, norm2: float) -> np.ndarray:
    """Augmented pivots for n rows, far apart: each is, of a sample of bounded size, the one farthest from those before."""
    most = min(PIVOTS, max(1, -(-n // SHARD)))
    held = list_matrix(rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("codes").toArrow().column("codes"), np.int64)
    points = augmented(held, norm2)
    chosen, away = [0], np.full(len(points), np.inf)
    while len(chosen) < most:
        step = points - points[chosen[-1]]
        away = np.minimum(away, (step * step).sum(1))
        if not away.max(initial=0.0):
            break
        chosen.append(int(np.argmax(away)))
    return points[chosen]


def _fitted(codes: np.ndarray, width: int) -> np.ndarray:
    return codes[:, :width] if codes.shape[1] >= width else np.pad(codes, ((0, 0), (0, width - codes.shape[1])))


def in_cells(rows: DataFrame, centres: np.ndarray, norm2: float) -> DataFrame:
    """rows with cell, the nearest pivot, and away, the distance to it. What a vector has beyond the pivots' width adds to it."""
    width = centres.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = list_matrix(batch.column("codes"), np.int64)
            beyond = (x[:, width:].astype(np.float64) ** 2).sum(1)
            points = augmented(x, norm2)
            near = np.hstack([_fitted(x, width), points[:, -1:]])
            d2 = (near * near).sum(1)[:, None] - 2 * near @ centres.T + (centres * centres).sum(1)
            cell = d2.argmin(1)
            step = near - centres[cell]  # anew, without cancellation
            away = np.sqrt((step * step).sum(1) + beyond)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], [*batch.schema.names, "cell", "away"])

    return rows.mapInArrow(run, "row long, vec_id long, label long, codes array<long>, cell int, away double")


def _routed(anchors: DataFrame, centres: np.ndarray, reach: np.ndarray, norm2: float) -> DataFrame:
    """anchors (row, label, codes, windows) with each cell whose bounds meet one of the windows."""
    width, norm = centres.shape[1] - 1, float(np.sqrt(norm2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = list_matrix(batch.column("codes"), np.float64)
            dots = _fitted(q, width) @ centres[:, :width].T
            cells, at = [], []
            for i, found in enumerate(batch.column("windows").to_pylist()):
                least, most = bounds(dots[i], reach, float(np.sqrt(q[i] @ q[i])), norm)
                meets = np.zeros(len(reach), bool)
                for w in found:
                    meets |= (most >= w["low"]) & (least <= w["high"])
                cells.append(np.flatnonzero(meets & (reach >= 0)))
                at.append(np.full(len(cells[-1]), i))
            at = np.concatenate(at) if at else np.zeros(0, np.int64)
            out = pa.Table.from_batches([batch]).take(pa.array(at)).append_column("cell", pa.array(np.concatenate(cells).astype(np.int32) if cells else [], pa.int32()))
            yield from out.combine_chunks().to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    return anchors.mapInArrow(run, f"{schema}, cell int")


_NEGATIVE = "anchor long, place int, row long, negative_id long, negative_score long"


def _negatives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """The best of one shard for one block of anchors, for each of their windows."""
    kinds = dict(c.split() for c in _NEGATIVE.split(", "))
    out = {c: [] for c in kinds}
    if anchors.num_rows and rows.num_rows:
        q, d = _both(anchors, rows)
        kind = _kind(q, d)
        ids, names = _ids(rows.column("vec_id")), rows.column("row").to_numpy()
        tree = CoverTree(d, rows.column("label").to_numpy(), d.astype(kind))
        for x, own, label, found in zip(q.astype(kind), anchors.column("row").to_pylist(), anchors.column("label").to_pylist(), anchors.column("windows").to_pylist(), strict=True):
            low, high = (np.array([w[c] for w in found]) for c in ("low", "high"))
            for w, (got, score) in zip(found, tree.search(x, ids, NEGATIVES, low, high, label), strict=True):
                out["anchor"] += [own] * len(got)
                out["place"] += [w["place"]] * len(got)
                out["row"] += names[got].tolist()
                out["negative_id"] += [None if i == _FAR else i for i in ids[got].tolist()]
                out["negative_score"] += [int(s) for s in score]
    return pa.table({c: pa.array(v, pa.int32() if kinds[c] == "int" else pa.int64()) for c, v in out.items()})


def mine(rows: DataFrame, scratch: Scratch, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, from a written table of `coded`.

    Anchors are the rows whose vec_id `every` divides. The result reads tables of the scratch block.
    """
    n, norm2 = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.expr("aggregate(codes, 0D, (s, x) -> s + cast(x as double) * x)")), F.lit(0.0))).first()
    anchors = scratch.write(rows.filter(F.col("vec_id") % every == 0), "anchors")
    found = positives(rows, anchors)
    window = F.struct(F.col("place").cast("int").alias("place"), F.expr(f"cast(ceil({LOWEST} * cast(positive_score as decimal(20,0)) / 100) as bigint)").alias("low"), F.expr(f"cast(floor({HIGHEST} * cast(positive_score as decimal(20,0)) / 100) as bigint)").alias("high"), "positive_id", "positive_score")
    windows = found.filter("positive_score >= 0").groupBy("anchor").agg(F.array_sort(F.collect_list(window)).alias("windows"))
    asked = scratch.write(anchors.join(windows, anchors["row"] == windows["anchor"]).select("row", F.col("vec_id").alias("anchor_id"), "label", "codes", F.expr("filter(windows, w -> w.low <= w.high)").alias("windows")).filter("size(windows) > 0"), "asked")
    if not n:
        return _named(asked.select(F.col("row").alias("anchor"), F.lit(1).alias("place"), F.lit(1).cast("long").alias("negative_id"), F.lit(1).cast("long").alias("negative_score"), "row"), asked)
    centres = pivots(rows, n, norm2)
    held = scratch.write(in_cells(rows.select("row", "vec_id", "label", "codes"), centres, norm2), "cells")
    reach, parts = np.full(len(centres), -1.0), [0] * len(centres)
    for r in held.groupBy("cell").agg(F.max("away").alias("away"), F.count(F.lit(1)).alias("n")).collect():  # PIVOTS at most
        reach[r["cell"]], parts[r["cell"]] = r["away"], -(-r["n"] // SHARD)
    blocks = max(1, -(-asked.count() // ANCHORS))
    dealt = F.array(*[F.lit(p) for p in parts])[F.col("cell")]
    a = _routed(asked, centres, reach, norm2).select("row", "label", "codes", "windows", "cell", F.explode(F.sequence(F.lit(0), dealt - 1)).alias("part"), F.pmod(F.xxhash64("row", F.lit(2)), F.lit(blocks)).cast("int").alias("block"))
    r = held.select("row", "vec_id", "label", "codes", "cell", F.pmod(F.xxhash64("row", F.lit(1)), dealt).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    key = ("cell", "part", "block")
    return _named(a.groupBy(*key).cogroup(r.groupBy(*key)).applyInArrow(_negatives, _NEGATIVE), asked)


def _named(met: DataFrame, asked: DataFrame) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last(), "row")
    best = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES).drop("row")
    of = asked.select(F.col("row").alias("anchor"), "anchor_id", F.explode("windows").alias("w")).select("anchor", "anchor_id", "w.place", "w.positive_id", "w.positive_score")
    return best.join(of, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch() as scratch:
        rows = scratch.write(coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
        return scratch.keep(mine(rows, scratch), "negatives")


ORACLE_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % {SHIFTED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.c, b.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a, v b WHERE a.vec_id % {EVERY} = 0 AND a.r <> b.r),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) AS k FROM s WHERE same QUALIFY k <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.vec_id, s.b) AS rank
      FROM p JOIN s ON p.a = s.a AND NOT s.same AND {LOWEST} * p.score <= 100 * s.score AND 100 * s.score <= {HIGHEST} * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
