"""Exact top-k search by MaxScore over sharded postings.

A vector's integer components are term weights: component d of value x is the posting (d, x) of a document, and a query
scores documents by the sum of q_d * x over its terms. Documents are dealt into shards of bounded size and queries into
blocks of bounded size; each shard meets each block of the stated query set once. In a shard the postings are kept term by
term, in blocks of documents, with the least and the greatest weight of each block. For a query these give a bound
for each term, max(0, q * least, q * greatest). Terms are ordered by bound; the last terms whose bounds together
stay below the score that a document must reach are non-essential. Essential postings are traversed; only documents
that can still reach the threshold are then probed in the other terms, and fewer with each term group. Shards' results
are merged by query.

Scores are exact: they are summed in float32 or float64 only if every partial sum is an integer below 2 ** 24 or
2 ** 53, else in int64. Ties go to the smaller vec_id. Cases: a vector that is null or holds a null or non-finite
component takes no part, nor does one without a vec_id; rows that share a vec_id are rows of their own, as queries and as
candidates of each other; shorter vectors lack the last terms; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilworks.llm.common import written

TOP = 20
SCALE = 64
EVERY = 20
#: Documents of a shard and of a block inside it, queries of a block, and terms probed at a time.
SHARD, BLOCK, QUERIES, PROBE = 16384, 2048, 16384, 8


class Shard:
    """Postings of a shard's documents, ordered by document id so that places settle ties; rows name them."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, kind: type, block: int = BLOCK, rows: np.ndarray | None = None):
        rows = ids if rows is None else rows
        order = np.lexsort((rows, ids))
        self.ids, self.rows = ids[order], rows[order]
        self.blocks = []
        terms = np.ascontiguousarray(weights[order].T.astype(kind))
        for i in range(0, len(ids), block):
            part = np.ascontiguousarray(terms[:, i : i + block])
            self.blocks.append((i, part, part.min(1), part.max(1)))

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents other than the row `own`."""
        places, scores = np.zeros(0, np.int64), np.zeros(0, query.dtype)
        for first, terms, low, high in self.blocks:
            bound = np.maximum(np.maximum(query * low, query * high), 0)
            order = np.argsort(-bound, kind="stable")
            order = order[query[order] != 0] if np.any(query) else order[:1]  # a term of bound 0 may still lower scores
            rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what terms from here on can add
            full = len(places) >= k
            needed = scores[k - 1] if full else None
            essential = len(order) if not full else max(1, int(np.searchsorted(-rest, -needed, side="right"))) if needed > 0 else len(order)
            essential = min(essential, len(order))
            at = np.arange(terms.shape[1])
            got = query[order[:essential]] @ terms[order[:essential]]
            step = essential
            while True:
                if full:
                    alive = got + rest[step] >= needed
                    at, got = at[alive], got[alive]
                if step >= len(order) or not len(at):
                    break
                more = order[step : step + PROBE]
                got = got + query[more] @ terms[np.ix_(more, at)]
                step = min(step + PROBE, len(order))
            other = self.rows[first + at] != own
            places, scores = np.concatenate([places, first + at[other]]), np.concatenate([scores, got[other]])
            if len(places) > k:
                # the k best: all above the k-th score, and of those equal to it the first
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                above, equal = np.flatnonzero(scores > kth), np.flatnonzero(scores == kth)
                best = np.concatenate([above, equal[: k - len(above)]])
                best = best[np.lexsort((places[best], -scores[best]))]
                places, scores = places[best], scores[best]
        best = np.lexsort((places, -scores))
        return self.ids[places[best]], scores[best]


def _dense(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.column("vec_id").to_numpy()
    out = np.zeros((len(ids), width), np.int64)
    codes = rows.column("codes").combine_chunks() if isinstance(rows.column("codes"), pa.ChunkedArray) else rows.column("codes")
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.chunk(0) if codes.num_chunks else pa.array([], codes.type)
    flat, sizes = codes.flatten().to_numpy(), codes.value_lengths().to_numpy()
    at = np.concatenate([[0], np.cumsum(sizes)])
    out[np.repeat(np.arange(len(ids)), sizes), np.arange(int(at[-1])) - np.repeat(at[:-1], sizes)] = flat
    return ids, out


def _meet(queries: pa.Table, docs: pa.Table) -> pa.Table:
    """One block of queries against one shard."""
    empty = pa.table({c: pa.array([], pa.int64()) for c in ("query", "query_id", "vec_id", "score")})
    if not queries.num_rows or not docs.num_rows:
        return empty
    width = max(int(pa.compute.max(pa.compute.list_value_length(t.column("codes"))).as_py() or 0) for t in (queries, docs)) or 1
    q_ids, q = _dense(queries, width)
    d_ids, d = _dense(docs, width)
    most = float(np.abs(q.astype(float)).max()) * float(np.abs(d.astype(float)).max()) * width
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    shard = Shard(d_ids, d, kind, rows=docs.column("row").to_numpy())
    out = [(r, i, *shard.search(x.astype(kind), r, TOP)) for r, i, x in zip(queries.column("row").to_pylist(), q_ids.tolist(), q, strict=True)]
    return pa.table({
        "query": np.concatenate([np.full(len(ids), r, np.int64) for r, _, ids, _ in out]),
        "query_id": np.concatenate([np.full(len(ids), i, np.int64) for _, i, ids, _ in out]),
        "vec_id": np.concatenate([ids for _, _, ids, _ in out]).astype(np.int64),
        "score": np.concatenate([s for *_, s in out]).astype(np.int64),
    })


def coded(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id and codes, floor(scale * x) for each component, of the vectors that take part; row names a row once it is written."""
    x = "cast(x as double)"
    good = vectors.filter("vec_id is not null and embedding is not null").filter(f"forall(embedding, x -> x is not null and not isnan({x}) and abs({x}) < double('infinity'))")
    return good.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform(embedding, x -> cast(floor({scale}D * {x}) as bigint))").alias("codes"))


def search(queries: DataFrame, docs: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of docs for each row of queries, both (row, vec_id, codes) of one
    written table; a query is no candidate of its own.

    A row of docs goes to each block of queries and a query to each shard. Blocks and shards have bounded sizes; only
    their numbers grow.
    """
    shards, blocks = max(1, -(-docs.count() // SHARD)), max(1, -(-queries.count() // QUERIES))
    part = lambda n: F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("row", "vec_id", "codes", part(blocks).alias("block"), every(shards).alias("shard"))
    d = docs.select("row", "vec_id", "codes", part(shards).alias("shard"), every(blocks).alias("block"))
    met = q.groupBy("shard", "block").cogroup(d.groupBy("shard", "block")).applyInArrow(_meet, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "codes")
    return search(rows.filter(F.col("vec_id") % EVERY == 0), rows)


ORACLE_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.c, d.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q, v d WHERE q.vec_id % {EVERY} = 0 AND q.r <> d.r),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
