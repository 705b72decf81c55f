"""Benchmark decontamination by Wu-Manber search over words.

Letters of the search are whole words, lower-cased; patterns are the windows of ten consecutive words of each benchmark
item, or all words of a shorter one. Patterns of one length make a class. A class's shift table says, for the hash of the
three words that end at a place, how far the search may move on: by no more than the distance of such a block from the end
of any pattern, and past the whole block if no pattern holds it. Where the table says 0 the block may end a pattern:
the bucket of its hash, ordered by the hash of the words before, selects the patterns, whose bytes are then compared
with the text's. Texts are cut into segments of end places, whose searches advance together in numpy; a window may begin
in the segment before, never in another text.

The benchmark is dealt into shards of bounded size, each of which is compiled on the driver and broadcast; documents pass
each shard once, without a shuffle if there is but one. Equal windows of many items are one pattern.

Cases: a null text or one without words has no hits; an item without words has no window; a null item_id counts as the
empty string, items that share an id are one; rows that occur again are each returned; an empty benchmark hits nothing;
further columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.llm.common import _LOWER, documents, mix64, prefix_hash, slabs, span_hash, text_buffers, word_spans

#: Words of a window, words of a block, end places of a segment.
WINDOW, BLOCK, SEGMENT = 10, 3, 512
#: Bytes of benchmark text that are compiled and broadcast at once; a longer item stands alone.
SHARD_BYTES = 1 << 22
#: Bytes that are compared at once.
COMPARED = 1 << 22
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: All bytes but digits, letters and those of characters beyond U+007F.
SEPARATORS = np.ones(256, bool)
SEPARATORS[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = False
SEPARATORS[128:] = False


@dataclass
class Words:
    """The words of texts laid end to end: lower-cased bytes, where words start and end, their hashes, each text's first."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Words:
        starts, ends = word_spans(data, offsets, SEPARATORS)
        low = _LOWER[data]
        hashes = span_hash(prefix_hash(low), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        return Words(low, starts, ends, hashes, np.searchsorted(starts, offsets))


def _run_hash(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` words from each place on; of none: 0."""
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        out = (out + hashes[at + j]) * _ODD
    return mix64(out)


def _same(a: Words, at_a: np.ndarray, b: Words, at_b: np.ndarray, width: int) -> np.ndarray:
    """Whether the `width` words from each place of a on are, byte by byte, those of b."""
    out = np.ones(len(at_a), bool)
    for j in range(width):
        still = np.flatnonzero(out)
        x, y = a.starts[at_a[still] + j], b.starts[at_b[still] + j]
        size = a.ends[at_a[still] + j] - x
        equal = size == b.ends[at_b[still] + j] - y
        out[still[~equal]] = False
        still, x, y, size = still[equal], x[equal], y[equal], size[equal]
        upto, i = np.concatenate([[0], np.cumsum(size)]), 0
        while i < len(still):
            k = max(i + 1, int(np.searchsorted(upto, upto[i] + COMPARED, side="right")) - 1)
            part = size[i:k]
            step = np.arange(int(part.sum())) - np.repeat(upto[i:k] - upto[i], part)
            unlike = a.data[np.repeat(x[i:k], part) + step] != b.data[np.repeat(y[i:k], part) + step]
            out[still[i:k][np.unique(np.repeat(np.arange(k - i), part)[unlike])]] = False
            i = k
    return out


class Patterns:
    """The patterns of one length: shift table, buckets, and the items of each pattern."""

    def __init__(self, words: Words, at: np.ndarray, items: np.ndarray, length: int):
        self.length, self.block = length, min(BLOCK, length)
        tail = length - self.block
        suffix, before = _run_hash(words.hashes, at + tail, self.block), _run_hash(words.hashes, at, tail)
        keys = self._key(suffix, before)
        order = np.lexsort((items, keys))
        at, items, keys = at[order], items[order], keys[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        again = np.flatnonzero(~fresh)
        fresh[again[~_same(words, at[again - 1], words, at[again], length)]] = True
        self.at, self.keys, self.items, self.words = at[fresh], keys[fresh], items, words
        self.item_from = np.append(np.flatnonzero(fresh), len(at))
        blocks = np.concatenate([_run_hash(words.hashes, self.at + q, self.block) for q in range(tail + 1)])
        moves = np.repeat(tail - np.arange(tail + 1), len(self.at)).astype(np.int16)
        bits = max(10, int(np.ceil(np.log2(4 * len(blocks) + 1))))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, tail + 1, np.int16)
        np.minimum.at(self.shift, (blocks & self.mask).astype(np.int64), moves)

    @staticmethod
    def _key(suffix: np.ndarray, before: np.ndarray) -> np.ndarray:
        return mix64(suffix ^ (before * _ODD))

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places in words where a pattern starts, and which."""
        count = np.diff(words.first)
        ends = np.maximum(count - self.length + 1, 0)  # places of a text at which a window may end
        cuts = -(-ends // SEGMENT)
        text = np.repeat(np.arange(len(count)), cuts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        place = words.first[:-1][text] + self.length - 1 + nth * SEGMENT
        last = np.minimum(place + SEGMENT, words.first[1:][text])
        tail, found, hashes = self.length - self.block, [], []
        while len(place):
            block = _run_hash(words.hashes, place - (self.block - 1), self.block)
            step = self.shift[(block & self.mask).astype(np.int64)]
            zero = step == 0
            if zero.any():
                found.append(place[zero] - (self.length - 1))
                hashes.append(block[zero])
            place = place + np.maximum(step, 1)
            more = place < last
            place, last = place[more], last[more]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.concatenate(found)
        keys = self._key(np.concatenate(hashes), _run_hash(words.hashes, start, tail))
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        many = high - low
        start, which = np.repeat(start, many), np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        same = _same(words, start, self.words, self.at[which], self.length)
        return start[same], which[same]


class Compiled:
    """The classes of a shard of the benchmark, and the names of its items in order."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int = WINDOW):
        self.names = sorted({i or "" for i in ids})
        place = {n: k for k, n in enumerate(self.names)}
        words = Words.of(*text_buffers(pa.array(texts, pa.large_string())))
        item, count = np.array([place[i or ""] for i in ids], np.int64), np.diff(words.first)
        self.classes = []
        for length in sorted({min(int(c), window) for c in count} - {0}):
            own = np.flatnonzero(count == length if length < window else count >= window)
            many = count[own] - length + 1
            step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            self.classes.append(Patterns(words, np.repeat(words.first[:-1][own], many) + step, np.repeat(item[own], many), length))

    def hits(self, words: Words) -> Iterator[tuple[list[tuple[int, int]], list[str]]]:
        """For each text the runs of words that are hit, as places in it, and the items whose windows occur, in order."""
        n = len(words.first) - 1
        edges = np.zeros(len(words.starts) + 1, np.int64)
        texts, items = [], []
        for c in self.classes:
            start, which = c.search(words)
            np.add.at(edges, start, 1)
            np.add.at(edges, start + c.length, -1)
            text = np.searchsorted(words.first, start, side="right") - 1
            pair = np.unique(text * len(c.at) + which)  # of equal windows in one text one
            text, which = pair // max(1, len(c.at)), pair % max(1, len(c.at))
            many = c.item_from[which + 1] - c.item_from[which]
            texts.append(np.repeat(text, many))
            items.append(c.items[np.repeat(c.item_from[which], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)])
        covered = np.cumsum(edges) > 0
        text, item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (texts, items))
        order = np.lexsort((item, text))
        text, item = text[order], item[order]
        at = np.searchsorted(text, np.arange(n + 1))
        for i in range(n):
            if at[i] == at[i + 1]:
                yield [], []
                continue
            own = covered[words.first[i] : words.first[i + 1]].astype(np.int8)
            turns = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
            yield list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)), [self.names[k] for k in np.unique(item[at[i] : at[i + 1]])]


_HITS = "array<struct<start:int,end:int>>"


def _pass(docs: DataFrame, key: str, text: str, compiled: Compiled) -> DataFrame:
    """key, n_words, hits and items of each row, against one shard."""
    shared = docs.sparkSession.sparkContext.broadcast(compiled)
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in slabs(offsets):
                words = Words.of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hits, items = zip(*held.hits(words), strict=True)
                runs = pa.array([[{"start": a, "end": b} for a, b in h] for h in hits], run_type)
                yield pa.record_batch({key: batch.column(0).slice(i, j - i), "n_words": pa.array(np.diff(words.first).astype(np.int64)), "hits": runs, "items": pa.array(items, pa.list_(pa.string()))})

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_words long, hits {_HITS}, items array<string>")


def _shards(benchmark: DataFrame, item: str, text: str, most: int) -> DataFrame:
    """item, text and shard of the distinct items, with shards of at most `most` bytes, or of one text that is longer."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")).filter("text is not null").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // most))
    while True:
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int"))
        sizes = dealt.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n"))
        if n == 1 or not sizes.filter(f"bytes > {most} and n > 1").limit(1).count():
            return dealt
        n *= 2


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, most: int = SHARD_BYTES) -> DataFrame:
    """key, n_words, hits (runs of word places, end exclusive) and items (ids as strings, in order) of each document."""
    dealt = _shards(benchmark, item, item_text, most)
    shards = [r[0] for r in dealt.select("shard").distinct().orderBy("shard").collect()]  # as many as passes over the documents
    held = lambda n: dealt.filter(F.col("shard") == n).select("item", "text").toArrow().to_pydict()
    if len(shards) <= 1:
        one = held(shards[0]) if shards else {"item": [], "text": []}
        return _pass(docs, key, text, Compiled(one["item"], one["text"], window))
    # equal rows have equal hits: they are counted, joined over the shards once, and come back as often
    named = docs.select(F.struct(F.col(key).alias("id"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("of")).alias("_row"), F.col(text).alias("_text"))
    out = None
    for n in shards:
        one = held(n)
        rows = _pass(named, "_row", "_text", Compiled(one["item"], one["text"], window))
        rows = rows.groupBy("_row").agg(F.count(F.lit(1)).alias("_copies"), F.first("n_words").alias("n_words"), F.first("hits").alias("hits"), F.first("items").alias("items"))
        out = rows if out is None else out.unionAll(rows)
    merged = out.groupBy("_row").agg(F.max("_copies").alias("_copies"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = f"""aggregate(hits, cast(array() as {_HITS}), (a, x) -> if(size(a) > 0 and x.start <= a[size(a) - 1].end,
        concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, x.end)))), concat(a, array(x))))"""
    each = merged.select(F.col("_row.id").alias(key), "n_words", F.expr(joined).alias("hits"), "items", F.explode(F.expr("sequence(1L, _copies)")))
    return each.select(key, "n_words", "hits", "items")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options: object) -> DataFrame:
    """doc_id of documents of which no word is hit."""
    return contamination(docs, benchmark, key, **options).filter("size(hits) = 0").select(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.expr("aggregate(hits, 0L, (s, x) -> s + x.end - x.start)")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS_SQL} AS w FROM benchmark),
c AS (SELECT item, w, least(len(w), {WINDOW}) AS m FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM c)),
x AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT x.r, x.m, x.i, p.item FROM x JOIN p ON x.m = p.m AND x.g = p.g),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + m)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
