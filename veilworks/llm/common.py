"""Shared plumbing of the operators: shared storage, batch sizes, text buffers and word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.sources.shared import Scratch, drop, shared_dir, written  # noqa: F401

#: Bytes that separate words: space and U+0009 to U+000D.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: Rows of a batch that goes to a Python worker, and bytes of text that are worked on at once.
BATCH_ROWS = 1000
SLAB_BYTES = 1 << 19


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what a Python worker holds at once: texts of a thousand rows, not ten thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(docs: DataFrame) -> F.Column:
    return F.coalesce(F.col("text"), F.lit(""))


def held_out(column: str, parts: int, part: int) -> F.Column:
    """Whether crc32 of the column as text leaves `part` when divided by `parts`; null counts as the empty text."""
    return F.expr(f"pmod(crc32(cast(coalesce(cast({column} as string), '') as binary)), {parts}) = {part}")


# ---------------------------------------------------------------- vectors


def finite_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Without rows whose vector is null or holds a null or non-finite component."""
    x = "cast(x as double)"
    return vectors.filter(F.col(column).isNotNull()).filter(F.expr(f"forall(`{column}`, x -> x is not null and not isnan({x}) and abs({x}) < double('infinity'))"))


def list_matrix(column: pa.Array | pa.ChunkedArray, kind: type, width: int = 0) -> np.ndarray:
    """Lists without nulls as the rows of a matrix of at least `width` columns; shorter lists end with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(kind)
    out = np.zeros((len(sizes), width), kind)
    at = np.concatenate([[0], np.cumsum(sizes)])
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(int(at[-1])) - np.repeat(at[:-1], sizes)] = flat
    return out


# ---------------------------------------------------------------- text buffers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch, end to end, and the n + 1 places where they start. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, first = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[first : first + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slabs(offsets: np.ndarray, most: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text stands alone, whole."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# ---------------------------------------------------------------- words and their hashes

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A 64-bit value for each byte, never 0.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the powers 0 to n - 1, modulo 2**64."""
    if len(_powers["up"]) < n:
        m = max(n, SLAB_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(m, base, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _powers[key] = out
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 sums; the hash of data[s:e] is (sums[e] - sums[s]) * inverse power s."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix64(((sums[ends] - sums[starts]) * down[starts]) ^ (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end. No word crosses the end of a text."""
    inside = ~separators[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words of each text, A-Z lower-cased, and the n + 1 places where texts start.

    A text with fewer words has its whole sequence as one; one without words has none. Repeats stay.
    """
    n = len(offsets) - 1
    starts, ends = word_spans(data, offsets)
    first = np.searchsorted(starts, offsets)  # the first word of each text
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    words = span_hash(prefix_hash(_LOWER[data]), starts, ends)
    count = np.diff(first)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        rolled *= np.uint64(_BASE)
        rolled += words[j : j + len(rolled)]
    own = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(own)]).astype(np.int64)
    long = np.flatnonzero(count >= width)
    out = np.empty(int(out_at[-1]), np.uint64)
    if len(long):
        sizes = own[long]
        step = np.arange(int(sizes.sum())) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        out[np.repeat(out_at[long], sizes) + step] = rolled[np.repeat(first[:-1][long], sizes) + step]
    for i in np.flatnonzero((count > 0) & (count < width)):
        h = int(count[i])
        for w in words[first[i] : first[i + 1]]:
            h = (h * _BASE + int(w)) & _MASK
        out[out_at[i]] = h ^ 0xA5A5A5A5A5A5A5A5
    return mix64(out), out_at
