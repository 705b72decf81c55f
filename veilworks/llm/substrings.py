"""Exact substring deduplication: every byte goes that a `LENGTH`-byte string covers which starts elsewhere too.

Suffixes that can take part are found by anchors. The anchor of a 400-byte string is the leftmost of its `GRAM`-byte
runs of least hash, so equal strings have equal anchors at equal places, and of all suffixes only those at anchors,
one in about 190, need to be compared. An anchor has a context: what the strings around it can reach.

1. Anchors that occur once go. The others are grouped by anchor and context hash. A context that occurs again is
   covered whole.
2. Anchors with several different contexts have one context each sent to the anchor's task. There the suffixes that
   start at the anchor, and the reversed prefixes that end at it, are put in order by deep-shallow sorting; common
   prefixes of neighbours give those of all pairs, and a pair that agrees on 400 bytes around the anchor covers what
   it agrees on.
3. An anchor with more than `GROUP` different contexts is dealt out by blocks of neighbouring 400-byte strings instead.
   Strings of a block have a core in common; contexts whose core occurs once in its place go. A block that recurs whole
   is covered whole; of those that share their core and differ around it one each names its strings, whose hashes
   are counted with partial sums and come back counted. So no task gets a group without bound, no group is cut, and
   rows grow with the contexts, not with their pairs.

Texts travel once, by a key of doc_id and text, and meet there both the contexts that are wanted of them and their
covered spans. Counts are written before they meet what they count, so that Spark can split the join at a hot anchor.

Beside what is removed, stretches of fewer bytes are noted if they hold more than `PASSAGE` words and occur elsewhere
too; nothing of them is removed. They are found where they hold an anchor of both texts: a stretch of 330 bytes does
so in about 19 of 20 cases, one of 400 always.

Cases: null text counts as empty; a text shorter than 400 bytes keeps all; rows that repeat are copies and lose all
that is long enough; an empty table gives an empty result; further columns stay in `removed`.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.llm.common import documents, drop, mix64, powers, prefix_hash, slabs, small_batches, span_hash, text_buffers, word_spans, written
from veilworks.llm.suffixsort import deep_shallow, neighbours

LENGTH = 400
GRAM = 16
REACH = LENGTH - GRAM  # bytes before an anchor that a string around it can have
#: Contexts of an anchor that one task compares (16 MB at most); neighbouring strings, and runs of words, of a block.
GROUP = 20_000
STRINGS, RUNS = 32, 8
#: A shorter stretch is noted if it has more words than this.
PASSAGE = 50

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, _NONE, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(back[:m], ahead[width - 1 : width - 1 + m])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie end to end: places of the anchors, their 64-bit hashes, and the first and the last start of the
    strings that each stands for."""
    n, width = len(data), LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, np.zeros(0, np.uint64), none, none
    sums = prefix_hash(data)
    _, down = powers(n + 1)
    m = n - GRAM + 1
    grams = mix64((sums[GRAM:] - sums[:m]) * down[:m])
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    at = (sliding_min(ranked, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(at), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= LENGTH:
            inside[a : b - LENGTH + 1] = True
    starts = np.flatnonzero(inside)
    at = at[starts]
    fresh = np.empty(len(at), bool)
    if not len(at):
        return none, np.zeros(0, np.uint64), none, none
    fresh[0] = True
    # places grow along a text, and a text's anchors lie inside it
    np.not_equal(at[1:], at[:-1], out=fresh[1:])
    first = np.flatnonzero(fresh)
    return at[first], grams[at[first]], starts[first], starts[np.append(first[1:] - 1, len(at) - 1)]


_ANCHORS = "rid long, pos int, low int, high int, anchor long, context long"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """low, high: how far before the anchor its first and its last string start. What they span is its context."""
    for batch in batches:
        rid = batch.column("rid").to_numpy()
        data, offsets = text_buffers(batch.column("_t"))
        for i, j in slabs(offsets):
            local = offsets[i : j + 1] - offsets[i]
            part = data[offsets[i] : offsets[j]]
            at, anchor, first, last = anchors(part, local)
            doc = np.searchsorted(local, at, side="right") - 1
            raw = part.tobytes()
            context = [xxhash.xxh3_64_intdigest(raw[a : b + LENGTH], seed=p - a) for p, a, b in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rid[i + doc], pa.int64()), pa.array(at - local[doc], pa.int32()), pa.array(at - first, pa.int32()), pa.array(at - last, pa.int32()),
                    pa.array(anchor.view(np.int64)), pa.array(np.array(context, np.uint64).view(np.int64)),
                ],
                names=["rid", "pos", "low", "high", "anchor", "context"],
            )


_CONTEXTS = "anchor long, known boolean, rid long, pos int, low int, high int, before binary, after binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts wanted of each text."""
    for batch in batches:
        data, offsets = text_buffers(batch.column("_t"))
        wanted = batch.column("wanted").to_pylist()
        rid = batch.column("rid").to_pylist()
        rows = []
        for i, each in enumerate(wanted):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            for w in each:
                p = w["pos"]
                rows.append((w["anchor"], w["known"], rid[i], p, w["low"], w["high"], text[p - w["low"] : p][::-1], text[p : p - w["high"] + LENGTH]))
        names = ["anchor", "known", "rid", "pos", "low", "high", "before", "after"]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _least(near: list[int]) -> list[np.ndarray]:
    """Minima of 1, 2, 4, ... neighbours, so that the common prefix of any two places in sorted order is read off."""
    out = [np.array(near)]
    while 2 ** len(out) <= len(near):
        half = 2 ** (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


Reach = tuple[list[int], list[int]]


def covered(before: list[bytes], after: list[bytes]) -> tuple[Reach, Reach]:
    """How far before and after the anchor each context is covered by some other; 0 and 0: not at all. And the same for
    the longest stretch of more than PASSAGE words that it shares with some other and that is too short to be covered.

    Contexts are joined in order of falling agreement after the anchor, as the branches of their suffix tree are. In
    each set those nearest to each other in the order of what lies before the anchor agree most there, so it is enough
    to look at the neighbours of what is added to a set, and the smaller set is added to the larger.
    """
    n = len(before)
    ahead, back = deep_shallow(after), deep_shallow(before)
    right, minima = neighbours(after, ahead), _least(neighbours(before, back))
    rank = [0] * n
    for i, x in enumerate(back):
        rank[x] = i
    left_most, right_most = [0] * n, [0] * n
    noted: Reach = ([0] * n, [0] * n)
    held: list[list[int]] = [[rank[x]] for x in ahead]  # ranks of the set that starts at a place of `ahead`
    top = list(range(n))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i in sorted(range(1, n), key=lambda i: -right[i]):
        a, b, depth = find(i - 1), find(i), right[i]
        if len(held[a]) < len(held[b]):
            a, b = b, a
        large, small = held[a], held[b]
        if depth >= GRAM and depth + REACH >= LENGTH:
            for r in small:
                at = bisect_left(large, r)
                for other in large[max(0, at - 1) : at + 1]:
                    low, high = min(r, other) + 1, max(r, other) + 1
                    k = (high - low).bit_length() - 1
                    shared = int(min(minima[k][low], minima[k][high - 2**k]))
                    if shared + depth >= LENGTH:
                        for x in (back[r], back[other]):
                            left_most[x], right_most[x] = max(left_most[x], shared), max(right_most[x], depth)
                        continue
                    longer = [x for x in (back[r], back[other]) if shared + depth > max(2 * PASSAGE, noted[0][x] + noted[1][x])]
                    if longer and len((before[longer[0]][:shared][::-1] + after[longer[0]][:depth]).split()) > PASSAGE:
                        for x in longer:
                            noted[0][x], noted[1][x] = shared, depth
        held[a] = sorted(large + small) if len(small) > 8 else large
        if held[a] is large:
            for r in small:
                insort(large, r)
        held[b], top[b] = [], a
    return (left_most, right_most), noted


_SPANS = "rid long, start int, stop int"


def _spans(rid: list[int], start: list[int], stop: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["rid", "start", "stop"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by anchor; a group of at most GROUP contexts is held at a time."""
    at, held = None, []

    def flush(rows: list[tuple], out: tuple[list[int], list[int], list[int]]) -> None:
        if len(rows) < 2 or all(r[0] for r in rows):
            return
        for left, right in covered([r[3] for r in rows], [r[4] for r in rows]):
            for k, (known, rid, pos, _, _) in enumerate(rows):
                if not known and right[k]:
                    out[0].append(rid)
                    out[1].append(pos - left[k])
                    out[2].append(pos + right[k])

    for batch in batches:
        out: tuple[list[int], list[int], list[int]] = ([], [], [])
        columns = (batch.column(c).to_pylist() for c in ("anchor", "known", "rid", "pos", "before", "after"))
        for anchor, *row in zip(*columns, strict=True):
            if anchor != at:
                flush(held, out)
                at, held = anchor, []
            held.append(tuple(row))
        yield _spans(*out)
    out = ([], [], [])
    flush(held, out)
    yield _spans(*out)


def _buffer(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts end to end, where they start, where their anchors lie, and how far before these the first and the last
    string start."""
    before, after = (batch.column(c).to_pylist() for c in ("before", "after"))
    data = np.frombuffer(b"".join(x[::-1] + y for x, y in zip(before, after, strict=True)), np.uint8)
    low, behind = (np.array([len(x) for x in c], np.int64) for c in (before, after))
    offsets = np.concatenate([[0], np.cumsum(low + behind)]).astype(np.int64)
    return data, offsets, offsets[:-1] + low, low, LENGTH - behind


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """count[i] whole numbers from first[i] on, for all i end to end, each behind its i."""
    at = np.repeat(np.arange(len(count)), count)
    return at, first[at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)


def _runs(data: np.ndarray, offsets: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where words start and end; the first words of the runs of PASSAGE + 1 words and fewer than LENGTH bytes around
    anchors, their contexts, and the words at the anchors."""
    first, last = word_spans(data, offsets)
    doc = np.searchsorted(offsets, first, side="right") - 1
    n = max(0, len(first) - PASSAGE)
    a, b, at = first[:n], last[len(last) - n :], doc[:n]
    here = np.flatnonzero((at == doc[len(doc) - n :]) & (a <= place[at]) & (b >= place[at] + GRAM) & (b - a < LENGTH))
    return first, last, here, at[here], np.searchsorted(last, place, side="right")


def _names(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, anchor: np.ndarray, place: np.ndarray, words: np.ndarray) -> np.ndarray:
    """64 bits for what is read from start to stop and for where the anchor, and which, lies in it."""
    away = ((place - start) * 2 + words).astype(np.int64).view(np.uint64)
    return mix64(span_hash(sums, start, stop) + mix64(anchor.view(np.uint64) + mix64(away))).view(np.int64)


_BLOCKS = "rid long, pos int, anchor long, known boolean, core long, block long, words boolean, start int, first int, last int, stop int"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of hot anchors' contexts, and the runs of words, by blocks of STRINGS or RUNS neighbours; core names what
    all that may be of a block have in common, block what those of this context span. start, first: those of the first
    one; last, stop: those of the last one."""
    for batch in batches:
        data, offsets, place, low, high = _buffer(batch)
        rid, pos, anchor = (batch.column(c).to_numpy() for c in ("rid", "pos", "anchor"))
        sums = prefix_hash(data)
        at, c = _ranges(-(low // STRINGS), low // STRINGS - high // STRINGS + 1)
        core = place[at] + c * STRINGS
        start, last = np.maximum(core - STRINGS + 1, (place - low)[at]), np.minimum(core, (place - high)[at])
        columns = [[at, core, core + LENGTH + 1 - STRINGS, start, start + LENGTH, last, last + LENGTH]]
        begin, end, run, doc, zero = _runs(data, offsets, place)
        block = (run - zero[doc]) // RUNS
        fresh = np.flatnonzero(np.diff(block, prepend=-LENGTH) | np.diff(doc, prepend=-1))
        at, a, b = doc[fresh], run[fresh], run[np.append(fresh[1:], len(run)) - 1] if len(run) else run
        base = zero[at] + block[fresh] * RUNS
        columns.append([at, begin[base + RUNS - 1], end[base + PASSAGE], begin[a], end[a + PASSAGE], begin[b], end[b + PASSAGE]])
        words = np.repeat([False, True], [len(c[0]) for c in columns])
        at, core, core_stop, start, first, last, stop = (np.concatenate(c) for c in zip(*columns, strict=True))
        names = [_names(sums, x, y, anchor[at], place[at], words) for x, y in ((core, core_stop), (start, stop))]
        shift = (pos - place)[at]
        out = [rid[at], pos[at], anchor[at], batch.column("known").to_numpy(zero_copy_only=False)[at], *names, words, start + shift, first + shift, last + shift, stop + shift]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int32()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])


_STRINGS = "string long, rid long, pos int, block long, wanted boolean, start int, stop int"


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings and runs of the blocks that are asked for of each context."""
    for batch in batches:
        data, offsets, place, _, _ = _buffer(batch)
        rid, pos, anchor = (batch.column(c).to_numpy() for c in ("rid", "pos", "anchor"))
        asked = batch.column("blocks")
        of = np.repeat(np.arange(len(rid)), asked.value_lengths().to_numpy(zero_copy_only=False))
        fields = asked.flatten()
        start, stop, words, wanted = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        shift = (place - pos)[of]
        start, stop = start + shift, stop + shift
        order = np.argsort(start, kind="stable")
        plain, runs = order[~words[order]], order[words[order]]
        k, a = _ranges(start[plain], stop[plain] - start[plain] - LENGTH + 1)
        block, b = plain[k], a + LENGTH
        if len(runs):
            begin, end, run, _, _ = _runs(data, offsets, place)
            x, y = begin[run], end[run + PASSAGE]
            k = np.searchsorted(start[runs], x, side="right") - 1
            here = (k >= 0) & (y <= stop[runs[k]])
            block, a, b = (np.concatenate(c) for c in ((block, runs[k[here]]), (a, x[here]), (b, y[here])))
        at = of[block]
        string = _names(prefix_hash(data), a, b, anchor[at], place[at], words[block])
        out = [string, rid[at], pos[at], (start - shift)[block] * 2 + words[block], wanted[block], a - shift[block], b - shift[block]]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in _STRINGS.split(", ")])


def _dealt(contexts: DataFrame) -> DataFrame:
    """Spans of the contexts of hot anchors, a table that goes. Rows grow with the contexts: each has about a dozen blocks, a block that
    recurs whole is covered whole, and of those that share only their core one each is taken apart."""
    blocks = written(contexts.mapInArrow(_blocks, _BLOCKS), "blocks")
    cores = written(blocks.groupBy("core").agg(F.count(F.lit(1)).alias("n"), (F.min("block") < F.max("block")).alias("mixed")).filter("n > 1").select("core", "mixed"), "cores")
    one = F.min(F.struct("rid", "pos", "known", "words", "start", "stop"))
    same = written(blocks.join(cores, "core").groupBy("core", "block", "mixed").agg(F.count(F.lit(1)).alias("n"), one.alias("one")), "same")
    again = blocks.filter("not known").join(same.filter("n > 1").select("core", "block"), ["core", "block"])
    again = again.select("rid", F.struct("start", F.col("first").alias("stop")).alias("a"), F.struct(F.col("last").alias("start"), "stop").alias("b"))
    asked = F.struct("one.start", "one.stop", "one.words", (~F.col("one.known") & (F.col("n") == 1)).alias("wanted"))
    lists = same.filter("mixed").groupBy("one.rid", "one.pos").agg(F.collect_list(asked).alias("blocks"))  # of one context
    strings = written(contexts.join(lists, ["rid", "pos"]).mapInArrow(_strings, _STRINGS), "strings")
    drop(contexts, cores)
    twice = written(strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("string"), "twice")
    ends = F.struct("start", "stop")
    hit = strings.filter("wanted").join(twice, "string").groupBy("rid", "pos", "block").agg(F.min(ends).alias("a"), F.max(ends).alias("b")).select("rid", "a", "b")
    # what lies between the first and the last of a block is covered by these two, which overlap
    return again.union(hit).select("rid", F.explode(F.array("a", "b")).alias("x")).select("rid", "x.start", "x.stop")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_t", F.coalesce("text", F.lit(""))).withColumn("rid", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("_t")))


def spans(texts: DataFrame) -> DataFrame:
    """rid, start and stop of covered stretches, of LENGTH bytes at least, and of those that are noted; they may overlap.
    texts: rid, _t and whatever the caller joins by rid.

    The plan meets the texts by rid in several places with the same columns, so one shuffle of them serves all.
    """
    spark = texts.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(texts.filter(F.octet_length("_t") >= LENGTH).select("rid", "_t").mapInArrow(_find, _ANCHORS), "anchors")
    seen = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "seen")
    shared = written(found.join(seen, "anchor"), "shared")
    drop(found, seen)
    one = F.min(F.struct("rid", "pos", "low", "high"))
    contexts = written(shared.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), one.alias("one")), "contexts")
    again = contexts.filter("n > 1").select("anchor", "context")
    whole = shared.join(again, ["anchor", "context"]).select("rid", (F.col("pos") - F.col("low")).alias("start"), (F.col("pos") - F.col("high") + LENGTH).alias("stop"))
    groups = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1").select("anchor", (F.col("m") > GROUP).alias("hot"))
    groups = written(groups, "groups")
    wanted = contexts.join(groups, "anchor").select("one.rid", "hot", F.struct("anchor", (F.col("n") > 1).alias("known"), "one.pos", "one.low", "one.high").alias("w"))

    def cut(hot: bool) -> DataFrame:
        lists = wanted.filter(F.col("hot") == F.lit(hot)).groupBy("rid").agg(F.collect_list("w").alias("wanted"))  # of one text
        return texts.join(lists, "rid").mapInArrow(_cut, _CONTEXTS)

    cool = cut(False).select("anchor", "known", "rid", "pos", "before", "after").repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_compare, _SPANS)
    out = whole.union(cool)
    if groups.filter("hot").limit(1).count():
        out = out.union(_dealt(written(cut(True).select("anchor", "known", "rid", "pos", "before", "after"), "hot")))
    return out


def _merge(pairs: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((p["start"], p["stop"]) for p in pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column("_t"))
        rows = []
        for i, pairs in enumerate(batch.column("spans").to_pylist()):
            text, merged = data[offsets[i] : offsets[i + 1]].tobytes(), _merge([p for p in pairs or [] if p["stop"] - p["start"] >= LENGTH])
            passages = sum(len(text[a:b].split()) > PASSAGE for a, b in _merge(pairs or []))
            kept, last = hashlib.sha256(), 0
            for a, b in merged:
                kept.update(text[last:a])
                last = b
            kept.update(text[last:])
            rows.append((len(text), sum(b - a for a, b in merged), len(merged), kept.hexdigest(), passages))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"])


def removed(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns of `keep`, _t and spans, a list of (start, stop) in bytes, null for texts that have none. What lies in
    those of LENGTH bytes and more is to go."""
    names = [f"k{i}" for i in range(len(keep))]
    texts = _keyed(docs).select("rid", "_t", *[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)])
    lists = spans(texts).groupBy("rid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # of one text
    return texts.join(lists, "rid", "left").select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "_t", "spans")


def digests(rows: DataFrame) -> DataFrame:
    """Of `removed`: doc_id, bytes, those removed, runs of them, the digest of the rest, and n_passages, how many
    stretches of more than PASSAGE words occur elsewhere too, removed or not."""
    return rows.mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(removed(documents(spark, sf_dir).select("doc_id", "text"), "doc_id"))
