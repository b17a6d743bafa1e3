"""Suffix-array dedup: bytes under a string of ``LENGTH`` bytes that also starts elsewhere are removed.

A suffix array of every byte would move a hundred times the corpus. So suffixes
are taken at anchors: in each window of ``LENGTH`` bytes, the starts of the
``CORE``-byte strings whose hash is least. Equal windows choose equal anchors,
hence every repeat meets another one under its core, and a fiftieth of the
suffixes is enough.

1. Scan: anchors with the hash of their core and of their context, that is all
   that a window over the core can reach (``REACH`` bytes on either side).
2. By core: a core seen once repeats nothing. Contexts that are equal are
   repeats as a whole and need no bytes. What is left are cores with different
   contexts: the edges of passages and of edited copies.
3. Only for these, the bytes are fetched and the suffixes sorted within a core.
   The array's common-prefix intervals are found with a stack; within each, the
   left contexts are sorted and scanned the same way, and every interval with
   different bytes on its left and on its right is a maximal repeat with all
   its occurrences.
4. Spans are merged per text, which gives what stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm.common import bitmap, in_bitmap, keep, mix64, partitions

LENGTH = 200
CORE = LENGTH // 2
REACH = LENGTH - CORE
BITS = 24
#: Bytes of text per numpy batch.
BATCH = 2 << 20
#: Bytes of text that travel together when contexts are fetched.
SEGMENT = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def key_of(data: bytes) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(data)).view(np.int64))


def sliding(x: np.ndarray, w: int, best: np.ufunc, pad: np.uint64) -> np.ndarray:
    """Least or greatest of every run of ``w`` values, by block prefixes and suffixes."""
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % w + w, pad, np.uint64)]).reshape(-1, w)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position, hash of the core and hash of the context of all anchors of some texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(data)
    if n < LENGTH:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    power, inverse = np.full((2, n + 1), 1, np.uint64)
    power[1:], inverse[1:] = BASE, INVERSE
    power, inverse = np.cumprod(power), np.cumprod(inverse)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * power[:-1])])

    def hashed(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((sums[stop] - sums[start]) * inverse[start])

    at = np.arange(n)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - at  # bytes to the end of the text
    core = mix64((sums[np.minimum(at + CORE, n)] - sums[:-1]) * inverse[:-1])
    core[left < CORE] = NONE
    least = sliding(core, REACH + 1, np.minimum, NONE)
    least[left < LENGTH] = 0  # not a whole window
    # Greatest of the least over all windows that begin at most REACH before.
    most = sliding(least[::-1], REACH + 1, np.maximum, np.uint64(0))[::-1]
    chosen = np.flatnonzero((core == most) & (core != NONE) & (most > 0))
    text = np.repeat(np.arange(len(texts)), sizes)[chosen]
    start = np.maximum(chosen - REACH, first[chosen])
    stop = np.minimum(chosen + LENGTH, chosen + left[chosen])
    shape = ((chosen - start) * (LENGTH + 1) + (stop - chosen)).astype(np.uint64)
    return text, chosen - first[chosen], core[chosen], mix64(hashed(start, stop) + mix64(shape))


def _texts(b: pa.RecordBatch, seen: set[int]) -> Iterator[tuple[bytes, int]]:
    """Texts of a batch that have a window, with their keys, each once per task."""
    for text in b.column("text").to_pylist():
        data = text.encode()
        if len(data) >= LENGTH and (key := key_of(data)) not in seen:
            seen.add(key)
            yield data, key


def _pieces(texts: Iterator[tuple[bytes, int]]) -> Iterator[list[tuple[bytes, int, int, int]]]:
    """Groups of about ``BATCH`` bytes of (bytes, key, place in the text, bytes of the text); long texts overlap."""
    held, size = [], 0
    for data, key in texts:
        for s in range(0, len(data), BATCH):
            start, stop = max(0, s - 2 * LENGTH), min(len(data), s + BATCH + 2 * LENGTH)
            held.append((data[start:stop], key, start, len(data)))
            size += stop - start
            if size >= BATCH:
                yield held
                held, size = [], 0
    if held:
        yield held


ROW = "core long, context long, key long, pos int, many boolean, start int, stop int"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def _rows(core, context, key, pos, many, start, stop) -> pa.RecordBatch:
    n = len(key)
    null = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
    return pa.record_batch(
        [null(core, pa.int64()), null(context, pa.int64()), pa.array(key, pa.int64()), null(pos, pa.int32()), null(many, pa.bool_()), null(start, pa.int32()), null(stop, pa.int32())],
        NAMES,
    )


def _scan(docs: DataFrame) -> DataFrame:
    """Anchors of distinct texts; contexts that a task sees twice are spans at once, and one row stands for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            found = []
            for pieces in _pieces(_texts(b, seen)):
                text, pos, core, context = anchors([x[0] for x in pieces])
                key, offset, size, length = (np.array(x, np.int64)[text] for x in zip(*[(k, s, n, len(d)) for d, k, s, n in pieces], strict=True))
                # Contexts that a cut clips are whole in the next piece.
                good = ((pos >= REACH) | (offset == 0)) & ((pos + LENGTH <= length) | (offset + length == size))
                pos = pos + offset
                found.append([x[good] for x in (core.view(np.int64), context.view(np.int64), key, pos, np.maximum(pos - REACH, 0), np.minimum(pos + LENGTH, size))])
            if not found:
                continue
            core, context, key, pos, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((pos, key, context, core))
            core, context, key, pos, start, stop = (x[order] for x in (core, context, key, pos, start, stop))
            same = (np.diff(core) == 0) & (np.diff(context) == 0)
            again = same & (np.diff(key) == 0) & (np.diff(pos) == 0)  # one anchor, from two pieces of a text
            fresh = ~np.insert(again, 0, False)
            core, context, key, pos, start, stop = (x[fresh] for x in (core, context, key, pos, start, stop))
            same = (np.diff(core) == 0) & (np.diff(context) == 0)
            twice, first = np.append(same, False) | np.insert(same, 0, False), ~np.insert(same, 0, False)
            yield _rows(None, None, key[twice], None, None, start[twice], stop[twice])
            yield _rows(core[first], context[first], key[first], pos[first], twice[first], start[first], stop[first])

    return docs.mapInArrow(run, ROW)


def _by_core(found: DataFrame) -> DataFrame:
    """Spans of equal contexts, and the anchors (one of each context) of cores with different contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            own = b.column("core").is_null().to_numpy(zero_copy_only=False)
            if own.any():
                yield b.filter(pa.array(own))
            rest = b.filter(pa.array(~own))
            held.append([rest.column(c).to_numpy(zero_copy_only=False) for c in NAMES])
        if not held:
            return
        core, context, key, pos, many, start, stop = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        if not len(core):
            return
        order = np.lexsort((pos, key, context, core))
        core, context, key, pos, many, start, stop = (x[order] for x in (core, context, key, pos, many.astype(bool), start, stop))
        same_core = np.diff(core) == 0
        same = same_core & (np.diff(context) == 0)
        again = same & (np.diff(key) == 0) & (np.diff(pos) == 0)  # one anchor of one text, from two tasks
        fresh = ~np.insert(again, 0, False)
        first = ~np.insert(same, 0, False)
        group = np.cumsum(first) - 1
        size = np.bincount(group[fresh], minlength=group[-1] + 1)
        several = np.bincount(group, weights=many, minlength=group[-1] + 1) > 0
        whole = ((size > 1) | several)[group]
        spans = whole & fresh
        for i in range(0, int(spans.sum()), 100_000):
            at = np.flatnonzero(spans)[i : i + 100_000]
            yield _rows(None, None, key[at], None, None, start[at], stop[at])
        # Cores of two contexts or more, at least one of them seen once.
        block = np.cumsum(~np.insert(same_core, 0, False)) - 1
        kinds = np.bincount(block[first])
        lone = np.bincount(block[first], weights=~whole[first], minlength=len(kinds))
        wanted = first & (kinds > 1)[block] & (lone > 0)[block]
        for i in range(0, int(wanted.sum()), 100_000):
            at = np.flatnonzero(wanted)[i : i + 100_000]
            yield _rows(core[at], context[at], key[at], pos[at], whole[at], start[at], stop[at])

    n = partitions(found.sparkSession)
    return found.repartition(n, F.coalesce("core", F.xxhash64("key", "start"))).mapInArrow(run, ROW)


def intervals(common: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (first, last, length) of a sorted array, inner ones first, by a stack.

    ``common[i]`` is what entries ``i`` and ``i + 1`` share.
    """
    stack: list[tuple[int, int]] = []
    for i, c in enumerate(common.tolist()):
        first = i
        while stack and stack[-1][1] > c:
            first, length = stack.pop()
            yield first, i, length
        if not stack or stack[-1][1] < c:
            stack.append((first, c))
    while stack:
        first, length = stack.pop()
        yield first, len(common), length


def maximal_repeats(right: np.ndarray, left: np.ndarray, rank: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Maximal repeats of one core: (bytes left, bytes right, occurrences), core and both reaching ``LENGTH``.

    ``right[i]`` is the common length after the core of entries ``i, i + 1`` in
    suffix order; ``rank`` each entry's place in the order of left contexts, and
    ``left`` what neighbours there share.
    """
    back = np.argsort(rank)
    for first, last, after in intervals(right):
        if left.max() + after < REACH:
            continue
        places = np.sort(rank[first : last + 1])
        # What neighbours among these share on the left: the least over the gap between them.
        shared = np.minimum.reduceat(left[: places[-1]], places[:-1])
        for i, j, before in intervals(shared):
            if before + after < REACH:
                continue
            members = back[places[i : j + 1]]
            # Not all below one inner interval, else they go on to the right.
            if right[members.min() : members.max()].min() == after:
                yield before, after, members


def _reach(texts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Common prefix lengths of neighbouring rows of a byte matrix."""
    differ = texts[1:] != texts[:-1]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), texts.shape[1])
    return np.minimum(n, np.minimum(length[1:], length[:-1]))


def _spans_of_core(data: list[bytes], before: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context how far its repeats reach left of and right of its core (-1: no repeat)."""
    n = len(data)
    after = np.array([len(d) for d in data]) - before - CORE
    # No byte of UTF-8 is 255: it ends a context before the others' next byte.
    right, left = np.full((2, n, REACH), 255, np.uint8)
    for i, d in enumerate(data):
        k = before[i]
        left[i, :k] = np.frombuffer(d, np.uint8, k)[::-1]
        right[i, : after[i]] = np.frombuffer(d, np.uint8, after[i], k + CORE)
    words = lambda x: np.ascontiguousarray(np.pad(x, ((0, 0), (0, -REACH % 8)))).view(">u8").astype(np.uint64)
    order = np.lexsort((after, *words(right).T[::-1], group))
    other = np.lexsort((before, *words(left).T[::-1], group))
    rank = np.empty(n, np.int64)
    rank[other] = np.arange(n)
    lcp, lce = _reach(right[order], after[order]), _reach(left[other], before[other])
    out_left, out_right = np.full(n, -1), np.full(n, -1)
    edges = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0, [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        own = order[a:b]
        for l, r, members in maximal_repeats(lcp[a : b - 1], lce[a : b - 1], rank[own] - a):
            at = own[members]
            out_left[at] = np.maximum(out_left[at], l)
            out_right[at] = np.maximum(out_right[at], r)
    return out_left, out_right


def _edges(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Spans of the anchors whose contexts differ, from the sorted suffixes of their cores."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmap(wanted.where("core is not null"), "key", BITS))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            out = []
            for data, key in _texts(b, seen):
                if in_bitmap(shared.value, np.array([key]).view(np.uint64), BITS)[0]:
                    out += [(key, s // SEGMENT, data[max(0, s - REACH) : s + SEGMENT + LENGTH]) for s in range(0, len(data), SEGMENT)]
            yield pa.record_batch(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())],
                ["key", "segment", "data"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, segment, data, places in zip(*[b.column(c).to_pylist() for c in ("key", "segment", "data", "places")], strict=True):
                at = max(0, segment * SEGMENT - REACH)
                yield pa.record_batch(
                    [pa.array([p["core"] for p in places]), pa.array([p["pos"] - p["start"] for p in places], pa.int32()),
                     pa.array([data[p["start"] - at : p["stop"] - at] for p in places], pa.binary()), pa.array([p["many"] for p in places]),
                     pa.array([key] * len(places)), pa.array([p["pos"] for p in places], pa.int32())],
                    ["core", "before", "data", "many", "key", "pos"],
                )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        core, before, key, pos, many = (table.column(c).to_numpy() for c in ("core", "before", "key", "pos", "many"))
        order = np.lexsort((pos, key, core))
        # One anchor of one text once, though copies of the text came from several tasks.
        again = (np.diff(core[order]) == 0) & (np.diff(key[order]) == 0) & (np.diff(pos[order]) == 0)
        order = order[~np.insert(again, 0, False)] if len(order) else order
        # Whole cores, about 20,000 contexts at a time.
        cuts = [0]
        for s in [*(np.flatnonzero(np.diff(core[order])) + 1).tolist(), len(order)]:
            if s - cuts[-1] >= 20_000 or s == len(order):
                cuts.append(s)
        for i, j in zip(cuts, cuts[1:], strict=False):
            at = order[i:j]
            l, r = _spans_of_core(table.column("data").take(pa.array(at)).to_pylist(), before[at].astype(np.int64), core[at])
            good = (l >= 0) & ~many[at].astype(bool)
            yield pa.record_batch(
                [pa.array(key[at][good]), pa.array((pos[at] - l)[good].astype(np.int32)), pa.array((pos[at] + CORE + r)[good].astype(np.int32))],
                ["key", "start", "stop"],
            )

    n = partitions(spark)
    place = F.struct("core", "pos", "start", "stop", "many")
    segment = F.floor(F.col("pos") / SEGMENT).alias("segment")
    places = wanted.where("core is not null").groupBy("key", segment).agg(F.collect_set(place).alias("places"))
    return (
        docs.mapInArrow(texts, "key long, segment long, data binary")
        .join(places, ["key", "segment"])
        .mapInArrow(cut, "core long, before int, data binary, many boolean, key long, pos int")
        .repartition(n, "core")
        .mapInArrow(sort, "key long, start int, stop int")
    )


def spans(docs: DataFrame) -> DataFrame:
    """Table (key of a text, start, stop) of bytes under repeats, unmerged; whole copies apart from one are not in it."""
    whole = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    first = keep(_by_core(_scan(whole)))
    return keep(first.where("core is null").select("key", "start", "stop").union(_edges(whole, first)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of each row.

    Texts are their UTF-8 bytes; null texts count as empty. Texts that occur
    twice are removed whole if they have ``LENGTH`` bytes. Ids are passed
    through, null or repeated; repeated rows are copies of each other. An empty
    table gives no rows; other columns are not read. Cores, contexts and texts
    are told apart by 64-bit hashes, edges by their bytes.

    Each task sends one row for equal contexts and each text once, however many
    copies it has. Copies are settled by a count without their texts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [t.encode() for t in b.column("text").to_pylist()]
            yield pa.record_batch([pa.array([key_of(d) for d in data], pa.int64()), pa.array([len(d) for d in data], pa.int64())], ["key", "n"])

    copies = keep(
        docs.select("text").mapInArrow(named, "key long, n long").where(F.col("n") >= LENGTH).groupBy("key").count().where("count > 1").select("key")
    )
    found = spans(docs)
    merged = (
        found.join(copies, "key", "left_anti").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    )
    cuts = keep(merged)
    shared = spark.sparkContext.broadcast(bitmap(cuts, "key", BITS))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only texts that a span may touch travel; of the others the digest does."""
        for b in batches:
            data = [t.encode() for t in b.column("text").to_pylist()]
            key = np.array([key_of(d) for d in data], np.int64)
            cut = in_bitmap(shared.value, key.view(np.uint64), BITS)
            yield pa.record_batch(
                [b.column("doc_id"), pa.array(key), pa.array([len(d) for d in data], pa.int64()),
                 pa.array([d if x else None for d, x in zip(data, cut, strict=True)], pa.binary()),
                 pa.array([None if x else hashlib.sha256(d).hexdigest() for d, x in zip(data, cut, strict=True)])],
                ["doc_id", "key", "n_bytes", "data", "sha"],
            )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, data, sha, whole, found in zip(*[b.column(c).to_pylist() for c in ("n_bytes", "data", "sha", "whole", "spans")], strict=True):
                if whole:
                    out.append((n, 1, hashlib.sha256(b"").hexdigest()))
                    continue
                runs: list[list[int]] = []
                for s in found or ():
                    if runs and s["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["stop"])
                    else:
                        runs.append([s["start"], s["stop"]])
                if data is not None:
                    edges = [0, *[x for r in runs for x in r], n]
                    sha = hashlib.sha256(b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))).hexdigest()
                out.append((sum(j - i for i, j in runs), len(runs), sha))
            yield pa.record_batch(
                [b.column("doc_id"), b.column("n_bytes"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    known = cuts.select("key", F.lit(False).alias("whole"), "spans").union(copies.select("key", F.lit(True), F.lit(None)))
    return (
        docs.mapInArrow(split, "doc_id long, key long, n_bytes long, data binary, sha string")
        .join(known, "key", "left").select("doc_id", "n_bytes", "data", "sha", "whole", "spans")
        .mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
