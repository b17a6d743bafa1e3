"""Benchmark decontamination by greedy string tiling.

Texts and test items are words: A-Z lower-cased, punctuation taken out, so a
passage is still found with other case or punctuation. A tile is a run of at
least ``SEED`` equal words, used once on either side; the longest come first.
An item is leaked into a text when tiles cover at least ``COVERAGE`` of its
words, in whatever order they stand.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm.common import bitmap, gram_hashes, in_bitmap, keep, mix64, word_hashes

SEED = 5
COVERAGE = 0.5
BITS = 24
PUNCTUATION = b".,;:!?\"'()[]{}"
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def words(text: str | None) -> np.ndarray:
    return word_hashes(text or "", PUNCTUATION)


def _prefixes(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running Karp-Rabin sums of t[k] * B**k, and B**-k to bring a run's sum to its start."""
    power, inverse = np.full((2, len(tokens) + 1), 1, np.uint64)
    power[1:], inverse[1:] = BASE, INVERSE
    power, inverse = np.cumprod(power), np.cumprod(inverse)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * power[:-1])]), inverse


def running_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``n`` tokens, each from the one before it."""
    if len(tokens) < n:
        return np.empty(0, np.uint64)
    sums, inverse = _prefixes(tokens)
    return mix64((sums[n:] - sums[:-n]) * inverse[: len(tokens) - n + 1])


def maximal_runs(item: np.ndarray, text: np.ndarray, places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in ``item``, starts in ``text`` and lengths of all common runs that cannot be made longer on either side.

    Only pairs of equal seeds with different words before them are taken, and
    each is stretched by bisection on the running hashes: a word repeated ``n``
    times meets one repeated ``m`` times in ``n + m`` pairs, not ``n * m``.
    """
    a, b = running_hashes(item, least), running_hashes(text, least)
    whole = np.flatnonzero(places[least - 1 :] - places[: len(b)] == least - 1) if len(b) else np.empty(0, int)
    if not len(a) or not len(whole):
        return (np.empty(0, np.int64),) * 3
    # Seed with the word before it; the item's first seed has none and equals nothing.
    before_a = mix64(a + np.concatenate([[np.uint64(0)], item[: len(a) - 1]]) * BASE)
    before_a[0] = ~before_a[0]
    before_b = mix64(b[whole] + text[whole - 1] * BASE)
    edge = (whole == 0) | (places[whole] - places[whole - 1] != 1)
    order = np.lexsort((before_a, a))
    lo, hi = np.searchsorted(a[order], b[whole], "left"), np.searchsorted(a[order], b[whole], "right")
    kinds, first, count = np.unique(before_a[order], return_index=True, return_counts=True)
    at = np.minimum(np.searchsorted(kinds, before_b), len(kinds) - 1)
    same = (kinds[at] == before_b) & ~edge & (first[at] >= lo) & (first[at] < hi)
    skip, skipped = np.where(same, first[at], hi), np.where(same, count[at], 0)
    n = hi - lo - skipped
    j = np.repeat(whole, n)
    k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i = order[k + np.where(k >= np.repeat(skip, n), np.repeat(skipped, n), 0)]
    # Runs end where the item, the text or its next gap does.
    gaps = np.append(np.flatnonzero(np.diff(places) != 1) + 1, len(text))
    low, high = np.full(len(i), least), np.minimum(len(item) - i, gaps[np.searchsorted(gaps, j, "right")] - j)
    (sa, ia), (sb, ib) = _prefixes(item), _prefixes(text)
    while (open_ := np.flatnonzero(low < high)).size:
        x, y, m = i[open_], j[open_], (low[open_] + high[open_] + 1) // 2
        fits = (sa[x + m] - sa[x]) * ia[x] == (sb[y + m] - sb[y]) * ib[y]
        low[open_] = np.where(fits, m, low[open_])
        high[open_] = np.where(fits, high[open_], m - 1)
    return i, j, low


def tiles(item: np.ndarray, text: np.ndarray, places: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, index in ``text``, length), longest first, ties from the left.

    ``places`` holds the word position of each entry of ``text``: runs do not
    cross a gap.
    """
    i, j, length = maximal_runs(item, text, places, least)
    heap = list(zip((-length).tolist(), i.tolist(), j.tolist(), strict=True))
    heapq.heapify(heap)
    used_a, used_b = np.zeros(len(item), bool), np.zeros(len(text), bool)
    free = len(item)
    out = []
    while heap and free >= least:
        m, i0, j0 = heapq.heappop(heap)
        taken = used_a[i0 : i0 - m] | used_b[j0 : j0 - m]
        if not taken.any():
            used_a[i0 : i0 - m] = used_b[j0 : j0 - m] = True
            free += m
            out.append((i0, j0, -m))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], taken.view(np.int8), [1]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= least:
                heapq.heappush(heap, (s - e, i0 + s, j0 + s))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, copies: bool = True) -> DataFrame:
    """Rows (doc_id, item_id, n_item, n_covered, n_tiles, coverage) of every item leaked into a document.

    Null and empty texts, and texts or items of fewer than ``SEED`` words, leak
    nothing. Repeated rows of the same id and text give one row per item; a
    null ``doc_id`` or ``item_id`` is kept as such. Empty tables give no rows.
    Other columns are not read.

    Whole texts are searched where they are scanned; only the words of runs that
    may match leave the scan. A set of ``2**BITS`` bits of seed hashes filters
    first, then seeds are joined by their hashes, so no document meets an item
    with which it shares no seed. Exact copies of a text are tiled once; a hot
    seed brings its documents together with the few items that hold it, and
    pairs whose shared seeds cannot cover enough are discarded before tiling.
    With ``copies`` false, rows carry the text's key instead of ids.
    """
    spark = docs.sparkSession

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column("item_key").to_pylist(), b.column("text"), strict=True):
                w = words(text.as_py())
                seed, n = np.unique(gram_hashes(w, SEED), return_counts=True)
                if len(seed):
                    yield pa.record_batch(
                        [pa.array(np.full(len(seed), key)), pa.array(np.full(len(seed), len(w))), _signed(seed), pa.array(n)],
                        ["item_key", "n_item", "seed", "n"],
                    )

    def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in enumerate(b.column("text")):
                w = pa.array([words(text.as_py()).view(np.int64)], pa.list_(pa.int64()))
                yield pa.record_batch([b.column("item_key")[k : k + 1], b.column("item_id")[k : k + 1], w], ["item_key", "item_id", "item"])

    all_items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    all_items = keep(all_items.withColumn("item_key", F.xxhash64(F.struct("item_id", "text"))))
    seed_rows = keep(all_items.mapInArrow(seeds, "item_key long, n_item long, seed long, n long"))
    tests = all_items.mapInArrow(item_words, "item_key long, item_id long, item array<bigint>")
    shared = spark.sparkContext.broadcast(bitmap(seed_rows, "seed", BITS))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k, text in enumerate(b.column("text")):
                w = words(text.as_py())
                grams = gram_hashes(w, SEED)
                at = np.flatnonzero(in_bitmap(shared.value, grams, BITS))
                if len(at):
                    places = np.unique(at[:, None] + np.arange(SEED))
                    out.append((k, np.unique(grams[at]).view(np.int64), places, w[places].view(np.int64)))
            took = pa.array([k for k, *_ in out], pa.int64())
            yield pa.record_batch(
                [b.column("doc_id").take(took), b.column("key").take(took)]
                + [pa.array([x[i] for x in out], pa.list_(pa.int64())) for i in (1, 2, 3)],
                ["doc_id", "key", "seeds", "places", "words"],
            )

    found = keep(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("key"), "text").mapInArrow(
            hits, "doc_id long, key string, seeds array<bigint>, places array<bigint>, words array<bigint>"
        )
    )
    texts = found.dropDuplicates(["key"])
    pairs = (
        texts.select("key", F.explode("seeds").alias("seed"))
        .join(seed_rows, "seed")
        .groupBy("key", "item_key")
        .agg(F.sum("n").alias("n"), F.first("n_item").alias("n_item"))
        .where(F.col("n") * SEED >= F.col("n_item") * coverage)
        .select("key", "item_key")
    )

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, id, x, places, text in zip(*[b.column(c).to_pylist() for c in ("key", "item_id", "item", "places", "words")], strict=True):
                got = tiles(np.array(x, np.int64).view(np.uint64), np.array(text, np.int64).view(np.uint64), np.array(places))
                n = sum(t[2] for t in got)
                if n >= coverage * len(x):
                    rows.append((key, id, len(x), n, len(got)))
            yield pa.record_batch(
                [pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(5)],
                ["key", "item_id", "n_item", "n_covered", "n_tiles"],
            )

    out = (
        texts.select("key", "places", "words")
        .join(pairs, "key")
        .join(tests, "item_key")
        .mapInArrow(tiled, "key string, item_id long, n_item long, n_covered long, n_tiles long")
        .withColumn("coverage", F.round(F.col("n_covered") / F.col("n_item"), 6))
    )
    if not copies:
        return out
    return found.select("doc_id", "key").distinct().join(out, "key").drop("key")


def without_leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows into which no item leaked, with all their columns."""
    key = "__key"
    while key in docs.columns:
        key += "_"
    leaked = leaks(docs, items, coverage, copies=False).select(F.col("key").alias(key)).distinct()
    # A null text has a null key, which an anti join keeps.
    return docs.withColumn(key, F.md5("text")).join(leaked, key, "left_anti").drop(key).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
