"""Token ids to and from compact files: a static range coder with shared frequencies and interleaved lanes.

A file set is two tables in one folder. ``frequencies`` holds one row for each
id that occurs: (id, frequency), frequencies adding up to ``2**SCALE``.
``frames`` holds whole documents in ascending id order, about ``FRAME`` ids to a
row: first id's position, document ids and lengths, checksum of the ids, and
one independent block of bytes. A block can be decoded without any other, and
from any of its checkpoints without what lies before, so reading is as parallel
as there are rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.llm.common import drop, keep, partitions, shared_dir
from wattframe.llm.tokens import word_encoder

SCALE = 20
LOW = 1 << 31
LANES = 1024
#: Rows of lanes between two checkpoints.
CHECKPOINT = 256
FRAME = 1 << 18
HEAD = struct.Struct("<4sIIIII")
MAGIC = b"RNS1"


class Table:
    """Frequencies of ids, scaled to ``2**SCALE``, and the lookup from slot to id."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.uint32), freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.rank = np.zeros(int(ids.max(initial=0)) + 1, dtype=np.int64)
        self.rank[ids] = np.arange(len(ids))
        self.slot = np.repeat(np.arange(len(ids)), freq)

    @classmethod
    def of_counts(cls, ids: np.ndarray, counts: np.ndarray) -> Table:
        """Every id that occurs keeps at least one slot; the rounding error goes to the commonest."""
        order = np.argsort(ids)
        ids, counts = ids[order].astype(np.int64), counts[order].astype(np.float64)
        if len(ids) > 1 << SCALE:
            raise ValueError("more ids than slots")
        if not len(ids):
            return cls(ids, ids)
        freq = np.maximum(1, np.floor(counts / counts.sum() * ((1 << SCALE) - len(ids)))).astype(np.int64)
        freq[np.argmax(freq)] += (1 << SCALE) - freq.sum()
        return cls(ids, freq)


def encode(ids: np.ndarray, table: Table) -> bytes:
    """One block. Id ``i`` belongs to lane ``i % lanes``; rows are coded from the last to the first."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    n_rows = -(-n // lanes)
    sym = table.rank[ids]
    freq, cum = table.freq[sym], table.cum[sym]
    x = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = [np.empty(0, np.uint32)] * n_rows
    states: list[tuple[int, np.ndarray]] = []
    top, thirty_two, scale = np.uint64(63 - SCALE), np.uint64(32), np.uint64(SCALE)
    for r in range(n_rows - 1, -1, -1):
        f, c = freq[r * lanes : (r + 1) * lanes], cum[r * lanes : (r + 1) * lanes]
        y = x[: len(f)]
        full = y >= (f << top)
        if full.any():
            words[r] = y[full].astype(np.uint32)
            y[full] >>= thirty_two
        q = y // f
        y[:] = (q << scale) + (y - q * f) + c
        if r % CHECKPOINT == 0:
            states.append((r, x.copy()))
    states.reverse()
    sizes = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    out = [HEAD.pack(MAGIC, n, lanes, SCALE, int(sizes[-1]), len(states))]
    out += [struct.pack("<II", r, int(sizes[r])) + s.tobytes() for r, s in states]
    out += [w.tobytes() for w in words]
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


def decode(block: bytes, table: Table, first: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids of a block; ``first``/``stop`` choose checkpoints (all by default). Raises on a damaged block."""
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("block checksum does not match")
    magic, n, lanes, scale, n_words, n_states = HEAD.unpack_from(block)
    if magic != MAGIC or scale != SCALE:
        raise ValueError("not a block of this format")
    if not n:
        return np.empty(0, np.uint32)
    each = 8 + 8 * lanes
    at, words_at = HEAD.size, HEAD.size + each * n_states
    words = np.frombuffer(block, "<u4", n_words, words_at).astype(np.uint64)
    r, pos = struct.unpack_from("<II", block, at + first * each)
    x = np.frombuffer(block, "<u8", lanes, at + first * each + 8).copy()
    n_rows = -(-n // lanes)
    last = n_rows if stop is None or stop >= n_states else stop * CHECKPOINT
    out = np.empty(min(n, last * lanes) - r * lanes, np.int64)
    begin, mask = r * lanes, np.uint64((1 << SCALE) - 1)
    thirty_two, shift = np.uint64(32), np.uint64(SCALE)
    low = np.uint64(LOW)
    while r < last:
        y = x[: min(lanes, n - r * lanes)]
        slot = y & mask
        s = table.slot[slot.astype(np.int64)]
        out[r * lanes - begin : r * lanes - begin + len(y)] = s
        y[:] = table.freq[s] * (y >> shift) + slot - table.cum[s]
        need = np.flatnonzero(y < low)
        if len(need):
            y[need] = (y[need] << thirty_two) | words[pos : pos + len(need)]
            pos += len(need)
        r += 1
    if last == n_rows and not (x == low).all():
        raise ValueError("lanes do not end where they began")
    return table.ids[out]


FRAMES = [
    T.StructField("part", T.IntegerType()),
    T.StructField("frame", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("n_ids", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("ids_crc32", T.LongType()),
]
TOKENS = T.StructType([*FRAMES, T.StructField("ids", T.BinaryType())])
STORED = T.StructType([*FRAMES, T.StructField("block", T.BinaryType())])


def _batch(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))


def tokens(docs: DataFrame, name: str, end_id: int) -> DataFrame:
    """Frames of ids in ascending order of ``doc_id``; ``start`` counts from the beginning of ``part``."""
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), "row")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, part = word_encoder(name), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        frame = start = size = 0
        held: list[bytes] = []
        ids: list[int | None] = []
        for b in batches:
            for id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                held.append(encoded(text.as_py()) + end)
                ids.append(id)
                size += len(held[-1]) // 4
                if size >= FRAME:
                    yield _batch([_frame(part, frame, start, ids, held)], TOKENS)
                    frame, start, size, held, ids = frame + 1, start + size, 0, [], []
        if held:
            yield _batch([_frame(part, frame, start, ids, held)], TOKENS)

    return ordered.mapInArrow(run, TOKENS)


def _frame(part: int, frame: int, start: int, ids: list, held: list[bytes]) -> dict:
    flat = b"".join(held)
    return {
        "part": part, "frame": frame, "start": start, "n_ids": len(flat) // 4, "doc_ids": ids,
        "lengths": [len(h) // 4 for h in held], "ids_crc32": zlib.crc32(flat), "ids": flat,
    }


def frequencies(frames: DataFrame) -> Table:
    """Counts of all ids of all frames, as a table; at most as many rows as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for ids in b.column("ids"):
                n = np.bincount(np.frombuffer(ids.as_buffer(), "<u4"))
                if len(n) > len(total):
                    n, total = total, n
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["id", "n"])

    got = frames.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    return Table.of_counts(got.column("id").to_numpy(), got.column("n").to_numpy())


def write(docs: DataFrame, path: str, name: str = "word_bpe_49k.json", end_id: int = 1) -> None:
    """Encode every text and write the file set to the new folder ``path``.

    A null text counts as empty: only the end id. Null ids come first, repeated
    ids follow each other as they are stored; an empty table gives files without
    rows. Other columns are not read. A text longer than a frame is a frame of
    its own. Rows are dealt by ranges of (id, place in the input), so a repeated
    id is split too, and finding the ranges reads no text. What goes through the
    driver is one number per part and one per vocabulary entry.
    """
    spark = docs.sparkSession
    frames = keep(tokens(docs, name, end_id))
    table = frequencies(frames)
    parts = sorted(frames.groupBy("part").agg(F.sum("n_ids")).collect())
    before = dict(zip((p for p, _ in parts), np.cumsum([0] + [n for _, n in parts]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast((table.ids, table.freq.astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(*shared.value)
        for b in batches:
            for row in b.to_pylist():
                ids = np.frombuffer(row.pop("ids"), "<u4")
                row["start"] += before[row["part"]]
                row["block"] = encode(ids, own)
                yield _batch([row], STORED)

    frames.mapInArrow(run, STORED).write.option("compression", "uncompressed").parquet(f"{path}/frames")
    spark.createDataFrame(
        pa.table({"id": pa.array(table.ids, pa.int64()), "frequency": pa.array(table.freq.astype(np.int64))})
    ).coalesce(1).write.parquet(f"{path}/frequencies")
    drop(frames)
    shared.destroy()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a file set: doc_id, start, n_tokens and the packed ids; every checksum is verified."""
    got = spark.read.schema("id long, frequency long").parquet(f"{path}/frequencies").toArrow()
    shared = spark.sparkContext.broadcast((got.column("id").to_numpy(), got.column("frequency").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(*shared.value)
        for b in batches:
            for row in b.to_pylist():
                ids = decode(row["block"], own).astype("<u4").tobytes()
                if zlib.crc32(ids) != row["ids_crc32"]:
                    raise ValueError(f"ids of frame {row['part']}, {row['frame']} do not match their checksum")
                ends = np.cumsum([0, *row["lengths"]])
                own_ids = [ids[4 * i : 4 * j] for i, j in zip(ends, ends[1:], strict=False)]
                yield pa.record_batch(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array(ends[:-1] + row["start"], pa.int64()),
                        pa.array(row["lengths"], pa.int64()), pa.array([zlib.crc32(i) for i in own_ids], pa.int64()),
                        pa.array(own_ids, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    frames = spark.read.schema(STORED).parquet(f"{path}/frames")
    return frames.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` as a file set and give the digest of each document as read back from it."""
    path = path or shared_dir(docs.sparkSession)
    write(docs, path)
    return read(docs.sparkSession, path).drop("ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
