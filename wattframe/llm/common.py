"""Helpers shared by the text operators: tables in the shared folder, bounded bitmaps, array expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python-side split and Java-side pattern of the same white space: \x20 and \x09-\x0D.
WS = " \t\n\x0b\x0c\r"
WS_PATTERN = r"[\x20\x09-\x0D]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, a temporary folder is used in local mode
    only; on a cluster that would be a different disk for each executor, so it
    is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="wattframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def keep(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete the tables that ``keep`` wrote for these frames."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/llm-" in path:
                spark = df.sparkSession
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: A key of more than one in this many rows is hot; so fewer than this many keys can be.
HOT_SHARE = 10_000


def join_each(many: DataFrame, one: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has a row per key and the key's rows in ``many`` as ``n``.

    Keys of more than ``total / HOT_SHARE`` rows are broadcast, fewer than
    ``HOT_SHARE`` whatever the data; all others are joined by shuffle, where no
    key is large any more. ``n`` is not in the result.
    """
    hot = F.col(n) * HOT_SHARE > total
    few, rest = F.broadcast(one.where(hot).drop(n)), one.where(~hot).drop(n)
    return many.join(few, key).unionByName(many.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS_PATTERN), "")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A packed bit set of ``2**bits`` positions: the top bits of each value of a column of 64-bit hashes.

    Its size is fixed by ``bits``, not by the data, so it may be sent to all
    executors. A set bit may stand for several values: use it only where a
    false hit costs time but changes no result.
    """
    pos = df.select(F.expr(f"cast(shiftrightunsigned(`{column}`, {64 - bits}) as int)").alias("p")).distinct()
    out = np.zeros(1 << bits, dtype=bool)
    out[pos.toArrow().column("p").to_numpy()] = True
    return np.packbits(out, bitorder="little")


def in_bitmap(packed: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    pos = (hashes.astype(np.uint64, copy=False) >> np.uint64(64 - bits)).astype(np.int64)
    return (packed[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1


def rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to at most ``size`` rows."""
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)


def word_hashes(text: str, remove: bytes = b"") -> np.ndarray:
    """64-bit hashes of a text's words, A-Z lower-cased and the bytes of ``remove`` taken out."""
    import xxhash

    words = text.encode().translate(LOWER, remove).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


ODD = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; a shorter text has none."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = words[:m] * ODD[0]
    for k in range(1, n):
        out += words[k : k + m] * ODD[k]
    return mix64(out)


def crc32_sql(hexed: str) -> str:
    """DuckDB SQL for the unsigned crc32 of bytes given as hexadecimal text: one step a bit, a new byte every eighth."""
    bits = f"flatten([[CAST('0x' || substr({hexed}, 2 * i + 1, 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] FOR i IN range(0, length({hexed}) // 2)])"
    step = "lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), {step}), 4294967295)"
