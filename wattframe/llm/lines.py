"""Lines that many documents share are dropped: explode, hash, count documents, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm.common import keep

#: Characters taken off both ends of a line, and its letters that are lower-cased.
STRIPPED = " \t\x0b\x0c\r\n"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Common lines (two hashes each) that are sent to all executors; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Parts into which every common line is dealt for a shuffled join, so that no line fills one task.
SALTS = 32


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case; all other letters stay as they are."""
    cut = F.trim(line, F.lit(STRIPPED))
    ascii_only = F.octet_length(cut) == F.char_length(cut)
    return F.when(ascii_only, F.lower(cut)).otherwise(F.translate(cut, UPPER, SMALL))


def _hashes(value: Column) -> list[Column]:
    """128 bits: two independent 64-bit hashes."""
    return [F.xxhash64(value), F.xxhash64(F.lit(1), value)]


def common_lines(docs: DataFrame, at_least: int = 10, least_chars: int = 1, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``k1``, ``k2`` (hashes of a key) and ``n_docs`` of each key found in ``at_least`` documents.

    Documents are told apart by their id (null is one id). A key counts once a
    document, however often it stands there: repeats within a row go before the
    shuffle, repeats across rows in the first of two aggregations, which deals
    rows by (key, id), so that a line in a third of all documents is spread.
    """
    keys = F.array_distinct(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), line_key))
    lines = docs.select(F.col(id).cast("string").alias("doc"), F.explode(keys).alias("line"))
    hashed = lines.where(F.char_length("line") >= least_chars).select(
        "doc", *[h.alias(k) for h, k in zip(_hashes(F.col("line")), ("k1", "k2"), strict=True)]
    )
    return hashed.distinct().groupBy("k1", "k2").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= at_least)


def without_common_lines(
    docs: DataFrame, at_least: int = 10, least_chars: int = 1, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and ``kept`` (the text of the lines that stay) of each row.

    A null or empty text is one empty line; an empty key is shorter than any
    ``least_chars`` of at least 1 and stays. Repeated rows (same id, same text)
    are worked out once and given back as often as they came; a null id is
    passed through; an empty table gives no rows; other columns are not read. A
    row whose lines are all dropped keeps an empty text. A very long text is
    one group, as large as the text itself; no group is larger.
    """
    gone = keep(common_lines(docs, at_least, least_chars, text, id).select("k1", "k2"))
    whole = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The one shuffle of the texts: grouping the lines again needs no other.
    place = ["doc_id", "t1", "t2"]
    rows = (
        whole.withColumns(dict(zip(("t1", "t2"), _hashes(F.col("text")), strict=True)))
        .groupBy(*place)
        .agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    )
    lines = rows.select(*place, "copies", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    own = line_key(F.col("line"))
    can = F.char_length(own) >= least_chars
    k1, k2 = _hashes(own)
    # Lines that can meet nothing, empty ones above all, are spread by their place.
    keyed = lines.withColumns({"can": can, "k1": F.when(can, k1).otherwise(F.xxhash64("t1", "pos")), "k2": k2})
    if gone.count() <= BROADCAST_ROWS:
        marked = keyed.join(F.broadcast(gone.withColumn("hit", F.lit(True))), ["k1", "k2"], "left")
    else:
        dealt = gone.withColumns({"hit": F.lit(True), "salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))})
        salted = keyed.withColumn("salt", F.pmod(F.xxhash64("t1", "pos"), F.lit(SALTS)).cast("int"))
        marked = salted.join(dealt.hint("merge"), ["k1", "k2", "salt"], "left")
    told = marked.withColumn("dropped", F.col("can") & F.coalesce("hit", F.lit(False)))
    lived = F.when(~F.col("dropped"), F.struct("pos", "line"))  # collect_list leaves nulls out
    back = told.groupBy(*place).agg(
        F.max("copies").alias("copies"),
        F.count("*").alias("n_lines"),
        F.count_if("dropped").alias("n_dropped"),
        F.sort_array(F.collect_list(lived)).alias("lived"),
    )
    out = back.select(
        "doc_id", "n_lines", "n_dropped", F.array_join(F.col("lived.line"), "\n").alias("kept"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    return out.drop("copy")


def deduplicated(docs: DataFrame, at_least: int = 10, least_chars: int = 1) -> DataFrame:
    """The digest of :func:`without_common_lines`: the kept text as its sha256."""
    out = without_common_lines(docs, at_least, least_chars)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT k, doc_id, string_split(text, chr(10)) AS parts FROM d),
l AS (SELECT k, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM p),
n AS (SELECT k, doc_id, i, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{UPPER}', '{SMALL}') AS key FROM l),
c AS (SELECT key FROM n WHERE key <> '' GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '-')) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM n LEFT JOIN c USING (key) GROUP BY k, doc_id"""
