"""Spelling variants: words one edit apart, found through a variable-length gram index.

A word stands between two end marks. From each place of it one gram is read: at
least ``SHORTEST`` characters, and one more as long as the gram so far is
frequent among all words and shorter than ``LONGEST``. Which grams are frequent
is the gram dictionary, a prefix tree pruned by count. As a gram is decided by
its own characters alone, an edit affects only the grams that cover its place.
The most grams that any one edit of a word can affect is the word's bound: two
near words share all grams but so many, hence at least one of the rarest
(bound + 1) grams of each. Only those short lists are merged (joined, with place
and length), and every pair found is verified by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from wattframe.llm.common import LOWER, crc32_sql, drop, keep, rows

SHORTEST, LONGEST = 3, 6
FIRST, LAST = "^", "$"
#: A gram is read on where it stands in more words than this, or than a 50,000th of all places.
FREQUENT, FREQUENT_GRAMS = 100, 50_000
#: An index entry with more words than this is cut up by the words' own deletions.
LONG_LIST = 1_000
#: Bits of the fixed-size tables of list lengths: by the number of words, but no more.
FEWEST_BITS, MOST_BITS = 16, 22
#: Words of a task, and of one batch of entries.
TASK_WORDS, WORDS_AT_ONCE = 50_000, 500
#: Distinct words that a worker counts before it hands them on.
HELD_WORDS = 300_000
#: One in so many (document, word) pairs is written with a letter missing.
SLIP = 31
SIGN = 1 << 63
#: Sides of an entry: the word is in the list, asks who else is in it, or both.
LISTED, ASKING, BOTH = 0, 1, 2


def typed_words(docs: DataFrame, least_chars: int = 7, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``word`` and ``n``: all runs of letters of ``least_chars`` or more, some with a letter taken out, and how often.

    A null text has no words; where the id is null no letter is taken out.
    Counts are added up in each worker before the shuffle, so that a word in a
    third of all texts is a few rows.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_chars},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held.keys())), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc, whole in zip(b.column("doc"), b.column("text"), strict=True):
                own = Counter(runs.findall(whole.as_py().encode().translate(LOWER).decode()))
                doc = doc.as_py()
                before = None if doc is None else zlib.crc32(f"{doc}:".encode())
                for word, n in own.items():
                    if before is not None and (h := zlib.crc32(word.encode(), before)) % SLIP == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_chars:
                            continue
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    told = docs.where(F.col(text).isNotNull()).select(F.col(id).cast("string").alias("doc"), F.col(text).alias("text"))
    return told.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# The gram index


def grams(word: str, frequent: set[str]) -> list[str]:
    """The gram at each place of the marked word."""
    marked, out = FIRST + word + LAST, []
    for at in range(len(marked) - SHORTEST + 1):
        end = at + SHORTEST
        while marked[at:end] in frequent and end - at < LONGEST and end < len(marked):
            end += 1
        out.append(marked[at:end])
    return out


def most_affected(found: list[str]) -> tuple[int, int]:
    """The most grams that one edit can affect: the most that cover one place, and that span one gap (an insertion)."""
    cover, span = [0] * (len(found) + LONGEST), [0] * (len(found) + LONGEST)
    for at, g in enumerate(found):
        cover[at] += 1
        for k in range(at + 1, at + len(g)):
            cover[k] += 1
            span[k] += 1
    return max(cover), max(span)


def _place_key(gram: str, size: int, at: int, more: str = "") -> int:
    """A 64-bit name of the list of words of ``size`` characters that hold ``gram`` at place ``at``."""
    return xxh3_64_intdigest(f"{gram}{size},{at}{more}")


def _per_word(words: DataFrame, schema: str, fn) -> DataFrame:
    """Rows of ``fn(word, n)`` for each word, in Arrow batches."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = fn()
        for b in rows(batches, WORDS_AT_ONCE):
            out = [row for w, n in zip(*(c.to_pylist() for c in b.columns), strict=True) for row in one(w, n)]
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names)

    return words.select("word", "n").mapInArrow(run, schema)


def frequent_grams(words: DataFrame) -> set[str]:
    """The inner nodes of the gram dictionary, grown length by length.

    At most ``FREQUENT_GRAMS`` a length can stand in more than that share of all
    places, which bounds what reaches the driver and the executors.
    """
    places = words.agg(F.sum(F.char_length("word") + 2)).first()[0] or 0
    limit = max(FREQUENT, places // FREQUENT_GRAMS)
    found: set[str] = set()
    for size in range(SHORTEST, LONGEST):
        inner = found

        def counted(batches: Iterator[pa.RecordBatch], size=size, inner=inner) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n: Counter[str] = Counter()
                for word in b.column("word").to_pylist():
                    marked = FIRST + word + LAST
                    for at in range(len(marked) - size + 1):
                        if size == SHORTEST or marked[at : at + size - 1] in inner:
                            n[marked[at : at + size]] += 1
                yield pa.record_batch([pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())], ["gram", "n"])

        all_of = words.select("word").mapInArrow(counted, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        more = {r.gram for r in all_of.where(F.col("n") > limit).collect()}
        if not more:
            break
        found = found | more
    return found


def list_lengths(words: DataFrame, frequent: set[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds, in two tables of ``2**bits`` counts, of how many words hold a gram, and hold it at one place and length.

    Grams that fall together are counted together: that changes the order of
    lists and which are cut up, never what is found.
    """
    size = 1 << bits

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size, np.int64)
        for b in rows(batches, 4 * WORDS_AT_ONCE):
            at = []
            for word in b.column("word").to_pylist():
                for place, g in enumerate(grams(word, frequent)):
                    at += [zlib.crc32(g.encode()) % size, size + _place_key(g, len(word), place) % size]
            where, n = np.unique(np.array(at, np.int64), return_counts=True)
            total[where] += n
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["at", "n"])

    got = words.select("word").mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * size, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    out = np.minimum(out, 2**31 - 1).astype(np.int32)
    return out[:size], out[size:]


def index(words: DataFrame) -> DataFrame:
    """Entries (key, side, word, n) of the lists to merge.

    A word asks among words of its own length and of one character more. An
    entry at a place whose list is long is written once for each deletion of the
    word instead, so that only words that agree in all but one character meet.
    """
    spark = words.sparkSession
    frequent = frequent_grams(words)
    n_words = words.count()
    bits = min(MOST_BITS, max(FEWEST_BITS, n_words.bit_length()))
    words = words.repartition(n_words // TASK_WORDS + 1)
    shared = spark.sparkContext.broadcast((frequent, *list_lengths(words, frequent, bits)))
    mask, long = (1 << bits) - 1, LONG_LIST

    def entries():
        frequent, by_gram, by_place = shared.value

        def one(word: str, n: int) -> Iterator[tuple]:
            found = grams(word, frequent)
            order = sorted((by_gram[zlib.crc32(g.encode()) & mask], g, k) for k, g in enumerate(found))
            size = len(word)
            bound, inserted = most_affected(found)
            if bound >= len(found):
                raise ValueError(f"words are too short for grams of up to {LONGEST} characters")
            for rank, (_, g, at) in enumerate(order[: bound + 1]):
                longer = ((size + 1, at), (size + 1, at + 1)) if rank <= inserted else ()
                for other, place in ((size, at), *longer):
                    key = _place_key(g, other, place)
                    if by_place[key & mask] <= long:
                        yield key - SIGN, BOTH if other == size else ASKING, word, n
                    elif other == size:
                        without = [word[:k] + word[k + 1 :] for k in range(size)]
                        for k, rest in enumerate(without):
                            yield _place_key(g, other, place, f",{k}{rest}") - SIGN, BOTH, word, n
                        for rest in set(without):
                            yield _place_key(g, other, place, f",{rest}") - SIGN, LISTED, word, n
                    else:
                        yield _place_key(g, other, place, f",{word}") - SIGN, ASKING, word, n

        return one

    return _per_word(words, "key long, side long, word string, n long", entries)


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs (a, a_n, b, b_n) of words (word, n) that differ by one inserted, deleted or replaced character."""
    entries = keep(index(words))
    asked = entries.where(F.col("side") != LISTED).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    listed = entries.where(F.col("side") != ASKING).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    # The words of a list have one length; who asks is as long, or one shorter.
    once = (F.col("a") < F.col("b")) | (F.char_length("a") < F.char_length("b"))
    met = asked.join(listed, "key").where(once & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of rows (word, form): forms are followed to the last by pointer doubling."""
    now = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        new = keep(moved)
        drop(now)
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of each word (word, n).

    A form is at least ``ratio`` times as frequent as its word, so chains of
    forms end. Ties go to the smallest word in code-point order.
    """
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select("b", "b_n", "a", "a_n")
    )
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), "near")))
    told = both.union(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.m") >= ratio * F.col("n")
    formed = keep(
        told.select(
            "word", "n", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")
        )
    )
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, least_chars: int = 7, least_n: int = 2, ratio: int = 10) -> DataFrame:
    """Spelling variants among the words of ``docs``.

    Null and empty texts have no words, repeated rows count as often as they
    stand there, an empty table gives no rows, other columns are not read. A
    very long text is counted whole, in one row.
    """
    return variants(keep(typed_words(docs, least_chars).where(F.col("n") >= least_n)), ratio)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Near words as equal texts: with one character masked, or with one left out.
SQL = f"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, run, count(*) AS c, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS bytes FROM r GROUP BY doc_id, run),
h AS (SELECT run, c, {crc32_sql("bytes")} AS h FROM c),
t AS (SELECT CASE WHEN h % {SLIP} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM t WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
i AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM w),
m AS MATERIALIZED (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS masked, left(word, i) || substr(word, i + 2) AS less FROM i),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS m FROM m a JOIN m b ON a.masked = b.masked AND a.word <> b.word
  UNION SELECT w.word, m.word, m.n FROM w JOIN m ON m.less = w.word UNION SELECT m.word, w.word, w.n FROM w JOIN m ON m.less = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, coalesce(form, word) AS root, form IS NULL AS ended FROM f
  UNION ALL SELECT walk.word, coalesce(f.form, f.word), f.form IS NULL FROM walk JOIN f ON f.word = walk.root WHERE NOT ended)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN walk ON walk.word = f.word AND ended"""
