"""Quotation linking: quoted passages are joined to the messages that wrote them, and conversations follow replies.

A line's quote level is the number of ``>`` marks before its text. Runs of
lines of one level are passages; a level-1 passage was written by the message
answered, deeper ones by messages before that. Passages are compared in a
normal form (words, lower case, without punctuation), whole, by paragraph and
by line, so re-wrapped and partly quoted text is still found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm.common import keep

MARKS = re.compile(r"[ \t]*((?:>[ \t]*)+)")
WORDS = re.compile(r"\w+")
#: A line or paragraph of fewer words says too little; whole passages count at any length.
LEAST_WORDS = 3


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """The text without its quotes, and the passages (level, lines), level 0 included, in order."""
    passages: list[tuple[int, list[str]]] = []
    own = []
    for line in text.split("\n"):
        found = MARKS.match(line)
        level = found[1].count(">") if found else 0
        rest = line[found.end() :] if found else line
        if not level:
            own.append(line)
        if passages and passages[-1][0] == level:
            passages[-1][1].append(rest)
        else:
            passages.append((level, [rest]))
    return "\n".join(own).strip("\n"), passages


def units(lines: list[str]) -> dict[str, int]:
    """Hashes of the normal forms of a passage, its paragraphs and its lines, each with its number of words."""
    parts = [(lines, 1)]
    paragraph: list[str] = []
    for line in [*lines, ""]:
        if line.strip():
            paragraph.append(line)
            parts.append(([line], LEAST_WORDS))
        elif paragraph:
            parts.append((paragraph, LEAST_WORDS))
            paragraph = []
    out = {}
    for part, least in parts:
        words = WORDS.findall(" ".join(part).lower())
        if len(words) >= least:
            out[hashlib.md5(" ".join(words).encode()).hexdigest()] = len(words)
    return out


def _parsed(messages: DataFrame) -> DataFrame:
    """Per message its own text, its number of quoted passages, deepest level, and units (passage, level, hash, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("hash", pa.string()), ("words", pa.int32())]))
        for b in batches:
            bodies, quoted, deepest, found = [], [], [], []
            for text in b.column("text").to_pylist():
                body, passages = parse(text)
                bodies.append(body)
                quoted.append(sum(level > 0 for level, _ in passages))
                deepest.append(max((level for level, _ in passages), default=0))
                rows = [(i, level, h, n) for i, (level, lines) in enumerate(passages) for h, n in units(lines).items()]
                if quoted[-1] and body:  # own lines on both sides of a quote are one text, too
                    rows += [(-1, 0, h, n) for h, n in units(body.split("\n")).items()]
                found.append([dict(zip(("passage", "level", "hash", "words"), r, strict=True)) for r in rows])
            yield pa.record_batch(
                [b.column("conv_id"), b.column("turn"), b.column("role"), pa.array(bodies, pa.string()), pa.array(quoted, pa.int32()), pa.array(deepest, pa.int32()), pa.array(found, unit)],
                ["conv_id", "turn", "role", "body", "n_quotes", "n_levels", "units"],
            )

    return messages.mapInArrow(
        run,
        "conv_id long, turn long, role string, body string, n_quotes int, n_levels int, "
        "units array<struct<passage:int,level:int,hash:string,words:int>>",
    )


def linked(messages: DataFrame) -> DataFrame:
    """One row per message: its text without quotes and its place in the tree of replies.

    Columns: conv_id, turn, role, body, n_quotes, n_levels, n_linked (quoted
    passages whose author is found), reply_to (turn answered), quoted (whether
    a quote says so; else it is the turn just before, if there is one), thread
    (turn that the replies go back to) and depth. Ordered by conv_id, thread and
    turn, every message comes after the one it answers.

    A passage's author is the first message of the conversation that wrote it
    itself, if it comes before the quoting one. The message answered is the
    author of most words at the lowest level linked; ties go to the latest turn.
    Null texts are empty; repeated rows count once; messages without a conv_id
    or turn stand alone (thread and depth null); an empty table gives no rows;
    other columns are not read.

    Authors are reduced to one row per passage and conversation before the join,
    so a line that everybody writes or quotes does not multiply, and a
    conversation with a third of all rows is spread by passages and by turns.
    """
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    found = keep(_parsed(rows))
    unit = found.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("units").alias("u")).select("conv_id", "turn", "u.*")
    authors = unit.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("author"))
    cited = (
        unit.where("level > 0").join(authors, ["conv_id", "hash"]).where("author < turn")
        # Of a passage's parts, the words each author wrote; parts within parts count in all of them alike.
        .groupBy("conv_id", "turn", "passage", "level", "author").agg(F.sum("words").alias("words"))
    )
    by_author = cited.groupBy("conv_id", "turn", "level", "author").agg(F.sum("words").alias("words"))
    answered = by_author.groupBy("conv_id", "turn").agg(
        F.max_by("author", F.struct(-F.col("level"), F.col("words"), F.col("author"))).alias("author")
    )
    passages = cited.select("conv_id", "turn", "passage").distinct().groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"))
    keys = found.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    before = keys.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("before"))
    parents = keep(
        keys.join(answered, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left").join(passages, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", F.coalesce("author", "before").alias("reply_to"), F.col("author").isNotNull().alias("quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    )
    place = _threads(parents)
    return found.drop("units").join(place, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body", "n_quotes", "n_levels", F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "reply_to", F.coalesce("quoted", F.lit(False)).alias("quoted"), "thread", "depth",
    )


def _threads(parents: DataFrame) -> DataFrame:
    """Root and depth of every message, by doubling the way up: as many joins as the logarithm of the longest chain."""
    now = parents.withColumn("thread", F.coalesce("reply_to", "turn")).withColumn("depth", F.when(F.col("reply_to").isNull(), 0).otherwise(1))
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        step = keep(
            now.join(up, ["conv_id", "thread"], "left").select(
                *parents.columns, F.col("thread").alias("was"), F.coalesce("next", "thread").alias("thread"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).cast("int").alias("depth"),
            )
        )
        now = step.drop("was")
        if step.where("thread <> was").isEmpty():
            return now


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
