"""Token counts and ids by a public tokenizer, each distinct piece of text encoded once per worker.

A tokenizer that first cuts a text into pieces (words, runs of white space) and
then encodes each piece by itself gives the same ids for a piece wherever it
stands. So the library encodes the pieces a worker has not met yet, in batches,
and a bounded memo answers for the rest.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm.common import LOWER

#: Pieces held by a worker; about 200 bytes each.
MEMO = 1_400_000
#: Bytes of text per batch handed to the library.
BATCH_BYTES = 4 << 20

_loaded: dict[str, object] = {}


def tokenizer(name: str):
    """The tokenizer file ``name``, loaded once per worker; threads off, since Spark already fills the cores."""
    if name not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = name if os.path.isabs(name) else public_tokenizers.path(name)
        _loaded[name] = Tokenizer.from_file(path)
    return _loaded[name]


class Memo(dict):
    """Piece to value; ``learn`` encodes what is missing and forgets everything once too large."""

    def __init__(self, encode: Callable[[list], list], most: int = MEMO):
        super().__init__()
        self.encode, self.most = encode, most

    def learn(self, pieces: set) -> None:
        missing = [p for p in pieces if p not in self]
        if len(self) + len(missing) > self.most:
            self.clear()
            missing = list(pieces)
        for i in range(0, len(missing), 20_000):
            part = missing[i : i + 20_000]
            self.update(zip(part, self.encode(part), strict=True))


class WordMemo(Memo):
    """A memo that encodes a missing word when it is asked for, so that no text is looked up twice."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = self.encode([word])[0]
        return out


_memos: dict[tuple[str, str], Memo] = {}


def forget() -> None:
    """Empty this worker's memos: workers are reused, and other operators need the memory."""
    for memo in _memos.values():
        memo.clear()


def by_bytes(sizes: list[int], most: int = BATCH_BYTES) -> Iterator[slice]:
    """Consecutive slices of about equal bytes; one larger item makes a slice of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


# Byte-level tokenizers: pieces carry the space before them.

#: The tokenizer's own outer cut for texts whose only white space is space and line feed.
PIECE = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
#: Other white space and control characters: such a text goes to the library as it is.
ODD = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Before a single space between letters or digits no piece can reach across.
SAFE = re.compile(r"(?<=[a-zA-Z0-9])(?= [a-zA-Z0-9])")


def split_safely(text: str, most: int = BATCH_BYTES // 4) -> list[str]:
    """Cut a long text before spaces between letters, about every ``most`` characters; never elsewhere."""
    out, start = [], 0
    while len(text) - start > most:
        at = SAFE.search(text, start + most)
        if at is None:
            break
        out.append(text[start : at.start()])
        start = at.start()
    out.append(text[start:])
    return out


def counter(name: str) -> Callable[[list[str]], list[int]]:
    """Token counts of texts by the byte-level tokenizer ``name``."""
    tok = tokenizer(name)
    specials = [t.content for t in tok.get_added_tokens_decoder().values()]

    def lengths(texts: list[str]) -> list[int]:
        return [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    memo = _memos.setdefault(("n", name), Memo(lengths))

    def plain(text: str) -> int:
        return sum(lengths(split_safely(text)))

    def count(texts: list[str]) -> list[int]:
        out: list[int] = [0] * len(texts)
        for part in by_bytes([len(t) for t in texts]):
            usual: list[tuple[int, str]] = []
            for i in range(part.start, part.stop):
                if ODD.search(texts[i]) or any(s in texts[i] for s in specials):
                    out[i] = plain(texts[i])
                else:
                    usual += [(i, s) for s in split_safely(texts[i])]
            for some in by_bytes([len(s) for _, s in usual]):
                cut = [(i, PIECE.findall(s)) for i, s in usual[some]]
                memo.learn(set().union(*[p for _, p in cut]))
                for i, pieces in cut:
                    out[i] += sum(map(memo.__getitem__, pieces))
        return out

    return count


def counts(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 1024, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of each row; only lengths leave the workers.

    A null text counts as empty (no tokens). Ids are passed through, null or
    repeated; an empty table gives no rows; other columns are not read. Rows are
    counted where they are scanned: no shuffle, so hot sources and copies do not
    matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name)
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), pa.array(count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text")
    )
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Word tokenizers: white space is dropped, so words are the pieces.

#: Words that the outer steps (normal form, lower case, cut at letters) leave whole and as they are,
#: and the same with one mark after them, which is always a piece of its own.
LETTERS = re.compile("([a-z\xdf-\xf6\xf8-\xff]+)([.,;:!?]?)")
_visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The byte-level alphabet: visible bytes stand for themselves, the others for code points from 256 on.
ALPHABET = {b: chr(b) for b in _visible} | {
    b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _visible)
}


def word_encoder(name: str) -> Callable[[str], bytes]:
    """Text to its ids as packed little-endian 32-bit integers, by the word tokenizer ``name``.

    The library's model is asked directly for plain lower-case words; all other
    words go through the whole tokenizer.
    """
    tok = tokenizer(name)
    merge = tok.model.tokenize
    table = {i: ALPHABET[i] for i in range(256)}
    marks = {m: array("I", [t.id for t in merge(m)]).tobytes() for m in ".,;:!?"}
    marks[""] = b""

    def encode(words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        others = []
        for i, w in enumerate(words):
            text = w.decode()
            if m := LETTERS.fullmatch(text):
                letters = m[1] if text.isascii() else m[1].encode().decode("latin-1").translate(table)
                out[i] = array("I", [t.id for t in merge(letters)]).tobytes() + marks[m[2]]
            else:
                others.append(i)
        for i in others:
            out[i] = array("I", tok.encode(words[i].decode(), add_special_tokens=False).ids).tobytes()
        return out

    memo = _memos.setdefault(("ids", name), WordMemo(encode))

    def ids(text: str) -> bytes:
        data = text.encode()
        # The tokenizer lower-cases, too, but only outside its special tokens.
        words = data.split() if b"<|" in data else data.translate(LOWER).split()
        return b"".join(map(memo.__getitem__, words))

    return ids
