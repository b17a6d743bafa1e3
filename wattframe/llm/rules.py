"""Quality rules: one table of thresholds, compiled into one projection without user functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm.common import WS, let, word_array

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Function words of the languages served; a text in one of them has many.
STOP_WORDS = (
    "the of and to in is that for it was with as on be at by this are an not from or "
    "de la el que en y los se del las un por con no una su para es al "
    "le les des et une dans du qui sur au pas pour est il elle ce ne "
    "der die das und den von zu mit sich auf ist im dem nicht ein eine"
).split()


class Rule(NamedTuple):
    """Keep a text while ``low <= part / per <= high`` (``per`` None: the count itself)."""

    name: str
    part: str
    per: str | None
    low: float | None
    high: float | None


#: Ratios to the number of words or of non-empty lines.
RULES = (
    Rule("length", "n_words", None, 10, None),
    Rule("word_length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.25),
    Rule("exclamations", "n_marks", "n_words", None, 0.25),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
)
#: Where the struct of ``measures`` has each count.
PLACE = {
    **{c: f"w.{c}" for c in ("n_words", "n_repeat_words", "n_stop_words")},
    **{c: f"l.{c}" for c in ("n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines")},
    **{c: c for c in ("word_chars", "n_symbols", "n_marks")},
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OTHER = ("n_marks", "n_stop_words", "n_lines", "n_ellipsis_lines", "n_bullet_lines")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(words: Column) -> Column:
    """Words covered by a window of five words that occurs twice or more."""

    def repeated(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        starts = let(
            pairs,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda e, k: (e["g"] == F.coalesce(F.get(s, k - 1)["g"], F.lit("")))
                        | (e["g"] == F.coalesce(F.get(s, k + 1)["g"], F.lit(""))),
                    ),
                    lambda e: e["i"],
                )
            ),
        )
        covered = let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get(p, k + 1) - x), F.lit(WINDOW))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered)

    grams = F.transform(
        F.slice(words, 1, F.size(words) - (WINDOW - 1)),
        lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, WINDOW)]),
    )
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(grams, repeated))


def measures(text: Column) -> Column:
    """A struct of all counts of a text; a null text counts as an empty one."""
    whole = F.coalesce(text, F.lit(""))
    plain = lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(_without(x, WS)) > 0)
    by_words = let(
        word_array(text),
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: plain(x).isin(*STOP_WORDS))).alias("n_stop_words"),
        ),
    )
    by_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: F.rtrim(y).endswith("...") | F.rtrim(y).endswith("…"))).alias(
                "n_ellipsis_lines"
            ),
            F.size(F.filter(x, lambda y: F.ltrim(y).substr(1, 1).isin("-", "*", "•", "·"))).alias("n_bullet_lines"),
        ),
    )
    return F.struct(
        by_words.alias("w"),
        by_lines.alias("l"),
        F.length(_without(whole, WS)).alias("word_chars"),
        (F.length(whole) - F.length(_without(whole, SYMBOLS))).alias("n_symbols"),
        (F.length(whole) - F.length(_without(whole, "!"))).alias("n_marks"),
    )


def _failed(at: Callable[[str], Column]) -> Column:
    return (at("n_words") < 10) | (100 * at("n_repeat_words") > 20 * at("n_words"))


def verdict(rules: Sequence[Rule], at: Callable[[str], Column]) -> Column:
    """The rule table as one boolean expression; ``at`` gives the column of a count. A ratio to zero fails."""
    out = ~_failed(at)
    for r in rules:
        value = at(r.part) if r.per is None else at(r.part) / F.nullif(at(r.per), F.lit(0))
        for limit, test in ((r.low, value.__ge__), (r.high, value.__le__)):
            if limit is not None:
                out = out & test(F.lit(limit))
    return F.coalesce(out, F.lit(False))


def judged(docs: DataFrame, text: str = "text", id: str = "doc_id", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per input row: id, the counts, ``base_failed`` and ``kept``.

    The rows need no order, no key and no shuffle. A null or empty text has no
    words and fails. A null id is passed through; repeated rows are judged one
    by one; an empty table gives no rows. Other columns are not read, so their
    names cannot clash. Copies and skewed sources change nothing: a row is
    judged alone, and a very long text costs ``n log n`` of its own words.
    """
    m = docs.select(F.col(id).alias("doc_id"), measures(F.col(text)).alias("m"))
    counts = m.select("doc_id", *[F.col(f"m.{p}").cast("long").alias(c) for c, p in PLACE.items()])
    return counts.select(
        "doc_id", *COUNTS, _failed(F.col).alias("base_failed"), verdict(rules, F.col).alias("kept"), *OTHER
    )


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that pass, with all their columns; judged in the scan, without a join."""

    def good(m: Column) -> Column:
        def at(count: str) -> Column:
            out = m
            for field in PLACE[count].split("."):
                out = out[field]
            return out

        return verdict(rules, at)

    # One expression binds the measures, so that the filter does not work them out for each rule.
    return docs.where(let(measures(F.col(text)), good))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The same rows in SQL, by unnesting words and lines."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    value = {r: r.part if r.per is None else f"{r.part} / nullif({r.per}, 0)" for r in RULES}
    tests = [f"{v} >= {r.low}" for r, v in value.items() if r.low is not None]
    rule = " AND ".join(tests + [f"{v} <= {r.high}" for r, v in value.items() if r.high is not None])
    ws = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, [x FOR x IN regexp_split_to_array(text, '{ws}+') IF x <> ''] AS ws FROM d),
u AS (SELECT k, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT k, i, word,
        CASE WHEN lead(word, 4) OVER o IS NULL THEN NULL
        ELSE concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o)
        END AS gram FROM u WINDOW o AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY k, gram) > 1 AS rep FROM g),
c AS (SELECT k, i, max(rep) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS cov FROM r),
nr AS (SELECT k, count(*) FILTER (cov) AS n_repeat_words FROM c GROUP BY k),
st AS (SELECT k, count(*) FILTER (lower(rtrim(word, '.,;:!?')) IN ({stop})) AS n_stop_words FROM u GROUP BY k),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
        count(*) FILTER (rtrim(line, ' ') LIKE '%...' OR rtrim(line, ' ') LIKE '%…') AS n_ellipsis_lines,
        count(*) FILTER (substr(ltrim(line, ' '), 1, 1) IN ('-', '*', '•', '·')) AS n_bullet_lines
      FROM l WHERE regexp_replace(line, '{ws}+', '', 'g') <> '' GROUP BY k),
a AS (SELECT d.k, d.doc_id, len(ws) AS n_words,
        CAST(length(regexp_replace(text, '{ws}+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        CAST(length(text) - length(translate(text, '!', '')) AS BIGINT) AS n_marks,
        coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_lines, 0) AS n_lines,
        coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines, coalesce(n_bullet_lines, 0) AS n_bullet_lines
      FROM d JOIN w USING (k) LEFT JOIN nr USING (k) LEFT JOIN st USING (k) LEFT JOIN ln USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({rule}, false) AS kept,
  n_marks, n_stop_words, n_lines, n_ellipsis_lines, n_bullet_lines FROM b"""


SQL = _sql()
