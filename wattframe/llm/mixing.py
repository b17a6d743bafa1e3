"""Mixing sources to target weights: iterative proportional fitting over (source, language, topic).

Tokens are raked until a sweep moves next to nothing. No document can be taken
more than once, so a reference factor stands for probability one. It is the
least that leaves at most ``SPARE`` percent of all tokens in cells of larger
factors: those cells are kept whole, the others are raked again to what the
targets leave. A stray cell so costs its own size, not a share of all others.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattframe.llm.common import drop, keep, word_array

MARGINS = ("source", "lang", "topic")
#: Default targets: each value's present share to this power, made to add up to one.
TEMPER = 0.9
#: Raking ends when a sweep moves less than this share of all tokens, and fails if that takes more sweeps.
TOLERANCE = 1e-11
MOST_SWEEPS = 300
#: Percent of all tokens that may lie in cells kept whole though their share would ask for more.
SPARE = 1
#: The reference factor is a power of this: the sums that find it are few, however many cells there are.
GRID = 1.001
#: Cells that may be broadcast; a row takes about 100 bytes. More are joined by shuffle.
SMALL_CELLS = 50_000
#: Kinds of text told apart by what they contain, the first that fits; all else is prose.
TOPICS = (
    ("legal", ("license", "copyright")),
    ("contact", ("@",)),
    ("setting", (' = "',)),
    ("table", (" | ",)),
)


def topic_of(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("prose")
    for name, marks in reversed(TOPICS):
        found = F.lit(False)
        for m in marks:
            found = found | low.contains(m)
        out = F.when(found, F.lit(name)).otherwise(out)
    return out


def with_cells(docs: DataFrame) -> DataFrame:
    """Each row's id, margins (null: empty string) and tokens, as a struct beside all its columns."""
    margins = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("source", "lang")]
    n = F.size(word_array(F.col("text"))).cast("long")
    return docs.select(
        F.struct(*docs.columns).alias("row"),
        *margins, topic_of(F.col("text")).alias("topic"), n.alias("n_tokens"),
    )


def factors(cells: DataFrame, targets: Mapping[str, DataFrame], most_sweeps: int = MOST_SWEEPS) -> DataFrame:
    """Rake the tokens of ``cells`` to the targets and give each cell's ``factor``.

    ``cells`` has one row per combination, with ``tokens``; a target has one row
    per value of its margin, with ``share`` (adding up to one over the values
    that occur). Each sweep scales the cells so that one margin after the other
    fits, until the weights settle; targets that contradict each other settle,
    too, with the last margin fitted (see ``misfit``). Weights that do not
    settle in ``most_sweeps`` are an error. Values without a target, and cells
    without tokens, keep factor one.
    """
    return _raked(cells.withColumn("held", F.lit(False)).withColumn("weight", F.col("tokens").cast("double")), targets, most_sweeps)


def capped(fit: DataFrame, targets: Mapping[str, DataFrame], top: float, most_sweeps: int = MOST_SWEEPS) -> DataFrame:
    """Hold the cells of factors above ``top`` at ``top`` and rake the others to what the targets leave."""
    held = (F.col("factor") > top) & (F.col("tokens") > 0)
    start = fit.withColumn("held", held).withColumn("weight", F.col("tokens") * F.least("factor", F.lit(top)))
    return _raked(start.drop("factor"), targets, most_sweeps)


def _raked(start: DataFrame, targets: Mapping[str, DataFrame], most_sweeps: int) -> DataFrame:
    total = float(start.agg(F.sum("tokens")).first()[0] or 0)
    few = start.count() <= SMALL_CELLS
    now, before = start, None
    if few:
        for m in targets:
            now = now.join(targets[m].select(m, F.col("share").alias(f"share_{m}")), m, "left")
        now = before = keep(now)
    for _ in range(most_sweeps):
        now = now.withColumn("was", F.col("weight"))
        for m in targets:
            now = _fitted(now, m, total) if few else _fitted_by_join(now, m, targets[m], total)
        now = keep(now)  # a row per cell
        moved = now.agg(F.sum(F.abs(F.col("weight") - F.col("was")))).first()[0] or 0.0
        now = now.drop("was")
        if before is not None:
            drop(before)
        before = now
        if moved <= TOLERANCE * total:
            factor = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0)
            return now.withColumn("factor", factor).drop("weight", "held", *[f"share_{m}" for m in targets])
    raise RuntimeError(f"weights did not settle in {most_sweeps} sweeps: the last moved {moved / total:.1e} of all tokens")


def _parts() -> tuple[Column, Column]:
    """What of a cell's weight may be scaled, and what is held."""
    held, zero = F.col("held"), F.lit(0.0)
    return F.when(held, zero).otherwise(F.col("weight")), F.when(held, F.col("weight")).otherwise(zero)


def _scaled(free: Column, fixed: Column, share: Column, total: float) -> Column:
    """A cell's weight where the free ones of its margin value, ``free`` in all, fill its share beside ``fixed``."""
    scale = F.when(free > 0, F.greatest(share * total - fixed, F.lit(0.0)) / free)
    return F.when(F.col("held"), F.col("weight")).otherwise(F.col("weight") * F.coalesce(scale, F.lit(1.0)))


def _fitted(now: DataFrame, m: str, total: float) -> DataFrame:
    """One margin fitted for up to ``SMALL_CELLS`` cells, which carry their target as ``share_<margin>``.

    Sums over the cells of a value are windows: a join would broadcast a table
    for each margin of each sweep, pages of some MB each in the driver.
    """
    of = Window.partitionBy(m)
    free, fixed = (F.sum(x).over(of) for x in _parts())
    return now.withColumn("weight", _scaled(free, fixed, F.col(f"share_{m}"), total))


def _fitted_by_join(now: DataFrame, m: str, target: DataFrame, total: float) -> DataFrame:
    """The same for any number of cells: sums are combined before the shuffle, so no value's cells meet in a task."""
    free, fixed = _parts()
    sums = now.groupBy(m).agg(F.sum(free).alias("free"), F.sum(fixed).alias("fixed")).join(target.select(m, "share"), m)
    weight = _scaled(F.col("free"), F.col("fixed"), F.col("share"), total)
    return now.join(sums, m, "left").withColumn("weight", weight).drop("free", "fixed", "share")


def reference(fit: DataFrame) -> float:
    """The least power of ``GRID`` that leaves at most ``SPARE`` percent of all tokens in cells of larger factors; 1 without tokens."""
    steps = (
        fit.where("tokens > 0 and factor > 0")
        .groupBy(F.ceil(F.log("factor") / F.log(F.lit(GRID))).alias("step")).agg(F.sum("tokens").alias("tokens"))
    )
    # A row per step of the grid: a few thousand for factors from 0.01 to 100.
    above = F.sum("tokens").over(Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1))
    total = fit.agg(F.sum("tokens")).first()[0]
    low = steps.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") * 100 <= F.lit(total) * SPARE).agg(F.min("step")).first()[0]
    return 1.0 if low is None else GRID**low


def misfit(fit: DataFrame, targets: Mapping[str, DataFrame]) -> float:
    """The largest share of tokens (by ``factor``) that lies at wrong values of one margin."""
    worst = 0.0
    for m in targets:
        sums = fit.groupBy(m).agg(F.sum(F.col("tokens") * F.col("factor")).alias("w"))
        total = sums.agg(F.sum("w")).first()[0] or 1.0
        off = sums.join(targets[m].select(m, "share"), m).agg(F.sum(F.abs(F.col("w") / total - F.col("share"))) / 2).first()[0]
        worst = max(worst, off or 0.0)
    return worst


def tempered(cells: DataFrame, margin: str, power: float = TEMPER) -> DataFrame:
    """Target shares of a margin: present shares flattened by ``power``."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).where(F.col("t") > 0)
    sums = sums.select(margin, F.pow("t", F.lit(power)).alias("p"))
    return sums.select(margin, (F.col("p") / F.lit(sums.agg(F.sum("p")).first()[0])).alias("share"))


def draw(id: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by the id: equal on every run and every machine."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 32)


def mixed(docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, seed: str = "mix") -> DataFrame:
    """Columns ``row`` (the input's own), ``source``, ``lang``, ``topic``, ``n_tokens``, ``factor``, ``probability``, ``sampled``.

    The probability is the cell's factor over the ``reference`` factor, at most
    one, so expected tokens have the target shares; cells above it are kept
    whole and the others raked around them once more (what then still lies
    above is cut to one, see ``misfit``). One draw per id decides; repeated ids
    are decided alike, null ids as the empty id. Null margins count as the empty
    string, null texts as no tokens. An empty table gives no rows. The table is
    first reduced to one row per cell, whatever share one source holds; only
    then is anything shuffled. Factors are joined back by broadcast up to
    ``SMALL_CELLS`` cells and by a shuffle beyond.
    """
    each = with_cells(docs)
    cells = keep(each.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    targets = targets or {m: keep(tempered(cells, m)) for m in MARGINS}
    fit = factors(cells, targets)
    top = reference(fit)
    fit = capped(fit, targets, top)
    n = fit.count()
    fit = fit.drop("tokens")
    return (
        each.join(F.broadcast(fit) if n <= SMALL_CELLS else fit, list(MARGINS))
        .withColumn("probability", F.least(F.lit(1.0), F.col("factor") / F.lit(top)))
        .withColumn("sampled", draw(F.col("row.doc_id"), seed) < F.col("probability"))
    )


def sample(docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, seed: str = "mix") -> DataFrame:
    """The sampled rows, columns as they were."""
    return mixed(docs, targets, seed).where("sampled").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(
        "row.doc_id", *MARGINS, "n_tokens", F.round("factor", 6).alias("factor"),
        F.round("probability", 6).alias("probability"), "sampled",
    )


def _sql() -> str:
    """The same in SQL, the sweeps written out."""
    from wattframe.llm.common import WS_PATTERN

    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(text), '{m}')" for m in marks) + f" THEN '{name}'" for name, marks in TOPICS
    )
    key = ", ".join(MARGINS)
    steps = [
        rf"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
e AS (SELECT doc_id, source, lang, CASE {cases} ELSE 'prose' END AS topic,
  len([x FOR x IN regexp_split_to_array(text, '{WS_PATTERN}') IF x <> '']) AS n_tokens FROM d),
cells AS MATERIALIZED (SELECT {key}, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM e GROUP BY {key})"""
    ]
    for m in MARGINS:
        steps.append(
            f"t_{m} AS MATERIALIZED (SELECT {m}, power(sum(tokens), {TEMPER}) / sum(power(sum(tokens), {TEMPER})) OVER () AS share "
            f"FROM cells GROUP BY {m} HAVING sum(tokens) > 0)"
        )
    steps.append("w0 AS (SELECT *, tokens AS weight, false AS held FROM cells)")
    # Enough sweeps for the weights to settle on small tables.
    sweeps, k = 16, 0
    for phase in range(2):
        for _ in range(sweeps):
            for m in MARGINS:
                k += 1
                part = f"OVER (PARTITION BY c.{m})"
                steps.append(
                    f"w{k} AS MATERIALIZED (SELECT {', '.join('c.' + x for x in MARGINS)}, c.tokens, CASE WHEN c.held THEN c.weight ELSE c.weight * coalesce("
                    f"greatest(t.share * (SELECT sum(tokens) FROM cells) - sum(CASE WHEN c.held THEN c.weight ELSE 0 END) {part}, 0) "
                    f"/ nullif(sum(CASE WHEN c.held THEN 0 ELSE c.weight END) {part}, 0), 1) END AS weight, c.held FROM w{k - 1} c LEFT JOIN t_{m} t USING ({m}))"
                )
        steps.append(f"f{phase} AS MATERIALIZED (SELECT {key}, tokens, CASE WHEN tokens > 0 THEN weight / tokens ELSE 1 END AS factor FROM w{k})")
        if phase == 0:
            steps.append(
                f"g AS (SELECT ceil(ln(factor) / ln({GRID})) AS step, sum(tokens) AS tokens FROM f0 WHERE tokens > 0 AND factor > 0 GROUP BY 1),\n"
                f"top AS MATERIALIZED (SELECT coalesce(power({GRID}, min(step)), 1) AS top FROM (SELECT step, coalesce(sum(tokens) OVER "
                f"(ORDER BY step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM g) "
                f"WHERE above * 100 <= (SELECT sum(tokens) FROM cells) * {SPARE})"
            )
            k += 1
            steps.append(f"w{k} AS (SELECT {key}, tokens, tokens * least(factor, top) AS weight, factor > top AND tokens > 0 AS held FROM f0, top)")
    steps.append(f"p AS (SELECT e.*, factor, least(1.0, factor / top) AS probability FROM e JOIN f1 USING ({key}), top)")
    return "WITH " + ",\n".join(steps) + (
        f"\nSELECT doc_id, {key}, n_tokens, round(factor, 6) AS factor, round(probability, 6) AS probability, "
        "CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < probability AS sampled FROM p"
    )


SQL = _sql()
