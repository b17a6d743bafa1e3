"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

A document is the set of its five-word shingles; two are linked when their
intersection is at least 0.8 of their union. The overlap of all pairs is the
product of the incidence matrix with its transpose; this computes the part of
it that can matter:

1. Columns get a global order: shingles of many documents last, else by hash.
2. Of each row only the leading columns enter, as many as its size demands: a
   row of ``n`` shingles must share one of its first ``n - ceil(0.8 n) + 1``
   columns with any partner. The order changes how much work is done, never the
   result, so it may come from a fixed-size bit set.
3. Columns are dealt out in blocks; a block drops columns with one document.
4. The remaining product is summed per pair, and pairs whose counts cannot
   reach the overlap their sizes ask for are discarded.
5. What is left is decided by the overlap of the whole rows.

Groups of copies would still give all pairs. So the product is first taken with
one row of each column only (a star), what links is merged, and the full product
is taken between rows of different components alone. That finds every
component, since any two linked documents that are not yet merged still meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm.common import WS_PATTERN, bitmap, gram_hashes, in_bitmap, join_each, keep, mix64, partitions, word_hashes
from wattframe.llm.components import components
from wattframe.llm.tokens import forget

N = 5
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Columns of more rows than this come last in the order.
COMMON = 40
BITS = 24
#: A common column is dealt to this many blocks.
SALT = 8
#: Shingles that a worker counts before it hands them on: eight bytes each, and a few copies of them.
HELD_SHINGLES = 1_500_000
#: Entries of the incidence that a worker holds before it hands them on: 28 bytes each, and a copy.
HELD_ENTRIES = 200_000
STARS = 4


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the shingle set; fewer words than five make one shingle, no words none."""
    words = word_hashes(text or "")
    if 0 < len(words) < N:
        return mix64(gram_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(gram_hashes(words, N))


def node_of(grams: np.ndarray) -> int:
    """64-bit name of a shingle set; documents of one set are one row of the matrix."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).view(np.int64)) if len(grams) else 0


def leading(n: int | np.ndarray):
    """How many leading columns of a row of ``n`` shingles can decide."""
    return n - (n * PERCENT + 99) // 100 + 1


def witnessed(n: int) -> int:
    """How many first columns of a row of ``n`` shingles may be among the leading columns of a row that it links with.

    A leading column of a row of ``s`` has at most ``s - ceil(0.8 s)`` before it
    there, and a linked row of ``n`` at most ``n - 0.8 / 1.8 (s + n)`` more; ``s``
    is ``0.8 n`` at least.
    """
    return n * (10_000 - PERCENT * PERCENT) // 10_000 + 1


def _columns(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(c).to_numpy(zero_copy_only=False) for c in names]


def _common(docs: DataFrame) -> np.ndarray:
    """Bit set of the columns that occur in more than ``COMMON`` rows, counted over all documents.

    Each task sends the distinct shingles of its rows as packed blocks of four
    bytes a shingle, one block for each range of hashes.
    """
    n = partitions(docs.sparkSession)
    bits = min(16, (n - 1).bit_length() + 3)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            grams, count = np.unique(np.concatenate(held), return_counts=True)
            edges = np.searchsorted(grams, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            edges = np.append(edges, len(grams))
            code = (grams >> np.uint64(32 - bits)).astype(np.uint32)
            made: list[tuple[bytes, bytes, bytes]] = []
            for r in range(1 << bits):
                part = slice(edges[r], edges[r + 1])
                again = np.flatnonzero(count[part] > 1)
                more = (count[part][again] - 1).astype(np.uint32)
                made.append((code[part].tobytes(), code[part][again].tobytes(), more.tobytes()))
                if len(made) == 64 or r + 1 == 1 << bits:
                    packed = [pa.array(x, pa.binary()) for x in zip(*made, strict=True)]
                    block = pa.array(range(r + 1 - len(made), r + 1), pa.int32())
                    yield pa.record_batch([block, *packed], ["block", "codes", "again", "more"])
                    made = []

        for b in batches:
            for text in b.column("text").to_pylist():
                grams = shingles(text)
                if len(grams) and (node := node_of(grams)) not in seen:
                    seen.add(node)
                    held.append(grams)
                    size += len(grams)
                    if size > HELD_SHINGLES:
                        yield from out()
                        held, size = [], 0
        if held:
            yield from out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for b in batches:
            for r, *packed in zip(*[b.column(c).to_pylist() for c in ("block", "codes", "again", "more")], strict=True):
                held.setdefault(r, []).append(tuple(np.frombuffer(x, np.uint32) for x in packed))
        for r in list(held):
            parts = held.pop(r)
            code, times = np.unique(np.concatenate([p[0] for p in parts]), return_counts=True)
            for _, again, more in parts:
                np.add.at(times, np.searchsorted(code, again), more.astype(np.int64))
            many = code[times > COMMON].astype(np.uint64)
            top = (np.uint64(r) << np.uint64(64 - bits)) | (many << np.uint64(32 - bits))
            yield pa.record_batch([pa.array(top.view(np.int64))], ["gram"])

    counted = (
        docs.select("text").mapInArrow(blocks, "block int, codes binary, again binary, more binary")
        .repartition(n, "block").mapInArrow(count, "gram long")
    )
    return bitmap(counted, "gram", BITS)


def _incidence(docs: DataFrame) -> DataFrame:
    """Leading columns that another row may share (gram, node, size), and one row per document (gram null)."""
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(_common(docs))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            own: list[tuple[int, int]] = []
            held: list[tuple[np.ndarray, int, int, np.ndarray]] = []
            size = 0

            def out(held: list) -> pa.RecordBatch:
                wide = [len(x[0]) for x in held]
                g = np.concatenate([x[0] for x in held]).view(np.int64)
                node, of = (np.repeat(np.array([x[i] for x in held], t), wide) for i, t in ((1, np.int64), (2, np.int32)))
                salt = np.concatenate([x[3] for x in held]).astype(np.int32)
                return pa.record_batch(
                    [pa.array(g), pa.array(node), pa.array(of), pa.array(salt), pa.nulls(len(g), pa.int64())],
                    ["gram", "node", "size", "salt", "doc_id"],
                )

            for text in b.column("text"):
                g = shingles(text.as_py())
                node = node_of(g)
                own.append((node, len(g)))
                if not len(g) or node in seen:
                    continue
                seen.add(node)
                hot = in_bitmap(common.value, g, BITS)
                p, cold = leading(len(g)), int((~hot).sum())
                # Beyond the leading columns: that a column is here, too (salt -1); common ones are kept without.
                w = max(p, min(witnessed(len(g)), cold))
                at = np.arange(w)
                salt = np.where(at >= p, -1, np.where(at < cold, 0, 1 + node % SALT)).astype(np.int8)
                held.append((np.concatenate([g[~hot], g[hot]])[:w], node, len(g), salt))
                size += w
                if size > HELD_ENTRIES:
                    yield out(held)
                    held, size = [], 0
            if held:
                yield out(held)
            n = len(own)
            yield pa.record_batch(
                [pa.nulls(n, pa.int64()), pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.int32()),
                 pa.nulls(n, pa.int32()), b.column("doc_id")],
                ["gram", "node", "size", "salt", "doc_id"],
            )

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            own = b.filter(pc.is_null(b.column("gram")))
            if own.num_rows:
                yield own.select(["gram", "node", "size", "doc_id"])
            rest = b.filter(pc.is_valid(b.column("gram")))
            held.append(_columns(rest, "gram", "node", "size", "salt"))
        gram, node, size, salt = (np.concatenate(x) for x in zip(*held, strict=True)) if held else [np.empty(0, np.int64)] * 4
        order = np.lexsort((node, gram))
        gram, node, size, salt = gram[order], node[order], size[order], salt[order]
        same = np.diff(gram) == 0
        fresh = np.concatenate([[True], ~(same & (np.diff(node) == 0))]) if len(gram) else np.empty(0, bool)
        gram, node, size, salt = gram[fresh], node[fresh], size[fresh], salt[fresh]
        same = np.diff(gram) == 0
        # A salted column may have its other rows elsewhere.
        kept = ((np.append(same, False) | np.insert(same, 0, False) | (salt > 0)) & (salt >= 0)) if len(gram) else fresh
        for i in range(0, int(kept.sum()), 50_000):
            at = np.flatnonzero(kept)[i : i + 50_000]
            yield pa.record_batch(
                [pa.array(gram[at].astype(np.int64)), pa.array(node[at].astype(np.int64)), pa.array(size[at].astype(np.int32)), pa.nulls(len(at), pa.int64())],
                ["gram", "node", "size", "doc_id"],
            )

    dealt = docs.mapInArrow(rows, "gram long, node long, size int, salt int, doc_id long").repartition(
        partitions(spark), F.coalesce("gram", F.xxhash64("doc_id", "node")), F.greatest("salt", F.lit(0))
    )
    return keep(dealt.mapInArrow(shared, "gram long, node long, size int, doc_id long"))


def _bounded(columns: DataFrame) -> DataFrame:
    """Rows of leading columns with ``live``, the most that a row can share, and ``band``, its size class.

    A leading column that no other row has among its ``witnessed`` ones is lost
    for every overlap that counts. A pair
    needs 0.8 / 1.8 of both sizes together, so at least one of its rows has
    ``live`` of 8/9 of its own size: these rows are ``good``. Sizes of a pair
    differ by a quarter at most, so its bands are equal or next to each other.
    """
    kept = columns.groupBy("node").agg(F.count("*").alias("kept"))
    first = f"(size - (size * {PERCENT} + 99) div 100 + 1)"
    return keep(
        columns.join(kept, "node")
        .withColumn("live", F.expr(f"cast(size - ({first} - kept) as int)"))
        .select(
            "gram", "node", "size", "live", F.expr(f"live * {100 + PERCENT} >= size * {2 * PERCENT}").alias("good"),
            F.floor(F.log(100 / PERCENT, F.col("size")) + 1e-9).cast("int").alias("band"),
        )
    )


def _may_link(slack: float) -> str:
    """Size bounds in SQL over a pair's sizes ``x``, ``y`` and the columns ``c`` they share."""
    rest = "((z * {p} + 99) div 100 - 1)".format(p=PERCENT)
    most = f"greatest({rest.replace('z', 'x')}, {rest.replace('z', 'y')})"
    need = f"ceil((x + y) * {PERCENT} / {100 + PERCENT})"
    return f"c >= {slack} * ({need} - {most})"


#: What a pair of rows ``a``, ``b`` in one column must fulfil; ``a`` is good and of b's band or the one below or above.
PAIR = (
    f"a.label <> b.label and least(a.size, b.size) * 100 >= greatest(a.size, b.size) * {PERCENT} "
    f"and least(a.live, b.live) * {100 + PERCENT} >= (a.size + b.size) * {PERCENT} and (not b.good or a.node < b.node)"
)


def _linked(docs: DataFrame, own: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole rows overlap enough."""
    spark = docs.sparkSession
    pairs = keep(pairs.select("a", "b"))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # One document of each node serves; a bit set finds it in the scan.
    chosen = own.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"))
    wanted = spark.sparkContext.broadcast(bitmap(chosen, "key", BITS))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            at = np.flatnonzero(in_bitmap(wanted.value, _columns(b, "key")[0].view(np.uint64), BITS))
            out = []
            for text in b.column("text").take(pa.array(at)).to_pylist():
                g = shingles(text)
                if len(g) and (node := node_of(g)) not in seen:
                    seen.add(node)
                    out.append((node, g.tobytes()))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["node", "grams"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = _columns(b, "a", "b")
            good = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                n = int((both[1:] == both[:-1]).sum())
                good.append(100 * n >= PERCENT * (len(x) + len(y) - n))
            good = np.array(good, bool)
            yield pa.record_batch([pa.array(a[good]), pa.array(c[good])], ["u", "v"])

    rows = docs.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(sets, "node long, grams binary")
    return (
        pairs.join(rows.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
        .join(rows.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
        .mapInArrow(decide, "u long, v long")
    )


def joined(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (smallest linked id) of each row.

    Null and empty texts have no shingles and are linked with nothing. A row
    with a null id takes part and gets its component's smallest id, null if
    there is none. Repeated rows each get a row. Empty tables give no rows.
    Other columns are not read. Sets are told apart by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _incidence(docs)
    own = found.where("gram is null").select("doc_id", "node", "size").withColumn("key", F.xxhash64("doc_id"))
    columns = found.where("gram is not null").select("gram", "node", "size")
    labels = _merge(docs, own, columns)
    least = keep(
        own.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
        .join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    )
    sets, rows = least.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    groups = least.groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("n"))
    # A component may hold a third of all sets, and a set a third of all documents.
    named = keep(join_each(least.select("node", "copies", "label"), groups, "label", "n", sets).drop("label"))
    out = join_each(own.where("size > 0").select("doc_id", "node", "size"), named, "node", "copies", rows)
    alone = own.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return out.drop("node").unionByName(alone).select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id")


def _merge(docs: DataFrame, own: DataFrame, columns: DataFrame) -> DataFrame:
    """Component label of every node that has a link."""
    rows = _bounded(columns)
    alone = rows.withColumn("label", F.col("node"))
    edges = keep(_linked(docs, own, _star(_near(alone), 0).where(_may_link(0.5))))
    labels = keep(components(edges))
    before = float("inf")
    for step in range(1, STARS + 1):
        now = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        near = _near(now)
        # Only columns in which a good row, its own or a copy from the next band, still meets a row of another component.
        mixed = near.groupBy("gram", "at").agg(
            F.min("label").alias("p"), F.max("label").alias("q"), F.max("good").alias("g"), F.max("mine").alias("m")
        )
        near = keep(near.join(mixed.where("p <> q and g and m").select("gram", "at"), ["gram", "at"], "left_semi"))
        by_label = near.groupBy("gram", "at", "label").agg(F.count_if(F.col("good")).alias("g"), F.count_if("mine").alias("m"))
        groups = by_label.groupBy("gram", "at").agg((F.sum("g") * F.sum("m") - F.sum(F.col("g") * F.col("m"))).alias("meets"), F.sum("m").alias("m"))
        meets, n = groups.agg(F.sum("meets"), F.sum("m")).first()
        if not meets:
            break
        # A star pays as long as the last one halved the rows that still meet.
        full = step == STARS or meets <= 4 * n or 2 * meets > before
        before = meets
        pairs = (_product(near) if full else _star(near, step)).where(_may_link(1.0 if full else 0.5))
        edges = edges.union(keep(_linked(docs, own, pairs)))
        labels = keep(components(edges))
        if full:
            break
    return labels


def _near(rows: DataFrame) -> DataFrame:
    """Rows at their own band (``mine``), good ones at the bands next to it, too."""
    at = F.when(F.col("good"), F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).otherwise(F.array("band"))
    return rows.withColumn("at", F.explode(at)).withColumn("mine", F.col("at") == F.col("band"))


def _counted(pairs: DataFrame) -> DataFrame:
    """Columns that the rows of each pair share."""
    return (
        pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.size").alias("x"), F.col("b.size").alias("y"))
        .groupBy("a", "b").agg(F.count("*").alias("c"), F.first("x").alias("x"), F.first("y").alias("y"))
    )


def _star(near: DataFrame, step: int) -> DataFrame:
    """The product with one good row of each column and band.

    It is the one that shares most of its leading columns, as the text does that
    others were copied from; ties fall in this step's random order.
    """
    order = F.struct((F.col("size") - F.col("live")).alias("lost"), F.xxhash64("node", F.lit(step)), "node", "size", "live", "label")
    lead = near.where("good").groupBy("gram", "at").agg(F.min(order).alias("a"))
    pair = PAIR.replace(" and (not b.good or a.node < b.node)", "")
    return _counted(lead.join(near.where("mine").alias("b"), ["gram", "at"]).where(pair).select("a", F.struct("b.*").alias("b")))


def _product(near: DataFrame) -> DataFrame:
    """The whole product between rows of different components, as far as sizes let a pair link."""
    a, b = near.where("good").alias("a"), near.where("mine").alias("b")
    return _counted(a.join(b, F.expr(f"a.gram = b.gram and a.at = b.at and {PAIR}")).select(F.struct("a.*").alias("a"), F.struct("b.*").alias("b")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows that stay when each component keeps the document of its smallest id; all columns as they were.

    Documents without words are no duplicates of each other and stay, and so do
    rows with a null id. Repeated rows of one id and text are one document. An
    id with several texts goes when any of them is linked to a smaller id.
    """
    found = keep(joined(docs))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = keep(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return rest
    once = rest.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return rest.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows by joining all shingles and following links; fit for small tables only.
SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, [x FOR x IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WS_PATTERN}') IF x <> ''] AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT k, array_to_string(ws[i:i + {N - 1}], ' ') AS g
    FROM (SELECT k, ws, unnest(range(1, len(ws) - {N - 2})) AS i FROM d WHERE len(ws) >= {N})
  UNION ALL SELECT k, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND {N - 1}),
n AS MATERIALIZED (SELECT k, count(*) AS n FROM s GROUP BY k),
o AS MATERIALIZED (SELECT a.k AS x, b.k AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM o JOIN n p ON p.k = x JOIN n q ON q.k = y WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
r(k, m) AS (SELECT k, k FROM d UNION SELECT r.k, e.y FROM r JOIN e ON e.x = r.m)
SELECT d.doc_id, any_value(coalesce(n.n, 0)) AS n_shingles, min(f.doc_id) AS component_id
FROM r JOIN d USING (k) JOIN d f ON f.k = r.m LEFT JOIN n ON n.k = d.k GROUP BY d.k, d.doc_id"""
