"""Personal data: patterns, and a skip-chain conditional random field that carries their labels through a document.

Nodes are the patterns' matches, runs of digits that write a matched number
again, and the other tokens with a digit or an at sign. Neighbouring nodes share
a chain potential; distant nodes with the same digits, or the same letters and
digits, share a skip potential. Matches are fixed, and a free node is linked to
the nearest match of its key; loopy message passing decides the free nodes, so a
number that is recognised once is found again, as a whole, where it is written
without its plus sign or country code or with other separators. A document
without any match is a field of free nodes, whose repeats share what their
shapes and neighbours say.
Potentials are learned by pseudo-likelihood from what the patterns find.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm.common import keep
from wattframe.llm.tokens import by_bytes

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Digits are taken possessively from the start of a run: the same matches, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
WORD = re.compile(r"\S+")
GROUP = re.compile(r"[0-9]++")
#: What may stand between the groups of digits of one number.
BETWEEN = re.compile(r"(?:[^\w@]|_){1,3}")
DIGITS = re.compile(r"[^0-9]+")
PLAIN = re.compile(r"[^a-z0-9]+")

#: Documents that the potentials are learned from at most (those first by a hash of their id), and tokens.
MOST_DOCS = 5_000
MOST_TOKENS = 100_000
FEATURES = 1 << 14
COLUMNS = 10
STEPS = 80
#: Messages of a document have settled when none moves by more than this; they are damped more after each 100 sweeps.
SETTLED = 1e-4
MOST_SWEEPS = 2_000
#: Weight of a skip edge before anything is learned: repeated tokens rather have one label.
SKIP = 3.0
#: A token with a skip edge gets a label when its belief is at least this.
BELIEF = 0.7


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(DIGITS.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def names_of(kind: int, raw: str) -> set[str]:
    """What a match is found again by: its digits, a phone number's also without a country code of up to three digits.

    The groups of an address are part of it and stay apart.
    """
    groups = GROUP.findall(raw)
    digits = "".join(groups)
    if KINDS[kind] == "email":
        return set()
    if KINDS[kind] == "ip":
        return {".".join(x.lstrip("0") or "0" for x in groups)}
    bare = [digits[c:] for c in (1, 2, 3) if len(digits) - c >= 7] if KINDS[kind] == "phone" else []
    return {digits, *bare, *("0" + x for x in bare)}


def repeats(text: str, found: list[tuple[int, int, int]], names: dict[str, str]) -> list[tuple[int, int, str]]:
    """(start, end, name) of the longest runs of digit groups outside the matches that have one of ``names``, from the left."""
    most = max((len(x) for x in names), default=0)
    groups, k, reach = [], 0, 0
    for m in GROUP.finditer(text) if most else ():
        while k < len(found) and found[k][0] < m.end():
            reach, k = max(reach, found[k][2]), k + 1
        groups.append((m.start(), m.end(), m.start() < reach))
    out, i = [], 0
    while i < len(groups):
        digits, parts, best = 0, [], None
        for j in range(i, len(groups)):
            s, e, taken = groups[j]
            digits += e - s
            if taken or digits > most or (j > i and not BETWEEN.fullmatch(text, groups[j - 1][1], s)):
                break
            parts.append(text[s:e])
            name = "".join(parts) if len(parts) != 4 else ".".join(x.lstrip("0") or "0" for x in parts)
            name = name if name in names else "".join(parts)
            if name in names:
                best = (j, names[name])
        if best:
            s = groups[i][0]
            while s and text[s - 1] in "(+":
                s -= 1
            out.append((s, groups[best[0]][1], best[1]))
            i = best[0]
        i += 1
    return out


class Graph:
    """Nodes and edges of many texts at once; texts share no edge. A negative end of a skip edge is a hub, -1 the first."""

    def __init__(self, texts: list[str], spans: list[list[tuple[int, int, int]]]):
        self.place: list[tuple[int, int, int]] = []  # text, start, end
        label, feats, chain, skip = [], [], [], []
        hubs = 0
        for k, (text, found) in enumerate(zip(texts, spans, strict=True)):
            known: dict[str, str] = {}
            for s, kind, e in found:
                for name in names_of(kind, text[s:e]):
                    known.setdefault(name, DIGITS.sub("", text[s:e]) if kind != 1 else name)
            nodes = [(s, e, kind + 1, {("n", known[x]) for x in names_of(kind, text[s:e])}) for s, kind, e in found]
            nodes += [(s, e, 0, {("n", name)}) for s, e, name in repeats(text, found, known)]
            nodes.sort(key=lambda x: x[:3])
            nodes = self._with_tokens(text, nodes)
            members: dict[tuple, list[int]] = {}
            before = -2
            for s, e, kind, keys in nodes:
                node, raw = len(self.place), text[s:e]
                self.place.append((k, s, e))
                label.append(kind)
                feats.append(self._features(text, raw, s, e, DIGITS.sub("", raw)))
                if before >= 0 and s - before <= 1:
                    chain.append((node - 1, node))
                before = e
                # A match may be found again by its tokens, too.
                for part in {raw, *raw.split()}:
                    digits, plain = DIGITS.sub("", part), PLAIN.sub("", part.lower())
                    keys = keys | ({("d", digits)} if len(digits) >= 6 else set()) | ({("p", plain)} if len(plain) >= 6 else set())
                for key in keys:
                    members.setdefault(key, []).append(node)
            edges: dict[tuple[int, int], None] = {}
            for group in dict.fromkeys(tuple(x) for x in members.values() if len(x) > 1):
                fixed = [x for x in group if label[x]]
                if not fixed:
                    hubs += 1
                    edges |= dict.fromkeys((x, -hubs) for x in group)
                    continue
                edges |= dict.fromkeys(zip(fixed, fixed[1:], strict=False))
                at = np.searchsorted(fixed, group)
                for x, right in zip(group, at.tolist(), strict=True):
                    if not label[x]:
                        near = [fixed[y] for y in (right - 1, right) if 0 <= y < len(fixed)]
                        edges[min(near, key=lambda y: abs(y - x)), x] = None
            skip += sorted(edges)
        self.label = np.array(label, np.int64)
        self.fixed = self.label > 0
        self.features = np.array(feats, np.int64).reshape(len(label), COLUMNS)
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array(skip, np.int64).reshape(-1, 2)

    @staticmethod
    def _with_tokens(text: str, nodes: list[tuple]) -> list[tuple]:
        """The nodes and, outside them, the tokens; adjacent tokens whose digits stand together elsewhere are one."""
        runs: list[list[tuple[int, int]]] = []
        j, reach = 0, 0
        for m in TOKEN.finditer(text):
            s, e = m.span()
            while j < len(nodes) and nodes[j][0] < e:
                reach, j = max(reach, nodes[j][1]), j + 1
            if s < reach:
                continue
            if runs and s - runs[-1][-1][1] <= 1:
                runs[-1].append((s, e))
            else:
                runs.append([(s, e)])
        whole = [DIGITS.sub("", text[r[0][0] : r[-1][1]]) for r in runs]
        times: dict[str, int] = {}
        for r, name in zip(runs, whole, strict=True):
            for x in {name, *(DIGITS.sub("", text[s:e]) for s, e in r)}:
                times[x] = times.get(x, 0) + 1
        out = list(nodes)
        for r, name in zip(runs, whole, strict=True):
            if len(r) > 1 and len(name) >= 6 and times[name] > 1 and "@" not in text[r[0][0] : r[-1][1]]:
                r = [(r[0][0], r[-1][1])]
            out += [(s, e, 0, set()) for s, e in r]
        return sorted(out, key=lambda x: x[:3])

    @staticmethod
    def _features(text: str, raw: str, s: int, e: int, digits: str) -> list[int]:
        import xxhash

        n = len(raw)
        shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W0-9_]+", "a", raw[:64]))
        before, after = text[max(0, s - 24) : s].split()[-1:], text[e : e + 24].split()[:1]
        names = [
            "bias", f"digits {min(len(digits), 20)}", f"length {min(n, 40) // 4}", f"shape {shape}",
            f"at {raw.count('@')}", f"dots {min(raw.count('.'), 5)}", f"dashes {min(raw.count('-'), 5)}",
            f"first {raw[0] if not raw[0].isalnum() else ''}", f"before {before}", f"after {after}",
        ]
        return [xxhash.xxh32_intdigest(x) % FEATURES for x in names]


N = len(KINDS) + 1


class Model:
    """Unary weights of features, a chain matrix and a skip weight per label."""

    def __init__(self) -> None:
        self.unary, self.chain, self.skip = np.zeros((FEATURES, N)), np.zeros((N, N)), np.full(N, SKIP)

    def fit(self, g: Graph) -> Model:
        """Pseudo-likelihood: each token's label given its features and its neighbours' labels; scaled gradient steps."""
        if not len(g.label):
            return self
        y = np.eye(N)[g.label]
        n = len(y)
        # All members of a hub are free, so it counts as no personal data.
        (a, b), (p, q) = g.chain.T, np.where(g.skip < 0, n - 1 - g.skip, g.skip).T
        label = np.concatenate([y, np.tile(np.eye(N)[:1], (-int(g.skip.min(initial=0)), 1))])
        # A free node that a match is linked to may be either: nothing is learned from its own label.
        known = np.ones((n, 1))
        for x, z in ((p, q), (q, p)):
            known[x[(x < n) & (label[z, 0] == 0)]] = 0
        known[g.label > 0] = 1
        sums = [np.full_like(x, 1e-3) for x in (self.unary, self.chain, self.skip)]
        around = np.zeros_like(label)
        np.add.at(around, p, label[q])
        np.add.at(around, q, label[p])
        around = np.minimum(around[:n], 2)
        for _ in range(STEPS):
            score = self.unary[g.features].sum(axis=1) + around * self.skip
            np.add.at(score, b, self.chain[g.label[a]])
            np.add.at(score, a, self.chain[:, g.label[b]].T)
            e = np.exp(score - score.max(axis=1, keepdims=True))
            miss = (y - e / e.sum(axis=1, keepdims=True)) * known / n
            grad_u = np.zeros_like(self.unary)
            for f in g.features.T:
                np.add.at(grad_u, f, miss)
            grad_c = y[a].T @ miss[b] + miss[a].T @ y[b]
            grads = [grad_u - 1e-5 * self.unary, grad_c - 1e-4 * self.chain, (miss * around).sum(axis=0) - 1e-2 * (self.skip - SKIP)]
            for w, s, d in zip((self.unary, self.chain, self.skip), sums, grads, strict=True):
                s += d * d
                w += 0.5 * d / np.sqrt(s)
        return self

    def beliefs(self, g: Graph) -> np.ndarray:
        """Marginals of all nodes by loopy sum-product, all messages of a sweep at once, each text until its messages settle."""
        unary = self.unary[g.features].sum(axis=1)
        unary[g.fixed] = np.where(np.eye(N, dtype=bool)[g.label[g.fixed]], 0.0, -50.0)
        size, hubs = len(unary), -int(g.skip.min(initial=0))
        unary = np.concatenate([unary, np.zeros((hubs, N))])
        hub = g.skip.min(axis=1, initial=0) < 0
        ends = np.where(g.skip < 0, size - 1 - g.skip, g.skip)
        frm = np.concatenate([g.chain[:, 0], g.chain[:, 1], ends[:, 0], ends[:, 1]])
        to = np.concatenate([g.chain[:, 1], g.chain[:, 0], ends[:, 1], ends[:, 0]])
        n, m = len(g.chain), len(g.skip)
        back = np.concatenate([np.arange(n) + n, np.arange(n), np.arange(m) + 2 * n + m, np.arange(m) + 2 * n])
        w = np.exp(np.maximum(self.skip, 0.0))
        # Two edges by way of a hub weigh as much as a direct one.
        skip = np.stack([np.diag(np.log(w)), np.diag(np.log(w + np.sqrt(w * w + (N - 2) * w - (N - 1))))])[hub.astype(int)]
        pair = np.concatenate([np.broadcast_to(x, (n, N, N)) for x in (self.chain, self.chain.T)] + [skip, skip])
        text = np.array([k for k, *_ in g.place], np.int64)
        text = text[np.concatenate([g.chain[:, 0], g.chain[:, 0], g.skip[:, 0], g.skip[:, 0]])]
        sent, live = np.zeros((len(frm), N)), np.arange(len(frm))
        for sweep in range(MOST_SWEEPS):
            if not len(live):
                break
            total = unary.copy()
            np.add.at(total, to[live], sent[live])
            out = (total[frm[live]] - sent[back[live]])[:, :, None] + pair[live]
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            step = (new - new.max(axis=1, keepdims=True)) - sent[live]
            sent[live] += step / (2 + sweep // 100)
            moved = np.zeros(int(text.max()) + 1)
            np.maximum.at(moved, text[live], np.abs(step).max(axis=1))
            live = live[moved[text[live]] > SETTLED]
        total = unary.copy()
        np.add.at(total, to, sent)
        total = total[:size]
        e = np.exp(total - total.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def added_spans(texts: list[str], spans: list[list[tuple[int, int, int]]], model: Model) -> list[list[tuple[int, int, int]]]:
    """Spans of free tokens that a skip edge and their belief give a label.

    Neighbours of one label are one span; edge punctuation is left out.
    """
    g = Graph(texts, spans)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(g.label) or g.fixed.all():
        return out
    belief = model.beliefs(g)
    best = belief.argmax(axis=1)
    held = np.zeros(len(best), bool)
    held[g.skip[g.skip >= 0]] = True
    good = ~g.fixed & held & (best > 0) & (belief.max(axis=1) >= BELIEF)
    for i in np.flatnonzero(good):
        k, s, e = g.place[i]
        raw = texts[k][s:e]
        s += len(raw) - len(raw.lstrip(".,;:!?\"'|"))
        e -= len(raw) - len(raw.rstrip(".,;:!?\"'|"))
        kind = int(best[i]) - 1
        if out[k] and out[k][-1][1] == kind and good[i - 1] and g.place[i - 1][0] == k and s - out[k][-1][2] <= 1:
            out[k][-1] = (out[k][-1][0], kind, e)
        elif s < e:
            out[k].append((s, kind, e))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def fit(docs: DataFrame) -> Model:
    """Learn from a bounded sample: the ``MOST_DOCS`` documents, and ``MOST_TOKENS`` of their tokens, first by a hash."""
    few = keep(docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_DOCS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            spans = [base_spans(t) for t in texts]
            for i, t in enumerate(texts):
                g = Graph([t], [spans[i]])
                n = len(g.label)
                if n:
                    yield pa.record_batch(
                        [pa.array([ids[i]], pa.int64()), pa.array([n]), *[pa.array([x.tobytes()]) for x in (g.label, g.features, g.chain, g.skip)]],
                        ["doc_id", "n", "label", "features", "chain", "skip"],
                    )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id", "left_semi")
    rows = rows.mapInArrow(run, "doc_id long, n long, label binary, features binary, chain binary, skip binary")
    # A document of many tokens counts as many; the first that go beyond the bound end the sample.
    rows = keep(rows.where(F.col("n") <= MOST_TOKENS // 10))
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(MOST_DOCS).toArrow().to_pylist()
    g, at, hubs, parts = Graph([], []), 0, 0, []
    for row in got:
        if at + row["n"] > MOST_TOKENS:
            break
        x = {c: np.frombuffer(row[c], np.int64) for c in ("label", "features", "chain", "skip")}
        parts.append((x["label"], x["features"].reshape(row["n"], -1), x["chain"].reshape(-1, 2) + at, np.where(x["skip"] < 0, x["skip"] - hubs, x["skip"] + at).reshape(-1, 2)))
        at, hubs = at + row["n"], hubs - int(x["skip"].min(initial=0))
    if parts:
        g.label, g.features, g.chain, g.skip = (np.concatenate(p) for p in zip(*parts, strict=True))
    return Model().fit(g)


def found(docs: DataFrame) -> DataFrame:
    """``doc_id``, the number of base spans of each kind, ``base_sha256`` and ``spans`` of each row.

    Null texts count as empty and have no spans. Ids are passed through, null or
    repeated; an empty table gives no rows; other columns are not read. Whole
    texts are searched where they are scanned, in time linear in their length,
    so hot sources, copies and very long texts need no shuffle. Spans are
    half-open ranges of code points.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            everything = b.column("text").to_pylist()
            for part in by_bytes([len(t) for t in everything]):
                texts = everything[part]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, shared.value)
                counts = [[sum(k == c for _, k, _ in x) for x in base] for c in range(len(KINDS))]
                yield pa.record_batch(
                    [b.column("doc_id").slice(part.start, len(texts)), *[pa.array(c, pa.int64()) for c in counts],
                     pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in base]),
                     pa.array([written(x + y) for x, y in zip(base, more, strict=True)])],
                    ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
                )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark.read.parquet(f"{sf_dir}/documents.parquet"))
