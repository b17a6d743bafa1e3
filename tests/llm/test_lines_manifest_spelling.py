"""Line dedup, Merkle manifest and spelling variants against brute force and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from wattframe.llm import lines, manifest, spelling

WS = " \t\n\x0b\x0c\r"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "\n".join(f"line {i}" for i in range(20_000))
ODD = [(1, None), (2, ""), (3, "\n \n"), (4, "x"), (4, "x"), (4, "y\nx"), (None, "x"), (None, "x"), (5, LONG), (6, LONG), (7, "É\n é \nx")]


# 12: line dedup


def brute_lines(rows, at_least, least_chars=1):
    key = lambda x: x.strip(WS).translate(ASCII_LOWER)
    found = collections.defaultdict(set)
    for id, text in rows:
        for x in (text or "").split("\n"):
            found[key(x)].add(id)
    gone = {k for k, ids in found.items() if len(k) >= least_chars and len(ids) >= at_least}
    out = []
    for id, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if key(x) not in gone]
        out.append((id, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("rows_sent", [500_000, 0])
@pytest.mark.parametrize("at_least, least_chars", [(2, 1), (3, 3)])
def test_lines_like_brute_force(table, monkeypatch, rows_sent, at_least, least_chars):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", rows_sent)
    r = random.Random(1)
    pool = ["Shared line", " shared LINE\t", "ÄÖ menu", "äÖ menu", "", "a", "A ", "ab", "one\x85", "one"]
    rows = ODD + [(100 + i, "\n".join(r.choice([*pool, f"own {i} {k}"]) for k in range(r.randrange(1, 9)))) for i in range(60)]
    got = lines.deduplicated(table(rows), at_least, least_chars).collect()
    assert collections.Counter(map(tuple, got)) == brute_lines(rows, at_least, least_chars)


def test_lines_of_no_rows_and_native_plan(table):
    assert lines.deduplicated(table([])).count() == 0
    assert lines.deduplicated(table([(1, "x")])).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    plan = lines.deduplicated(table(ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_a_line_in_one_document_many_times_is_no_common_line(table):
    rows = [(1, "\n".join(["again"] * 50)), *[(2, "again")] * 20]
    assert {(r.doc_id, r.n_dropped) for r in lines.deduplicated(table(rows), 3).collect()} == {(1, 0), (2, 0)}


# 11: Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, lower=False):
    out = []
    for name in manifest.FIELDS:
        v = row[name]
        if name == "text" and lower and v is not None:
            v = v.translate(ASCII_LOWER)
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return H(*out)


def brute_tree(nodes):
    """The root of a list of digests and, for each, the (left, right) siblings up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i - i % 16
            paths[k].append((nodes[first:i], nodes[i + 1 : first + 16]))
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def brute_manifest(rows):
    by_source = collections.defaultdict(list)
    for row in rows:
        by_source[row["source"]].append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(by_source[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r)))
        trees[s] = (own, *brute_tree([brute_leaf(r) for r in own]))
    root, tops = brute_tree([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        own, subroot, paths = trees[s]
        for row, path in zip(own, paths, strict=True):
            id = row["doc_id"]
            bad = id is not None and zlib.crc32(str(id).encode()) % 5 == 0
            folded, all_siblings = brute_leaf(row, bad), []
            for left, right in path + top:
                folded = H(*left, folded, *right)
                all_siblings += left + right
            out.append((id, brute_leaf(row), subroot, root, H(*all_siblings), folded, folded == root))
    return collections.Counter(out)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_like_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    manifest.places.cache_clear()
    r = random.Random(2)
    sizes = {None: 3, "": 1, "hot": 900, "é": 17, "z": 16, "a": 256, "b": 257}
    sizes |= {f"s{i}": 1 for i in range(30)}
    rows, id = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            id += r.randrange(1, 4)
            rows.append((id, r.choice([None, "", "Some TEXT É", "lower only", "A" * 5000]), r.choice([None, "en"]), source, r.choice([None, 7, -1])))
    rows += [(None, "Null ID", "en", "hot", 1), (None, "Null ID", "en", "hot", 1), (4, "Twice", None, "hot", 2), (4, "twice", None, "hot", 2)]
    r.shuffle(rows)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as tree", "2 as pos", "3 as leaf")
    got = manifest.audited(df).collect()
    assert collections.Counter(map(tuple, got)) == brute_manifest([dict(zip(names, x, strict=True)) for x in rows])
    assert {x.verified for x in got} == {True, False}
    assert manifest.audited(df.limit(0)).count() == 0


def test_van_emde_boas_places():
    for height in range(1, 5):
        found = np.concatenate([manifest.address(d, np.arange(16**d), height) for d in range(height)])
        assert sorted(found.tolist()) == list(range(manifest.nodes_in(height)))
    # A run of siblings and the parent lie next to each other at the bottom of a block.
    parent, run = manifest.address(2, np.array([5]), 4)[0], manifest.address(3, np.arange(80, 96), 4)
    assert run.tolist() == list(range(parent + 1, parent + 17))


# 13: spelling variants


def brute_words(rows, least_chars=7):
    n = collections.Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = 1 if id is None else zlib.crc32(f"{id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_chars:
                n[run] += 1
    return n


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n, ratio=10):
    linked = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in linked.items():
        if others:
            best = min(others, key=lambda v: (-n[v], v))
            if n[best] >= ratio * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(linked[w]), n[form[w]] if w in form else None))
    return sorted(out)


def vocabulary(seed, size):
    r = random.Random(seed)
    words = ["abcabcabc", "aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "anananan", "ananana", "éééééééé", "ééééééé", "×÷éèêëç", "straßenÿ"]
    while len(words) < size:
        w = "".join(r.choice(["ba", "ka", "né", "ti", "rou", "s", "in"]) for _ in range(r.randrange(3, 6)))
        for _ in range(r.randrange(4)):
            at = r.randrange(len(w))
            w = r.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "é" + w[at + 1 :]])
        if len(w) >= 7:
            words.append(w)
    return {w: r.choice([2, 3, 20, 40, 400, 4000]) for w in words}


@pytest.mark.parametrize("frequent, long", [(100, 1000), (3, 1000), (3, 4), (1, 0)])
def test_variants_like_brute_force(spark, monkeypatch, frequent, long):
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    monkeypatch.setattr(spelling, "LONG_LIST", long)
    n = vocabulary(4, 500)
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert sorted(map(tuple, got)) == brute_variants(n)


def test_words_like_brute_force(table, monkeypatch):
    r = random.Random(5)
    pool = [*vocabulary(6, 60), "Short", "UPPERCASE", "ÉCLATANTE", "mixed9digits", "under_scored"]
    rows = [(i, r.choice([" ", ", ", "\n"]).join(r.choices(pool, k=r.randrange(40)))) for i in range(120)]
    rows += [(None, "wonderful wonderful"), (1, None), (2, ""), (3, "wonderful"), (3, "wonderful"), (4, "y" * 50_000), (5, "longword " * 30_000)]
    got = {x.word: x.n for x in spelling.typed_words(table(rows)).collect()}
    assert got == dict(brute_words(rows))
    whole = spelling.grouped(table(rows)).collect()
    assert sorted(map(tuple, whole)) == brute_variants({w: n for w, n in brute_words(rows).items() if n >= 2})
    assert spelling.grouped(table([])).count() == 0


def test_an_edit_affects_no_more_grams_than_the_bound():
    r = random.Random(7)
    words = list(vocabulary(8, 200))
    frequent = {g for w in words[:60] for s in range(3, 6) for k in range(len(w)) if len(g := f"^{w}$"[k : k + s]) == s and r.random() < 0.6}
    for w in words:
        own = collections.Counter(spelling.grams(w, frequent))
        for at in range(len(w)):
            for v, side in ((w[:at] + w[at + 1 :], 0), (w[:at] + "q" + w[at:], 1), (w[:at] + "q" + w[at + 1 :], 0)):
                common = sum((own & collections.Counter(spelling.grams(v, frequent))).values())
                assert common >= len(spelling.grams(w, frequent)) - spelling.most_affected(spelling.grams(w, frequent))[side]
