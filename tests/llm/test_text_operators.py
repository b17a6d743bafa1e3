"""Each text operator against brute force, exact round trips and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from wattframe.llm import common, components, decontaminate, jaccard, mixing, pii, quotes, rans, repeats, rules, tokens, toxicity

SPACE = r"[\x20\x09-\x0D]+"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "one two"), (None, "one two"), (None, None),
    (6, prose(1, 400)), (7, prose(1, 400) + " x"), (8, prose(2, 20_000)), (9, "a " * 3000), (10, "é" * 5000 + " ß\x1c "),
]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# 7: quality rules


def measured(text):
    words = [w for w in re.split(SPACE, text or "") if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.sub(SPACE, "", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_rules_count_like_brute_force(table):
    texts = [t for _, t in ODD] + ["a b c d e x a b c d e", "l one\nl one\n\n\nl one", "# a $$ b", "a b a b a b a b a b a b"]
    df = rules.judged(table(list(enumerate(texts))))
    for r in df.collect():
        want = measured(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_rules_keep_rows_as_they_are(table):
    good = "the cat sat on the mat and it was a very good day for all of us in town"
    docs = table([(1, good), (2, "# # # # # # # # # # # #"), (3, None)])
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [1]
    assert rules.keep_good(table([])).count() == 0


def test_rules_run_no_python(table):
    plan = rules.judged(table(ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# 8: n-gram Jaccard join


def sets_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in re.split(SPACE, low) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    own = [sets_of(t) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                n = len(own[a] & own[b])
                if own[a] and own[b] and 100 * n >= 80 * (len(own[a]) + len(own[b]) - n) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return [(len(s), c) for s, c in zip(own, label, strict=True)]


@pytest.mark.parametrize("above", [40, 2])
def test_jaccard_like_brute_force(table, monkeypatch, above):
    monkeypatch.setattr(jaccard, "COMMON", above)
    r = random.Random(3)
    texts = [None, "", "a b", "A B", "a b c", " \n"]
    for k in range(8):
        words = prose(k, r.randrange(8, 120)).split()
        for _ in range(8):  # copies with ever more edits, and a passage that all share
            words = list(words)
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
            texts.append(" ".join(words))
    shared = prose(99, 30)
    texts += [f"{prose(200 + i, 40)} {shared}" for i in range(12)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.joined(table(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def edge_family(f, ends):
    """A passage, the passage and 16% new shingles (0.84, sizes on both sides of 1.25 ** 20), and texts that hold most of it but link to neither."""
    passage = prose(5000 + f, 88).split()
    texts = []
    for j in range(25):
        other = prose(6000 + 100 * f + j, 10).split()
        for text in ([*passage[:74], *other], [*other, *passage[14:]])[:ends]:
            texts += [" ".join(text), " ".join([*text, f"end{j}"])]
    return [*texts, " ".join(passage), " ".join(passage + [f"new{f}x{i}" for i in range(16)])]


def test_jaccard_across_a_band_edge(table):
    """In the larger one's band, all good rows are copies from the band below."""
    texts = edge_family(0, 2) + edge_family(1, 2)
    want = brute_components(texts)
    assert want[101] == (100, 100) and want[203] == (100, 202)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.joined(table(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_jaccard_leading_column_further_back_in_the_other(table):
    """New shingles push columns out of the larger one's leading ones: they are not lost for the overlap."""
    texts = edge_family(0, 1)
    want = brute_components(texts)
    assert want[51] == (100, 50)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.joined(table(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_jaccard_odd_rows(table):
    got = jaccard.joined(table(ODD))
    assert got.count() == len(ODD)
    by = collections.defaultdict(set)
    for r in got.collect():
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[1] == {(0, 1)} and by[3] == {(0, 3)} and by[4] == by[5] == {(1, 4)}
    assert (1, 4) in by[None] and (0, None) in by[None]
    assert by[7] == {(397, 6)}
    assert jaccard.joined(table([])).count() == 0
    stay = [r.doc_id for r in jaccard.one_of_each(table(ODD)).collect()]
    assert sorted(x for x in stay if x) == [1, 2, 3, 4, 6, 8, 9, 10] and stay.count(None) == 2


def test_jaccard_hot_sets_and_components_are_broadcast(table, monkeypatch):
    """Some sets and components are over the share at which they are hot, others under it."""
    monkeypatch.setattr(common, "HOT_SHARE", 8)
    texts = [prose(300, 60)] * 20 + [f"{prose(301, 60)} e{i}" for i in range(20)] + [prose(310 + i, 30) for i in range(20)] + [None, ""] * 10
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.joined(table(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_components_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3)]
    got = dict(rows_of(components.components(spark.createDataFrame(edges, "u long, v long"))))
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + k] == 100 for k in range(30))
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 5: benchmark decontamination


def greedy(item, text, least=5):
    """Longest common unmarked run first, from the left."""
    a, b, total = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return total
        a[i : i + k] = b[j : j + k] = [True] * k
        total += k


def test_tiles_like_brute_force():
    r = random.Random(5)
    for _ in range(60):
        item = [r.randrange(6) for _ in range(r.randrange(5, 30))]
        text = [r.randrange(6) for _ in range(r.randrange(0, 40))]
        at = r.randrange(len(item))
        text += item[at:] + [9] + item[:at]
        got = decontaminate.tiles(np.array(item, np.uint64), np.array(text, np.uint64), np.arange(len(text)))
        assert sum(t[2] for t in got) == greedy(item, text)
        assert all(item[i : i + n] == text[j : j + n] for i, j, n in got)


def test_tiles_like_brute_force_across_gaps_and_periods():
    r = random.Random(6)
    for _ in range(80):
        item = ([r.randrange(3) for _ in range(r.randrange(1, 4))] * 20)[: r.randrange(5, 30)]
        text = ([r.randrange(3) for _ in range(r.randrange(1, 4))] * 20)[: r.randrange(5, 40)] + item[3:]
        cut = r.randrange(len(text))
        places = np.arange(len(text)) + 2 * (np.arange(len(text)) >= cut)
        got = decontaminate.tiles(np.array(item, np.uint64), np.array(text, np.uint64), places)
        assert sum(t[2] for t in got) == greedy(item, [*text[:cut], -1, *text[cut:]])
        assert all(item[i : i + n] == text[j : j + n] and not j < cut < j + n for i, j, n in got)


def test_one_repeated_word_makes_few_runs(spark, table):
    """Runs grow with the sum of both lengths, and an item's words are not repeated for each of its seeds."""
    w = np.full(1, 7, np.uint64)
    i, j, n = decontaminate.maximal_runs(w.repeat(20_000), w.repeat(1_000_000), np.arange(1_000_000), 5)
    assert len(i) < 1_020_000 and n.max() == 20_000
    items = spark.createDataFrame([(1, "ha " * 20_000), (2, prose(70, 20_000))], "item_id long, text string")
    docs = table([(1, "ha " * 400_000), (2, prose(71, 500)), (3, f"x {prose(70, 20_000)} y")])
    assert sorted(rows_of(decontaminate.leaks(docs, items))) == [(1, 1, 20_000, 20_000, 1, 1.0), (3, 2, 20_000, 20_000, 1, 1.0)]


def test_reordered_passages_leak_and_clean_texts_stay(spark, table):
    item = prose(50, 40).split()
    items = spark.createDataFrame([(0, " ".join(item), "z"), (1, "too short", "z"), (2, None, "z"), (3, "", "z")], "item_id long, text string, key string")
    texts = [
        f"{prose(60, 300)} {' '.join(item[20:]).upper()}, {prose(61, 50)} {' '.join(item[:20])}!", prose(62, 300),
        f"{prose(63, 30)} {' '.join(item[:9])} {prose(64, 30)}", None, "", "too short",
    ]
    docs = table([*enumerate(texts), (0, texts[0])])
    assert rows_of(decontaminate.leaks(docs, items)) == [(0, 0, 40, 40, 2, 1.0)]
    clean = decontaminate.without_leaks(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2, 3, 4, 5]
    assert decontaminate.leaks(table([]), items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


# 6: mixing


def test_raking_meets_margins(spark):
    r = random.Random(1)
    cells = [(s, g, t, float(r.randrange(1, 1000))) for s in "ab" for g in "xyz" for t in "pq"]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double")
    want = {"source": {"a": 0.7, "b": 0.3}, "lang": {"x": 0.2, "y": 0.3, "z": 0.5}, "topic": {"p": 0.5, "q": 0.5}}
    targets = {m: spark.createDataFrame(list(w.items()), f"{m} string, share double") for m, w in want.items()}
    fit = mixing.factors(df, targets)
    assert mixing.misfit(fit, targets) < 1e-9
    with pytest.raises(RuntimeError):
        mixing.factors(df, targets, most_sweeps=1)
    got = fit.collect()
    total = sum(r.tokens * r.factor for r in got)
    for m, w in want.items():
        for v, share in w.items():
            assert sum(r.tokens * r.factor for r in got if r[m] == v) / total == pytest.approx(share, abs=1e-6)


def test_a_stray_document_takes_its_own_size_only(spark):
    """One document of a rare source and language hardly changes what is kept of the others."""
    rows = [(i, prose(i % 50, 30), f"l{i % 3}", f"s{i % 11}") for i in range(3300)]
    schema = "doc_id long, text string, lang string, source string"
    share = [
        mixing.mixed(spark.createDataFrame(x, schema)).where("row.doc_id >= 0").selectExpr("sum(probability * n_tokens) / sum(n_tokens)").first()[0]
        for x in (rows, [*rows, (-1, "two words", "rare", "rare")])
    ]
    assert abs(share[0] - share[1]) < 0.001


def test_cells_above_the_reference_are_kept_whole(spark):
    cells = [(s, g, "p", 5.0 if (s, g) == ("a", "x") else 1000.0) for s in "abc" for g in "xy"]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double")
    want = {"source": {"a": 0.4, "b": 0.3, "c": 0.3}, "lang": {"x": 0.5, "y": 0.5}}
    targets = {m: spark.createDataFrame(list(w.items()), f"{m} string, share double") for m, w in want.items()}
    fit = mixing.factors(df, targets)
    top = mixing.reference(fit)
    got = {(r.source, r.lang): r.factor for r in mixing.capped(fit, targets, top).collect()}
    before = {(r.source, r.lang): r.factor for r in fit.collect()}
    above = {c for c, f in before.items() if f > top}
    assert all(got[c] == pytest.approx(top) for c in above) and sum(t for s, g, _, t in cells if (s, g) in above) <= 0.01 * 5005
    assert mixing.misfit(mixing.capped(fit, targets, top), targets) < 0.01


def test_mixing_odd_rows(spark):
    rows = [(i, prose(i, 30), "en", f"s{i % 3}" if i % 7 else None, 5) for i in range(200)] + [(None, None, None, None, 0), (3, prose(3, 30), "en", "s0", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight long")
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    assert len({r.sampled for r in got if r.row.doc_id == 3}) == 1
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.mixed(docs.limit(0)).count() == 0


# 2 and 10: tokens


def random_texts(n):
    r = random.Random(9)
    letters = "aBz.,!?' \n\t<|>15\x1cßÉſİ é日"
    return ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(n)] + ["x<|endoftext|>y  \n\n a \n", "<|ENDOFTEXT|> It's"]


def test_counts_equal_the_library(table):
    texts = random_texts(500) + [t or "" for _, t in ODD]
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in tokens.counts(table(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t, add_special_tokens=False))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 1024)
    assert tokens.counts(table([(None, None)])).collect()[0].n_tokens == 0
    assert tokens.counts(table([])).count() == 0


def test_long_texts_are_split_only_at_safe_places():
    text = prose(4, 50_000) + "x" * 100_000
    parts = tokens.split_safely(text, 10_000)
    assert "".join(parts) == text and len(parts) > 20
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert sum(len(lib.encode(p, add_special_tokens=False)) for p in parts) == len(lib.encode(text, add_special_tokens=False))


def test_token_files_round_trip(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(rans, "FRAME", 3000)
    texts = random_texts(300) + [t or "" for _, t in ODD]
    r = random.Random(2)
    rows = [*enumerate(texts), (None, "null id"), (5, texts[5])]
    r.shuffle(rows)
    path = f"file://{tmp_path}/ids"
    rans.write(table(rows), path)
    got = rans.read(spark, path).orderBy("start").collect()
    assert [x.doc_id for x in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    lib, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for x in got:
        ids = [*lib.encode("null id" if x.doc_id is None else texts[x.doc_id], add_special_tokens=False).ids, 1]
        packed = np.array(ids, "<u4").tobytes()
        assert (x.start, x.n_tokens, x.ids_crc32, bytes(x.ids)) == (at, len(ids), zlib.crc32(packed), packed)
        at += len(ids)
    rans.write(table([]), f"file://{tmp_path}/none")
    assert rans.read(spark, f"file://{tmp_path}/none").count() == 0


def test_blocks_decode_from_checkpoints_and_detect_damage():
    r = np.random.default_rng(0)
    ids = np.minimum(r.zipf(1.3, 400_000), 49_000).astype(np.uint32)
    table = rans.Table.of_counts(*np.unique(ids, return_counts=True))
    block = rans.encode(ids, table)
    assert (rans.decode(block, table) == ids).all() and len(block) < 2 * len(ids)
    row = rans.CHECKPOINT * rans.LANES
    assert (rans.decode(block, table, first=1) == ids[row:]).all()
    assert (rans.decode(block, table, first=0, stop=1) == ids[:row]).all()
    with pytest.raises(ValueError):
        rans.decode(block[:5000] + bytes([block[5000] ^ 1]) + block[5001:], table)


# 1: toxicity


def test_toxicity_learns_and_scores_odd_rows(spark, table):
    texts = [prose(i, 60) + (" you vile fool" if i % 4 == 0 else "") for i in range(400)]
    docs, labels = table(list(enumerate(texts))), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(7, None)], "doc_id long, label int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(200, 400))
    assert 0 < len(model[0]) < 500  # sparse
    odd = toxicity.scored(table(ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.scored(table([]), model).count() == 0
    assert len(toxicity.fit(docs, labels.limit(0))[0]) == 0


def test_held_out_rows(spark):
    df = spark.range(50)
    got = df.select("id", toxicity.held_out(df.id).alias("h")).collect()
    assert [r.h for r in got] == [zlib.crc32(str(r.id).encode()) % 5 == 0 for r in got]


# 9: personal data

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": name != "ip" or all(int(x) < 256 for x in m[0].split(".")),
                "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15,
            }
            if ok[name]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_like_the_patterns():
    r = random.Random(8)
    for _ in range(4000):
        text = "".join(r.choice("ab@.+-% 0123456789()é\n") for _ in range(r.randrange(60)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("4952935900253052 10.0.0.255 1.2.3.999 +1 (974) 555-3436 a@b.c") == plain_spans("4952935900253052 10.0.0.255 1.2.3.999 +1 (974) 555-3436 a@b.c")


def test_patterns_are_linear_on_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" * 50_000, "a@" * 100_000, "+" + "1-" * 100_000):
        pii.base_spans(text)


def test_skip_chain_carries_labels(spark, table):
    r = random.Random(4)

    def card():
        d = [r.randrange(10) for _ in range(15)]
        return next("".join(map(str, [*d, c])) for c in range(10) if pii.luhn("".join(map(str, [*d, c]))))

    cards = [card() for _ in range(300)]
    rows = [(i, f"word {cards[i]} and more 12 then {prose(i, 5)} {cards[i] if i % 2 else ''} call +1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)} now") for i in range(300)]
    number = card()
    dotted = ".".join(number[i : i + 4] for i in range(0, 16, 4))
    rows.append((1000, f"my card {number} again the card {dotted} please and item 77"))
    rows += [(2000 + i, t) for i, (_, t) in enumerate(ODD)]
    got = {r.doc_id: r for r in pii.found(table(rows)).collect()}
    text = dict(rows)[1000]
    assert (got[1000].n_card, got[1000].n_phone) == (1, 0)
    assert f"card:{text.index(dotted)}:{text.index(dotted) + len(dotted)}" in got[1000].spans.split(",")
    for i, t in rows:
        base = pii.written(plain_spans(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert not base or set(base.split(",")) <= set(got[i].spans.split(","))
    assert got[2000].spans == "" and pii.found(table([])).count() == 0


def added(texts):
    spans = [pii.base_spans(t) for t in texts]
    model = pii.Model().fit(pii.Graph(texts, spans))
    return [[(pii.KINDS[k], t[s:e]) for s, k, e in x] for t, x in zip(texts, pii.added_spans(texts, spans, model), strict=True)]


def test_whole_numbers_are_found_again():
    forms = ("(743) 555-3824", "743-555-3824", "743 555 3824", "1 743 555 3824")
    texts = [f"call +1 (743) 555-3824 or {x} today, not 12 of 2024" for x in forms]
    texts += ["call +1 743 555 3824 or (743) 555-3824 today", "host 10.0.0.1 is down, 10-0-0-1 and 1000 others"]
    want = [[("phone", x)] for x in (*forms, forms[0])] + [[("ip", "10-0-0-1")]]
    assert added(texts) == want


def test_far_repeats_have_one_label():
    text = "call +1 (743) 555-3824 now" + " and later on (743) 555-3824 again" * 60
    assert added([text]) == [[("phone", "(743) 555-3824")] * 60]


def test_field_runs_through_documents_without_a_match():
    r = random.Random(12)

    def digits(valid):
        d = "".join(str(r.randrange(10)) for _ in range(15))
        return next(d + str(c) for c in range(10) if pii.luhn(d + str(c)) == valid)

    wrong = digits(False)
    texts = [f"paid by card {digits(True)} today and not 12 of 2024" for _ in range(200)]
    texts += [f"paid by card {wrong} today and again by card {wrong} today", f"order 12 of {wrong} and 12 of 2024"]
    got = added(texts)
    assert got[-2:] == [[("card", wrong)] * 2, []] and not any(got[:-2])


# 3: suffix-array dedup


def brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    n = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_repeats_like_brute_force(table, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH", 3000)
    monkeypatch.setattr(repeats, "SEGMENT", 1024)
    r = random.Random(6)
    passage = [prose(300 + i, 60) for i in range(3)]
    texts = [None, "", "short", "x" * 199, "y" * 200, "z" * 700, "ab" * 400, prose(1, 900), prose(1, 900), "é" * 300]
    for i in range(30):
        words = prose(400 + i % 6, 150).split()
        for _ in range(r.randrange(5)):
            words[r.randrange(150)] = f"edit{r.randrange(99)}"
        texts.append(" ".join(words) + passage[i % 3] + prose(i, r.randrange(30)))
        texts.append(prose(900 + i, 10) + passage[i % 3][r.randrange(80) :] + passage[r.randrange(3)])
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.deduplicated(table(list(enumerate(texts)))).collect()}
    want = brute_repeats(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert repeats.deduplicated(table([])).count() == 0


def test_maximal_repeats_of_a_core():
    data = [b"abc" + b"C" * 100 + b"x" * 100, b"zbc" + b"C" * 100 + b"x" * 98 + b"yy", b"qqq" + b"C" * 100 + b"x" * 100]
    left, right = repeats._spans_of_core(data, np.array([3, 3, 3]), np.zeros(3, int))
    assert left.tolist() == [2, 2, 0] and right.tolist() == [100, 98, 100]


# 4: quotation linking


def test_quotes_link_nested_and_partial_passages(spark):
    a = "We should ship the new engine next week.\nThe tests all pass on my machine."
    b = "> We should ship the new engine\n> next week. The tests all pass on my machine.\n\nI do not think that we are ready yet."
    c = "Late to this thread.\n>> The tests all pass on my machine.\n> I do not think that we are ready yet.\nWhy not, what is missing?"
    rows = [(1, 0, "u", a), (1, 1, "v", b), (1, 2, "w", "Unrelated words by another person."), (1, 3, "u", c), (2, 0, "u", None), (2, 5, "v", "> no such passage was ever written\nok"), (None, 1, "u", "lost"), (1, 0, "u", a)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as hash", "2 as thread")
    got = {(r.conv_id, r.turn): r for r in quotes.linked(df).collect()}
    assert len(got) == 7
    assert (got[1, 1].reply_to, got[1, 1].quoted, got[1, 1].n_linked) == (0, True, 1)
    assert got[1, 1].body == "I do not think that we are ready yet."
    assert (got[1, 3].reply_to, got[1, 3].quoted, got[1, 3].n_quotes, got[1, 3].n_levels, got[1, 3].n_linked) == (1, True, 2, 2, 2)
    assert (got[1, 3].thread, got[1, 3].depth) == (0, 2)
    assert (got[1, 2].reply_to, got[1, 2].quoted) == (1, False)
    assert (got[2, 5].reply_to, got[2, 5].n_quotes, got[2, 5].n_linked, got[2, 5].body) == (None, 1, 0, "ok")
    assert got[2, 0].body == "" and got[None, 1].thread is None
    assert quotes.linked(df.limit(0)).count() == 0


def test_long_reply_chain(spark):
    df = spark.range(300).selectExpr("1L as conv_id", "id as turn", "'u' as role", "concat('message ', id) as text")
    got = quotes.linked(df).collect()
    assert all(r.thread == 0 and r.depth == r.turn for r in got)


def test_mixing_sweeps_broadcast_nothing(spark, monkeypatch):
    cells = spark.createDataFrame([(s, lang, "prose", 7 * i + 13) for i, s in enumerate("abcde") for lang in ("x", "y")], "source string, lang string, topic string, tokens long")
    targets = {m: mixing.tempered(cells, m, 0.5) for m in mixing.MARGINS}
    plans = []
    kept = mixing.keep
    monkeypatch.setattr(mixing, "keep", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    key = lambda fit: {(r.source, r.lang): round(r.factor, 9) for r in fit.collect()}
    few = key(mixing.factors(cells, targets))
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans[1:])
    monkeypatch.setattr(mixing, "SMALL_CELLS", 0)
    assert key(mixing.factors(cells, targets)) == few
