"""The whole pipeline on a small folder, against the same steps in plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
from tests.llm.test_text_operators import SPACE, brute_components, greedy, measured
from tokenizers import Tokenizer
from wattframe.llm import mixing, rules

COMMON = "the of and to in is it was with as on be by this".split()


def text_of(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(COMMON) if r.random() < 0.4 else f"w{r.randrange(9999)}" for _ in range(n))


def passes(text):
    n_words, chars, symbols, dup, repeat = measured(text)
    words = [w for w in re.split(SPACE, text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip()]
    counts = {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_lines": len(lines),
        "n_marks": (text or "").count("!"), "n_stop_words": sum(w.rstrip(".,;:!?").lower() in rules.STOP_WORDS for w in words),
        "n_ellipsis_lines": sum(x.rstrip(" ").endswith(("...", "…")) for x in lines), "n_bullet_lines": sum(x.lstrip(" ")[:1] in "-*•·" for x in lines),
    }
    if n_words < 10 or 100 * repeat > 20 * n_words:
        return False
    values = [(counts[r.part] / (counts[r.per] if r.per else 1), r) for r in rules.RULES]
    return all((r.low is None or v >= r.low) and (r.high is None or v <= r.high) for v, r in values)


def raked(rows):
    """Sampled rows (id, text, lang, source) by the same sweeps over a dictionary of cells."""
    cell = lambda r: (r[3] or "", r[2] or "", next((n for n, marks in mixing.TOPICS if any(m in r[1].lower() for m in marks)), "prose"))
    tokens = collections.Counter()
    for r in rows:
        tokens[cell(r)] += len([w for w in re.split(SPACE, r[1]) if w])
    total, weight = sum(tokens.values()), {c: float(n) for c, n in tokens.items()}
    share = []
    for m in range(3):
        sums = collections.Counter()
        for c, n in tokens.items():
            sums[c[m]] += n
        power = {v: n**mixing.TEMPER for v, n in sums.items()}
        share.append({v: p / sum(power.values()) for v, p in power.items()})
    def settle(weight, held):
        while True:
            was = weight
            for m in range(3):
                free, fixed = collections.Counter(), collections.Counter()
                for c, w in weight.items():
                    (fixed if c in held else free)[c[m]] += w
                weight = {c: w if c in held else w * max(share[m][c[m]] * total - fixed[c[m]], 0) / free[c[m]] for c, w in weight.items()}
            if sum(abs(weight[c] - was[c]) for c in weight) <= mixing.TOLERANCE * total:
                return {c: weight[c] / tokens[c] for c in weight}

    factor = settle(weight, set())
    step = lambda f: math.ceil(math.log(f) / math.log(mixing.GRID))
    steps = {step(f) for f in factor.values()}
    top = mixing.GRID ** min(x for x in steps if 100 * sum(tokens[c] for c in factor if step(factor[c]) > x) <= mixing.SPARE * total)
    factor = settle({c: tokens[c] * min(f, top) for c, f in factor.items()}, {c for c, f in factor.items() if f > top})
    draw = lambda i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:8], 16) / 2**32
    return [r for r in rows if draw(r[0]) < min(1.0, factor[cell(r)] / top)]


def test_pipeline_like_plain_python(spark, tmp_path):
    r = random.Random(1)
    item = text_of(77, 30)
    texts = [text_of(i, 40 + i % 60) for i in range(60)]
    texts += [texts[3], texts[4] + " end", texts[5].replace("the", "THE"), None, "", "# $ % " * 30, "wow!! " * 40]
    texts += [f"{text_of(200 + i, 50)} {' '.join(item.split()[15:])} {text_of(300 + i, 9)} {' '.join(item.split()[:15])}" for i in range(3)]
    texts += [text_of(400 + i, 50) + ' mail a@b.org and key = "x"' for i in range(6)]
    rows = [(i, t, r.choice(["en", "de", None]), f"s{min(i % 5, 2)}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, "too short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [x for x in rows if passes(x[1])]
    label = [c for _, c in brute_components([x[1] for x in left])]
    left = [x for i, x in enumerate(left) if label[i] == i]
    words = lambda t: t.lower().translate({ord(c): None for c in ".,;:!?\"'()[]{}"}).split()
    left = [x for x in left if greedy(words(item), words(x[1])) < 0.5 * len(words(item))]
    assert 50 < len(left) < 70
    want, at, lib = [], 0, Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i, t, *_ in raked(left):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)

    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(x) for x in got] == want and len(want) > 20
