"""Operators 7 and 8, and the quality stage, against plain versions: one text, word and place at a time."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from spanweave.llm import kernels, licenses, quality
from spanweave.llm.kernels import flat

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SYMBOL = re.compile(rb"[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")


def mix(x):
    return int(kernels.mix(np.array([x % (1 << 64)], np.uint64))[0])


def span_hash(word):
    return mix(sum((b + 1) * pow(kernels.BASE, k, 1 << 64) for k, b in enumerate(word)))


def lower(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def plain_features(text):
    """Buckets of one text's features, by its words, symbol runs and ratios."""
    words, symbols = [lower(w) for w in WORD.findall(text)], SYMBOL.findall(text)
    top = lambda h: h >> (64 - quality.BITS)
    named = {top(mix(span_hash(w) ^ quality.WORD_KIND)) for w in words}
    some = max(len(words), 1)
    ratios = [math.log2(1 + len(words)), min(15, 16 * len(symbols) / some), 8 * len(named) / some, 8 * len(re.findall(rb"[A-Z]", text)) / max(len(text), 1)]
    binned = {top(mix((1000 + k) * 4097 + math.floor(r))) for k, r in enumerate(ratios)}
    return named | {top(mix(span_hash(s) ^ quality.SYMBOL_KIND)) for s in symbols} | binned


def some_texts(seed, n):
    draw = random.Random(seed)
    good, bad = ["river", "stone", "garden", "light", "Reading"], ["buy", "cheap", "click", "NOW", "$$$"]
    make = lambda words, k: " ".join(draw.choice(words if draw.random() < 0.7 else ["the", "of", "and", "à", "x1"]) + draw.choice(["", "", ".", "!!"]) for _ in range(k))
    rows = [(k, make(good if k % 3 == 0 else bad, draw.randrange(1, 60))) for k in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (None, make(good, 20)), (3, rows[3][1])]


def test_features_of_each_text():
    texts = [(t or "").encode() for _, t in some_texts(1, 60)]
    owner, bucket = quality.features(*flat(pa.array(texts, pa.binary())))
    for k, text in enumerate(texts):
        assert set(bucket[owner == k].tolist()) == plain_features(text)


def test_grades_and_selection_are_the_plain_ones(spark, documents, clashing):
    rows = some_texts(2, 240)
    labels = [(k, int(k % 3 == 0), int(k % 7 == 1)) for k in range(200)] + [(None, 1, 0), (5, None, 1)]
    docs, lab = clashing(documents(rows)), spark.createDataFrame(labels, LABELS)
    weights, cuts, least = quality.train(docs, lab)
    assert np.count_nonzero(weights) and (np.diff(cuts) > 0).all()
    want = []
    for doc_id, text in rows:
        x = sum(float(weights[f]) for f in plain_features((text or "").encode()))
        tails = [1 / (1 + math.exp(-(x - c))) for c in cuts.tolist()]
        want.append((repr(doc_id), round(sum(tails), 6), round(tails[0], 6), round(tails[1], 6), tails[1] >= least))
    got = [(repr(r.doc_id), round(r.expected_grade, 6), round(r.p_at_least_1, 6), round(r.p_at_least_2, 6), r.keep) for r in quality.score(docs, lab).collect()]
    assert sorted(got) == sorted(want)
    kept = [(repr(r.doc_id), r.text) for r in quality.select(docs, lab).collect()]
    assert sorted(map(repr, kept)) == sorted(repr((repr(d), t)) for (d, t), w in zip(rows, want, strict=True) if w[-1])


def loss(owner, bucket, grade, weights, cuts):
    x = np.bincount(owner, weights[bucket].astype(float), len(grade))
    bounds = np.concatenate([[-np.inf], cuts, [np.inf]])
    f = lambda z: 1 / (1 + np.exp(-z))
    return -np.log(np.maximum(f(bounds[grade + 1] - x) - f(bounds[grade] - x), 1e-12)).mean()


def test_fit_is_a_minimum():
    """No step of a weight or threshold lowers the penalised loss by more than rounding."""
    draw = np.random.default_rng(3)
    grade = draw.integers(0, 3, 600)
    rows = [[0] + [1 + int(g)] * (draw.random() < 0.8) + [4] * (draw.random() < 0.5) for g in grade]
    owner, bucket = np.repeat(np.arange(600), list(map(len, rows))), np.array([f for r in rows for f in r])
    weights, cuts = quality.fit(owner, bucket, grade, penalty=0.0, steps=3000)
    best = loss(owner, bucket, grade, weights, cuts)
    for k in (1, 2, 3):
        for step in (-0.05, 0.05):
            moved = weights.copy()
            moved[k] += step
            assert loss(owner, bucket, grade, moved, cuts) >= best - 1e-5
    for k in (0, 1):
        for step in (-0.05, 0.05):
            moved = cuts.copy()
            moved[k] += step
            assert loss(owner, bucket, grade, weights, moved) >= best - 1e-5


def plain_scan(words, notices, least, spread):
    """Places of notices: every window from left to right is aligned, without asking first what it holds."""
    found = []
    for name, notice in notices:
        size = len(notice)
        need, width = math.ceil(least * size), int(size * (spread if size >= licenses.SHORT else spread / 2)) + 2
        start = 0
        while start < len(words):
            pairs = licenses.align(words[start : start + width], notice) if words[start] in notice else []
            if len(pairs) >= need:
                found.append((len(pairs), len(pairs) / size, start + pairs[0][0], start + pairs[-1][0], name))
                start += pairs[-1][0] + 1
            else:
                start += 1
    taken = []
    for _, share, first, last, name in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[4])):
        if all(last < a or first > b for _, _, a, b in taken):
            taken.append((name, share, first, last))
    return sorted(taken, key=lambda f: f[2])


@pytest.mark.parametrize("seed", range(4))
def test_scan_finds_what_every_window_finds(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)]
    notices = tuple((f"n{k}", " ".join(draw.choice(vocabulary) for _ in range(n))) for k, n in enumerate((12, 25, 40)))
    scanner = licenses.Scanner(notices, 0.8)
    texts = []
    for _ in range(25):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            own = draw.choice(notices)[1].split()
            edited = [w for w in own if draw.random() > 0.08]
            if draw.random() < 0.5:
                edited.insert(draw.randrange(len(edited)), draw.choice([*vocabulary, "other"]))
            parts += draw.choice([edited, own, [draw.choice([*vocabulary, "x", "y"]) for _ in range(draw.randrange(30))]])
        texts.append(" ".join(parts))
    got = scanner.scan(*flat(pa.array([t.encode() for t in ["", *texts]], pa.binary())))
    for text, found in zip(["", *texts], got, strict=True):
        want = plain_scan(text.split(), [(n, t.split()) for n, t in notices], 0.8, 3.0)
        assert [(n, round(s, 9), a, b) for n, s, a, b in found] == [(n, round(s, 9), a, b) for n, s, a, b in want]
