"""Fingerprints against a plain version: one window, neighbourhood and filter at a time."""

import hashlib
import random
from collections import Counter
from math import log2

import numpy as np
import pyarrow as pa
import pytest

from spanweave.llm import digests
from spanweave.llm.kernels import flat

W, SPAN = digests.WIDTH, digests.SPAN


def entropy_class(window):
    gain = np.rint(np.array([0.0] + [n * log2(n) for n in range(1, W + 1)]) * 65536).astype(int)
    return int((gain[W] - sum(gain[n] for n in Counter(window).values())) * digests.CLASSES // gain[W])


def plain_places(text, rank):
    """Where the features of one text are."""
    m = len(text) - W + 1
    if m <= 0:
        return []
    ranks = [int(rank[entropy_class(text[k : k + W])]) for k in range(m)]
    votes = Counter(min(range(k, min(k + SPAN, m)), key=lambda j: (ranks[j], j)) for k in range(m))
    return sorted({k for k, n in votes.items() if n >= digests.LEAST} | {min(range(m), key=lambda j: (ranks[j], j))})


def plain_chain(text, rank):
    """Sets of bits, and features, of the filters of one text."""
    features = [text] if 0 < len(text) < W else [text[k : k + W] for k in plain_places(text, rank)]
    features = list(dict.fromkeys(features))
    out = []
    for at in range(0, len(features), digests.FEATURES):
        few = features[at : at + digests.FEATURES]
        bits = set()
        for f in few:
            h = sum((b + 1) * pow(digests.BASE, k, 1 << 64) for k, b in enumerate(f)) % (1 << 64)
            h = int(digests.mix(np.array([h], np.uint64))[0])
            bits |= {h >> (11 * k) & 2047 for k in range(digests.PICKS)}
        out.append((bits, len(few)))
    return out


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    size = lambda c: (sum(n for _, n in c), b"".join(np.packbits([k in x for k in range(2048)]).tobytes() for x, _ in c))
    if size(b) < size(a):
        a, b = b, a
    filled = lambda n: 1 - (1 - 1 / 2048) ** (5 * n)
    total = 0.0
    for x, n in a:
        scores = []
        for y, m in b:
            chance = 2048 * filled(n) * filled(m)
            scores.append(max(0.0, min(1.0, (len(x & y) - chance) / (min(len(x), len(y)) - chance))))
        total += n * max(scores)
    return total / sum(n for _, n in a)


def some_texts(seed=3, n=60):
    draw = random.Random(seed)
    words = ["al", "beta", "gam", "ét", "ñandú", "omega", "12", "x", "zzzzzz", "AAAA"]
    make = lambda k: " ".join(draw.choice(words) for _ in range(k))
    return [None, "", "a", "é", "x" * 23, "x" * 24, "y" * 300, make(3000), *(make(draw.choice([1, 3, 6, 12, 40, 200])) for _ in range(n)), "𝒳" * 40]


def as_rank(texts):
    seen = Counter(entropy_class(t[k : k + W]) for t in texts for k in range(len(t) - W + 1))
    rank = np.empty(digests.CLASSES + 1, np.int16)
    for at, c in enumerate(sorted(range(digests.CLASSES + 1), key=lambda c: (seen[c], c))):
        rank[c] = at
    return rank


def test_chains_and_likeness_are_the_plain_ones(monkeypatch):
    monkeypatch.setattr(digests, "BLOCK", 512)
    texts = [(t or "").encode() for t in some_texts()]
    rank = as_rank(texts)
    found = digests.chains(*flat(pa.array(texts, pa.binary())), rank)
    plain = [plain_chain(t, rank) for t in texts]
    for k, chain in enumerate(plain):
        mine = range(found.first[k], found.first[k + 1])
        assert [(set(np.flatnonzero(np.unpackbits(found.filters[i])).tolist()), found.features[i]) for i in mine] == chain
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    got = digests.likeness(found, i, found, j)
    assert got == pytest.approx([plain_likeness(plain[a], plain[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], abs=1e-6)
    again = digests.parse([found.text(k) for k in range(len(texts))])
    assert (again.filters == found.filters).all() and (again.first == found.first).all() and (again.features == found.features).all()


def plain_edits(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()))
    texts = [(t or "") for _, t in ordered]
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:] + texts[:1], strict=True)]
    rank = as_rank([t.encode() for t in texts])
    a, b = [plain_chain(t.encode(), rank) for t in texts], [plain_chain(t.encode(), rank) for t in edited]
    return sorted(
        (repr(d), len(t), hashlib.sha256(e.encode()).hexdigest(), round(plain_likeness(x, y), 6), round(plain_likeness(x, z), 6))
        for (d, _), t, e, x, y, z in zip(ordered, texts, edited, a, b, a[1:] + a[:1], strict=True)
    )


@pytest.mark.parametrize("size", [1 << 25, 1 << 10])
def test_edits_are_the_plain_ones(spark, documents, clashing, monkeypatch, size):
    """In one range and in many, with null ids, repeated ids and equal rows."""
    monkeypatch.setattr(digests, "RANGE_BYTES", size)
    draw = random.Random(9)
    rows = [(draw.choice([None, 1, 2, 3, 10, 11, 12, 13, 14, k]), t) for k, t in enumerate(some_texts(4, 40))] + [(1, "same words " * 9)] * 4
    docs = clashing(documents(rows)).selectExpr("*", "1 AS `range`", "2 AS guest", "3 AS digest", "4 AS unnamed", "5 AS k").repartition(5)
    got = digests.edits(docs).collect()
    assert sorted((repr(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 6), round(r.near_next, 6)) for r in got) == plain_edits(rows)
    texts = {}
    for r in digests.fingerprints(docs, digests.rarity(digests.class_counts(docs))).collect():
        texts.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert all(r.fingerprint in texts[r.doc_id] for r in got)


def test_one_document_and_none(spark, documents):
    assert digests.edits(documents([])).count() == 0
    (row,) = digests.edits(documents([(7, "abc")])).collect()
    assert (row.doc_id, row.n_chars, row.edited_sha256) == (7, 3, hashlib.sha256(b"aba").hexdigest()) and row.near_next == 1.0
    (row,) = digests.edits(documents([(None, None)])).collect()
    assert (row.n_chars, row.fingerprint, row.edited_fingerprint, row.near_edited, row.near_next) == (0, "", "", 1.0, 1.0)


def test_compared_columns(spark):
    texts = ["one text that is long enough for some features of its own", "another text, which shares no part of the first one at all"]
    rank = as_rank([t.encode() for t in texts])
    found = digests.chains(*flat(pa.array(texts)), rank)
    a, b = found.text(0), found.text(1)
    df = spark.createDataFrame([(1, a, a), (2, a, None), (3, None, None), (4, a, b)], "id long, x string, y string")
    got = {r.id: r.likeness for r in digests.compared(df, "x", "y").collect()}
    assert (got[1], got[2], got[3]) == (1.0, 0.0, 1.0) and got[4] < 0.2


def test_likeness_tells_edited_texts_from_others(spark):
    """On the given documents of 200 bytes and more: half of a text that stays against the next text."""
    df = digests.op11_digests(spark, "/root/testdata/sf0.001").where("n_chars >= 200").toPandas()
    assert (df.near_edited > df.near_next).mean() > 0.99
    assert df.near_edited.median() > 0.4 and df.near_next.median() < 0.1
