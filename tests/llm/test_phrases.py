"""Collocations against counts of every phrase by itself."""

import random
import re
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanweave.llm import phrases
from spanweave.llm.kernels import flat


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def pieces(text):
    return [re.findall("[^\x20\t]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", lower(text or ""))]


def brute(rows, least, best, longest=5):
    """Rows (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for words in pieces(text):
            n["und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f["und" if lang is None else lang, tuple(words[i : i + k])] += 1
    found = {key: c for key, c in f.items() if c >= least and len(key[1]) > 1}
    covered = {(lang, w[i : i + k]) for (lang, w), c in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if c >= f[lang, w[i : i + k]]}
    out = []
    for lang in n:
        mine = []
        for (of, w), a in found.items():
            if of == lang and (of, w) not in covered:
                score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
                mine.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, rank + 1, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(mine)[:best])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def some_rows(seed, n=120):
    draw = random.Random(seed)
    words = ["a", "B", "b", "the", "Of", "é", "É", "x1", "long-word", "ñ", "𝒳"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " "]
    text = lambda: "".join(draw.choices(words, range(len(words), 0, -1))[0] + draw.choice(gaps) for _ in range(draw.choice([0, 1, 2, 30, 80])))
    rows = [(draw.choice(["en", "de", None, "und", ""]), draw.choice([text(), text(), None, "", "a b a b a b a b a b"])) for _ in range(n)]
    return rows + [("en", "same words in a row again")] * 30


@pytest.mark.parametrize(("seed", "least", "block"), [(1, 10, 1 << 23), (2, 3, 200), (3, 25, 2000)])
def test_collocations_are_brute_force(spark, clashing, seed, least, block):
    rows = some_rows(seed)
    docs = clashing(spark.createDataFrame(rows, "lang string, text string")).selectExpr("*", "1 AS n", "2 AS slot", "3 AS word", "4 AS a", "5 AS l").repartition(3)
    assert rows_of(phrases.collocations(docs, least=least, best=40, block_bytes=block)) == brute(rows, least, 40)


def test_other_lengths(spark):
    rows = some_rows(4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    for longest in (2, 3):
        assert rows_of(phrases.collocations(docs, least=5, longest=longest)) == brute(rows, 5, 2000, longest)


def test_lists_go_when_counted(spark):
    folder = Path(urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path)
    rows, before = some_rows(5), set(folder.glob("phrases-*"))
    found = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5)
    left = [spark.read.parquet(str(p)).columns for p in set(folder.glob("phrases-*")) - before]
    assert left and not [c for c in left if "positions" in c or "slot" in c]
    assert rows_of(found) == brute(rows, 5, 2000)


def test_nothing_to_count(spark):
    for rows in ([], [(None, None), ("en", ""), ("de", " .,\n")], [("en", "one two three")] * 5):
        docs = spark.createDataFrame(rows, "lang string, text string")
        assert phrases.collocations(docs, least=6).count() == 0


def test_scores_past_64_bits(spark):
    draw = random.Random(6)
    rows = []
    for _ in range(200):
        n = draw.randrange(10**12, 10**14)
        left, right = draw.randrange(10**9, n), draw.randrange(10**9, n)
        rows.append((draw.randrange(1, min(left, right)), n, left, right))
    rows += [(10**14, 10**14, 10**14, 10**14), (3, 7, 1, 21000), (3, 7, 1, 21001)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = df.select("a", "n", "l", "r", phrases.cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [int(r.s) for r in got] == [1000 * r.a * r.n // (r.l * r.r) for r in got]


def test_joined_lists():
    texts = ["a b a b a", "b a. b a", "", "a"]
    words, lengths, positions = phrases.word_lists(*flat(pa.array(texts)))
    assert words.cast(pa.large_string()).to_pylist() == ["a", "b"] and lengths.tolist() == [6, 4]
    left, right, n, at = phrases.extended(lengths, positions)
    assert list(zip(left.tolist(), right.tolist(), n.tolist(), strict=True)) == [(0, 1, 2), (1, 0, 4)]
    assert (np.sort(at[:2]) == at[:2]).all()
    again = phrases.unpacked(phrases.packed(positions), len(positions))
    assert (again == positions).all() and len(phrases.unpacked(phrases.packed(np.zeros(0, np.int32)), 0)) == 0
