"""The filter audit against a count of every order by itself."""

import random
import re
from itertools import permutations

import numpy as np
from pyspark.sql import types as T

from spanweave.llm import filters
from spanweave.llm.kernels import flat

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
WORD = re.compile("[^\x20\x09-\x0d]+")


def fails_of(docs):
    out = []
    for doc_id, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        copy = any(b[0] is not None and doc_id is not None and b[0] < doc_id and (b[1] or "") == text for b in docs)
        out.append((source or "", {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": copy}))
    return out


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = fails_of(docs)
    rows, shapley = {}, {}
    for part in {p for p, _ in fails}:
        mine = [(d[0], f) for d, (p, f) in zip(docs, fails, strict=True) if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                failing = [d for d in mine if d[1][x]]
                rows[part, "".join(order), k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(sum(f.values()) == 1 for _, f in failing), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in rows.items()}


def found(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def some_docs():
    draw = random.Random(5)
    texts = [None, "", " \t\n", "A" * 40, "é" * 30, "x $ y", "ONE two", "w " * 60, " ".join(f"w{k}" for k in range(49)), " ".join(f"w{k}" for k in range(50)), " ".join(f"w{k % 33}" for k in range(50)), " ".join(f"w{k % 32}" for k in range(50)), "\x0bW\x0cw\x1cW", "B" * 5 + "b" * 95, "B" * 6 + "b" * 94]
    rows = [(None if draw.random() < 0.1 else draw.randrange(40), draw.choice(texts), draw.choice([None, "", "p", "q", "r'"])) for _ in range(150)]
    return rows + [(1, "same", "p"), (1, "same", "p"), (2, "same", "q"), (None, "same", "p"), (None, "same", "q")]


def test_audit_is_every_order_counted(spark, documents, clashing):
    docs = some_docs()
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (3, None, 1), (4, 0, None), (None, 1, 1), (5, 1, 0), (99, 1, 1)]
    got = found(filters.audit(clashing(documents(docs)), clashing(spark.createDataFrame(labels, LABELS))))
    assert got == brute(docs, labels)


def test_no_documents_or_labels(spark, documents):
    empty = spark.createDataFrame([], LABELS)
    assert filters.audit(documents([]), empty).count() == 0
    docs = [(1, "a b", None), (2, "a b", "s")]
    assert found(filters.audit(documents(docs), empty)) == brute(docs, [])


def test_names_of_columns_inside(spark, documents):
    docs = documents(some_docs()).selectExpr("*", "1 AS part", "2 AS digest", "3 AS mask", "4 AS salt", "5 AS n", "6 AS good")
    assert found(filters.audit(docs, spark.createDataFrame([], LABELS))) == brute(some_docs(), [])


def test_colliding_hashes_are_told_apart_by_bytes():
    import pyarrow as pa

    texts = ["aa bb aa cc", "aa aa", "", "dd", "ab ba ab abc abd"]
    data, offsets = flat(pa.array(texts))
    want = ([len(t.split()) for t in texts], [len(set(t.split())) for t in texts])
    for hashed in (filters.word_hashes, lambda d, s, e: np.zeros(len(s), np.uint64), lambda d, s, e: (e - s).astype(np.uint64)):
        words, distinct = filters.word_counts(data, offsets, hashed)
        assert (words.tolist(), distinct.tolist()) == want


def test_blocks_of_hashes_give_the_same_words():
    import pyarrow as pa

    data, offsets = flat(pa.array(["one two three " * 50 + "x" * 300]))
    starts, ends = filters.spans(~filters.SPACE[data], offsets)
    assert (filters.word_hashes(data, starts, ends, block=16) == filters.word_hashes(data, starts, ends)).all()
