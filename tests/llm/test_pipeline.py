"""The whole pipeline, stage by stage, against brute force on a small corpus with odd rows."""

import collections
import itertools
import random
import re
import tracemalloc

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from spanweave.llm import graphs, neardup, quality, shared

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def corpus():
    rng = random.Random(21)
    items = [(k, prose(rng, 20)) for k in range(5)]
    shared = prose(rng, 70)
    rows = [(None, None), (1, ""), (2, " \n"), (2, " \n"), (3, "one"), (None, prose(rng, 90))]
    rows += [(10 + k, prose(rng, rng.randrange(20, 160))) for k in range(25)]
    rows += [(40 + k, rows[8][1]) for k in range(4)] + [rows[9]] * 2  # copies, and a row that comes three times
    rows += [(None, rows[10][1]), rows[5]]
    for k in range(6):  # near copies
        words = rows[12 + k % 2][1].split()
        words[rng.randrange(len(words))] = f"edit{k}"
        rows.append((50 + k, " ".join(words)))
    rows += [(60 + k, prose(rng, 30) + " " + shared + " " + prose(rng, 30)) for k in range(4)]
    rows += [(70 + k, prose(rng, 40) + " " + items[k][1] + " " + prose(rng, 20)) for k in range(5)]
    rows += [(80 + k, prose(rng, 1500)) for k in range(2)]
    return rows, items


def near(rows):
    """One row of each class of rows with words (least id, null last), all rows without words."""
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    best, out = {}, []
    for n, (i, t) in enumerate(rows):
        if not sets[n]:
            out.append((i, t))
        else:
            best[find(n)] = min(best.get(find(n), (True, 0, "~")), (i is None, i or 0, t))
    return out + [(None if unknown else i, t) for unknown, i, t in best.values()]


def cleaned(rows, length=200):
    starts = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        starts.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = set()
        for p in range(len(b) - length + 1):
            if starts[b[p : p + length]] > 1:
                gone.update(range(p, p + length))
        if not gone:
            out.append((i, t))
        elif len(gone) < len(b):
            out.append((i, bytes(x for k, x in enumerate(b) if k not in gone).decode("utf-8", "ignore")))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, documents):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, items = corpus()
    docs = documents([(i, t, None if k % 11 == 0 else f"s{k % 3}") for k, (i, t) in enumerate(rows)])
    docs.withColumn("id", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("block", F.lit("y")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items + [(None, None), (9, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([*((k, 1, 0) for k in range(14, 85)), (11, 1, 0), (12, 0, 0), (13, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda rows: sorted(rows, key=repr)
    held = [(r.doc_id, r.text) for r in docs.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "minhash near-dedup", "suffix-array dedup", "benchmark decontamination", "mixing to target weights"]
    expect = {1: near, 2: cleaned, 3: lambda rows: [(i, t) for i, t in rows if not any(f" {x} " in f" {t} " for _, x in corpus()[1])]}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns
        kept = [(r.doc_id, r.text) for r in found.collect()]
        if k:
            assert key(kept) == key(expect[k](held))
        else:  # whatever it keeps are rows of the input, labelled good ones among them
            assert not collections.Counter(kept) - collections.Counter(held) and len({i for i, _ in kept if i and 14 <= i < 85}) > 30
            found, kept = docs, held
        docs = spark.createDataFrame(found.collect(), found.schema) if kept else found
        held = kept
    assert any(i == 18 for i, _ in held) or any(i == 19 for i, _ in held)
    mixed = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert key((r.doc_id, r["size"]) for r in mixed) == key((i, len(WORDS.findall(t or ""))) for i, t in held)
    assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 2 for r in mixed)


def test_run_and_rerun(spark, folder):
    first = sorted(corpus_pipeline.run(spark, folder).collect(), key=repr)
    assert len(first) > 20 and first == sorted(corpus_pipeline.run(spark, folder).collect(), key=repr)


def test_repeated_rows_leave_one(spark, documents):
    """A row that comes twice survives near-dedup once, so that the next stage does not empty it."""
    rng = random.Random(1)
    t, u = prose(rng, 100), prose(rng, 100)
    docs = documents([(1, t), (1, t), (2, u), (None, prose(rng, 100))])
    kept = corpus_pipeline.near_stage(spark, docs, "")
    assert sorted(((r.doc_id, r.text == t) for r in corpus_pipeline.substring_stage(spark, kept, "").collect()), key=repr) == [(1, True), (2, False), (None, False)]


def test_empty_documents(spark, tmp_path, documents, folder):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_stage_keeps_estimates_short(spark, documents, monkeypatch):
    """What the driver holds of a cut must not grow with the rounds: Spark's estimates of size multiply in joins."""
    found, real = [], shared.cut

    def cut(df):
        done = real(df)
        found.append(done._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length())
        return done

    monkeypatch.setattr(neardup, "cut", cut)
    monkeypatch.setattr(graphs, "cut", cut)
    corpus_pipeline.near_stage(spark, documents(corpus()[0]), "").count()
    assert len(found) > 6 and max(found) <= 63


def test_quality_fit_on_the_driver_is_small(monkeypatch):
    """The fit runs on the driver: beside its features (6 bytes each) it may not hold several 64-bit copies of them."""
    rng = np.random.default_rng(3)
    grade = rng.integers(0, 3, 8000)
    rows = np.sort((rng.integers(0, 3000, (8000, 300)) + 400 * grade[:, None]) % 3400, axis=1).astype(np.int32)
    owner, bucket = np.repeat(np.arange(8000, dtype=np.uint16), 300), rows.reshape(-1)
    tracemalloc.start()
    weights, gaps = quality.fit(owner, bucket, grade, steps=3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (weights != 0).sum() > 100
    assert most < 13 * len(bucket)
    monkeypatch.setattr(quality, "PART", 1000)
    again = quality.fit(owner, bucket, grade, steps=3)
    assert np.allclose(weights, again[0]) and np.allclose(gaps, again[1])
