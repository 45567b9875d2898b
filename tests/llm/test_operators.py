"""The ten operators against brute force on small tables, with their edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanweave.llm import ctw, decontaminate, kernels, licenses, lm, media, mixing, neardup, pages, progressive, quality, substrings, suffix, urls
from spanweave.llm.graphs import components
from spanweave.llm.shared import cut

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "two words"), (5, "two words"), (6, "Ä é ß   x"), (7, "a" * 3000), (8, "x y " * 4000)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def corpus(seed=1):
    """Texts with exact copies, near copies and a shared passage, besides the odd rows."""
    rng = random.Random(seed)
    rows = list(ODD)
    shared = prose(rng, 60)
    for i in range(100, 130):
        rows.append((i, prose(rng, rng.randrange(1, 150))))
    for i in range(200, 212):
        base = rows[-1][1] if i % 4 else prose(rng, 120)
        words = base.split()
        if i % 4:
            words[rng.randrange(len(words))] = "edit" + str(i)
        rows.append((i, " ".join(words)))
    rows += [(300 + k, rows[15][1]) for k in range(3)]
    rows += [(400 + k, prose(rng, 30) + " " + shared + "\n" + prose(rng, 20)) for k in range(4)]
    return rows


# --- suffix arrays -----------------------------------------------------------


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array(seed):
    rng = random.Random(seed)
    for _ in range(20):
        t = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 50))]
        t = np.array((t * rng.randint(1, 3)) + [0], np.uint16)
        sa = suffix.suffix_array(t)
        assert list(sa) == sorted(range(len(t)), key=lambda i: list(t[i:]))
        common = suffix.permuted_common_prefixes(t, sa)
        for r in range(1, len(t)):
            a, b = t[sa[r] :], t[sa[r - 1] :]
            n = min(len(a), len(b))
            assert common[sa[r]] == (np.append(a[:n] != b[:n], True)).argmax()


def removed(rows, length):
    starts = collections.Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        starts.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if starts[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [2000, 1 << 22])
def test_substrings(documents, clashing, block):
    rows = corpus()
    got = substrings.digests(clashing(documents(rows)), block_bytes=block)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == removed(rows, 200)


def test_substrings_clean_keeps_columns(documents, clashing):
    docs = clashing(documents(corpus()))
    got = substrings.clean(docs, block_bytes=3000)
    assert got.columns == docs.columns
    rows = got.collect()
    assert {r.doc_id for r in rows if r.text is None} == {None, 1} and all(r.n_chars == len(r.text) for r in rows if r.text)
    assert not any(r.doc_id in (300, 301, 302) for r in rows)
    assert substrings.clean(docs.where("false")).count() == 0 and substrings.digests(docs.where("false")).count() == 0


# --- near duplicates ---------------------------------------------------------


def classes(rows, width, percent):
    sets = {}
    for n, (_, t) in enumerate(rows):
        w = WORDS.findall(lower(t))
        sets[n] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return sorted([(i, len(sets[n]), least.get(find(n)) if i is not None else None) for n, (i, _) in enumerate(rows)], key=repr)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_neardup(documents, clashing, width, percent):
    rows = corpus()
    got = neardup.classes(clashing(documents(rows)), width, percent).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == classes(rows, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_neardup_group_of_edits(documents):
    """A dense group of copies with random edits, where only some pairs reach the threshold."""
    rng = random.Random(9)
    base = prose(rng, 100).split()
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            k = rng.randrange(99)
            words[k], words[k + 1] = words[k + 1], words[k]
        rows.append((i, " ".join(words)))
    got = neardup.classes(documents(rows), 3, 85).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == classes(rows, 3, 85)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_neardup_costs_stars_not_pairs(documents, monkeypatch, width, percent):
    """Copies with one to three edits, linked densely: what is tested and linked grows with the rows, not with their square."""
    tested = []
    similar = neardup._Links.similar
    monkeypatch.setattr(neardup._Links, "similar", lambda self, pairs: (tested.append(pairs.count()), similar(self, pairs))[1])
    sizes = []
    for n in (100, 400):
        rng = random.Random(2)
        base, rows = prose(rng, 100).split(), []
        for i in range(n):
            words = list(base)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
            rows.append((i, " ".join(words)))
        tested.clear()
        got = neardup.classes(documents(rows), width, percent).collect()
        assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == classes(rows, width, percent)
        sizes.append(sum(tested))
    assert sizes[1] < 8 * sizes[0] + 400


def test_neardup_compares_small_groups_at_once(documents, monkeypatch):
    """Groups of a few texts that are alike, but mostly not enough, post no differences; both ways give the same classes."""
    posted = []
    settle = neardup._settle
    monkeypatch.setattr(neardup, "_settle", lambda links, rows: (posted.append(rows.count()), settle(links, rows))[1])
    rng, rows = random.Random(5), []
    for group in range(4):
        base = prose(rng, 100).split()
        for i in range(7):
            words = list(base)
            for k in rng.sample(range(100), 3):
                words[k] = f"e{rng.randrange(10**6)}"
            rows.append((10 * group + i, " ".join(words)))
    told = lambda: sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.classes(documents(rows), 3, 85).collect())
    want = sorted(classes(rows, 3, 85))
    assert told() == want and sum(posted) == 0
    monkeypatch.setattr(neardup, "NEAR", 0)
    assert told() == want and sum(posted) > 0


def test_neardup_counts_dense_groups_at_once(documents, monkeypatch):
    """Groups of many texts that agree but are mostly not similar enough post no differences; all ways give the same classes."""
    posted = []
    settle = neardup._settle
    monkeypatch.setattr(neardup, "_settle", lambda links, rows: (posted.append(rows.count()), settle(links, rows))[1])
    rng, rows = random.Random(11), []
    for group in range(3):
        base = prose(rng, 100).split()
        for i in range(40):
            words = list(base)
            for k in rng.sample(range(100), 3):
                words[k] = f"e{rng.randrange(10**6)}"
            rows.append((100 * group + 2 * i, " ".join(words)))
            if i % 4 == 0:
                words[-1] = f"e{rng.randrange(10**6)}"
                rows.append((100 * group + 2 * i + 1, " ".join(words)))
    told = lambda: sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.classes(documents(rows), 3, 85).collect())
    want = sorted(classes(rows, 3, 85))
    assert told() == want and sum(posted) == 0
    for limit in ("DENSE_WORK", "DENSE"):
        posted.clear()
        monkeypatch.setattr(neardup, limit, 0)
        assert told() == want and sum(posted) > 0


def test_neardup_repeated_ids(documents):
    """Rows of one id with different texts are documents of their own; select keeps one row of each class."""
    rng = random.Random(5)
    a, b, c = prose(rng, 80), prose(rng, 80), prose(rng, 80)
    rows = [(1, a), (1, a), (1, b), (2, b + " more"), (None, a), (None, c), (None, c), (3, ""), (3, ""), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.classes(documents(rows)).collect()), key=repr)
    assert got == sorted([(1, 76, 1), (1, 76, 1), (1, 76, 1), (2, 77, 1), (None, 76, 1), (None, 76, None), (None, 76, None), (3, 0, 3), (3, 0, 3), (None, 0, None)], key=repr)
    kept = sorted(((r.doc_id, r.text) for r in neardup.select(documents(rows)).collect()), key=repr)
    assert kept == sorted([(1, a), (1, b), (None, c), (3, ""), (3, ""), (None, None)], key=repr)


def test_neardup_select_and_empty(documents, clashing):
    docs = clashing(documents(corpus()))
    kept = neardup.select(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({(c, c is None and i) for i, _, c in classes(corpus(), 5, 80)})
    assert neardup.classes(docs.where("false")).count() == neardup.select(docs.where("false")).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(components(links).collect())
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_rounds_keep_estimates_short(spark):
    """Spark multiplies its estimates of size in every join; what a cut carries on must not have a growing number of digits."""

    def bits(df):
        return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()

    rows = spark.createDataFrame([(k, k % 3) for k in range(20)], "id long, label long")
    ids = rows.select("id")
    for _ in range(4):
        rows = cut(rows.join(ids, "id").join(rows.select("id"), "id"))
        assert bits(rows) <= 64
    assert sorted(rows.collect()) == [(k, k % 3) for k in range(20)]
    labels = components(spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long"))
    assert bits(labels) <= 64
    assert sorted(labels.collect()) == [(k, 0) for k in range(61)]


# --- decontamination ---------------------------------------------------------


def test_decontaminate(spark, documents, clashing):
    item = "Then Ann Smith has 7 apples and 30 kg of rice, while Bob has 12 apples in a box"
    rows = [(21, "so . " + item + " ."), (22, item.replace("Ann", "Zoe").replace("Bob", "Max").replace("7", "8")), (23, item.replace("Ann", "Zoe").replace("Bob", "Zoe").replace("7", "9").replace("12", "9")), (24, "clean words only here and nothing else to be seen at all in this text")]
    bench = spark.createDataFrame([(9, item), (9, item), (None, None), (10, ""), (11, "too short")], "item_id long, text string")
    docs = clashing(documents(rows + ODD))
    got = {r.doc_id: r for r in decontaminate.judge(docs, bench, block=2).where("doc_id is not null").collect()}
    assert {i for i, r in got.items() if r.contaminated} == {21, 22}
    assert got[22].reparameterised and not got[21].reparameterised and 9 in got[21].item_ids
    left = decontaminate.select(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 2
    assert not decontaminate.judge(docs, bench.where("false")).where("contaminated").count()
    assert decontaminate.judge(docs.where("false"), bench).count() == 0


def found_items(items, text, width=8, least=13):
    """What is found of some items in a text: (item number, share, whether values differ)."""
    block = decontaminate.Block(list(range(len(items))), [i.encode() for i in items], width)
    return block.judge(decontaminate.Tokens(*kernels.flat(pa.array([text.encode()], pa.binary()))), least).get(0, [])


def test_decontaminate_arithmetic():
    items = ["Add 12, 7, 9, 15, 3, 8 and 20", "Convert 12 km 5 m to cm", "Sum 4 8 15 16 23 42 and give the total of them"]
    for k, item in enumerate(items):
        assert found_items(items, f"We read: {item}. Then more words follow here.") == [(k, 1.0, False)]
    assert not found_items(items, "Add 13, 6, 9, 15, 2, 8 and 20. Convert 13 km 5 m to cm.")


def test_decontaminate_names():
    item = "Tom has 5 apples. Ann has 3 pears. How many fruits do Tom and Ann have together"
    assert found_items([item], "So: " + item.replace("Tom", "Bob").replace("Ann", "Eve") + "?") == [(0, 1.0, True)]
    assert [r[:2] for r in found_items([item], item.replace("Ann", "Mary Ann"))] == [(0, 1.0)]
    assert found_items([item], item.replace(" Ann", "\nAnn").replace("many ", "many\n")) == found_items([item], item.lower()) == [(0, 1.0, False)]
    assert not found_items([item], item.replace("Tom", "Bob").replace("Ann", "Bob"))


@pytest.mark.parametrize("n", [15, 20, 30])
def test_decontaminate_insertions(n):
    words = prose(random.Random(n), 2 * n).split()
    item, other = words[:n], words[n:]
    for k in range(1, n):
        for text in (item[:k] + ["inserted"] + item[k:], item[:k] + item[k + 1 :]):
            if max(k, len(text) - k - (len(text) > n)) < 8:  # no part has a window
                continue
            found = found_items([" ".join(item)], " ".join(other[:5] + text + other[5:]))
            assert found and found[0][1] >= (n - 3) / n, k
    assert not found_items([" ".join(item)], " ".join(item[:8] + other + item[8:12]))
    assert not found_items(["x " * 14], "x " * 10)


def test_decontaminate_verbatim_against_brute_force(spark, documents):
    """Every document that holds an item word for word is found, others of random words are not."""
    rng = random.Random(11)
    items = [(k, prose(rng, rng.randrange(13, 30))) for k in range(20)]
    items += [(50, "What is 3 + 4 * 12 - 7 / 2 + 19 - 44 + 8 ?"), (51, "Compute 12 kg plus 30 kg minus 4 kg times 2 m over 9 s")]
    rows = []
    for k in range(80):
        parts = [prose(rng, rng.randrange(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts += [rng.choice(items)[1], prose(rng, rng.randrange(1, 60))]
        rows.append((k, " ".join(parts)))
    want = {(i, k) for i, t in rows for k, item in items if f" {item} " in f" {t} "}
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (7, 1000):
        found = decontaminate.judge(documents(rows), bench, block=block).collect()
        assert {(r.doc_id, k) for r in found for k in r.item_ids} == want
        assert all(r.contaminated == any(i == r.doc_id for i, _ in want) for r in found)


# --- urls --------------------------------------------------------------------


def test_url_rules(spark):
    rows = [(1, "http://www.EXAMPLE.com/en/x"), (2, "https://a.example.com/en/y?q"), (3, "http://b.com"), (4, "http://x.net/es/1#f"), (5, "http://x.org/a"), (6, None), (7, "no scheme"), (7, "no scheme"), (8, "http://example.com.net/fr/"), (None, "http://notexample.com/en/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block") and got[3].rule is None and got[3].path == ""
    assert (got[4].rule, got[4].path) == ("net/es/", "/es/1") and (got[8].rule, got[8].verdict) == ("net/fr/", "block")
    assert got[6].host == got[6].path == "" == got[7].host and got[None].rule == "com/"
    assert urls.judge(df.where("false")).count() == 0
    assert urls.judge(df.where("page_id = 5")).first().verdict == "allow"


def test_url_model_against_brute_force():
    """Witten-Bell interpolation of orders 0 to 3, by dictionaries."""
    rng = random.Random(1)
    train, asked = ([prose(rng, 2).replace(" ", "/").encode() for _ in range(n)] for n in (40, 15))
    model = urls.fit(train, 3)
    counts = collections.defaultdict(collections.Counter)
    symbols = lambda u: [*u, urls.END]
    for u in train:
        s = [urls.END] * 3 + symbols(u)
        for k in range(3, len(s)):
            for d in range(4):
                counts[d, tuple(s[k - d : k])][s[k]] += 1
    for u, got in zip(asked, urls.log_likelihood(model, asked)[0], strict=True):
        s, total = [urls.END] * 3 + symbols(u), 0.0
        for k in range(3, len(s)):
            p = 1 / urls.SYMBOLS
            for d in range(4):
                seen = counts.get((d, tuple(s[k - d : k])))
                if seen:
                    p = (seen[s[k]] + len(seen) * p) / (sum(seen.values()) + len(seen))
            total += math.log(p)
        assert got == pytest.approx(total, rel=1e-9)


def test_url_sample_is_distinct(spark):
    """One URL that comes many times is one of the sample."""
    rows = [(k, f"http://a.com/{k % 30}") for k in range(30)] + [(100 + k, "http://b.net/es/x") for k in range(500)] + [(900, "http://c.net/es/y"), (901, "http://z.org/es/q")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), sample=20).collect()}
    assert got[0] == "allow" and got[100] == got[900] == "block" and len(got) == 532


def test_url_model_learns():
    rng = random.Random(0)
    good = [f"http://a.com/news/{prose(rng, 1)}".encode() for _ in range(300)]
    bad = [f"http://b.net/{prose(rng, 1)}-casino-{rng.randrange(99)}".encode() for _ in range(300)]
    models = urls.fit(good[:200], 4), urls.fit(bad[:200], 4)
    cut = urls.threshold(urls.ratio(*models, good[200:]), urls.ratio(*models, bad[200:]))
    assert (urls.ratio(*models, good[200:]) >= cut).mean() > 0.97 and (urls.ratio(*models, bad[200:]) < cut).mean() > 0.97
    p = sum(math.exp(urls.log_likelihood(models[0], [bytes([b])])[0][0]) for b in range(256)) + math.exp(urls.log_likelihood(models[0], [b""])[0][0])
    assert p < 1.0 + 1e-9


# --- language model ----------------------------------------------------------


def brute_ctw(grams_counts, depth, asked):
    """Context trees by recursion over dictionaries."""
    tables = collections.defaultdict(lambda: [0, 0])
    for (context, byte), n in grams_counts.items():
        for k in range(8):
            node, bit = (k, byte >> (8 - k)), byte >> (7 - k) & 1
            for d in range(depth + 1):
                tables[node, context[:d]][bit] += n
    memo = {}

    def pe(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pw(node, s):
        if (node, s) not in memo:
            own = pe(*tables[node, s]) if (node, s) in tables else 0.0
            if len(s) < depth and (node, s) in tables:
                kids = sum(pw(node, s + (y,)) for y in {c[len(s)] for (m, c) in list(tables) if m == node and len(c) == len(s) + 1 and c[: len(s)] == s})
                m = max(own, kids)
                own = m + math.log(0.5 * math.exp(own - m) + 0.5 * math.exp(kids - m))
            memo[node, s] = own
        return memo[node, s]

    def p_one(node, context, d):
        s = context[:d]
        if (node, s) not in tables:
            return 0.5
        a, b = tables[node, s]
        kt = (b + 0.5) / (a + b + 1)
        if d == depth:
            return kt
        w = math.exp(pe(a, b) + math.log(0.5) - pw(node, s))
        return w * kt + (1 - w) * p_one(node, context, d + 1)

    out = []
    for context, byte in asked:
        total = 0.0
        for k in range(8):
            p = p_one((k, byte >> (8 - k)), context, 0)
            total += math.log10(p if byte >> (7 - k) & 1 else 1 - p)
        out.append(total)
    return out


def test_lm_against_brute_force(documents):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(0, 12)).upper() if i % 3 else prose(rng, 5)) for i in range(30)] + [(90, None), (91, ""), (92, "zz\n zz"), (93, "q" * 50)]
    depth, counts = 3, collections.Counter()
    texts = {i: [*b" ".join((t or "").encode().lower().split()), 255] for i, t in rows}
    parts = {i: [(tuple(([255] * depth + x)[k + depth - 1 :: -1][:depth]), b) for k, b in enumerate(x)] for i, x in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    for i, x in parts.items():
        if not held[i]:
            counts.update(x)
    words = {i: [*WORDS.findall(lower(t)), None] for i, t in rows}
    known = collections.Counter(w for i, x in words.items() if not held[i] for w in x)
    n, v = sum(known.values()), len(known)
    for block in (150, 1 << 20):
        for r in lm.score(documents(rows), depth, block).collect():
            assert r.score == pytest.approx(sum(brute_ctw(counts, depth, parts[r.doc_id])), rel=1e-4)
            assert r.base_score == pytest.approx(sum(math.log10((known[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words[r.doc_id]), rel=1e-9)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words[r.doc_id]), sum(known[w] > 0 for w in words[r.doc_id]), n)


def test_lm_edges(documents, clashing):
    docs = clashing(documents(ODD))
    assert lm.score(docs).count() == len(ODD) and lm.score(docs.where("false")).count() == 0
    only = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows = lm.score(documents([(i, "ab") for i in only])).collect()
    assert all(r.train_tokens == 0 and r.score == pytest.approx(3 * 8 * math.log10(0.5)) for r in rows)


def test_finder():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 20000))
    asked = rng.integers(0, len(keys), 50000)
    assert (lm.Finder(keys).find(keys[asked]) == asked).all()


# --- mixing ------------------------------------------------------------------


def targets(rows):
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(WORDS.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(size.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * size[s]}
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = 2.0 * size[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out, size


def test_mixing(documents, clashing):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(0, 60)), rng.choice(["a", "b", "c", "Z", None])) for i in range(900)] + [(1000 + i, prose(rng, 3), "tiny") for i in range(3)] + [(i, t, "odd") for i, t in ODD[:6]]
    docs = clashing(documents(rows))
    want, size = targets(rows)
    source = docs.select("doc_id", "source")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    per = collections.Counter()
    for r in got:
        per[r.source] += r.taken
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size and r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
    for s, t in want.items():
        assert abs(per[s] - t) <= 31
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in got} and source.count() == len(rows)
    assert mixing.mix(docs.where("false")).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(documents([(1, ""), (2, None)])).collect())


def test_mixing_is_fair(documents):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(60)]
    docs = documents(rows)
    mean = np.mean([[r.copies for r in sorted(mixing.mix(docs, seed=k).collect(), key=lambda r: r.doc_id)] for k in range(12)], axis=0)
    assert (mean[::3] == 2).all() and abs(mean[1::3].mean() - 5 / 6) < 0.06 and abs(mean[2::3].mean() - 5 / 3) < 0.06
    assert mean[1::3].min() > 0.3 and mean[2::3].max() < 2.01 and mean[2::3].min() > 1.1


# --- quality -----------------------------------------------------------------


def test_quality(spark, documents, clashing):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, 40).split()
        toxic, poor = i % 7 == 0, i % 5 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["vile", "rotten"])
        if poor:
            words = [w + "!!" for w in words]
        rows.append((i, " ".join(words)))
        if i < 700:
            labels.append((i, int(not poor), int(toxic)))
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5000, 1, 0), (3, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = clashing(documents(rows + ODD))
    got = {r.doc_id: r for r in quality.score(docs, lab).where("doc_id >= 700").collect()}
    right = [r.keep == (i % 7 > 0 and i % 5 > 0) for i, r in got.items()]
    assert np.mean(right) > 0.97 and all(0 <= r.p_at_least_2 <= r.p_at_least_1 <= 1 for r in got.values())
    kept = quality.select(docs, lab)
    assert kept.columns == docs.columns
    assert quality.score(docs, lab.where("false")).where("not keep").count() == 0
    assert quality.score(docs.where("false"), lab).count() == 0


def test_quality_of_repeated_ids(spark, documents):
    """Ids that come very often with equal or other texts keep the fitting sample within its bound."""
    rows = [(1, "good text here")] * 300 + [(1, f"other text {k}") for k in range(300)] + [(2, "bad words there"), (None, "x")]
    lab = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    sizes_ = []
    fit = quality.fit
    try:
        quality.fit = lambda owner, bucket, grade: (sizes_.append(len(grade)), fit(owner, bucket, grade))[1]
        assert quality.score(documents(rows), lab, sample=50).count() == len(rows)
    finally:
        quality.fit = fit
    assert max(sizes_) <= 50


# --- licenses ----------------------------------------------------------------


def test_patience_alignment():
    assert licenses.align(list("xabcdy"), list("abcd")) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert licenses.align(list("abXcd"), list("abcd")) == [(0, 0), (1, 1), (3, 2), (4, 3)]
    rng = random.Random(2)
    for _ in range(200):
        a, b = [[rng.randrange(9) for _ in range(rng.randrange(12))] for _ in range(2)]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs))


def test_licenses(documents, clashing):
    mit = next(t for n, t in licenses.NOTICES if n == "mit" and len(t) > 200)
    rows = [(100, "words before\nReleased under the MIT License.\nwords after"), (101, "Licensed under CC BY-NC 4.0."), (102, mit.upper().replace("COPY,", "duplicate,")), (103, "License plate and the version of under"), (104, "Licensed under the Apache License, Version 2.0. and Released under the MIT License")]
    got = {r.doc_id: [f.license for f in r.found] for r in licenses.scan(clashing(documents(rows + ODD))).collect()}
    assert got[100] == ["mit"] and got[101] == ["cc-by-nc-4.0"] and got[102] == ["mit"] and got[103] == [] and got[104] == ["apache-2.0", "mit"]
    assert not any(v for k, v in got.items() if k is None or k < 100)
    assert licenses.scan(documents([])).count() == 0


@pytest.mark.parametrize("gap", [5, 60, 120])
def test_license_with_insertions(gap):
    """Every complete notice is found, wherever words are put into it."""
    scanner = licenses.Scanner(licenses.NOTICES, 0.85)
    rng = random.Random(gap)
    for name, text in licenses.NOTICES:
        words = text.split()
        if len(words) < 60 and gap > len(words) or len(words) < licenses.SHORT:
            continue
        k = rng.randrange(1, len(words))
        given = " ".join(["before"] * 9 + words[:k] + prose(rng, gap).split() + words[k:] + ["after"] * 9)
        found = scanner.scan(*kernels.flat(pa.array([given.encode()], pa.binary())))[0]
        assert name in [f[0] for f in found], (name, k)


def test_license_coverage_is_brute_force_at_most():
    """Patience pairs no more words than the longest common subsequence, and all words of an exact copy."""
    rng = random.Random(4)
    for _ in range(200):
        a, b = [rng.choices(range(12), k=rng.randrange(1, 25)) for _ in range(2)]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        pairs = licenses.align(a, b)
        assert len(pairs) <= best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(x < y and u < v for (x, u), (y, v) in itertools.pairwise(pairs)) and len(licenses.align(a, a)) == len(a)


# --- pages -------------------------------------------------------------------


def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>var x='<p>no</p>'</script></head><body><nav><a>Home</a></nav><div class='cookie-notice'>We use cookies</div>{body}<footer>&copy; site</footer></body></html>"


def test_pages(spark):
    rows = [
        (1, "http://h/1", page("<article><h1>A &amp; B</h1><p>one <b>two</b>\n three<p>four<br>five<ul><li>x<li>y</ul><section class='comments'>hey</section></article>")),
        (2, "http://h/2", page("<div id='content'><p>First text of a page.</p><form>no</form><p>Second&nbsp;text.</p></div>")),
        (3, "http://h/3", None), (4, None, ""), (5, "http://h/5", "<p>broken <b>markup &lt;ok"), (5, "http://h/5", "plain text only"),
        *[(10 + k, "http://w/x", page(f"<div><p>Written by staff</p><p>Story number {k} tells of {'abcdefgh'[k]}.</p></div>")) for k in range(8)],
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in pages.main_text(df).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert got[1] == ["A & B\n\none two three\n\nfour five\n\nx\n\ny"] and got[2] == ["First text of a page.\n\nSecond text."]
    assert got[3] == got[4] == [""] and sorted(got[5]) == ["broken markup <ok", "plain text only"]
    assert got[13] == ["Story number 3 tells of d."]
    spread = {(r.page_id, r.text) for r in pages.main_text(df, most=0).collect()}
    assert spread == {(k, t) for k, v in got.items() for t in v}
    assert pages.main_text(df.where("false")).count() == 0


def test_wrapper_of_all_pages(spark):
    rows = [(k, "http://w/x", page(f"<div><p>Written by staff</p><p>Story number {k} tells of {'abcdefghijklmnop'[k]}.</p></div>")) for k in range(16)]
    odd = [(50, "http://w/x", ""), (51, "http://w/x", "<p>Moved</p>"), (52, "http://w/x", page("<table><tr><td>Another layout</table>"))]
    copies = [(100 + k, "http://c/x", page(f"<p>visits {k}</p><article><p>The only story of this house.</p><p>It goes on and on for long.</p></article>")) for k in range(40)]
    plain = [(200 + k, "http://u/x", page(f"<p>visits {k}</p><div><p>The only story of this house.</p><p>It goes on and on for long.</p></div>")) for k in range(40)]
    df = spark.createDataFrame(rows + odd + copies + plain, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert [got[k] for k in range(16)] == [f"Story number {k} tells of {'abcdefghijklmnop'[k]}." for k in range(16)]
    assert got[50] == "" and got[51] == "Moved" and got[52] == "Another layout"
    assert got[103] == "The only story of this house.\n\nIt goes on and on for long."
    assert "The only story of this house." in got[203] and "It goes on and on for long." in got[203]


def test_frames_are_not_cut_out():
    article = "<article><p>A story that is told at some length.</p><section id='related-work'><h2 id='search-results'>Found</h2><p>Sum <math><mi>x</mi></math></p></section></article>"
    want = "A story that is told at some length.\n\nFound\n\nSum x"
    for frame in ("<div class='layout has-sidebar'>{}</div>", "<div class='content-with-sidebar'>{}</div>", "<form id='aspnetForm'>{}</form>", "<div class='sidebar layout'>{}</div>"):
        assert pages.extract(page(frame.format(article)), None) == want
    assert pages.extract(page("<form><div><p>Only plain text on this page.</p></div></form><div class='sidebar'>no</div>"), None) == "Only plain text on this page."


def test_parts_of_a_page_are_joined():
    assert pages.extract(page("<article><p>One</p></article><div>x</div><article><p>Two</p><article>In two</article></article><article class='related'>no</article>"), None) == "One\n\nTwo\n\nIn two"
    assert pages.extract(page("<div class='content'><p>One</p></div><p>x</p><section class='post'><p>Two</p></section>"), None) == "One\n\nTwo"


def brute_weight(a, b):
    """Simple tree matching by its recursion."""
    if a.key != b.key:
        return 0
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_weight(x, y))
    return 1 + best[-1][-1]


@pytest.mark.parametrize("seed", range(20))
def test_tree_matching(seed):
    rng = random.Random(seed)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" if depth and rng.random() < 0.8 else "text" for t in rng.choices(["div", "b", "i"], k=rng.randrange(1, 5)))

    def paired(a, b):
        """Nodes of a mapping, by its pairs of texts."""
        return list(pages.Matcher().align(a, b))

    a, b = pages.parse(tree(3)), pages.parse(tree(3))
    pages.shape(a)
    pages.shape(b)
    assert pages.Matcher().weight(a, b) == pages.Matcher().weight(b, a) == brute_weight(a, b)
    ours = paired(a, b)
    assert len({id(x) for x, _ in ours}) == len({id(y) for _, y in ours}) == len(ours)
    again = pages.frame(pages.skeleton(a))
    assert again.size == a.size and pages.Matcher().weight(again, a) == a.size


def long_part(kind, n=40):
    return f"<{kind}>" + "".join(f"<p>Not the story, but line {k} of many others.</p>" for k in range(n)) + f"</{kind.split()[0]}>"


@pytest.mark.parametrize("kind", ["section class='comments'", "form class='newsletter'", "div class='cookie-banner'", "div class='sidebar'", "form", "aside"])
def test_long_parts_are_no_story(spark, kind):
    """However long it is, what is marked as something else stays out."""
    story = "<p>A short story.</p>"
    for body in (f"<article>{story}{long_part(kind)}</article>", f"<div>{story}</div>{long_part(kind)}", f"<main>{story}</main>{long_part(kind)}", f"<div class='content'>{story}{long_part(kind)}</div>", f"<div>{story}</div><section class='comments'><article><p>First!</p></article></section>{long_part(kind)}"):
        assert pages.extract(page(body), None) == "A short story."
    rows = [(k, "http://long/x", page(f"<article><p>Story {k} is short.</p>{long_part(kind, 20 + k)}</article>")) for k in range(3)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {k} is short." for k in range(3)}


def test_what_an_article_keeps():
    parts = ["dialog", "object", "audio", "video", "canvas", "label", "noscript"]
    for tag in parts:
        assert pages.extract(page(f"<article><p>a</p><{tag}><p>story part</p></{tag}></article>"), None) == "a\n\nstory part"
    assert pages.extract(page("<div class='sidebar'><h1>Head</h1><p>All that the page has.</p></div>"), None) == "Head\n\nAll that the page has."
    assert pages.extract(page("<section class='comments'><article><p>First!</p></article></section>"), None) == ""


@pytest.mark.parametrize("seed", range(3))
def test_long_lists_are_matched_exactly(seed):
    """Against the recursion without any bound, on lists past all sizes at which the way of computing changes."""
    rng = random.Random(seed)
    cell = lambda: "<td>" + "".join(f"<{t}>x</{t}>" for t in rng.choices(["b", "i", "u"], k=rng.randrange(3))) + "</td>"
    rows = lambda n: "<table>" + "".join(f"<tr>{''.join(cell() for _ in range(rng.randrange(1, 3)))}</tr>" for _ in range(n)) + "</table>"
    one, two = pages.parse(rows(300)), pages.parse(rows(330))
    pages.shape(one)
    pages.shape(two)
    want = brute_weight(one, two)
    assert pages.Matcher().weight(one, two) == pages.Matcher().weight(two, one) == want
    known = pages.Matcher()
    pairs = list(known.align(one, two))
    assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
    table, other = one.children[0], two.children[0]
    chosen = list(known._pairs(table.children, other.children))
    assert sum(known.weight(table.children[i], other.children[j]) for i, j in chosen) == want - 2
    assert all(a > b and c > d for (a, c), (b, d) in itertools.pairwise(chosen))


def test_wrapper_without_hints(spark):
    """No article, main, class or id: only what varies in the slots of the host tells text from template."""
    rng = random.Random(3)
    html, want = {}, {}
    for k in range(12):
        story = [prose(rng, 20) for _ in range(1 + k % 3)]
        extra = "<ul><li>Read it on paper too</li></ul>" if k % 4 == 0 else ""
        html[k] = f"<html><body><div><div>The Daily House</div><div>All rights of this house are kept</div></div>{extra}<div>{''.join(f'<p>{p}</p>' for p in story)}</div><div><p>Written by our staff</p></div></body></html>"
        want[k] = "\n\n".join(story)
    df = spark.createDataFrame([(k, "http://plain/x", h) for k, h in html.items()], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert got == want
    assert all(pages.extract(h, None) != want[k] for k, h in html.items())


def test_pages_of_any_size():
    for text in ("<a " * 100_000, "<script " * 50_000, "<!" * 100_000, "</" * 100_000, "< " * 100_000, "<a '\"" * 50_000, "</x>" * 50_000, "<b>" * 20_000 + "<p>" * 20_000):
        pages.extract(text, {(1, 1): 9}, of=pages.frame(pages.skeleton(pages.parse(text))))
    deep = [pages.parse("<div>" * 5_000 + f"text {k}" + ("<p>more</p>" * k)) for k in range(2)]
    for tree in deep:
        pages.shape(tree)
    assert pages.Matcher().weight(*deep) == 5_002
    rows = ["<table>" + "".join(f"<tr><td>{k}</td>{'<td>x</td>' * (k * m % 7)}</tr>" for k in range(3_000)) + "</table>" for m in (1, 2)]
    one, two = map(pages.parse, rows)
    pages.shape(one)
    pages.shape(two)
    assert len(list(pages.Matcher().align(one, two))) >= 3_000
    long_ = "<article>" + "<p>word and word</p>" * 250_000 + "</article>"
    assert pages.extract(long_, None).count("word and word") == 250_000
    assert pages.extract("a <3 b <i>c</i> <p title='x>y'>d <e", None) == "a <3 b c\n\nd"



# --- media -------------------------------------------------------------------


def test_media_round_trip():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 64, 65, 384, 385, 2000)] + [b"\xff" * 700, b"\0" * 300]
    files, lengths, padded = media.encode_texts(pa.array(texts, pa.binary()))
    seen = 0
    for rows, payloads, rgb in media.decode_files(files):
        for k, r in enumerate(rows.tolist()):
            seen += 1
            assert payloads[k] == texts[r] + bytes(int(padded[r]) - len(texts[r]))
            general = progressive.decode_scans(files[r])
            assert (progressive.to_rgb(general) == rgb[k]).all()
            assert progressive.payload_of(np.concatenate([c["coefficients"] for c in general["components"].values()])[None])[0][: padded[r]].tobytes() == payloads[k]
    assert seen == len(texts)


def test_inverse_transform():
    rng = np.random.default_rng(2)
    c = rng.integers(-50, 50, (3, 64))
    got = progressive.inverse(c)
    block = np.zeros(64)
    block[progressive.ZIGZAG] = c[1]
    block = block.reshape(8, 8)
    for y, x in ((0, 0), (3, 5), (7, 7)):
        s = sum((1 / math.sqrt(2) if u == 0 else 1) * (1 / math.sqrt(2) if v == 0 else 1) / 4 * block[u, v] * math.cos((2 * y + 1) * u * math.pi / 16) * math.cos((2 * x + 1) * v * math.pi / 16) for u in range(8) for v in range(8))
        assert abs(min(255, max(0, s + 128)) - int(got[1, y, x])) <= 0.51


def test_media_query(documents, clashing):
    rows = ODD + [(70, "same"), (71, "same")]
    got = media.digests(clashing(documents(rows))).collect()
    by = {(r.doc_id, r.n_bytes): r for r in got}
    for i, t in rows:
        b = (t or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        r = by[i, len(b)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert by[70, 4].media_sha256 == by[71, 4].media_sha256 and by[70, 4].feature == by[71, 4].feature
    stored = media.store(documents(rows))
    back = {(r.doc_id, bytes(r.payload).rstrip(b"\0")) for r in media.load(stored).collect()}
    assert back == {(i, (t or "").encode().rstrip(b"\0")) for i, t in rows}
    assert media.digests(documents([])).count() == 0


# --- kernels -----------------------------------------------------------------


def test_words_kernel():
    texts = ["Hello  WORLD", "", "\tä Ö\n", "x" * 70000]
    data, offsets = kernels.flat(pa.array(texts))
    hashes, starts, ends, owner = kernels.words(data, offsets)
    got = [(int(o), bytes(data[a:b]).decode()) for o, a, b in zip(owner, starts, ends, strict=True)]
    assert got == [(n, w) for n, t in enumerate(texts) for w in WORDS.findall(t)]
    assert hashes[0] == kernels.words(*kernels.flat(pa.array(["hello"])))[0][0]


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 1e6 + 0.5])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-9, rel=1e-12)


def test_equal_rows_fall_in_many_chunks(spark, documents):
    """3,000 rows without an id and with one text: no chunk holds many, and their words come near the target."""
    from spanweave.llm import mixing

    docs = documents([(None, "five words in a text", "hot")] * 3_000 + [(k, "a b", "cold") for k in range(50)])
    sized = mixing.sizes(docs)
    assert sized.count() == 3_050 and sized.select("mark").where("size = 5").distinct().count() == 3_000
    chunks = sized.groupBy(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(63))).count().agg(F.max("count")).first()[0]
    assert chunks < 120
    rows = mixing.mix(docs).groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most")).collect()
    assert {r.source: r.n for r in rows} == {"hot": 3_000, "cold": 50}
    assert all(abs(r.taken - r.target) <= 5 and r.most <= 2 for r in rows)


def test_neardup_compares_large_groups_by_blocks(documents, monkeypatch):
    """Groups of more than NEAR texts, most of them not similar enough, post no differences but are compared block by block."""
    posted, links = [], []
    settle, linking = neardup._settle, neardup._join_dense
    monkeypatch.setattr(neardup, "_settle", lambda links, rows: (posted.append(rows.count()), settle(links, rows))[1])
    monkeypatch.setattr(neardup, "_join_dense", lambda *x: (links.append(x[1].count()), linking(*x))[1])
    monkeypatch.setattr(neardup, "NEAR", 10)
    rng, rows = random.Random(11), []
    for group in range(2):
        base = prose(rng, 100).split()
        for i in range(40):
            words = list(base)
            for k in rng.sample(range(100), 1 if i % 5 == 1 else 3):
                words[k] = f"e{rng.randrange(10**6)}"
            rows.append((100 * group + 2 * i, " ".join(words)))
            if i % 4 == 0:
                words[-1] = f"e{rng.randrange(10**6)}"
                rows.append((100 * group + 2 * i + 1, " ".join(words)))
    told = lambda: sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.classes(documents(rows), 3, 85).collect())
    want = sorted(classes(rows, 3, 85))
    for work in (1 << 30, 8000):  # one block a pivot, and several
        posted.clear()
        links.clear()
        monkeypatch.setattr(neardup, "DENSE_WORK", work)
        assert told() == want and sum(links) > 0 and sum(posted) == 0
