"""URL filters: list rules first, then a ratio of two character models.

URLs that a rule decides are labelled; a bounded sample of them (``sample``
different ones of each class, those of least hash) fits one variable-order Markov model for
accepted and one for rejected URLs. Each model interpolates orders 0 to
``order`` by Witten-Bell smoothing over bytes and an end symbol. A URL without
a rule is scored by (log P_accepted - log P_rejected) / symbols and allowed
from a threshold on, which is the one of best balanced accuracy on the fifth
of the sample that the models have not seen.

Defined cases: a null URL or one without ``://`` has an empty host and path,
fits no rule and is scored as the text it is (null: empty); if only one class
has labelled URLs, its verdict goes to every URL without a rule; if none has,
all are allowed. Of URLs that score alike, all get one verdict. Very long URLs
are scored whole. Repeated rows are judged alike; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import flat
from .shared import table

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = 256
SYMBOLS = 257
BITS = 9


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def _symbols(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all URLs, each closed by END, and the number of the URL of each."""
    data, offsets = flat(pa.array(urls, pa.binary()))
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(urls)), lengths + 1)
    out = np.full(len(data) + len(urls), END, np.int64)
    out[np.arange(len(data)) + np.repeat(np.arange(len(urls)), lengths)] = data
    return out, owner


def _contexts(symbols: np.ndarray, owner: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(context, context with symbol) of orders 0, 1, ...; before a URL's start stand END symbols."""
    context = np.zeros(len(symbols), np.int64)
    first = np.searchsorted(owner, owner)
    yield context, symbols
    for k in range(1, order + 1):
        at = np.arange(len(symbols)) - k
        before = np.where(at >= first, symbols[np.maximum(at, 0)], END)
        context = context | before << (BITS * (k - 1))
        yield context, context << BITS | symbols


def fit(urls: list[bytes], order: int) -> list[tuple[np.ndarray, ...]]:
    """By order: contexts with totals and kinds, and context-symbol keys with counts."""
    model = []
    for context, key in _contexts(*_symbols(urls), order):
        keys, counts = np.unique(key, return_counts=True)
        owners, starts = np.unique(keys >> BITS if len(model) else keys * 0, return_index=True)
        totals = np.add.reduceat(counts, starts) if len(keys) else counts
        kinds = np.diff(np.append(starts, len(keys)))
        model.append((owners, totals, kinds, keys, counts))
    return model


def _find(table_: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table_):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table_, keys), len(table_) - 1)
    return np.where(table_[at] == keys, values[at], 0).astype(np.float64)


def log_likelihood(model: list[tuple[np.ndarray, ...]], urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Natural log-probability and number of symbols of each URL."""
    symbols, owner = _symbols(urls)
    p = np.full(len(symbols), 1 / SYMBOLS)
    for (context, key), (owners, totals, kinds, keys, counts) in zip(_contexts(symbols, owner, len(model) - 1), model, strict=True):
        total, kind = _find(owners, context, totals), _find(owners, context, kinds)
        p = np.where(total > 0, (_find(keys, key, counts) + kind * p) / np.maximum(total + kind, 1), p)
    return np.bincount(owner, np.log(p), len(urls)), np.bincount(owner, minlength=len(urls))


def ratio(accepted: list, rejected: list, urls: list[bytes]) -> np.ndarray:
    good, n = log_likelihood(accepted, urls)
    return (good - log_likelihood(rejected, urls)[0]) / np.maximum(n, 1)


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut of best balanced accuracy; of several, the one nearest to 0."""
    cuts = np.unique(np.concatenate([good, bad]))
    if not len(good) or not len(bad):
        return 0.0
    middle = np.concatenate([cuts[:1] - 1e-9, (cuts[1:] + cuts[:-1]) / 2])
    right = 1 - np.searchsorted(np.sort(good), middle) / len(good) + np.searchsorted(np.sort(bad), middle) / len(bad)
    best = np.flatnonzero(right == right.max())
    return float(middle[best[np.argmin(np.abs(middle[best]))]])


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, order: int = 5, sample: int = 20_000) -> DataFrame:
    """page_id, host, path, rule, verdict and, where no rule fits, the method's score."""
    host, path = parts(F.col("url"))
    pages = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    name, said = rule(F.col("host"), F.col("path"), rules)
    ruled = pages.select("page_id", "url", "host", "path", name.alias("rule"), said.alias("said"))
    labelled = {}
    for verdict in ("allow", "block"):
        rows = ruled.where((F.col("said") == verdict) & F.col("url").isNotNull()).select("url").distinct().orderBy(F.xxhash64("url"), "url").limit(sample).collect()
        labelled[verdict] = [r.url.encode() for r in rows]
    models, cut_at, only = None, 0.0, "allow"
    if labelled["allow"] and labelled["block"]:
        train = {k: [u for i, u in enumerate(v) if i % 5 or len(v) < 5] for k, v in labelled.items()}
        held = {k: v[::5] for k, v in labelled.items()}
        models = fit(train["allow"], order), fit(train["block"], order)
        cut_at = threshold(ratio(*models, held["allow"]), ratio(*models, held["block"]))
    elif labelled["block"]:
        only = "block"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column("said").to_pylist()
            open_ = [i for i, v in enumerate(said) if v is None]
            scores: list[float | None] = [None] * len(said)
            if open_ and models:
                urls = batch.column("url").take(pa.array(open_)).to_pylist()
                own = {u: k for k, u in enumerate(dict.fromkeys(urls))}
                values = ratio(*models, [(u or "").encode() for u in own])
                for i, u in zip(open_, urls, strict=True):
                    scores[i] = float(values[own[u]])
            verdict = [v if v is not None else (only if s is None else "allow" if s >= cut_at else "block") for v, s in zip(said, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), batch.column("rule"), pa.array(verdict, pa.string()), pa.array(scores, pa.float64())],
                ["page_id", "host", "path", "rule", "verdict", "score"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return ruled.mapInArrow(score, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def op3_urls(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))
