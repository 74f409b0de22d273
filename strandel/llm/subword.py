"""Supervised subword embeddings: hashed word and character n-gram vectors averaged per text.

Each feature (a word, a pair of neighbouring words, or a run of 2 to 4 characters) hashes to one
of BUCKETS learned vectors. A pair hashes by the difference of its words' hashes, so that all pairs
of a word and itself share one vector. A text is the mean of its features' vectors, shrunk by PRIOR
vectors of zero so that a text of few features stays near the bias, and a linear softmax turns it
into class probabilities. Training is mini-batch stochastic gradient descent in numpy on a bounded sample
of labelled rows. As the output is linear in the mean, scoring folds vectors and output weights
into one table of logits a bucket, so a whole text costs one look-up a feature.

Long texts run in slices of bounded size, and what a slice leaves open (an unfinished word, the last
word before the edge) goes on into the next. Counts are integers and folded logits are fixed-point
numbers, so a score does not depend on where slices end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandel.llm.words import SPACE, groups, mix, slices

BUCKETS = 1 << 15
SIZES = (2, 3, 4)
SLICE = 1 << 19
PRIOR = 24.0
#: Folded logits are whole multiples of 1 / POINT, whose sums are exact in any order.
POINT = 1 << 20
_SHIFT = np.uint64(64 - 15)
_STEP = np.uint32(0x01000193)


@dataclass(frozen=True)
class Model:
    """classes in order; logits: (BUCKETS, classes) folded table; bias; temperature."""

    classes: tuple
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h.astype(np.uint64) + np.uint64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> _SHIFT).astype(np.int32)


def _ngrams(chars: np.ndarray, bounds: np.ndarray, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first of each text and the end, buckets) of the runs of each size that begin before `end` and lie in one text."""
    h = chars.astype(np.uint32) * _STEP + np.uint32(17)
    own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * _STEP + chars[n - 1 :]
        if n not in SIZES:
            continue
        whole = own[: len(h)] == own[n - 1 :]
        whole[end:] = False
        yield np.concatenate(([0], np.cumsum(whole)))[np.minimum(bounds, len(h))], _bucket(h[whole], n)


def _spaces(chars: np.ndarray) -> np.ndarray:
    out, low = np.zeros(len(chars), bool), chars < 128
    out[low] = SPACE[chars[low]]
    return out


def _words(chars: np.ndarray, inside: np.ndarray, starts: np.ndarray, before: int = 0) -> np.ndarray:
    """Hash of each stretch of `inside` that begins at `starts`; the first one has `before` characters ahead of it.

    A word's hash is a sum over its characters and their places in it, so that parts of a word add up.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(starts[0], len(chars)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(chars)]))))
    at[: starts[1] - starts[0] if len(starts) > 1 else len(at)] += before
    value = mix(chars[starts[0] :].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(32))) * inside[starts[0] :]
    return np.add.reduceat(value, starts - starts[0])


def _linked(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each text and the end, buckets) of the pairs of neighbouring words of a text."""
    with np.errstate(over="ignore"):
        step = words[1:] - words[:-1]
    within = np.ones(len(step), bool)
    edges = first[1:-1] - 1
    within[edges[(edges >= 0) & (edges < len(within))]] = False
    return np.concatenate(([0], np.cumsum(within)))[np.minimum(first, len(within))], _bucket(step[within], 10)


def _short(texts: list[str], a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features of the whole texts a to b at once."""
    chars, rows = _points("".join(texts[a:b])), np.arange(a, b)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts[a:b]]))).astype(np.int64)
    for starts, buckets in _ngrams(chars, bounds, len(chars)):
        yield rows, starts, buckets
    inside, fresh = ~_spaces(chars), np.zeros(len(chars) + 1, bool)
    fresh[bounds] = True
    s = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | fresh[:-1])) if len(chars) else np.zeros(0, np.int64)
    words, first = _words(chars, inside, s), np.searchsorted(s, bounds, "left")
    yield rows, first, _bucket(words, 9)
    yield rows, *_linked(words, first)


def _long(text: str, row: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features of one long text, slice by slice."""
    rows, all_of = np.array([row]), lambda x: np.array([0, len(x)])
    part, size = np.zeros(0, np.uint64), 0  # the sum and length of a word that the last slice left unfinished
    last = np.zeros(0, np.uint64)  # the last finished word
    for at in range(0, len(text), SLICE):
        to = min(len(text), at + SLICE)
        chars = _points(text[at : to + max(SIZES) - 1])
        for _, buckets in _ngrams(chars, np.array([0, len(chars)]), to - at):
            yield rows, all_of(buckets), buckets
        body = chars[: to - at]
        inside = ~_spaces(body)
        s = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        goes_on = size > 0 and bool(inside[0])
        words = _words(body, inside, s, size if goes_on else 0)
        with np.errstate(over="ignore"):
            if goes_on:
                words[0] += part[0]
            elif size:
                words = np.concatenate((part, words))
        begun = len(body) - int(s[-1]) + (size if goes_on and len(s) == 1 else 0) if len(s) and inside[-1] else 0
        if begun and to < len(text):
            words, part, size = words[:-1], words[-1:], begun
        else:
            part, size = part[:0], 0
        yield rows, all_of(words), _bucket(words, 9)
        chain = np.concatenate((last, words))
        _, buckets = _linked(chain, np.array([0, len(chain)]))
        yield rows, all_of(buckets), buckets
        last = chain[-1:]


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of the texts, first feature of each and the end, buckets), kind by kind, slice by slice."""
    sizes = np.array([len(t) for t in texts], np.int64)
    for a, b in groups(sizes, SLICE):
        yield from _long(texts[a], a) if b - a == 1 and sizes[a] > SLICE else _short(texts, a, b)


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """Class probabilities of whole texts; a text without features gets those of the bias alone."""
    k = len(model.classes)
    total, count = np.zeros((len(texts), k), np.int64), np.zeros(len(texts), np.int64)
    table = [np.round(model.logits[:, c].astype(float) * POINT).astype(np.int32) for c in range(k)]
    for rows, starts, buckets in features(texts):
        count[rows] += np.diff(starts)
        for c in range(k):
            sums = np.concatenate(([0], np.cumsum(table[c][buckets], dtype=np.int64)))
            total[rows, c] += np.diff(sums[starts])
    z = (total / POINT / (count + PRIOR)[:, None] + model.bias) / model.temperature
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each whole text and their shares of its features."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for rows, starts, buckets in features(texts):
        for i, a, b in zip(rows.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            found[i].append(np.unique(buckets[a:b], return_counts=True))
    out = []
    for parts in found:
        total = np.zeros(BUCKETS, np.int64)
        for x, n in parts:
            total[x] += n
        at = np.flatnonzero(total)
        out.append((at.astype(np.int32), (total[at] / (PRIOR + total.sum())).astype(np.float32)))
    return out


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def training_bags(docs: DataFrame, labels: DataFrame, most_rows: int) -> pd.DataFrame:
    """label, weight, buckets and shares of at most about `most_rows` labelled rows, whole texts.

    `labels` (doc_id, label) are drawn by the hash of doc_id, evenly by label, with the weight
    that gives each label its share in the corpus. The draw is bounded, so its ids are broadcast.
    """
    n_of = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(most_rows).collect()}
    if not n_of:
        return pd.DataFrame({"label": [], "weight": [], "buckets": [], "shares": []})
    each = max(1, most_rows // len(n_of))
    rows = labels.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in n_of.items()], labels.select("label", F.lit(1.0).alias("share")).schema)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    drawn = labels.join(F.broadcast(rows), "label").filter(chance < F.col("share")).select("doc_id", "label")
    schema = "label string, buckets binary, shares binary"  # packed: the driver holds 6 bytes a distinct feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            got = bags([x or "" for x in b.column(1).to_pylist()])
            yield pa.record_batch([b.column(0), pa.array([x.astype("<u2").tobytes() for x, _ in got], pa.binary()), pa.array([y.astype("<f4").tobytes() for _, y in got], pa.binary())], names=["label", "buckets", "shares"])

    got = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(F.col("label").cast("string"), "text").mapInArrow(run, schema).toPandas()
    total = sum(n_of.values())
    share = {str(k): n / total for k, n in n_of.items()}
    seen = got.label.value_counts()
    got["weight"] = [share[x] * len(got) / seen[x] for x in got.label]
    got["order"] = [zlib.crc32(x + y) for x, y in zip(got.buckets, got.shares, strict=True)]
    return got.sort_values(["order", "label"], kind="stable", ignore_index=True).drop(columns="order")


def train(rows: pd.DataFrame, width: int = 12, epochs: int = 12, rate: float = 1.0, batch: int = 16, seed: int = 7) -> Model:
    """Fits vectors and softmax by stochastic gradient descent, then a temperature on a tenth set aside."""
    classes = tuple(sorted(set(rows.label))) if len(rows) else ("",)
    k, rng = len(classes), np.random.default_rng(seed)
    y = np.array([classes.index(x) for x in rows.label], int)
    weight = np.array(rows.weight, float)
    bags_ = [(np.frombuffer(a, "<u2"), np.frombuffer(s, "<f4")) for a, s in zip(rows.buckets, rows.shares, strict=True)]
    vectors = rng.normal(0, 0.3, (BUCKETS, width)).astype(np.float32)
    out, bias = np.zeros((width, k), np.float32), np.zeros(k, np.float32)
    aside = np.arange(len(y)) % 10 == 3 if len(y) >= 200 else np.zeros(len(y), bool)
    fit = np.flatnonzero(~aside)
    steps, done = max(1, epochs * -(-len(fit) // batch)), 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for a in range(0, len(fit), batch):
            pick = fit[a : a + batch]
            lengths = [len(bags_[i][0]) for i in pick]
            at = np.concatenate([bags_[i][0] for i in pick]).astype(np.int64) if sum(lengths) else np.zeros(0, np.int64)
            share = np.concatenate([bags_[i][1] for i in pick]) if len(at) else np.zeros(0, np.float32)
            doc = np.repeat(np.arange(len(pick)), lengths)
            mean = np.zeros((len(pick), width), np.float32)
            for d in range(width):
                mean[:, d] = np.bincount(doc, share * vectors[at, d], len(pick))
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= weight[pick][:, None]
            step = rate * (1 - done / steps)
            pull = (p @ out.T).astype(np.float32)
            out -= step * (mean.T @ p).astype(np.float32)
            bias -= step * 0.1 * p.sum(0).astype(np.float32)
            np.subtract.at(vectors, at, step * 10 * share[:, None] * pull[doc])
            done += 1
    model = Model(classes, (vectors @ out).astype(np.float32), bias.astype(float))
    if not aside.any():
        return model
    z = np.stack([np.array([(model.logits[bags_[i][0]] * bags_[i][1][:, None]).sum(0) + model.bias]).ravel() for i in np.flatnonzero(aside)])
    heat = np.geomspace(0.5, 8, 25)
    loss = []
    for t in heat:
        p = np.exp(z / t - (z / t).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss.append(-(np.log(np.maximum(p[np.arange(len(z)), y[aside]], 1e-9)) * weight[aside]).sum())
    return Model(classes, model.logits, model.bias, float(heat[int(np.argmin(loss))]))
