"""Toxicity by subword bags, averaged into a linear softmax.

A word is the mean of the vectors of its byte n-grams (ends marked), so that
spellings never seen share vectors with known ones; a window of words is the
mean of its distinct words, and a linear softmax over two classes reads it; a text is as
toxic as its worst window, so that length doesn't dilute it. Vectors and softmax are
trained jointly, in numpy, on a bounded sample of labelled texts. Scoring is one
scan: the softmax's logit is linear in the n-grams, so each bucket of the trained
table comes down to one number, and whole texts are scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIZES = (3, 4, 5)
BUCKETS = 1 << 20
LEAST = 4
DIM = 8
PER_CLASS = 1_200
STEPS = 300
WINDOW = 24
SPACE = 32
SLICE = 250_000
MULTIPLIER = 0x9E3779B97F4A7C15


def raw_bytes(texts: list[str]) -> list[bytes]:
    """Each text in lower case, its words parted and enclosed by one space."""
    return [(" " + " ".join(t.lower().split()) + " ").encode("utf-8", "replace") if t and not t.isspace() else b" " for t in texts]


def word_marks(texts: list[str]) -> np.ndarray:
    """A hash of each word, in order: what tells words apart, whatever their number in the table."""
    b = np.frombuffer(b"".join(raw_bytes(texts)), np.uint8)
    space = np.flatnonzero(b == SPACE)
    real = np.flatnonzero(np.diff(space) > 1)
    first, end = space[real] + 1, space[real + 1]
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.r_[np.ones(1, np.uint64), np.full(len(b), x, np.uint64)], dtype=np.uint64) for x in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)))
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)]
        return (sums[end] - sums[first]) * down[first]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, their words, document of each word, words per document), n-gram size by size.

    Words are parted by white space and lower-cased. A word number without
    n-grams parts two documents and counts for none.
    """
    raw = raw_bytes(texts)
    b = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(x) for x in raw])
    space = b == SPACE
    count = np.cumsum(space)
    word = count - 1
    at = np.flatnonzero(space)
    doc_of = np.searchsorted(np.cumsum(sizes), at, "right")
    real = np.zeros(len(at), bool)
    real[:-1] = np.diff(at) > 1
    per_doc = np.bincount(doc_of[real], minlength=len(texts))
    h = b.astype(np.uint32)
    with np.errstate(over="ignore"):
        for n in range(2, max(SIZES) + 1):
            if len(b) < n:
                return
            h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :]
            if n not in SIZES:
                continue
            inner = count[n - 2 : len(b) - 1] - count[: len(b) - n + 1]
            good = np.flatnonzero(inner == 0)
            mixed = (h[good] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            yield (mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1), word[good], doc_of, per_doc


@dataclass
class Model:
    table: np.ndarray
    bias: float
    cut: float

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability that each text is toxic; 0 for texts without words."""
        out = np.zeros(len(texts))
        start = 0
        while start < len(texts):
            size, end = 0, start
            while end < len(texts) and (end == start or size < SLICE):
                size += len(texts[end] or "")
                end += 1
            out[start:end] = self._some(texts[start:end])
            start = end
        return out

    def _some(self, texts: list[str]) -> np.ndarray:
        value, doc = word_values(texts, self.table)
        if not len(value):
            return np.zeros(len(texts))
        window, owner, value = distinct(*windows(doc), value, word_marks(texts))
        logit = np.bincount(window, value, len(owner)) * WINDOW / np.maximum(np.bincount(window), WINDOW) + self.bias
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, owner, logit)
        return 1 / (1 + np.exp(-np.clip(out, -50, 50))) * np.isfinite(out)


def word_values(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean of the buckets' numbers, document) of each word, in order."""
    sums = many = doc = None
    for bucket, word, doc_of, _ in grams(texts):
        n = len(doc_of)
        s, m = np.bincount(word, table[bucket], n), np.bincount(word, minlength=n)
        sums, many, doc = (s, m, doc_of) if sums is None else (sums + s, many + m, doc)
    if sums is None:
        return np.zeros(0), np.zeros(0, np.int64)
    real = np.flatnonzero(many)
    return sums[real] / many[real], doc[real]


def distinct(window: np.ndarray, owner: np.ndarray, value: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word of a window once, as in training, so that a word said over and over counts once."""
    order = np.lexsort((mark, window))
    w, m = window[order], mark[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (m[1:] != m[:-1])
    return w[new], owner, value[order][new]


def windows(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window of each word, document of each window): each document in runs of WINDOW words.

    A shorter run counts as filled up with words of no weight. A last run of under half a window belongs to the one before it.
    """
    first = np.r_[True, doc[1:] != doc[:-1]]
    start = np.flatnonzero(first)
    n = np.diff(np.r_[start, len(doc)])
    runs = np.maximum(1, (n + WINDOW // 2) // WINDOW)
    at = np.arange(len(doc)) - np.repeat(start, n)
    run = np.minimum(at // WINDOW, np.repeat(runs, n) - 1)
    window = run + np.repeat(np.cumsum(runs) - runs, n)
    return window, np.repeat(doc[start], runs)


def _texts_by_bucket(doc: np.ndarray, ids: np.ndarray, bucket: np.ndarray, word: np.ndarray, words: int, step: int = 50_000) -> np.ndarray:
    """In how many texts each bucket stands, for those that too few hold can't be learnt from; a slice of the texts at a time."""
    order = np.argsort(word, kind="stable")
    by_word = bucket[order]
    size = np.bincount(word, minlength=words)
    first = np.cumsum(size) - size
    pairs = np.unique(doc * words + ids)
    out = np.zeros(BUCKETS, np.int32)
    cut = 0
    while cut < len(pairs):
        # whole texts only, or a text's bucket would count twice
        end = min(len(pairs), cut + step)
        end = int(np.searchsorted(pairs, (pairs[end - 1] // words + 1) * words))
        d, w = pairs[cut:end] // words, pairs[cut:end] % words
        n = size[w]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[w], n)
        out += np.bincount(np.unique(np.repeat(d, n) * BUCKETS + by_word[at]) % BUCKETS, minlength=BUCKETS).astype(np.int32)
        cut = end
    return out


def train(texts: list[str], toxic: list[int], steps: int = STEPS, seed: int = 7) -> Model:
    """All vectors, the softmax and its bias, by gradient descent with momentum on the whole sample.

    A text is as toxic as its worst window: its logit is a soft maximum over
    windows, soft enough at first that all windows learn and hard at the end.
    With two classes the softmax's gradient is one number a text, so that the
    gradient of a bucket's vector is a multiple of the difference of the two
    softmax rows. A fifth of the sample is held out to set ``cut``, the lowest
    value from 0.4 up that at most one in 500 held-out clean texts passes.
    Buckets that fewer than LEAST of the sample's texts hold have no vector; a
    word of such buckets alone has the value 0 here and in scoring.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(toxic, dtype=np.float64)
    held = rng.permutation(len(texts)) < len(texts) // 5
    known: dict[str, int] = {}
    ids, docs = [], []
    for i in np.flatnonzero(~held):
        w = (texts[i] or "").lower().split()
        ids.extend(known.setdefault(x, len(known)) for x in w)
        docs.append(np.full(len(w), i))
    if not ids or not y[~held].any() or y[~held].all():
        return Model(np.zeros(BUCKETS), -np.inf, 0.5)
    ids, doc = np.array(ids), np.concatenate(docs)
    some = list(grams([" ".join(known)]))
    bucket, word = np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some]).astype(np.int32)
    del some
    share = 1 / np.bincount(word, minlength=len(known))
    held_by = _texts_by_bucket(doc, ids, bucket, word, len(known))
    bucket, word = bucket[held_by[bucket] >= LEAST], word[held_by[bucket] >= LEAST]
    window, owner = windows(doc)
    at = np.unique(window * len(known) + ids)
    window, ids = at // len(known), at % len(known)
    scale = WINDOW / np.maximum(np.bincount(window), WINDOW)
    used = np.unique(bucket)
    code = np.searchsorted(used, bucket).astype(np.int32)
    del bucket
    vectors, rows, bias = rng.normal(0, 0.01, (len(used), DIM)), rng.normal(0, 0.3, (2, DIM)), -2.0
    speed = [np.zeros_like(vectors), np.zeros_like(rows), 0.0]
    texts_with = np.unique(owner)
    heavy = np.zeros(len(y))
    heavy[texts_with] = np.where(y[texts_with] > 0, 0.5 / max(1, y[texts_with].sum()), 0.5 / max(1, (1 - y[texts_with]).sum()))
    runs = np.bincount(owner, minlength=len(y))
    for step in range(steps):
        slope = rows[1] - rows[0]
        value = np.bincount(word, (vectors @ slope)[code], len(known)) * share
        z = np.bincount(window, value[ids], len(owner)) * scale + bias
        sharp = 4.0 * step / steps
        top = np.full(len(y), -np.inf)
        np.maximum.at(top, owner, z)
        e = np.exp(sharp * (z - top[owner]))
        total = np.bincount(owner, e, len(y))
        pooled = np.zeros(len(y))
        pooled[texts_with] = top[texts_with] + (np.log(total[texts_with] / runs[texts_with]) / sharp if sharp else 0)
        if not sharp:
            pooled[texts_with] = (np.bincount(owner, z, len(y)) / np.maximum(runs, 1))[texts_with]
        g = (1 / (1 + np.exp(-np.clip(pooled, -50, 50))) - y) * heavy
        gz = g[owner] * e / total[owner]
        by_word = np.bincount(ids, (gz * scale)[window], len(known)) * share
        per = np.bincount(code, by_word[word], len(used))
        push = per @ vectors
        for i, grad in enumerate((per[:, None] * slope, np.stack([-push, push]))):
            speed[i] = 0.9 * speed[i] + 0.1 * grad
        speed[2] = 0.9 * speed[2] + 0.1 * g.sum()
        # one pace for the whole table: what many texts agree on moves, what one text holds hardly does
        pace = 0.2 / max(np.abs(speed[0]).max(), 1e-5)
        vectors -= pace * speed[0] + 1e-3 * vectors
        rows -= 0.5 * speed[1] + 1e-3 * rows
        bias -= 2.0 * speed[2]
    table = np.zeros(BUCKETS, np.float32)
    table[used] = vectors @ (rows[1] - rows[0])
    model = Model(table, float(bias), 0.5)
    clean = np.flatnonzero(held & (y == 0))
    if len(clean):
        got = np.sort(model.score([texts[i] for i in clean]))
        model.cut = min(0.99, max(0.4, float(got[len(got) - 1 - len(got) // 500])))
    return model


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int]]:
    """At most ``per_class`` labelled texts of each class, in the order of a hash of the id. The one bounded step."""
    told = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).where("__y in (0, 1)")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).where(F.col(text_col).isNotNull())
    ids = []
    for k in (0, 1):
        ids += [r[0] for r in told.where(F.col("__y") == k).select("__id").distinct().orderBy(F.xxhash64("__id"), "__id").limit(per_class).collect()]
    picked = docs.sparkSession.createDataFrame([(i,) for i in set(ids) if i is not None], "__id long")
    got = rows.join(F.broadcast(picked), "__id").join(told, "__id").select("__id", "__t", F.col("__y").cast("int").alias("__y")).distinct().collect()
    got = sorted(got, key=lambda r: (r["__id"], r["__t"], r["__y"]))
    return [r["__t"] for r in got], [r["__y"] for r in got]


def scorer(model: Model):
    """Column function: text to probability; null and blank texts get 0."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.round(model.score(s.tolist()), 6))

    return lambda text: score(F.coalesce(text, F.lit("")))


def judge(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, toxicity, toxic) for every row of ``docs``.

    The model is fitted on at most ``per_class`` labelled texts a class; the
    scan then scores all texts, whole. Null and blank texts score 0; rows
    without an id are scored too, and repeated rows alike. Without labels of
    both classes nothing is toxic. Other columns are not read. An empty table
    gives an empty result.
    """
    model = train(*sample(docs, labels, per_class, id_col, text_col))
    return docs.select(F.col(id_col).alias("doc_id"), scorer(model)(F.col(text_col)).alias("toxicity")).withColumn("toxic", F.col("toxicity") > F.lit(model.cut))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model doesn't call toxic."""
    model = train(*sample(docs, common.table(spark, sf_dir, "labels")))
    return docs.where(scorer(model)(F.col("text")) <= F.lit(model.cut))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
