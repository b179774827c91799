"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the mark of a word's start before it. Its best
segmentation under a unigram model over a public vocabulary follows from the
best segmentations of its prefixes. All distinct pre-tokens of a task go into a
trie, in which every prefix is one node; nodes are scored level by level, each
once, from their ancestors, and the counts at the words' ends are kept for the
rest of the task. Levels that many words reach are arrays; below them the trie's
few branches are walked node by node. Documents then add up their words' counts.
There is no shuffle.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MODEL = os.environ.get("ECHOFOLD_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
U = np.uint64
BASE = 0x9E3779B97F4A7C15
SPARSE = 16


class Vocabulary:
    """Pieces and scores. The file ranks its pieces and gives no probabilities: by Zipf's law, rank r has log-probability -ln(r + 2.7).

    A character that no piece covers is spelt in bytes, one token a byte, each
    ten below the least likely piece.
    """

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        score = -np.log(np.arange(len(pieces)) + 2.7)
        self.scores = dict(zip(pieces, score.tolist()))
        self.unknown = float(score.min()) - 10
        self.longest = max(map(len, pieces))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(p) for p in pieces}):
            mine = [p for p in pieces if len(p) == n]
            codes = np.array([[ord(c) for c in p] for p in mine], dtype=U)
            h = _hash_rows(codes)
            order = np.argsort(h)
            h = h[order]
            if (h[1:] == h[:-1]).any():
                raise ValueError("two pieces have one hash")
            self.by_length[n] = h, np.array([self.scores[p] for p in mine])[order]

    def alone(self, word: str) -> int:
        """Tokens of one word, by itself, for comparison."""
        w = MARK + word
        best = [(0.0, 0)]
        for i in range(1, len(w) + 1):
            tokens = len(w[i - 1].encode("utf-8", "replace"))
            s, n = best[i - 1]
            top = (s + self.unknown * tokens, n + tokens)
            if w[i - 1] in self.scores:
                top = None
            for k in range(max(0, i - self.longest), i):
                p = self.scores.get(w[k:i])
                if p is not None:
                    got = (best[k][0] + p, best[k][1] + 1)
                    if top is None or got[0] > top[0] or (got[0] == top[0] and got[1] < top[1]):
                        top = got
            best.append(top)
        return best[-1][1]


def _hash_rows(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), U)
        for k in range(codes.shape[1]):
            h = h * U(BASE) + codes[:, k] + U(1)
        return h


def counts(words: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """Tokens of each of these distinct words."""
    return _trie([MARK + w for w in words], vocabulary) if words else np.zeros(0, np.int64)


def _trie(words: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """Level by level: all prefixes of one length are one array; a node knows its parent and its last character.

    Where no more than SPARSE words go on, their branches are followed in ``_branches``.
    """
    sizes = np.array([len(w) for w in words])
    order = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    live = len(words)
    node = np.zeros(live, np.int64)  # of each word, at the level before
    # per level: prefix hash, score, tokens, parent
    levels = [(np.zeros(1, U), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    powers = [U(1)]
    ends = np.zeros(len(words), np.int64)
    for depth in range(1, int(sizes[0]) + 1):
        live = int(np.searchsorted(-sizes, -depth, "right"))
        if live <= SPARSE:
            break
        code = flat[starts[:live] + depth - 1]
        key = node[:live] << 21 | code
        seen, first, node = np.unique(key, return_index=True, return_inverse=True)
        parent, char = seen >> 21, (seen & ((1 << 21) - 1)).astype(U)
        with np.errstate(over="ignore"):
            powers.append(powers[-1] * U(BASE))
            whole = levels[-1][0][parent] * U(BASE) + char + U(1)
        c = char.astype(np.int64)
        width = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        width = np.where((c >= 0xD800) & (c < 0xE000), 1, width)
        score = levels[-1][1][parent] + vocabulary.unknown * width
        tokens = levels[-1][2][parent] + width
        covered = np.zeros(len(seen), bool)
        up = np.arange(len(seen))
        at = parent
        for n in range(1, min(depth, vocabulary.longest) + 1):
            before = levels[depth - n]
            if n > 1:
                at = levels[depth - n + 1][3][at]
            if n not in vocabulary.by_length:
                continue
            known, value = vocabulary.by_length[n]
            with np.errstate(over="ignore"):
                h = whole - before[0][at] * powers[n]
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = np.flatnonzero(known[place] == h)
            s = before[1][at[hit]] + value[place[hit]]
            t = before[2][at[hit]] + 1
            better = (s > score[hit]) | ((s == score[hit]) & (t < tokens[hit]))
            if n == 1:
                better[:] = True
            better = hit[better], s[better], t[better]
            score[better[0]], tokens[better[0]] = better[1], better[2]
        levels.append((whole, score, tokens, parent))
        over = np.flatnonzero(sizes[:live] == depth)
        ends[over] = tokens[node[over]]
        if depth > vocabulary.longest:
            levels[depth - vocabulary.longest - 1] = None
    depth = len(levels) - 1
    below: dict[int, list[int]] = {}
    for i in range(int(np.searchsorted(-sizes, -depth, "left"))):
        below.setdefault(int(node[i]), []).append(i)
    for at, mine in below.items():
        before = []
        for up in range(depth, max(-1, depth - vocabulary.longest), -1):
            _, score, tokens, parent = levels[up]
            before.append((float(score[at]), int(tokens[at])))
            at = int(parent[at])
        for i, n in _branches({i: words[order[i]] for i in mine}, depth, before[::-1], vocabulary):
            ends[i] = n
    out = np.zeros(len(words), np.int64)
    out[order] = ends
    return out


def _branches(words: dict[int, str], depth: int, before: list[tuple[float, int]], vocabulary: Vocabulary) -> Iterator[tuple[int, int]]:
    """(word, tokens) of words that share the node at ``depth``; ``before`` has (score, tokens) of it and its ancestors, nearest last."""
    pieces, longest = vocabulary.scores, vocabulary.longest
    todo = [(list(words), depth, before)]
    while todo:
        mine, at, best = todo.pop()
        while mine:
            kids: dict[str, list[int]] = {}
            for i in mine:
                if len(words[i]) == at:
                    yield i, best[-1][1]
                else:
                    kids.setdefault(words[i][at], []).append(i)
            mine = []
            at += 1
            for char, group in kids.items():
                w = words[group[0]]
                if char in pieces:
                    top = None
                else:
                    spelt = len(char.encode("utf-8", "replace"))
                    top = (best[-1][0] + vocabulary.unknown * spelt, best[-1][1] + spelt)
                for n in range(1, min(at, longest, len(best)) + 1):
                    value = pieces.get(w[at - n : at])
                    if value is not None:
                        got = (best[-n][0] + value, best[-n][1] + 1)
                        if top is None or got[0] > top[0] or (got[0] == top[0] and got[1] < top[1]):
                            top = got
                if len(kids) == 1:
                    mine = group
                    best.append(top)
                    if len(best) > 4 * longest:
                        del best[:-longest]
                else:
                    todo.append((group, at, [*best[-longest:], top]))


class Counter:
    """Counts of whole texts; words once counted are kept, up to a number of them."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 600_000):
        self.vocabulary, self.keep, self.known = vocabulary, keep, {}

    def __call__(self, texts: list[str | None]) -> list[int]:
        split = [t.split() if t else [] for t in texts]
        if len(self.known) > self.keep:
            self.known = {}
        new = {w for ws in split for w in ws}.difference(self.known)
        if new:
            new = sorted(new)
            self.known.update(zip(new, counts(new, self.vocabulary).tolist()))
        get = self.known.__getitem__
        return [sum(map(get, ws)) for ws in split]


def count(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row; ``model`` is the vocabulary's file on every executor.

    Null and blank texts have 0 of both. Texts are counted whole; a word of any
    length is segmented whole. Rows without an id and repeated rows are counted
    like others. Other columns are not read. An empty table gives an empty result.
    """

    @F.pandas_udf("struct<n_words: long, n_tokens: long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(Vocabulary(model))
        for s in batches:
            texts = s.tolist()
            yield pd.DataFrame({"n_words": [len(t.split()) for t in texts], "n_tokens": counter(texts)}, dtype="int64")

    got = run(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), got.alias("c")).select("doc_id", "c.n_words", "c.n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(common.table(spark, sf_dir, "documents"))
