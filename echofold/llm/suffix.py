"""Suffix-array dedup of passages by deep-shallow sorting.

A passage of ``LEAST`` words is a repeat if the same words stand elsewhere, and
all its occurrences but the first, by (doc_id, place), are duplicates. The
suffixes that matter are found first: of each run of LEAST words one anchor is
chosen by its content alone (the least hash of GRAM words), so that equal runs
have equal anchors, and runs whose anchor occurs once in all texts repeat
nowhere. The suffixes of the other runs, with the words that tell them apart,
are parted by anchor, and each part's suffix array is built by deep-shallow
sorting: multikey quicksort to a shallow depth, all segments at a time, then a
blind trie for each group that still shares its prefix. Neighbours in the array
that share LEAST words are the repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAST = 50
GRAM = 16
SHALLOW = 6
U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PER_PART = 40_000


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and words per text."""
    split = [t.split() if t else [] for t in texts]
    many = np.array([len(w) for w in split], dtype=np.int64)
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x) for w in split for x in w), U, int(many.sum())), many


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n + 1, U)
    with np.errstate(over="ignore"):
        if n:
            out[1:] = np.cumprod(np.full(n, base, U), dtype=U)
    return out


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place where as many follow."""
    n = len(words)
    if n < size:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        sums = np.r_[np.zeros(1, U), np.cumsum(words * _powers(BASE, n)[:n], dtype=U)]
        h = (sums[size:] - sums[:-size]) * _powers(INVERSE, n)[: n - size + 1]
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
        return h ^ (h >> U(32))


def _least(h: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` values, by doubling."""
    out, have = h, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(words: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, anchor, its hash) of every run of LEAST words within a text; starts count over all texts.

    The anchor is the leftmost least gram of the run.
    """
    span = LEAST - GRAM + 1
    h = gram_hashes(words, GRAM)
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    low = _least(h, span)
    ends = np.repeat(np.cumsum(many), many)
    start = np.flatnonzero(np.arange(len(low)) + LEAST <= ends[: len(low)])
    if not len(start):
        return start, start, np.zeros(0, U)
    # the leftmost place of a run's least hash: the next place, from the start on, where that hash stands
    order = np.argsort(h, kind="stable")
    rank = np.searchsorted(h[order], low[start], "left")
    first = order[rank]
    late = np.flatnonzero(first < start)
    if len(late):
        s, v = start[late], low[start[late]]
        a = rank[late]
        b = np.searchsorted(h[order], v, "right")
        # places of one hash are ascending; find the first not before the start
        while (b - a > 0).any():
            mid = (a + b) // 2
            less = (order[np.minimum(mid, len(order) - 1)] < s) & (a < b)
            b = np.where(~less & (a < b), mid, b)
            a = np.where(less, mid + 1, a)
        first[late] = order[a]
    return start, first, h[first]


def shallow_sort(text: np.ndarray, starts: np.ndarray, depth: int = SHALLOW) -> list[np.ndarray]:
    """Multikey quicksort of the suffixes at ``starts``, to ``depth`` words.

    Every round parts all open segments by their pivots' word at the depth of
    the segment: less, equal, more; equal ones go a word deeper. Returns the
    groups that share ``depth`` words, in order.
    """
    n = len(starts)
    order = np.arange(n)
    seg = np.zeros(n, np.int64)  # first place of the segment of each place
    deep = np.zeros(n, np.int64)
    live = np.arange(n) if depth > 0 else np.zeros(0, np.int64)
    while len(live):
        s = seg[live]
        head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[head, len(s)])
        open_ = np.repeat(size > 1, size) & (deep[live] < depth)
        live, s = live[open_], s[open_]
        if not len(live):
            break
        head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[head, len(s)])
        word = text[starts[order[live]] + deep[live]]
        pivot = np.repeat(word[head + size // 2], size)
        key = 1 + (word > pivot).astype(np.int64) - (word < pivot)
        part = np.repeat(np.arange(len(head)), size) * 3 + key
        turn = np.argsort(part, kind="stable")
        order[live] = order[live[turn]]
        part, key = part[turn], key[turn]
        new = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        seg[live] = np.repeat(live[new], np.diff(np.r_[new, len(part)]))
        deep[live] = deep[live] + (key == 1)
    cuts = np.flatnonzero(np.diff(seg)) + 1
    return np.split(order, cuts) if n else []


class _Node:
    __slots__ = ("depth", "kids")

    def __init__(self, depth: int):
        self.depth, self.kids = depth, {}


def _shared(a: bytes, b: bytes, least: int) -> int:
    """Words that two keys share, of which ``least`` are known."""
    lo, hi = least, len(a) // 8
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[8 * lo : 8 * mid] == b[8 * lo : 8 * mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def blind_sort(keys: list[bytes], known: int) -> list[list[int]]:
    """Order of keys of eight-byte words that share ``known`` words, equal ones together, by a blind trie.

    A node holds the place of the first word in which its keys differ and
    nothing of what they share. An insertion walks down by those words alone,
    compares with the one leaf it meets, and then knows where to branch off.
    """
    words = len(keys[0]) // 8
    root: _Node | list[int] = [0]
    for i in range(1, len(keys)):
        k = keys[i]
        at = root
        while type(at) is _Node:
            d = at.depth
            at = at.kids.get(k[8 * d : 8 * d + 8]) or next(iter(at.kids.values()))
        other = keys[at[0]]
        if k == other:
            at.append(i)
            continue
        n = _shared(k, other, known)
        over, at = None, root
        while type(at) is _Node and at.depth < n:
            over, at = at, at.kids[k[8 * at.depth : 8 * at.depth + 8]]
        mine = k[8 * n : 8 * n + 8]
        if type(at) is _Node and at.depth == n:
            at.kids[mine] = [i]
            continue
        node = _Node(n)
        node.kids = {other[8 * n : 8 * n + 8]: at, mine: [i]}
        if over is None:
            root = node
        else:
            over.kids[k[8 * over.depth : 8 * over.depth + 8]] = node
    assert words >= known
    out, stack = [], [root]
    while stack:
        at = stack.pop()
        if type(at) is _Node:
            stack.extend(at.kids[w] for w in sorted(at.kids, reverse=True))
        else:
            out.append(at)
    return out


class _Keys:
    """Keys of LEAST words at places of one byte string, cut out only while they are looked at."""

    def __init__(self, raw: bytes, starts: list[int]):
        self.raw, self.starts = raw, starts

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, i: int) -> bytes:
        s = self.starts[i]
        return self.raw[8 * s : 8 * (s + LEAST)]


def repeats(text: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Groups of suffixes that share LEAST words, in the order of the suffix array."""
    raw = text.astype(">u8").tobytes()
    out = []
    for group in shallow_sort(text, starts):
        if len(group) > 1:
            out += [group[x] for x in blind_sort(_Keys(raw, starts[group].tolist()), SHALLOW) if len(x) > 1]
    return out


def _marked(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the spans of words under runs that start at (doc, at)."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + LEAST)] if len(doc) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    last = np.r_[head[1:], len(doc)] - 1 if len(head) else head
    return doc[head], at[head], at[last] + LEAST


def _anchored(texts: list[str]):
    """(words, start, anchor, its hash, text of each start, first word of each text) of a slice of texts."""
    words, many = word_hashes(texts)
    start, at, h = anchors(words, many)
    first = np.cumsum(many) - many
    return words, start, at, h, np.searchsorted(first + many, start, "right"), first


def anchor_rows(docs: DataFrame, id_type: str) -> DataFrame:
    """(doc_id, t, k, at) of (doc_id, t, text): every anchor of every text, with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t, text = batch.columns
            for a, b in common.slices(text):
                _, _, at, h, doc, first = _anchored(text[a:b].to_pylist())
                new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
                row = pa.array(a + doc[new])
                place = pa.array((at[new] - first[doc[new]]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids.take(row), t.take(row), pa.array(h[new].view(np.int64)), place], names=["doc_id", "t", "k", "at"])

    return docs.mapInArrow(run, f"doc_id {id_type}, t long, k long, at int")


def context_rows(held: DataFrame, parts: int, id_type: str) -> DataFrame:
    """(part, salt, doc_id, t, lo, runs, words) of (doc_id, t, text, ats): for each wanted anchor its run of suffixes.

    ``words`` are the hashes of all words under the suffixes, the first of which starts at ``lo``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t, text, ats = batch.columns
            own = t.to_numpy(zero_copy_only=False)
            for a, b in common.slices(text):
                words, start, at, h, doc, first = _anchored(text[a:b].to_pylist())
                told = ats[a:b]
                sizes = told.value_lengths().to_numpy(zero_copy_only=False)
                flat = told.flatten()
                wanted = flat.field("at").to_numpy(zero_copy_only=False) + np.repeat(first, sizes)
                ways = flat.field("ways").to_numpy(zero_copy_only=False)
                by = np.argsort(wanted, kind="stable")
                wanted, ways = wanted[by], ways[by]
                found = np.minimum(np.searchsorted(wanted, at), max(len(wanted) - 1, 0))
                use = np.flatnonzero(wanted[found] == at) if len(wanted) else np.zeros(0, np.int64)
                start, at, h, doc, ways = start[use], at[use], h[use], doc[use], ways[found[use]] if len(use) else ways[:0]
                head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
                runs = np.diff(np.r_[head, len(at)])
                row = a + doc[head]
                salt = (_spread(own[row]) % ways[head].astype(U)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((h[head] % U(parts)).astype(np.int64)),
                        pa.array(salt),
                        ids.take(pa.array(row)),
                        t.take(pa.array(row)),
                        pa.array(start[head] - first[doc[head]]),
                        pa.array(runs),
                        pa.array([words[s : s + r - 1 + LEAST].tobytes() for s, r in zip(start[head].tolist(), runs.tolist())], pa.binary()),
                        pa.array(ways[head] > 1),
                    ],
                    names=["part", "salt", "doc_id", "t", "lo", "runs", "words", "hot"],
                )

    return held.mapInArrow(run, f"part long, salt long, doc_id {id_type}, t long, lo long, runs long, words binary, hot boolean")


def _spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.int64).view(U) * U(BASE)
        return x ^ (x >> U(29))


def sort_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, t, s, e, key) of one part's contexts: spans of late suffixes, and, with a key, the first of each kind of suffix of hot anchors."""
    pdf = pdf.sort_values(["doc_id", "t", "lo"], kind="stable").drop_duplicates(["doc_id", "t", "lo"], ignore_index=True)
    ids, t = pdf["doc_id"], pdf["t"]
    code = ((ids != ids.shift()) | (t != t.shift())).cumsum().to_numpy() - 1
    where = np.flatnonzero(np.r_[True, np.diff(code) > 0])
    runs, lo = pdf["runs"].to_numpy(), pdf["lo"].to_numpy()
    # equal contexts: the first stands for all, and all suffixes of the others are late
    twin = pdf["words"].duplicated().to_numpy()
    out = [(code[twin], lo[twin], lo[twin] + runs[twin] - 1 + LEAST)]
    one = np.flatnonzero(~twin)
    runs, lo, doc, hot = runs[one], lo[one], code[one], pdf["hot"].to_numpy()[one]
    text = np.frombuffer(b"".join(pdf["words"].iloc[one]), U)
    size = runs + LEAST - 1
    inner = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = np.repeat(np.cumsum(size) - size, runs) + inner
    doc, at, hot = np.repeat(doc, runs), np.repeat(lo, runs) + inner, np.repeat(hot, runs)
    # suffixes are numbered by (doc_id, place), so the least number of a group is the first occurrence
    late = [g[g != g.min()] for g in repeats(text, starts)]
    late = np.concatenate(late) if late else np.zeros(0, np.int64)
    out.append(_marked(doc[late], at[late]))
    doc_, s, e = (np.concatenate(x) for x in zip(*out))
    got = pd.DataFrame({"row": where[doc_], "s": s, "e": e, "key": None})
    if hot.any():
        lead = hot.copy()
        lead[late] = False
        lead = np.flatnonzero(lead)
        raw = text.tobytes()
        keys = [xxhash.xxh3_128_digest(raw[8 * x : 8 * (x + LEAST)]) for x in starts[lead].tolist()]
        got = pd.concat([got, pd.DataFrame({"row": where[doc[lead]], "s": at[lead], "e": at[lead] + LEAST, "key": keys})])
    at = got["row"].to_numpy()
    return pd.DataFrame({"doc_id": ids.to_numpy()[at], "t": t.to_numpy()[at], "s": got["s"].to_numpy(), "e": got["e"].to_numpy(), "key": got["key"].to_numpy()})


def spans(docs: DataFrame, per_part: int = PER_PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word): words under a repeat of LEAST words or more whose first occurrence is elsewhere.

    Words are parted by white space, as ``str.split`` does it, and compared
    exactly, up to 64-bit hashes; spans don't overlap or touch. A repeat within
    one text counts like one across texts. Texts that are null or have fewer
    than LEAST words have none. Rows without an id are left out, and a repeated
    row counts once; of different texts under one id the one of lesser hash is
    the first. Whole copies of a text are found by its md5, so that any number
    of them costs one. An anchor with more than ``per_part`` occurrences is
    sorted in several parts, whose first suffixes are then compared by hashes of
    128 bits, so no task holds all of a passage's occurrences. Other columns are
    not read. An empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    each = common.checkpoint(rows.select("doc_id", F.md5("text").alias("m"), common.words(F.col("text")).alias("n")).distinct())
    firsts = each.groupBy("m").agg(F.min("doc_id").alias("d"), F.count("*").alias("c")).where("c > 1").select("m", "d")
    copies = each.where(F.col("n") >= LEAST).join(firsts, "m").where(F.col("doc_id") != F.col("d")).select("doc_id", F.lit(0).alias("s"), F.col("n").cast("int").alias("e"))

    found = common.written(anchor_rows(rows.select("doc_id", "t", "text"), id_type))
    spot = F.xxhash64("t", "at")
    often = found.groupBy("k").agg(F.count("*").alias("c"), F.min(spot).alias("lo"), F.max(spot).alias("hi")).where("lo <> hi")
    often = often.select("k", F.ceil(F.col("c") / F.lit(per_part)).cast("int").alias("ways"))
    shared = found.join(often, "k").groupBy("t", "doc_id").agg(F.collect_set(F.struct("at", "ways")).alias("ats"))
    # of the copies of a text the first stands for all
    per_doc = common.checkpoint(shared.groupBy("t").agg(F.min_by(F.struct("doc_id", "ats"), "doc_id").alias("x")).select(F.col("x.doc_id").alias("d"), F.col("t").alias("u"), "x.ats"))
    parts = common.pieces(per_doc.agg(F.sum(F.size("ats"))).first()[0] or 0, per_part)

    held = rows.join(per_doc, (F.col("doc_id") == F.col("d")) & (F.col("t") == F.col("u"))).select("doc_id", "t", "text", "ats")
    sorted_ = common.checkpoint(context_rows(held, parts, id_type).groupBy("part", "salt").applyInPandas(sort_part, f"doc_id {id_type}, t long, s int, e int, key binary"))
    leads = sorted_.where("key is not null")
    least = leads.groupBy("key").agg(F.min(F.struct("doc_id", "t", "s")).alias("p"))
    later = leads.join(least, "key").where(F.struct("doc_id", "t", "s") != F.col("p"))
    every = copies.unionByName(sorted_.where("key is null").select("doc_id", "s", "e")).unionByName(later.select("doc_id", "s", "e"))
    by = Window.partitionBy("doc_id").orderBy("s", "e")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return (
        every.withColumn("new", F.when(F.col("s") <= before, 0).otherwise(1))
        .withColumn("g", island)
        .groupBy("doc_id", "g")
        .agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"))
        .select("doc_id", "start_word", "end_word")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(common.table(spark, sf_dir, "documents"))


SQL = f"""
with t as (
  select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as ws from documents),
w as (
  select doc_id, i, md5(array_to_string(ws[i + 1:i + {LEAST}], ' ')) as h
  from (select doc_id, ws, unnest(range(0, len(ws) - {LEAST - 1})) as i from t where len(ws) >= {LEAST})),
late as (select doc_id, i as s, i + {LEAST} as e from w qualify row_number() over (partition by h order by doc_id, i) > 1),
m as (
  select *, case when s <= max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from late),
g as (select *, sum(new) over (partition by doc_id order by s, e rows unbounded preceding) as g from m)
select doc_id, cast(min(s) as integer) as start_word, cast(max(e) as integer) as end_word from g group by doc_id, g
"""
