"""SimHash near-dedup by multi-index hashing.

A text's fingerprint has 128 bits: the signs of the weighted sum, over its
distinct words and word pairs, of the bits of their hashes. A word weighs its
length beyond three characters (nine at most), which spares the short words
that every text has, and a pair of neighbours weighs one. Distinct fingerprints
are found within ``RADIUS`` bits by multi-index hashing: of m segments, two
fingerprints within r bits agree in some segment up to r/m bits, so all segment
values within that small ball are looked up in a table of the segment, and
complete distances are verified. With more fingerprints segments are fewer and
longer: eight of 16 bits up to some hundreds of thousands, then six, five, four.
A table too large for a task is parted by blocks of its segment: of p + q blocks,
values within p bits have q equal, so a table for each q of them, parted by these,
meets all, and no fingerprint is copied to the parts around its own.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .search import bits_column, bits_of

RADIUS = 23
SEGMENTS = 8
SEG_BITS = 16
U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: str) -> bytes:
        if len(self) > 150_000:
            self.clear()
        x = self[word] = hashlib.md5(word.encode()).digest()
        return x


def fingerprints(texts: list[str], hashes: dict | None = None) -> np.ndarray:
    """(n, 2) uint64 of the lower and upper half; a text without features has 0, 0."""
    hashes = _Hashes() if hashes is None else hashes
    out = np.zeros((len(texts), 2), U)
    held: list[tuple[int, list[str]]] = []
    size = 0
    for i, t in enumerate(texts):
        w = t.split() if t else []
        if w:
            held.append((i, w))
            size += len(w)
        if held and (size > 60_000 or i == len(texts) - 1):
            _some(held, size, hashes, out)
            held, size = [], 0
    if held:
        _some(held, size, hashes, out)
    return out


def _some(held, size, hashes, out) -> None:
    flat = [x for _, w in held for x in w]
    both = np.frombuffer(b"".join(map(hashes.__getitem__, flat)), "<u8").reshape(-1, 2)
    up, low = both[:, 0], both[:, 1]
    length = np.fromiter(map(len, flat), np.int64, size)
    n = np.array([len(w) for _, w in held])
    doc = np.repeat(np.arange(len(held)), n)
    last = np.zeros(size, bool)
    last[np.cumsum(n) - 1] = True
    first = np.flatnonzero(~last)
    # features: words, then neighbouring pairs, whose halves are crossed
    f_low = np.concatenate([low, low[first] ^ up[first + 1]])
    f_up = np.concatenate([up, up[first] ^ low[first + 1]])
    f_doc = np.concatenate([doc, doc[first]])
    weight = np.concatenate([np.clip(length, 3, 12) - 3, np.ones(len(first), np.int64)]).astype(np.int16)
    use = weight > 0
    f_low, f_up, f_doc, weight = f_low[use], f_up[use], f_doc[use], weight[use]
    if not len(weight):
        return
    with np.errstate(over="ignore"):
        key = (f_low ^ (f_up * U(0x9E3779B97F4A7C15))) + f_doc.astype(U) * U(0xD6E8FEB86659FD93)
    _, pick = np.unique(key, return_index=True)
    pick = pick[np.argsort(f_doc[pick], kind="stable")]
    f_low, f_up, f_doc, weight = f_low[pick], f_up[pick], f_doc[pick], weight[pick]
    starts = np.flatnonzero(np.r_[True, f_doc[1:] != f_doc[:-1]])
    which = [held[d][0] for d in f_doc[starts]]
    total = np.add.reduceat(weight.astype(np.int64), starts)
    for col, f in ((0, f_low), (1, f_up)):
        bits = np.unpackbits(f.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits * weight[:, None], starts, axis=0, dtype=np.int64)
        half = np.packbits(2 * sums > total[:, None], axis=1, bitorder="little")
        out[which, col] = half.view("<u8")[:, 0]


def ball(bits: int, radius: int) -> np.ndarray:
    """All masks of up to ``radius`` ones among ``bits`` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], dtype=np.int64)


def segment(low: np.ndarray, up: np.ndarray, k: int) -> np.ndarray:
    per = 64 // SEG_BITS
    return ((low if k < per else up) >> U(SEG_BITS * (k % per)) & U((1 << SEG_BITS) - 1)).astype(np.int64)


def segments(n: int, radius: int) -> list[tuple[int, int]]:
    """(start, size) of the segments of 128 bits for which lookups and candidates of ``n`` fingerprints are fewest."""

    def cuts(many: int) -> list[tuple[int, int]]:
        ends = [128 * (i + 1) // many for i in range(many)]
        return [(a, b - a) for a, b in zip([0, *ends], ends)]

    def cost(many: int) -> float:
        return sum(sum(comb(size, r) for r in range(radius // many + 1)) * (1 + n / 2**size) for _, size in cuts(many))

    return cuts(min((SEGMENTS, 6, 5, 4), key=cost))


def matches(low: np.ndarray, up: np.ndarray, seg: np.ndarray, own: np.ndarray, per_segment: int, radius: int, size: int = SEG_BITS, earlier: list[tuple[int, int]] | None = None, masks: np.ndarray | None = None):
    """Edges that join all of these fingerprints within ``radius`` that share a ball; ``own`` marks those that probe.

    Each pair is looked up from the larger segment value; the edges are those
    of stars around the smallest member, one for each joined row, not all pairs.
    With ``earlier`` segments given, only pairs that none of those segments
    meets are joined, and a third array counts each row's. ``masks`` are those
    of the ball to look up, by default all.
    """
    order = np.argsort(seg, kind="stable")
    low, up, seg, own = low[order], up[order], seg[order], own[order]
    forest, count = common.Forest(len(seg)), np.zeros(len(seg), np.int64)
    probe = np.flatnonzero(own)
    for mask in ball(size, per_segment) if masks is None else masks:
        other = seg[probe] ^ mask
        ask = probe if mask == 0 else probe[other < seg[probe]]
        other = seg[ask] ^ mask
        begin = np.searchsorted(seg, other, "left")
        many = np.searchsorted(seg, other, "right") - begin if mask else np.maximum(0, ask - begin)
        use = many > 0
        ask, begin, many = ask[use], begin[use], many[use]
        ends = np.cumsum(many)
        cut = 0
        while cut < len(ask):
            base = ends[cut - 1] if cut else 0
            to = max(cut + 1, int(np.searchsorted(ends, base + 2_000_000, "right")))
            m = many[cut:to]
            a = np.repeat(ask[cut:to], m)
            b = np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[cut:to], m)
            d = np.bitwise_count(low[a] ^ low[b])
            near = np.flatnonzero(d <= radius)
            a, b, d = a[near], b[near], d[near]
            near = d + np.bitwise_count(up[a] ^ up[b]) <= radius
            a, b = a[near], b[near]
            if earlier is not None:
                apart = np.stack([low[a] ^ low[b], up[a] ^ up[b]], axis=1)
                new = np.ones(len(a), bool)
                for start, bits in earlier:
                    new &= np.bitwise_count(bits_of(apart, start, bits)) > per_segment
                a, b = a[new], b[new]
                count += np.bincount(a, minlength=len(seg)) + np.bincount(b, minlength=len(seg))
            forest.join(a, b)
            cut = to
    root = forest.roots(np.arange(len(seg)))
    member = np.flatnonzero(root != np.arange(len(seg)))
    if earlier is None:
        return order[member], order[root[member]]
    back = np.zeros_like(count)
    back[order] = count
    return order[member], order[root[member]], back


@lru_cache(maxsize=None)
def tables(size: int, per_segment: int, alike: int) -> list[tuple[int, np.ndarray]]:
    """(kept, masks) by which a segment of ``size`` bits is looked up in parts, each of equal ``segment & kept``.

    Of ``per_segment + alike`` blocks of the segment, values within ``per_segment``
    bits have ``alike`` equal. There is a table for each choice of so many blocks;
    every mask of the ball belongs to that of the first blocks it leaves alone.
    """
    blocks = max(1, per_segment + alike)
    ends = [size * i // blocks for i in range(blocks + 1)]
    block = np.array([(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])])
    every = ball(size, per_segment)
    same = (every[:, None] & block) == 0
    first = (same & (np.cumsum(same, axis=1) <= alike)) @ block
    return [(int(kept), every[first == kept]) for kept in (block[list(c)].sum() for c in combinations(range(blocks), alike))]


def _alike(n: int, per_task: int, per_segment: int, size: int) -> int:
    """The least number of equal blocks by which a segment's tables are parted so that no part has many more rows than ``per_task``."""
    alike = 0
    while n >> min(kept.bit_count() for kept, _ in tables(size, per_segment, alike)) > per_task and per_segment + alike < size:
        alike += 1
    return alike


def links(prints: DataFrame, radius: int = RADIUS, per_task: int = 400_000, many: int | None = None) -> DataFrame:
    """(u, v, n) of ids of distinct fingerprints (id, low, up): edges that join all within ``radius``, and, where v is null, n of the links of u.

    With more than ``per_task`` fingerprints a segment has several tables, each
    parted by the blocks it takes as equal, and a fingerprint is sent once to
    each: 24 or 25 rows with one such block, 48 to 84 with two. A pair is met once in
    a segment, and the first segment that meets it counts and joins it.
    """
    n = prints.count()
    cuts = segments(many or n, radius)
    per_segment = radius // len(cuts)
    alike = _alike(n, per_task, per_segment, min(b for _, b in cuts))
    code = F.array("low", "up")
    kept = [(k, i, bits_column(code, a, b).bitwiseAND(F.lit(x).cast("long"))) for k, (a, b) in enumerate(cuts) for i, (x, _) in enumerate(tables(b, per_segment, alike))]
    which = [(k, i) for k, i, _ in kept]

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        k, i = which[int(key[0])]
        start, size = cuts[k]
        ids, codes = pdf["id"].to_numpy(), pdf[["low", "up"]].to_numpy().view(U)
        masks = tables(size, per_segment, alike)[i][1]
        a, b, count = matches(codes[:, 0], codes[:, 1], bits_of(codes, start, size), np.ones(len(ids), bool), per_segment, radius, size, cuts[:k], masks)
        some = np.flatnonzero(count)
        edges = pd.DataFrame({"u": ids[a], "v": ids[b], "n": 0}).astype({"v": "Int64"})
        return pd.concat([edges, pd.DataFrame({"u": ids[some], "v": pd.array([None] * len(some), "Int64"), "n": count[some]})])

    told = prints.select("id", "low", "up", F.posexplode(F.array(*[x for _, _, x in kept])).alias("k", "part"))
    return told.groupBy("k", "part").applyInPandas(work, "u long, v long, n long")


def prints_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, low, up) of the documents that have words; the halves as signed longs."""

    @F.pandas_udf("struct<low: long, up: long>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for s in batches:
            got = fingerprints(s.tolist(), hashes).view(np.int64)
            yield pd.DataFrame({"low": got[:, 0], "up": got[:, 1]})

    return docs.select(F.col(id_col).alias("doc_id"), made(F.coalesce(F.col(text_col), F.lit(""))).alias("f")).select("doc_id", "f.low", "f.up")


def groups(docs: DataFrame, radius: int = RADIUS, per_task: int = 400_000, id_col: str = "doc_id", text_col: str = "text", many: int | None = None) -> DataFrame:
    """(doc_id, group_id, links, keep): the near-dup group of every row.

    Documents are in one group if a chain of fingerprints within ``radius``
    bits joins them; ``group_id`` is the smallest doc_id of the group, and that
    document, or one of its repeated rows, is the one to ``keep``. ``links`` is
    the number of other fingerprints within the radius; copies share theirs.
    Texts that are null, blank, or of one word of up to three characters have no
    features: they are groups of their own, kept and without links. So are
    rows without an id. Texts are taken whole, whatever their length. Only the
    two columns named are read. ``many`` sets for how many fingerprints segments
    are cut, by default as many as there are. An empty table gives an empty result.
    """
    made = common.checkpoint(prints_of(docs, id_col, text_col))
    real = ((F.col("low") != 0) | (F.col("up") != 0)) & F.col("doc_id").isNotNull()
    reps = common.checkpoint(made.where(real).groupBy("low", "up").agg(F.min("doc_id").alias("id")))
    found = common.checkpoint(links(reps, radius, per_task, many))
    tree = common.components(found.where("v is not null").select("u", "v"))
    count = found.where("v is null").groupBy("u").agg(F.sum("n").alias("links"))
    named = reps.join(tree, F.col("id") == F.col("node"), "left").join(count, F.col("id") == F.col("u"), "left").select(F.col("low").alias("l"), F.col("up").alias("p"), F.coalesce("root", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    told = made.where(real).join(named, (F.col("low") == F.col("l")) & (F.col("up") == F.col("p"))).select("doc_id", "low", "up", "group_id", "links")
    # the least id is the one to keep; only repeated ids need a place among themselves
    first = Window.partitionBy("doc_id").orderBy("low", "up")
    one = F.when(F.col("doc_id") == F.col("group_id"), F.row_number().over(first) == 1).otherwise(F.lit(False))
    told = told.select("doc_id", "group_id", "links", one.alias("keep"))
    rest = made.where(~real).select("doc_id", F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("links"), F.lit(True).alias("keep"))
    return told.unionByName(rest)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-dup group, with the columns of ``docs``."""
    return common.only_ids(docs, groups(docs).where("keep").select("doc_id"), "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"))


def sql(radius: int = RADIUS) -> str:
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
with recursive t as (
  select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as ws from documents),
w as (select doc_id, i, ws[i] as a, ws[i + 1] as b from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from t)),
dict as (select a, md5_number_lower(a) as lo, md5_number_upper(a) as up from (select distinct a from w)),
f as (
  select distinct doc_id, lo, up, cast(greatest(least(length(w.a), 12) - 3, 0) as bigint) as wt from w join dict using (a)
  union
  select distinct w.doc_id, xor(x.lo, y.up), xor(x.up, y.lo), cast(1 as bigint)
  from w join dict x on x.a = w.a join dict y on y.a = w.b where w.b is not null),
s as (
  select doc_id, sum(wt) as total,
    list_value({', '.join(f'sum(wt * cast((lo >> {i}) & 1 as bigint))' for i in range(64))}) as sl,
    list_value({', '.join(f'sum(wt * cast((up >> {i}) & 1 as bigint))' for i in range(64))}) as su
  from f where wt > 0 group by doc_id),
p as (
  select doc_id,
    cast(list_sum(list_transform(sl, lambda x, i: case when 2 * x > total then cast(1 as hugeint) << (i - 1) else cast(0 as hugeint) end)) as ubigint) as lo,
    cast(list_sum(list_transform(su, lambda x, i: case when 2 * x > total then cast(1 as hugeint) << (i - 1) else cast(0 as hugeint) end)) as ubigint) as up
  from s),
fp as (select distinct lo, up from p),
link as (
  select x.lo, x.up, count(*) as links from fp x join fp y on (x.lo <> y.lo or x.up <> y.up)
   and bit_count(xor(x.lo, y.lo)) + bit_count(xor(x.up, y.up)) <= {radius} group by x.lo, x.up),
edge as (
  select x.doc_id as u, y.doc_id as v from p x join p y on x.doc_id <> y.doc_id
   and bit_count(xor(x.lo, y.lo)) + bit_count(xor(x.up, y.up)) <= {radius}),
reach(u, v) as (
  select doc_id, doc_id from p union select r.u, e.v from reach r join edge e on e.u = r.v),
g as (select u as doc_id, min(v) as group_id from reach group by u)
select d.doc_id, coalesce(g.group_id, d.doc_id) as group_id, coalesce(link.links, 0) as links,
       coalesce(g.group_id, d.doc_id) = d.doc_id as keep
from documents d left join p using (doc_id) left join link on link.lo = p.lo and link.up = p.up left join g using (doc_id)
"""
