"""Windows of k words as hashes, packed: the pieces that the k-gram queries share.

A table of one row a window costs more in rows than in hashes. Here a batch's
windows are parted into buckets by their hash, and a row holds a bucket's
windows as byte strings, one a column, so a shuffle moves little more than the
hashes, and a bucket is counted in numpy. A task holds one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BUCKETS = 2048
#: Words hashed at a time.
WORDS = 500_000


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings; each distinct one is hashed once."""
    d = pc.fill_null(words, "").dictionary_encode()
    h = xxhash.xxh3_64_intdigest
    table = np.fromiter((h(w) for w in d.dictionary.to_pylist()), U, len(d.dictionary))
    return table[d.indices.to_numpy(zero_copy_only=False)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n + 1, U)
    with np.errstate(over="ignore"):
        if n:
            out[1:] = np.cumprod(np.full(n, base, U), dtype=U)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place where as many follow; equal runs have equal hashes wherever they stand."""
    n = len(words)
    if n < size:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        sums = np.r_[np.zeros(1, U), np.cumsum(words * _powers(BASE, n)[:n], dtype=U)]
        return mixed((sums[size:] - sums[:-size]) * _powers(INVERSE, n)[: n - size + 1])


def slices(many: np.ndarray, most: int = WORDS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` words, or of one longer row."""
    ends, at = np.cumsum(many), 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def lists(batch: pa.RecordBatch, col: str, most: int = WORDS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Slices of a batch with the number of words of each row and all of its words in a row."""
    many = pc.fill_null(pc.list_value_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for i, j in slices(many, most):
        part = batch.slice(i, j - i)
        yield part, many[i:j], part.column(col).flatten()


def places(many: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, row, off) of all windows of ``k`` words that lie in one row; places count over all rows."""
    begin = np.cumsum(many) - many
    each = np.maximum(many - k + 1, 0)
    row = np.repeat(np.arange(len(many)), each)
    off = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    return begin[row] + off, row, off


def numbers(col: pa.Array, kind: type = np.int64) -> np.ndarray:
    return pc.fill_null(col, pa.scalar(0).cast(col.type)).to_numpy(zero_copy_only=False).astype(kind)


def _bytes(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Byte strings of the parts of an array between ``cuts``, without a copy."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(x)])


def planes(x: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Whole numbers in columns of 16 bits each: the upper ones hardly change and pack well."""
    v = np.ascontiguousarray(x).view(np.uint16).reshape(len(x), -1)
    return {f"{name}{i}": np.ascontiguousarray(v[:, i]) for i in range(v.shape[1])}


def joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """The numbers that ``planes`` took apart."""
    return np.ascontiguousarray(np.stack([unpacked(table, f"{name}{i}", np.uint16) for i in range(np.dtype(kind).itemsize // 2)], axis=1)).view(kind).ravel()


def packed(bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row a bucket, with its share of each column as bytes."""
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    b = bucket[order]
    head = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    cuts = np.r_[head, len(b)].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(b[head].astype(np.int32)), *[_bytes(x[order], cuts) for x in columns.values()]], names=["bucket", *columns])


def unpacked(table: pa.Table, col: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(col).to_pylist()), kind)


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h & U(BUCKETS - 1)).astype(np.int32)


def heads(*keys: np.ndarray) -> np.ndarray:
    """First places of the runs of equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


POSITION = ("unit0", "unit1", "unit2", "unit3", "line0", "line1", "off0", "off1")


def digests(words: pa.Array, at: np.ndarray, k: int) -> np.ndarray:
    """md5 of the ``k`` words, joined by spaces, from each of the places: two big-endian halves."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(size + 1) - size - 1
    whole = memoryview(" ".join(words.to_pylist()).encode())
    made = b"".join([md5(whole[i:j]).digest() for i, j in zip(begin[at].tolist(), (begin + size)[at + k - 1].tolist())])
    return np.frombuffer(made, ">u8").reshape(-1, 2).astype(U)


def windowed(segs: DataFrame, lane: str, k: int, work: Callable[..., pa.Table], schema: str, other: str | None = None) -> DataFrame:
    """``work`` on the windows of ``k`` words of each bucket that occur more than once.

    It gets arrays in the order of (h, unit, line, off), ``first`` and ``size``
    of each run of equal hashes, and a table's null units as lines below zero.
    ``nxt`` is half a hash of the next window in the segment, 0 at its end, or
    the whole hash of the window in the ``other`` lane.
    """
    kind = np.uint32 if other is None else U

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, many, words in lists(batch, "lane"):
                hashed = gram_hashes(word_hashes(words), k)
                at, row, off = places(many, k)
                if not len(at):
                    continue
                h = hashed[at]
                if other is None:
                    # half of a hash tells whether all members go on alike; whole ones are compared where counts are
                    nxt = np.zeros(len(at), kind)
                    more = np.flatnonzero(off + k < many[row])
                    nxt[more] = (hashed[at[more] + 1] >> U(32)).astype(kind) | kind(1)
                else:
                    nxt = gram_hashes(word_hashes(part.column("other").flatten()), k)[at]
                none = pc.is_null(part.column("unit")).to_numpy(zero_copy_only=False)
                line = numbers(part.column("line"), np.int32)
                yield packed(bucket_of(h), h=h, nxt=nxt, **planes(numbers(part.column("unit"))[row], "unit"), **planes(np.where(none, -line, line).astype(np.int32)[row], "line"), **planes(off.astype(np.int32), "off"))

    def count(table: pa.Table) -> pa.Table:
        h = unpacked(table, "h", U)
        order = np.argsort(h)
        first = heads(h[order])
        size = np.diff(np.r_[first, len(h)])
        keep = order[np.repeat(size > 1, size)]
        h, nxt, unit, line, off = h[keep], unpacked(table, "nxt", kind)[keep], joined(table, "unit", np.int64)[keep], joined(table, "line", np.int32)[keep], joined(table, "off", np.int32)[keep]
        order = np.lexsort((off, line, unit, h))
        h, first = h[order], heads(h[order])
        return work(h.view(np.int64), nxt[order], unit[order], line[order], off[order], first, np.diff(np.r_[first, len(h)]))

    cols = [segs["unit"], segs["line"], segs[lane].alias("lane"), *([] if other is None else [segs[other].alias("other")])]
    got = segs.select(*cols).mapInArrow(cut, f"bucket int, h binary, nxt binary, {', '.join(f'{c} binary' for c in POSITION)}")
    return got.groupBy("bucket").applyInArrow(count, schema)


def named(unit: np.ndarray, line: np.ndarray) -> dict:
    """Columns of positions, with null units as such."""
    return {"unit": pa.array(unit, mask=line < 0), "line": np.abs(line)}


def repeated(segs: DataFrame, lane: str, k: int) -> DataFrame:
    """(h, unit, line, off, n, same, lead): the windows of ``k`` words that occur more than once.

    ``n`` counts a window's occurrences; ``same`` says whether one window
    follows them all in their segments; ``lead`` marks the first of them.
    """

    def work(h, nxt, unit, line, off, first, size) -> pa.Table:
        same = (np.minimum.reduceat(nxt, first) == np.maximum.reduceat(nxt, first)) & (nxt[first] != 0) if len(first) else np.zeros(0, bool)
        lead = np.zeros(len(h), bool)
        lead[first] = True
        return pa.table({"h": h, **named(unit, line), "off": off, "n": np.repeat(size, size), "same": np.repeat(same, size), "lead": lead})

    return windowed(segs, lane, k, work, "h long, unit long, line int, off int, n long, same boolean, lead boolean")


def repeated_lines(segs: DataFrame, lane: str, k: int) -> DataFrame:
    """(unit, line) of the segments with a window that occurs more than once, once for each bucket at most."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, many, words in lists(batch, "lane"):
                at, row, _ = places(many, k)
                if len(at):
                    h = gram_hashes(word_hashes(words), k)[at]
                    none = pc.is_null(part.column("unit")).to_numpy(zero_copy_only=False)
                    line = numbers(part.column("line"), np.int32)
                    yield packed(bucket_of(h), h=h, **planes(numbers(part.column("unit"))[row], "unit"), **planes(np.where(none, -line, line).astype(np.int32)[row], "line"))

    def count(table: pa.Table) -> pa.Table:
        h = unpacked(table, "h", U)
        order = np.argsort(h)
        first = heads(h[order])
        size = np.diff(np.r_[first, len(h)])
        keep = order[np.repeat(size > 1, size)]
        unit, line = joined(table, "unit", np.int64)[keep], joined(table, "line", np.int32)[keep]
        order = np.lexsort((line, unit))
        one = order[heads(unit[order], line[order])]
        return pa.table(named(unit[one], line[one]))

    got = segs.select("unit", "line", segs[lane].alias("lane")).mapInArrow(cut, f"bucket int, h binary, {', '.join(f'{c} binary' for c in POSITION[:6])}")
    return got.groupBy("bucket").applyInArrow(count, "unit long, line int")


def sizes(seqs: DataFrame, lane: str, k: int) -> DataFrame:
    """(copies, buckets): how many windows of ``k`` words occur that often, of those that repeat; partial counts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, many, words in lists(batch, "lane"):
                at = places(many, k)[0]
                if len(at):
                    h = gram_hashes(word_hashes(words), k)[at]
                    yield packed(bucket_of(h), h=h)

    def count(table: pa.Table) -> pa.Table:
        h = np.sort(unpacked(table, "h", U))
        n = np.diff(np.r_[heads(h), len(h)])
        copies, many = np.unique(n[n > 1], return_counts=True)
        return pa.table({"copies": copies.astype(np.int64), "buckets": many.astype(np.int64)})

    return seqs.select(seqs[lane].alias("lane")).mapInArrow(cut, "bucket int, h binary").groupBy("bucket").applyInArrow(count, "copies long, buckets long")


def md5_groups(segs: DataFrame, lane: str, k: int) -> DataFrame:
    """(key, occurrences, units) of the runs of ``k`` words that occur more than once, by their md5; null units don't count as units."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, many, words in lists(batch, "lane"):
                at, row, _ = places(many, k)
                if len(at):
                    d = digests(words, at, k)
                    none = pc.is_null(part.column("unit")).to_numpy(zero_copy_only=False)
                    yield packed(bucket_of(d[:, 0]), a=d[:, 0], b=d[:, 1], **planes(numbers(part.column("unit"))[row], "unit"), none=none.astype(np.uint8)[row])

    def count(table: pa.Table) -> pa.Table:
        a = unpacked(table, "a", U)
        order = np.argsort(a)
        first = heads(a[order])
        size = np.diff(np.r_[first, len(a)])
        keep = order[np.repeat(size > 1, size)]
        a, b, unit, none = a[keep], unpacked(table, "b", U)[keep], joined(table, "unit", np.int64)[keep], unpacked(table, "none", np.uint8)[keep]
        order = np.lexsort((unit, none, b, a))
        a, b, unit, none = a[order], b[order], unit[order], none[order]
        first = heads(a, b)
        if not len(first):
            return pa.table({"key": pa.array([], pa.string()), "occurrences": pa.array([], pa.int64()), "units": pa.array([], pa.int64())})
        size = np.diff(np.r_[first, len(a)])
        new = np.zeros(len(a), np.int64)
        new[heads(a, b, unit, none)] = 1
        units = np.add.reduceat(np.where(none > 0, 0, new), first)
        ok = size > 1
        raw = np.stack([a[first[ok]], b[first[ok]]], axis=1).astype(">u8").tobytes().hex()
        return pa.table({"key": [raw[i : i + 32] for i in range(0, len(raw), 32)] if ok.any() else pa.array([], pa.string()), "occurrences": size[ok].astype(np.int64), "units": units[ok]})

    got = segs.select("unit", segs[lane].alias("lane")).mapInArrow(cut, "bucket int, a binary, b binary, unit0 binary, unit1 binary, unit2 binary, unit3 binary, none binary")
    return got.groupBy("bucket").applyInArrow(count, "key string, occurrences long, units long")
