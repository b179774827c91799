"""Line dedup through a sharded minimal perfect hash over distinct line hashes.

The distinct 64-bit hashes of all lines, with the number of distinct texts that
hold them, are cut into shards. Each shard gets a minimal perfect hash (levels
of bit arrays, ranks by popcount), which indexes two compact arrays: a 16-bit
fingerprint and a 32-bit count. The shards are files in the shared folder; the
documents are then scanned once, where they lie, and every line's hash probes
the arrays, so that no line is joined or shuffled with its document.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, simhash

MOST = 6
NAMES = ["n_lines", "n_dropped", "__n", "__f", "__kept"]
GAMMA = 2
U = np.uint64


def _spin(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return ((_spin(keys, level + 1) >> U(32)) * U(size) >> U(32)).astype(np.int64)


def build(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """One shard: distinct uint64 keys and their counts, as bytes."""
    left, sizes, bits = keys, [], []
    while len(left):
        size = -(-GAMMA * len(left) // 64) * 64
        at = _slot(left, len(sizes), size)
        once = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(np.packbits(once, bitorder="little"))
        left = left[~once[at]]
    words = np.concatenate(bits).view(U) if bits else np.zeros(0, U)
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1].astype(np.uint32)
    head = np.array([len(keys), len(sizes), *sizes], dtype=np.int64)
    empty = Shard(head, words, ranks, None, None)
    at = empty.index(keys)
    prints, many = np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.uint32)
    prints[at] = (_spin(keys, 0) & U(0xFFFF)).astype(np.uint16)
    many[at] = np.minimum(counts, 0xFFFFFFFF)
    return b"".join(x.tobytes() for x in (head, words, ranks, many, prints))


class Shard:
    def __init__(self, head, words, ranks, many, prints):
        self.n, self.sizes, self.words, self.ranks, self.many, self.prints = int(head[0]), head[2:], words, ranks, many, prints

    @staticmethod
    def read(raw) -> "Shard":
        n, levels = np.frombuffer(raw, np.int64, 2)
        head = np.frombuffer(raw, np.int64, 2 + int(levels))
        w, at = int(head[2:].sum()) // 64, head.nbytes
        words = np.frombuffer(raw, U, w, at)
        ranks = np.frombuffer(raw, np.uint32, w, at := at + 8 * w)
        many = np.frombuffer(raw, np.uint32, int(n), at := at + 4 * w)
        prints = np.frombuffer(raw, np.uint16, int(n), at + 4 * int(n))
        return Shard(head, words, ranks, many, prints)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; -1 where no level has it."""
        out, todo, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = _slot(keys[todo], level, int(size)) + start
            word, bit = self.words[at >> 6], U(1) << (at & 63).astype(U)
            hit = (word & bit) != 0
            out[todo[hit]] = self.ranks[at[hit] >> 6] + np.bitwise_count(word[hit] & (bit[hit] - U(1)))
            todo, start = todo[~hit], start + int(size)
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        at = self.index(keys)
        known = at >= 0
        known[known] = self.prints[at[known]] == (_spin(keys[known], 0) & U(0xFFFF)).astype(np.uint16)
        return np.where(known, self.many[np.where(known, at, 0)] if self.n else 0, 0).astype(np.int64)


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


@lru_cache(maxsize=64)
def _open(folder: str, k: int) -> Shard:
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        return Shard.read(np.memmap(f"{url.path}/{k:06d}", np.uint8, "r"))
    system, path = _system(folder)
    with system.open_input_file(f"{path}/{k:06d}") as f:
        return Shard.read(f.read())


def _write(folder: str, k: int, data: bytes) -> None:
    """Atomic, and the same bytes each time, so a task may run again."""
    url = urlparse(folder)
    mark = uuid.uuid4().hex
    if url.scheme in ("", "file"):
        os.makedirs(url.path, exist_ok=True)
        with open(f"{url.path}/.{k}-{mark}", "wb") as f:
            f.write(data)
        os.replace(f"{url.path}/.{k}-{mark}", f"{url.path}/{k:06d}")
        return
    system, path = _system(folder)
    system.create_dir(path)
    with system.open_output_stream(f"{path}/.{k}-{mark}") as f:
        f.write(data)
    system.move(f"{path}/.{k}-{mark}", f"{path}/{k:06d}")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def line_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, n): each distinct line's hash and the number of distinct texts that hold it; blank lines left out."""
    one = docs.select(F.xxhash64(text_col).alias("t"), F.array_distinct(F.transform(F.filter(lines(F.col(text_col)), lambda x: F.trim(x) != ""), line_hash)).alias("hs")).where(F.size("hs") > 0)
    return one.select("t", F.explode("hs").alias("h")).distinct().groupBy("h").agg(F.count("*").alias("n"))


def index(counts: DataFrame, per_shard: int = 200_000) -> tuple[str, int]:
    """Writes the shards of (h, n); returns their folder and number."""
    spark = counts.sparkSession
    folder = f"{common.shared_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    counts = common.checkpoint(counts)
    shards = common.pieces(counts.count(), per_shard)

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        _write(folder, int(key[0]), build(pdf["h"].to_numpy().astype(np.int64).view(U), pdf["n"].to_numpy()))
        return pd.DataFrame({"shard": [int(key[0])], "n": [len(pdf)]})

    counts.groupBy(F.pmod("h", F.lit(shards)).cast("int").alias("shard")).applyInPandas(make, "shard int, n long").agg(F.sum("n")).collect()
    return folder, shards


def prober(folder: str, shards: int):
    """Column function: array of line hashes to array of counts."""

    @F.pandas_udf("array<long>")
    def probe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            sizes = np.array([0 if x is None else len(x) for x in s], dtype=np.int64)
            flat = np.concatenate([x for x in s if x is not None and len(x)] or [np.zeros(0, np.int64)]).astype(np.int64)
            got = np.zeros(len(flat), np.int64)
            where = np.mod(flat, shards)
            order = np.argsort(where, kind="stable")
            ends = np.searchsorted(where[order], np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(ends)):
                mine = order[ends[k] : ends[k + 1]]
                got[mine] = _open(folder, int(k)).counts(flat[mine].view(U))
            yield pd.Series(np.split(got, np.cumsum(sizes)[:-1]) if len(s) else [], dtype=object)

    return probe


def family_counts(docs: DataFrame, counts: Column, most: int, text_col: str = "text") -> DataFrame:
    """(h, n): hashes of lines that more than ``most`` distinct texts hold, and in how many near-dup groups of texts.

    ``counts`` are the numbers of texts by line. Groups are those of SimHash
    among the texts that hold such a line; only these are fingerprinted.
    """
    hashes = F.transform(lines(F.col(text_col)), line_hash)
    held = docs.select(F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"), hashes.alias("hs"), counts.alias("n")).select(
        "t", "text", F.array_distinct(F.filter("hs", lambda h, i: F.get("n", i) > most)).alias("hs")
    ).where(F.size("hs") > 0)
    family = simhash.groups(held, id_col="t").select(F.col("doc_id").alias("t"), "group_id").distinct()
    rows = held.select("t", F.explode("hs").alias("h")).distinct()
    return rows.join(family, "t").select("h", "group_id").distinct().groupBy("h").agg(F.count("*").alias("n"))


def dedup(docs: DataFrame, most: int = MOST, per_shard: int = 200_000, text_col: str = "text", families: bool = False) -> DataFrame:
    """``docs`` with common lines taken out of ``text_col``, and ``n_lines`` and ``n_dropped``.

    A line, without spaces at its ends, is common if more than ``most``
    distinct texts hold it; copies of a whole text count once. All common lines
    go, wherever they stand; blank lines and the order stay. A text made up of
    common and blank lines alone stays as it is: whole copies are the near-dup
    stage's work. With ``families``, near copies of whole texts, as SimHash
    groups them, count once too: prose that stands in the variants of one text
    alone isn't common and stays in all of them. Null texts stay null, with 0 lines; empty texts have one
    blank line. Repeated rows are treated alike. Columns of the input named
    n_lines or n_dropped get the suffix ``_in``. An empty table gives an empty
    result. Lines are told apart by 64-bit hashes.
    """
    docs = common.clear_names(docs, NAMES)
    folder, shards = index(line_counts(docs, text_col), per_shard)
    text = F.col(text_col)
    hashes = F.transform(lines(text), line_hash)
    out = docs.withColumn("__n", prober(folder, shards)(hashes)).withColumn("__f", F.col("__n"))
    if families:
        # the second index has common lines alone, so the first says which of its answers count
        folder, shards = index(family_counts(docs, prober(folder, shards)(hashes), most, text_col), per_shard)
        out = out.withColumn("__f", prober(folder, shards)(hashes))
    out = out.withColumn("__kept", F.filter(lines(text), lambda x, i: (F.trim(x) == "") | (F.get("__n", i) <= most) | (F.get("__f", i) <= most)))
    some = F.exists("__kept", lambda x: F.trim(x) != "")
    kept = F.when(some, F.col("__kept")).otherwise(lines(text))
    n = F.when(text.isNull(), 0).otherwise(F.size(lines(text)))
    return (
        out.withColumn("n_lines", n)
        .withColumn("n_dropped", F.when(text.isNull(), 0).otherwise(F.size(lines(text)) - F.size(kept)))
        .withColumn(text_col, F.when(F.col("n_dropped") > 0, F.array_join(kept, "\n")).otherwise(text))
        .drop("__n", "__f", "__kept")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines common to more than ``MOST`` near-dup groups of texts; n_chars follows the text."""
    out = dedup(docs, families=True)
    out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*common.clear_names(docs, NAMES).columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")


SQL = f"""
with l as (
  select distinct trim(line, ' ') as line, text
  from (select text, unnest(string_split(text, chr(10))) as line from documents)
  where trim(line, ' ') <> ''),
common as (select line from l group by line having count(*) > {MOST}),
d as (
  select row_number() over () as rid, doc_id, text, string_split(text, chr(10)) as ls from documents),
e as (
  select rid, i, ls[i] as line, trim(ls[i], ' ') as t
  from (select rid, ls, unnest(range(1, len(ls) + 1)) as i from d)),
f as (
  select rid, i, line, t = '' as blank, t in (select line from common) as bad from e),
k as (
  select rid, count(*) as n, count(*) filter (not bad) as left_, bool_or(not bad and not blank) as anyleft,
         string_agg(line, chr(10) order by i) filter (not bad) as rest
  from f group by rid)
select d.doc_id, cast(coalesce(n, 0) as integer) as n_lines,
       cast(case when anyleft then n - left_ else 0 end as integer) as n_dropped,
       case when anyleft and left_ < n then rest else d.text end as text
from d left join k using (rid)
"""
