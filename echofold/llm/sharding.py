"""Reproducible shuffle and shards by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of their id. A balanced Feistel network
permutes the smallest power of four not below n; numbers that land outside
0..n-1 are sent through it again (cycle walking), which makes it a permutation
of 0..n-1 itself. ``shard`` and ``slot`` follow from the permuted position by
arithmetic, so any reader can compute where a row went, and ``unpermute`` which
row a slot holds, without any table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PRIME = 2147483647
ROUNDS = 6


def keys(seed: int) -> list[int]:
    out, x = [], seed % (PRIME - 1) + 1
    for _ in range(ROUNDS):
        x = x * 48271 % PRIME
        out.append(x)
    return out


def half_bits(n: int) -> int:
    b = 1
    while 1 << (2 * b) < n:
        b += 1
    if b > 30:
        raise ValueError("more than 2**60 rows")
    return b


def _mix(r: np.ndarray, key: int, mask: int) -> np.ndarray:
    x = (r + key) % PRIME
    x = x * x % PRIME
    return (x * 16807 + key) % PRIME & mask


def _walk(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    b = half_bits(n)
    mask, x = (1 << b) - 1, x.astype(np.int64).copy()
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> b, x[todo] & mask
        for k in reversed(keys(seed)) if back else keys(seed):
            if back:
                left, right = right ^ _mix(left, k, mask), left
            else:
                left, right = right, left ^ _mix(right, k, mask)
        x[todo] = left << b | right
        todo = todo[x[todo] >= n]
    return x


def permute(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    return _walk(x, n, seed, False)


def unpermute(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    return _walk(x, n, seed, True)


def numbered(df: DataFrame, id_col: str, per_bucket: int = 100_000, out: str = "row_number") -> DataFrame:
    """Adds the global row number by ``id_col``, null ids last, without gathering rows in one task.

    Ids are cut at approximate quantiles of the whole column; exact counts by
    bucket give each bucket's first number, and a window within a bucket the rest.
    """
    n = df.count()
    parts = common.pieces(n, per_bucket)
    at = [k / parts for k in range(1, parts)]
    cuts = sorted({c for c in (df.agg(F.percentile_approx(id_col, at, 10000)).first()[0] or []) if c is not None}) if at else []
    edges = np.array(cuts)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), "right").astype("int32"))

    def bucket(c):
        known = place(F.coalesce(c, F.lit(cuts[0]))) if cuts else F.lit(0)
        return F.when(c.isNull(), len(cuts) + 1).otherwise(known)

    with_bucket = df.withColumn("__b", bucket(F.col(id_col)))
    rows = df.select(id_col).withColumn("__b", bucket(F.col(id_col))).groupBy("__b").count().collect()
    first, start = 0, []
    for b, k in sorted((r["__b"], r["count"]) for r in rows):
        start.append((b, first))
        first += k
    offsets = df.sparkSession.createDataFrame(start, "__b int, __first long")
    rest = [F.xxhash64(*[c for c in df.columns])]
    w = Window.partitionBy("__b").orderBy(F.col(id_col).asc_nulls_last(), *rest)
    return (
        with_bucket.withColumn("__k", F.row_number().over(w))
        .join(offsets, "__b")
        .withColumn(out, F.col("__first") + F.col("__k") - 1)
        .drop("__b", "__k", "__first")
    )


def shard(docs: DataFrame, id_col: str = "doc_id", shards: int = 64, seed: int = 20240229) -> DataFrame:
    """Every row with its ``row_number``, permuted ``position``, ``shard`` and ``slot``.

    position = permute(row_number), shard = position mod shards, slot =
    position div shards, so that shards differ by one row at most. Rows without
    an id are numbered last; rows with equal ids are ordered by a hash of all
    their columns, and identical rows take neighbouring numbers. Texts play no
    part. Columns of these names in the input get the suffix ``_in``. An empty
    table gives an empty result.
    """
    names = ["row_number", "position", "shard", "slot", "__b", "__k", "__first"]
    docs = common.clear_names(docs, names)
    n = docs.count()

    @F.pandas_udf("long")
    def position(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return (
        numbered(docs, id_col)
        .withColumn("position", position("row_number"))
        .withColumn("shard", (F.col("position") % shards).cast("int"))
        .withColumn("slot", F.floor(F.col("position") / F.lit(shards)).cast("long"))
    )


def write_shards(docs: DataFrame, path: str, **kw) -> None:
    """Writes each shard to its own folder, in slot order."""
    out = shard(docs, **kw)
    n = kw.get("shards", 64)
    out.repartition(n, "shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents"))


def sql(shards: int = 64, seed: int = 20240229) -> str:
    def network(x: str) -> str:
        out = f"select r, {x} // s.side as l0, {x} % s.side as r0, s.side as side, s.n as n, step from {{src}}"
        out = f"({out})"
        for i, k in enumerate(keys(seed)):
            sq = f"(((r{i} + {k}) % {PRIME}) * ((r{i} + {k}) % {PRIME})) % {PRIME}"
            f = f"((({sq}) * 16807 + {k}) % {PRIME}) % side"
            out = f"(select r, r{i} as l{i + 1}, xor(l{i}, {f}) as r{i + 1}, side, n, step from {out})"
        return f"select r, l{ROUNDS} * side + r{ROUNDS} as x, step + 1 as step from {out}"

    sides = " ".join(f"when {1 << (2 * b)} >= n then {1 << b}" for b in range(1, 31))
    base = network("b.r").format(src="numbered b, size s")
    again = network("w.x").format(src="walk w, size s where w.x >= s.n")
    return f"""
with recursive numbered as (
  select row_number() over (order by doc_id) - 1 as r, 0 as step from documents),
size as (select n, case {sides} end as side from (select count(*) as n from documents)),
walk as (
  {base}
  union all
  {again}),
done as (select w.r, w.x as position from walk w, size s where w.x < s.n),
docs as (select *, row_number() over (order by doc_id) - 1 as row_number from documents)
select d.*, p.position, cast(p.position % {shards} as integer) as shard, p.position // {shards} as slot
from docs d join done p on p.r = d.row_number
"""
