"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code is the signs of its components. Codes are cut into m segments of
about log2(n) bits, and every segment has a table: one row for each code, parted
and sorted by the segment's value. In round r the open queries look up, in all
tables, the values that differ from their own in exactly r bits; what they meet
is verified on whole codes. After round r every code within m * (r + 1) - 1 bits
has been met, so a query whose last verified distance is within that bound is
finished, exactly and with all ties. Only open queries are sent on: the tables
stay where they are, and the shuffle is that of the values looked up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 10
EVERY = 100
PER_VALUE = 100_000
AT_ONCE = 200_000
U = np.uint64


def masks(bits: int, radius: int) -> np.ndarray:
    """Masks of exactly ``radius`` ones among ``bits`` bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], dtype=np.int64)


def bits_of(codes: np.ndarray, start: int, size: int) -> np.ndarray:
    """``size`` bits (62 at most) from ``start`` of each code, a row of 64-bit words."""
    w, s = divmod(start, 64)
    got = codes[:, w] >> U(s)
    if s + size > 64:
        got = got | codes[:, w + 1] << U(64 - s)
    return (got & U((1 << size) - 1)).astype(np.int64)


def bits_column(code: Column, start: int, size: int) -> Column:
    """The same bits as a column."""
    w, s = divmod(start, 64)
    got = F.shiftrightunsigned(F.get(code, F.lit(w)), s)
    if s + size > 64:
        got = got.bitwiseOR(F.shiftleft(F.get(code, F.lit(w + 1)), 64 - s))
    return got.bitwiseAND(F.lit((1 << size) - 1))


def segments(width: int, n: int, bits: int | None = None) -> list[tuple[int, int]]:
    """(start, size) of the segments of ``width`` bits for ``n`` codes: about log2(n) bits each, so that a value has about one code."""
    many = max(1, -(-width // min(62, max(4, bits or round(np.log2(max(n, 2)))))))
    ends = [width * (i + 1) // many for i in range(many)]
    return [(a, b - a) for a, b in zip([0, *ends], ends)]


def codes_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, code) with the code as 64-bit words, and the number of bits, that of the longest vector."""
    width = vectors.agg(F.max(F.size(vector_col))).first()[0] or 0
    words = common.pieces(width, 64)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.columns
            size = v.value_lengths().to_numpy(zero_copy_only=False)
            one = pc.fill_null(pc.greater(v.flatten(), 0), False).to_numpy(zero_copy_only=False)
            bits = np.zeros((len(v), words * 64), np.uint8)
            bits[np.repeat(np.arange(len(v)), size), np.arange(len(one)) - np.repeat(np.cumsum(size) - size, size)] = one
            flat = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(np.int64)
            made = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * words, pa.array(flat))
            yield pa.RecordBatch.from_arrays([ids, made], names=["id", "code"])

    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(code, f"id {kind}, code array<long>").groupBy("id").agg(F.min("code").alias("code")), max(width, 1)


def probes(open_: DataFrame, cuts: list[tuple[int, int]], radius: int) -> DataFrame:
    """(code, worst, seg, val) of (code, worst): the values at exactly ``radius`` bits from those of the code, in all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, worst = batch.columns
            if not len(code):
                continue
            bits = code.flatten().to_numpy(zero_copy_only=False).view(U).reshape(len(code), -1)
            for seg, (start, size) in enumerate(cuts):
                if radius > size:
                    continue
                ball, own = masks(size, radius), bits_of(bits, start, size)
                per = max(1, AT_ONCE // len(ball))
                for a in range(0, len(own), per):
                    val = (own[a : a + per, None] ^ ball).ravel()
                    row = pa.array(np.repeat(np.arange(a, min(a + per, len(own))), len(ball)))
                    yield pa.RecordBatch.from_arrays([code.take(row), worst.take(row), pa.array(np.full(len(val), seg, np.int32)), pa.array(val)], names=["code", "worst", "seg", "val"])

    return open_.select("code", "worst").mapInArrow(run, "code array<long>, worst int, seg int, val long")


def top_k(vectors: DataFrame, k: int = K, asks: Column | None = None, bits: int | None = None, per_value: int = PER_VALUE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the k nearest other codes of every vector, or of those whose id meets ``asks``.

    A component's bit is one if it is above zero; nulls and NaN inside a vector
    count as zero bits, shorter vectors are filled up with them. Equal
    distances are ranked by id. With fewer than k other vectors all are given.
    Rows without a vector or an id are neither queries nor neighbours; of rows
    with one id the smallest code counts, so repeated rows are one. Of equal
    codes only the k + 1 smallest ids can be in a result, so a code has a row
    for any number of copies, and equal queries are one search. A segment value
    with more than ``per_value`` codes is spread over several tasks. Other
    columns are not read. An empty table gives an empty result.
    """
    every, width = codes_of(vectors, id_col, vector_col)
    every = common.checkpoint(every)
    kind = every.schema["id"].dataType.simpleString()
    near = Window.partitionBy("code").orderBy("id")
    few = every.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
    codes = common.checkpoint(few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    n = codes.count()
    cuts = segments(width, n, bits)
    m = len(cuts)

    values = F.array(*[bits_column(F.col("code"), a, b) for a, b in cuts])
    table = codes.select(F.col("code").alias("other"), "ids", F.posexplode(values).alias("seg", "val"))
    ways = F.ceil(F.col("c") / F.lit(per_value)).cast("int")
    hot = common.checkpoint(table.groupBy("seg", "val").agg(F.count("*").alias("c")).where(F.col("c") > per_value).select("seg", "val", ways.alias("ways")))
    some = hot.limit(1).count() > 0
    table = table.join(hot, ["seg", "val"], "left").withColumn("part", F.pmod(F.xxhash64("other"), F.coalesce("ways", F.lit(1)))) if some else table.withColumn("part", F.lit(0).cast("long"))
    parts = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), common.pieces(n * m, 4 * per_value))
    keys = ["seg", "val", "part"]
    table = common.checkpoint(table.select(*keys, "other", "ids").repartition(parts, *keys).sortWithinPartitions(*keys))

    asked = every if asks is None else every.withColumnRenamed("id", id_col).where(asks).withColumnRenamed(id_col, "id")
    open_ = common.checkpoint(asked.select("code").distinct().withColumn("worst", F.lit(width + 1)))
    words = common.pieces(width, 64)
    far = reduce(lambda a, b: a + b, [F.bit_count(F.get("code", F.lit(w)).bitwiseXOR(F.get("other", F.lit(w)))) for w in range(words)])
    best = None
    for radius in range(max(size for _, size in cuts) + 1):
        ask = probes(open_, cuts, radius)
        if some:
            ask = ask.join(hot, ["seg", "val"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("ways", F.lit(1)).cast("long") - 1))).drop("ways")
        else:
            ask = ask.withColumn("part", F.lit(0).cast("long"))
        # a code that other segments meet in an earlier round, or before in this one, has been verified there
        apart = [F.bit_count(bits_column(F.col("code"), a, b).bitwiseXOR(bits_column(F.col("other"), a, b))) for a, b in cuts]
        new = reduce(and_, [(x > radius) | ((x == radius) & (F.lit(i) >= F.col("seg"))) for i, x in enumerate(apart)])
        met = ask.join(table, keys).where((far <= F.col("worst")) & new).select("code", far.cast("int").alias("distance"), F.explode("ids").alias("id"))
        met = met if best is None else met.unionByName(best)
        w = Window.partitionBy("code").orderBy("distance", "id")
        best = common.checkpoint(met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r"))
        covered = m * (radius + 1) - 1
        told = best.groupBy("code").agg(F.count("*").alias("c"), F.max("distance").alias("d"))
        full = F.col("c") == k + 1
        open_ = common.checkpoint(told.where(~(full & (F.col("d") <= covered))).select("code", F.when(full, F.col("d")).otherwise(width + 1).cast("int").alias("worst")))
        if not open_.limit(1).count():
            break
    found = asked.join(best.withColumnRenamed("id", "neighbor_id"), "code").where(F.col("id") != F.col("neighbor_id"))
    w = Window.partitionBy("id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("id").cast(kind).alias("vec_id"), "rank", "neighbor_id", "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by EVERY, searched against all rows."""
    return top_k(common.table(spark, sf_dir, "embeddings"), asks=F.col("vec_id") % EVERY == 0)


SQL = f"""
with c as (select vec_id, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as b from embeddings),
p as (
  select x.vec_id, y.vec_id as neighbor_id,
         cast(list_sum(list_transform(x.b, lambda v, i: abs(v - y.b[i]))) as integer) as distance
  from c x join c y on x.vec_id <> y.vec_id where x.vec_id % {EVERY} = 0)
select vec_id, cast(row_number() over (partition by vec_id order by distance, neighbor_id) as integer) as rank, neighbor_id, distance
from p qualify rank <= {K}
"""
