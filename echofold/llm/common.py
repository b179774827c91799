"""Pieces the training-data operators share.

Nothing here keeps state on a machine: lineage is cut with ``checkpoint()``
and files go to the shared folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; made up only in local mode, as in tests."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path and not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    path = path or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="echofold-")
        sc.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: a checkpoint in columns, far smaller than one of rows."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_names(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns of the input whose names a result needs get the suffix ``_in``."""
    taken = {x.lower() for x in names}
    have = {c.lower() for c in df.columns}
    renamed = []
    for c in df.columns:
        new = c
        if c.lower() in taken:
            new = c + "_in"
            while new.lower() in have | taken:
                new += "_in"
            have.add(new.lower())
        renamed.append(new)
    return df.toDF(*renamed) if renamed != df.columns else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one whose scan has fewer parts than there are cores is parted anew, larger ones stay where they are."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


@F.pandas_udf(T.IntegerType())
def _words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([0 if t is None else len(t.split()) for t in s], dtype="int32")


def words(text: Column) -> Column:
    """Number of words parted by white space, as ``str.split`` does it everywhere here; 0 for null and for blank text."""
    return _words(text)


def slices(text: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` characters, or of one longer text, so that a batch's words are never all in memory."""
    size = pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < len(size):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, to
        at = to


class Forest:
    """Union-find over 0..n-1 that keeps the smallest member as root."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hook larger roots under smaller ones, all edges at once, until nothing moves."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            open_ = lo != hi
            if not open_.any():
                return
            a, b = lo[open_], hi[open_]
            np.minimum.at(self.parent, b, a)

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(q, p):
                self.parent = p
                return p[x]
            p = q


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of undirected ``edges(u, v)``; root is the smallest node.

    Alternating large-star and small-star: every round ships each edge a
    constant number of times, and the rounds grow with the logarithm of the
    longest path. Each round is checkpointed. Null ends and loops are ignored.
    """
    now = checkpoint(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        near = Window.partitionBy("u")
        large = (
            both.withColumn("m", F.least("u", F.min("v").over(near)))
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        low = large.withColumn("m", F.min("v").over(near))
        small = (
            low.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = checkpoint(small)
        mark = now.agg(
            F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))
        ).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select("v", "v").distinct()
    )


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids``. Rows without an id stay.

    A repeated id leaves one row, that of the least hash over all columns, so
    the same one each time; equal rows are one.
    """
    kept = ids.select(F.col(ids.columns[0]).alias("__id")).where("__id is not null").distinct()
    with_id = docs.join(kept, docs[id_col] == kept["__id"], "left_semi")
    n = docs.select(F.count(id_col).alias("n"), F.count_distinct(id_col).alias("d")).first()
    if n["n"] != n["d"]:
        marked = docs.withColumn("__mark", F.xxhash64(*docs.columns))
        least = marked.groupBy(F.col(id_col).alias("__id")).agg(F.min("__mark").alias("__least")).where("__id is not null")
        kept = kept.join(least, "__id")
        with_id = marked.join(kept, (marked[id_col] == kept["__id"]) & (marked["__mark"] == kept["__least"]), "left_semi").drop("__mark").dropDuplicates([id_col])
    return with_id.unionByName(docs.where(F.col(id_col).isNull()))


def pieces(n: int, size: int) -> int:
    return max(1, -(-n // size))
