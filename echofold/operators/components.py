"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; makes up a folder in local mode alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="echofold-")
    sc.setCheckpointDir(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """The table written to the checkpoint folder and read again: in columns and packed, a part of what a checkpoint of rows takes."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; a component is named by its smallest node.

    Every part of the edges is first brought down to the stars of its own
    components, wherever it lies. Then, each round, every node takes the smallest
    label among itself and its neighbours, then the label of its label, until
    nothing changes; labels are checkpointed, edges are read from the checkpoint
    made at the start. Loops and null nodes are left out; no edges give no nodes.
    """
    one = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    kind = one.schema["a"].dataType.simpleString()
    one = cut_lineage(one.mapInPandas(_stars, f"a {kind}, b {kind}"))
    both = cut_lineage(one.union(one.select("b", "a")).toDF("a", "b"))
    label = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        step = label.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "m").alias("l"), F.col("component").alias("was"))
        jump = step.select(F.col("node").alias("n2"), F.col("l").alias("l2"))
        new = cut_lineage(step.join(jump, F.col("l") == F.col("n2"), "left").select("node", F.least("l", F.coalesce("l2", "l")).alias("component"), "was"))
        moved = new.where("component <> was").limit(1).count()
        label = new.select("node", "component")
        if not moved:
            return label


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch's components as edges from their smallest nodes."""
    for rows in batches:
        nodes, code = np.unique(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]), return_inverse=True)
        parent = np.arange(len(nodes))
        u, v = code[: len(rows)], code[len(rows) :]
        while len(u):
            while not np.array_equal(parent[parent], parent):
                parent = parent[parent]
            lo, hi = np.minimum(parent[u], parent[v]), np.maximum(parent[u], parent[v])
            u, v = u[lo != hi], v[lo != hi]
            np.minimum.at(parent, hi[lo != hi], lo[lo != hi])
        leaf = np.flatnonzero(parent != np.arange(len(nodes)))
        yield pd.DataFrame({"a": nodes[parent[leaf]], "b": nodes[leaf]})


def interval_union(spans: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(keys, lo, hi): closed integer intervals merged where they overlap or touch."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        spans.withColumn("__new", F.when(F.col(lo) <= before + 1, 0).otherwise(1))
        .withColumn("__g", run)
        .groupBy(*keys, "__g")
        .agg(F.min(lo).alias(lo), F.max(hi).alias(hi))
        .drop("__g")
    )
