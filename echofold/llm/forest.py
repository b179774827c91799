"""Embedding near-dedup by a forest of random-projection trees.

In each tree a node's vectors are projected on a random direction and split at
the median; those within a band around it go to both sides (spill), so that near
vectors part seldom, and seldom in all trees. Upper levels are split in Spark,
at quantiles over all of a node's vectors; once a node fits a task, the task
splits it on, down to leaves in which all pairs are compared. Pairs that reach
the cosine are verified on the full vectors and united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

COSINE = 0.95
TREES = 8
LEAF = 512
SPILL = 0.1
PER_TASK = 20_000


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def direction(dim: int, tree: int, level: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, level]).normal(size=dim)


def compare(x: np.ndarray, cosine: float, forest: common.Forest, rows: np.ndarray, step: int = 2048) -> None:
    """Unites all pairs of ``rows`` that reach the cosine."""
    for i in range(0, len(rows), step):
        for j in range(i, len(rows), step):
            a, b = np.nonzero(x[rows[i : i + step]] @ x[rows[j : j + step]].T >= cosine)
            forest.join(rows[i + a], rows[j + b])


def descend(x: np.ndarray, cosine: float, leaf: int, spill: float, rng) -> common.Forest:
    """Splits down to leaves; a node that five directions can't split is compared whole."""
    forest = common.Forest(len(x))
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) > leaf:
            for _ in range(5):
                p = x[rows] @ rng.normal(size=x.shape[1])
                low, high = np.quantile(p, [0.5 - spill / 2, 0.5 + spill / 2])
                left, right = rows[p <= high], rows[p >= low]
                if max(len(left), len(right)) < 0.9 * len(rows):
                    todo += [left, right]
                    break
            else:
                compare(x, cosine, forest, rows)
        elif len(rows) > 1:
            compare(x, cosine, forest, rows)
    return forest


def route(pdf: pd.DataFrame, cuts: dict, trees: int, seed: int, split: int) -> pd.DataFrame:
    """(tree, node, row, projection at level ``split``) of each vector under the cuts known so far."""
    x = unit(np.stack(pdf["v"].to_list()))
    out = []
    for t in range(trees):
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        for level in range(split):
            p = x @ direction(x.shape[1], t, level, seed)
            low = np.array([cuts[t, n][0] for n in node.tolist()])
            high = np.array([cuts[t, n][1] for n in node.tolist()])
            left, right = p[row] <= high, p[row] >= low
            node = np.concatenate([2 * node[left], 2 * node[right] + 1])
            row = np.concatenate([row[left], row[right]])
        p = x @ direction(x.shape[1], t, split, seed)
        out.append(pd.DataFrame({"tree": t, "node": node, "row": row, "p": p[row]}))
    return pd.concat(out)


def links(vectors: DataFrame, cosine: float, trees: int, leaf: int, spill: float, per_task: int, seed: int) -> DataFrame:
    """Edges (u, v) of ids that join the near vectors of (id, v), whose vectors are distinct and of one length."""
    n, depth = vectors.count(), 0
    while n * (0.5 + spill / 2) ** depth > max(per_task, leaf):
        depth += 1
    cuts: dict = {}
    for level in range(depth):
        known = dict(cuts)

        def project(batches: Iterator[pd.DataFrame], known=known, level=level) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield route(pdf, known, trees, seed, level)[["tree", "node", "p"]]

        at = vectors.select("v").mapInPandas(project, "tree int, node long, p double").groupBy("tree", "node").agg(F.percentile_approx("p", [0.5 - spill / 2, 0.5 + spill / 2], 1000).alias("q"))
        cuts |= {(r["tree"], r["node"]): tuple(r["q"]) for r in at.collect()}

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            to = route(pdf, cuts, trees, seed, depth)
            got = pdf.iloc[to["row"].to_numpy()].reset_index(drop=True)
            yield pd.DataFrame({"tree": to["tree"].to_numpy(), "node": to["node"].to_numpy(), "id": got["id"], "v": got["v"]})

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        rng = np.random.default_rng([seed, int(key[0]), int(key[1])])
        root = descend(unit(np.stack(pdf["v"].to_list())), cosine, leaf, spill, rng).roots(np.arange(len(ids)))
        member = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"u": ids[member], "v": ids[root[member]]})

    return vectors.select("id", "v").mapInPandas(spread, "tree int, node long, id long, v array<float>").groupBy("tree", "node").applyInPandas(grow, "u long, v long")


def groups(
    vectors: DataFrame,
    cosine: float = COSINE,
    trees: int = TREES,
    leaf: int = LEAF,
    spill: float = SPILL,
    per_task: int = PER_TASK,
    seed: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, group_id, keep): the near-dup group of every vector.

    Vectors are in one group if a chain of pairs of at least ``cosine`` joins
    them; ``group_id`` is the smallest vec_id of the group and that one, or one
    of its repeated rows, is kept. Equal vectors are grouped without search, so
    thousands of copies cost one. Vectors that are null, zero, hold nulls or
    NaN, or have not the most common length are groups of their own and kept;
    so are rows without an id. Other columns are not read. An empty table gives
    an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v"))
    usual = rows.agg(F.mode(F.size("v"), True)).first()[0] or 0
    fit = (
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & (F.size("v") == usual)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    good = rows.where("fit").drop("fit")
    reps = common.checkpoint(good.groupBy("v").agg(F.min("vec_id").alias("id")))
    tree = common.components(links(reps, cosine, trees, leaf, spill, per_task, seed))
    named = good.join(reps, "v").join(tree, F.col("id") == F.col("node"), "left").select("vec_id", F.coalesce("root", "id").alias("group_id"))
    told = named.withColumn("keep", F.row_number().over(Window.partitionBy("group_id").orderBy("vec_id")) == 1)
    return told.unionByName(rows.where(~F.col("fit")).select("vec_id", F.col("vec_id").alias("group_id"), F.lit(True).alias("keep")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "embeddings"))


SQL = f"""
with recursive e as (
  select x.vec_id as u, y.vec_id as v from embeddings x join embeddings y on x.vec_id <> y.vec_id
  where list_cosine_similarity(cast(x.embedding as double[]), cast(y.embedding as double[])) >= {COSINE}),
reach(u, v) as (select vec_id, vec_id from embeddings union select r.u, e.v from reach r join e on e.u = r.v)
select u as vec_id, min(v) as group_id, min(v) = u as keep from reach group by u
"""
