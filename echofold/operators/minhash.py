"""MinHash signatures as an aggregation, and the pairs that reach an estimate by a set join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import MASK, P61, U, minhash, minhash_family
from . import grams
from .components import kept
from .structural import pairs_of


def signatures(values: DataFrame, id_col: str, hashes: int = 256, seed: int = 42) -> DataFrame:
    """(id, signature) of the sets in (id, x): the least of each hash over a set's values, as array<long>.

    Batches are reduced where they lie, one partial signature for each set met
    in a batch; the least of the partial ones is taken position by position.
    Null values count for nothing, and a set without values has no row.
    """
    a, b = minhash_family(hashes, seed)
    kind = values.schema[id_col].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values(id_col, kind="stable")
            code = pd.factorize(pdf[id_col])[0]
            x = pdf["x"].to_numpy(dtype=np.int64).view(U)
            cuts = np.flatnonzero(np.diff(code)) + 1
            ends = [0, *cuts, len(x)] if len(x) else [0]
            made = [minhash(x[i:j], a, b).view(np.int64) for i, j in zip(ends, ends[1:])]
            yield pd.DataFrame({id_col: pdf[id_col].iloc[ends[:-1]].to_numpy(), "part": pd.Series(made, dtype=object)})

    # without nulls pandas keeps the values whole numbers
    return _whole(values.select(id_col, "x").dropna().mapInPandas(partial, f"{id_col} {kind}, part array<long>"), id_col, hashes)


def _whole(parts: DataFrame, id_col: str, hashes: int) -> DataFrame:
    """(id, signature) from partial signatures (id, part)."""
    least = [F.min(F.get("part", F.lit(i))).alias(f"h{i}") for i in range(hashes)]
    return parts.groupBy(id_col).agg(*least).select(id_col, F.array(*[f"h{i}" for i in range(hashes)]).alias("signature"))


def of_segments(segs: DataFrame, lane: str, size: int, hashes: int = 256, seed: int = 42) -> DataFrame:
    """(unit, signature) over all runs of ``size`` words of a unit's segments; a run's value is 60 bits of its md5.

    The least of a hash doesn't mind a value that comes twice, so runs are
    hashed where their segments lie and never sent; only partial signatures are.
    """
    a, b = minhash_family(hashes, seed)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, many, words in grams.lists(batch, "lane", 50_000):
                at, row, _ = grams.places(many, size)
                if not len(at):
                    continue
                x = grams.digests(words, at, size)[:, 0] >> U(4)
                unit = grams.numbers(part.column("unit"))[row]
                first = grams.heads(unit)
                out = np.empty((len(first), hashes), U)
                with np.errstate(over="ignore"):
                    for i in range(hashes):
                        h = x * a[i] + b[i]
                        h = (h & U(P61)) + (h >> U(61))
                        out[:, i] = np.minimum.reduceat(np.where(h >= U(P61), h - U(P61), h), first)
                yield pa.RecordBatch.from_arrays([pa.array(unit[first]), pa.ListArray.from_arrays(np.arange(len(first) + 1, dtype=np.int32) * hashes, out.view(np.int64).ravel())], names=["unit", "part"])

    told = segs.where("unit is not null").select("unit", segs[lane].alias("lane"))
    return _whole(told.mapInArrow(partial, "unit long, part array<long>"), "unit", hashes)


def empty_signature(hashes: int = 256) -> list[int]:
    """That of a set without values: all ones, -1 as a long."""
    return [MASK - (1 << 64)] * hashes


def pairs(signed: DataFrame, id_col: str, hashes: int, least: float) -> DataFrame:
    """(a, b, copies_a, copies_b, estimate): pairs of distinct signatures that agree in a share of ``least`` or more.

    A signature is named by its smallest id and counts its copies. As a set of
    (place, value) a signature agrees in a share e with another where their
    Jaccard similarity is e / (2 - e), so the prefix join finds all pairs.
    """
    reps = kept(signed.groupBy("signature").agg(F.min(id_col).alias("id"), F.count("*").alias("copies")))
    sets = reps.select("id", F.transform("signature", lambda v, i: F.xxhash64(i, v)).alias("features"))
    near = pairs_of(sets, (least / (2 - least)) - 1e-12).select("a", "b", (2 * F.col("similarity") / (1 + F.col("similarity"))).alias("estimate"))
    x, y = reps.select(F.col("id").alias("a"), F.col("copies").alias("copies_a")), reps.select(F.col("id").alias("b"), F.col("copies").alias("copies_b"))
    return near.join(x, "a").join(y, "b").select("a", "b", "copies_a", "copies_b", "estimate")
