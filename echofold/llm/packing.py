"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents longer than a sequence are cut into full sequences and a remainder,
so whole texts are packed. The pieces are parted by a hash of the document, and
each part is evolved on several islands. An individual is a set of bins.
Crossover injects whole well-filled bins of one parent into the other, takes
out the other's bins that hold any of their pieces, and best-fits the pieces so
displaced, largest first; mutation empties a few of the worst-filled bins the
same way. After each era every island's elite migrates to the next island of its
part. The best individual of a part's islands is its packing.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
ISLANDS = 2
ERAS = 2
BROOD = 4
TURNS = 6
PER_PART = 4_000


def best_fit(sizes: np.ndarray, which: np.ndarray, bins: list[list[int]], capacity: int) -> None:
    """Puts the pieces ``which``, largest first, each into the fullest bin that holds it, else a new one."""
    room = [capacity - sum(int(sizes[i]) for i in b) for b in bins]
    free = sorted((r, k) for k, r in enumerate(room) if r > 0)
    for i in which[np.lexsort((which, -sizes[which]))]:
        n = int(sizes[i])
        at = bisect_left(free, (n, -1))
        if at < len(free):
            r, k = free.pop(at)
            bins[k].append(int(i))
        else:
            r, k = capacity, len(bins)
            bins.append([int(i)])
        if r > n:
            insort(free, (r - n, k))


def fitness(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> float:
    """Mean squared fill: fewer bins first, then full ones beside empty ones."""
    return sum((sum(int(sizes[i]) for i in b) / capacity) ** 2 for b in bins) / len(bins) if bins else 0.0


def cross(a: list[list[int]], b: list[list[int]], sizes: np.ndarray, capacity: int, rng) -> list[list[int]]:
    fill = np.array([sum(int(sizes[i]) for i in x) for x in a])
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    lo, hi = sorted(rng.integers(0, len(good) + 1, 2))
    gift = [list(a[k]) for k in good[lo : max(hi, lo + 1)]]
    given = {i for x in gift for i in x}
    kept, loose = [], []
    for x in b:
        if given.isdisjoint(x):
            kept.append(list(x))
        else:
            loose.extend(i for i in x if i not in given)
    out = gift + kept
    best_fit(sizes, np.array(loose, dtype=np.int64), out, capacity)
    return out


def mutate(a: list[list[int]], sizes: np.ndarray, capacity: int, rng) -> list[list[int]]:
    fill = np.array([sum(int(sizes[i]) for i in x) for x in a])
    gone = set(np.argsort(fill, kind="stable")[: max(2, len(a) // 50)].tolist()) | set(rng.integers(0, len(a), 2).tolist())
    out = [list(x) for k, x in enumerate(a) if k not in gone]
    best_fit(sizes, np.array([i for k in sorted(gone) for i in a[k]], dtype=np.int64), out, capacity)
    return out


def first_brood(sizes: np.ndarray, capacity: int, rng, brood: int) -> list[list[list[int]]]:
    """Best-fit decreasing, and best fits around random first bins."""
    every = np.arange(len(sizes))
    out = []
    for k in range(brood):
        bins: list[list[int]] = []
        if k:
            some = rng.permutation(len(sizes))[: len(sizes) // 4]
            room = 0
            for i in some:
                if not bins or sizes[i] > room:
                    bins.append([])
                    room = capacity
                bins[-1].append(int(i))
                room -= int(sizes[i])
            best_fit(sizes, np.setdiff1d(every, some), bins, capacity)
        else:
            best_fit(sizes, every, bins, capacity)
        out.append(bins)
    return out


def evolve(brood: list[list[list[int]]], sizes: np.ndarray, capacity: int, rng, turns: int) -> list[list[list[int]]]:
    """The brood after ``turns`` generations, best first; the elite never gets worse."""
    rank = lambda xs: sorted(xs, key=lambda x: (len(x), -fitness(sizes, x, capacity)))
    keep = len(brood)
    brood = rank(brood)
    for _ in range(turns):
        a, b = rng.integers(0, len(brood), 2)
        young = [cross(brood[min(a, b)], brood[max(a, b)], sizes, capacity, rng), cross(brood[max(a, b)], brood[min(a, b)], sizes, capacity, rng), mutate(brood[0], sizes, capacity, rng)]
        brood = rank(brood + young)[:keep]
    return brood


def _numbers(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, x in enumerate(bins):
        out[x] = k
    return out


def _bins(numbers: np.ndarray) -> list[list[int]]:
    order = np.argsort(numbers, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1)] if len(numbers) else []


def cut(docs: DataFrame, length: Column, capacity: int, id_col: str) -> DataFrame:
    """(row, doc_id, piece, start, n): pieces of at most ``capacity``; documents without length have none.

    Rows are numbered, so that pieces of rows with one id, or with none, are told apart; checkpoint the result.
    """
    n = F.coalesce(length, F.lit(0)).cast("long")
    last = F.floor((F.col("__n") - 1) / F.lit(capacity)).cast("long")
    return (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("doc_id"), n.alias("__n"))
        .where("__n > 0")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("start", F.col("piece") * capacity)
        .withColumn("n", F.least(F.lit(capacity).cast("long"), F.col("__n") - F.col("start")))
        .drop("__n")
    )


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    length: Column | None = None,
    islands: int = ISLANDS,
    eras: int = ERAS,
    brood: int = BROOD,
    turns: int = TURNS,
    per_part: int = PER_PART,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 11,
) -> DataFrame:
    """(row, doc_id, piece, start, n, bin, offset): where each piece of each document goes.

    ``length`` is a column of ``docs``, words by default. Piece p covers the
    units from ``start``, ``n`` of them; ``bin`` is the sequence and ``offset``
    its place there. Null and blank texts have no pieces. Rows without an id
    and repeated rows are packed as documents of their own: ``row`` numbers the
    rows by their place in the input, so the same files give the same packing.
    Other columns are not read. An empty table gives an empty result.
    """
    made = common.checkpoint(cut(docs, common.words(F.col(text_col)) if length is None else length, capacity, id_col))
    full = made.where(F.col("n") == capacity)
    rest = made.where(F.col("n") < capacity)
    parts = common.pieces(rest.count(), per_part)
    cols = ["row", "doc_id", "piece", "start", "n"]
    types = "row long, doc_id string, piece long, start long, n long"
    state = f"part int, island int, {types}, brood array<int>"
    order = ["doc_id", "row", "piece"]

    def rng_of(part: int, island: int, era: int):
        return np.random.default_rng([seed, part, island, era])

    def rows(key: tuple, pdf: pd.DataFrame, bred: list[list[list[int]]]) -> pd.DataFrame:
        numbers = np.stack([_numbers(x, len(pdf)) for x in bred], axis=1)
        return pdf[cols].assign(part=key[0], island=key[1], brood=list(numbers))[["part", "island", *cols, "brood"]]

    def begin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        sizes, rng = pdf["n"].to_numpy(), rng_of(int(key[0]), int(key[1]), 0)
        return rows(key, pdf, evolve(first_brood(sizes, capacity, rng, brood), sizes, capacity, rng, turns))

    def go_on(era: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            # a part's pieces come twice, from the island itself and, as one elite, from its neighbour
            pdf = pdf.sort_values(order, kind="stable")
            own = pdf[~pdf["guest"]].reset_index(drop=True)
            guest = pdf[pdf["guest"]]
            sizes, rng = own["n"].to_numpy(), rng_of(int(key[0]), int(key[1]), era)
            bred = [_bins(x) for x in np.stack(own["brood"].to_list()).T]
            if len(guest):
                bred.append(_bins(np.stack(guest["brood"].to_list())[:, 0]))
            return rows(key, own, evolve(bred, sizes, capacity, rng, turns)[:brood])

        return run

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = None
        for _, own in pdf.sort_values(["island", *order], kind="stable").groupby("island", sort=True):
            sizes, numbers = own["n"].to_numpy(), np.stack(own["brood"].to_list())[:, 0]
            bins = _bins(numbers)
            value = (-len(bins), fitness(sizes, bins, capacity))
            if found is None or value > found[0]:
                found = value, own.reset_index(drop=True), numbers
        _, own, numbers = found
        own = own[cols].assign(part=key[0], bin=numbers)
        own = own.sort_values(["bin", "n", *order], ascending=[True, False, True, True, True])
        return own.assign(offset=own.groupby("bin")["n"].cumsum() - own["n"])[["part", *cols, "bin", "offset"]]

    spread = rest.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.lit(parts)).cast("int")).withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    now = spread.groupBy("part", "island").applyInPandas(begin, state)
    for era in range(1, eras):
        now = common.checkpoint(now)
        guests = now.withColumn("island", (F.col("island") + 1) % islands).withColumn("brood", F.slice("brood", 1, 1))
        both = now.withColumn("guest", F.lit(False))
        if islands > 1:
            both = both.unionByName(guests.withColumn("guest", F.lit(True)))
        now = both.groupBy("part", "island").applyInPandas(go_on(era), state)
    chosen = now.groupBy("part").applyInPandas(best, f"part int, {types}, bin int, offset long")
    name = lambda *c: F.concat_ws("-", *c)
    ids = docs.schema[id_col].dataType
    out = chosen.select(*cols, name(F.lit("p"), "part", "bin").alias("bin"), "offset").unionByName(
        full.select(*cols, name(F.lit("d"), "row", "piece").alias("bin"), F.lit(0).cast("long").alias("offset"))
    )
    return out.withColumn("doc_id", F.col("doc_id").cast(ids))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of the documents."""
    return pack(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
