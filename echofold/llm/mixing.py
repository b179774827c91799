"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks of equal numbers of characters. Block
j (from 0) of a source with weight w is released at slot floor(j / w) and due
by slot ceil((j + 1) / w); serving, in each slot, the released block that is
due first (earliest deadline first, ties by source) keeps every source within
one block of its target at every slot. Weights are whole numbers of slots in a
period, so one period of the schedule repeats for ever: the driver computes that
period, which grows with the number of sources alone, and the slot of each
block follows by arithmetic wherever the block lies.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 16_384
PERIOD = 1_000
DRY = 0.05


def schedule(share: list[int]) -> list[list[int]]:
    """The slots, in one period of sum(share), of each source's blocks."""
    period = sum(share)
    slots: list[list[int]] = [[] for _ in share]
    due: list[tuple[int, int]] = []
    later: list[tuple[int, int]] = [(0, s) for s, n in enumerate(share) if n]
    heapq.heapify(later)
    for t in range(period):
        while later and later[0][0] <= t:
            _, s = heapq.heappop(later)
            heapq.heappush(due, (-(-(len(slots[s]) + 1) * period // share[s]), s))
        _, s = heapq.heappop(due)
        slots[s].append(t)
        j = len(slots[s])
        if j < share[s]:
            heapq.heappush(later, (j * period // share[s], s))
    return slots


def _offsets(rows: DataFrame, per_bucket: int) -> DataFrame:
    """Adds ``__at``, the characters of the source before this document, in the order of md5(id), id.

    A source may be of any size: it is cut by the first hexadecimal digits of
    the md5, the sums of the pieces are summed up, and windows run in the pieces.
    """
    n = rows.count()
    digits = 0
    while n > per_bucket << (4 * digits):
        digits += 1
    rows = rows.withColumn("__p", F.substring("__h", 1, digits) if digits else F.lit(""))
    by = Window.partitionBy("source").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "__p").agg(F.sum("__len").alias("__sum")).select(F.col("source").alias("__s"), F.col("__p").alias("__q"), F.coalesce(F.sum("__sum").over(Window.partitionBy("source").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("source", "__p").orderBy("__h", "doc_id", "__len").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("__in", F.coalesce(F.sum("__len").over(inside), F.lit(0)))
        .join(sums, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__p") == F.col("__q")))
        .withColumn("__at", F.col("__base") + F.col("__in"))
    )


def plan(sizes: list[tuple[str | None, int]], weights: dict | None, block: int, period: int, dry: float):
    """(source, slots in a period, their places, period), and the horizon in slots."""
    sizes = sorted(sizes, key=lambda x: (x[0] is not None, x[0]))
    if weights is None:
        want = [int(n**0.5) for _, n in sizes]
    else:
        want = [weights.get(s, 0) for s, _ in sizes]
    total = sum(want)
    period = max(period, 10 * len(sizes))
    share = [max(1, period * w // total) if w > 0 or weights is None else 0 for w in want] if total else [1 for _ in sizes]
    slots, whole = schedule(share), sum(share)
    ends = []
    for (s, n), k, at in zip(sizes, share, slots):
        blocks = max(1, -(-n // block))
        if k:
            ends.append(((blocks - 1) // k * whole + at[(blocks - 1) % k] + 1, k))
    gone, horizon = 0, 0
    for end, k in sorted(ends):
        gone, horizon = gone + k, end
        if gone > dry * whole:
            break
    return [(s, k, at, whole) for (s, _), k, at in zip(sizes, share, slots)], horizon


def mix(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    block: int = BLOCK,
    period: int = PERIOD,
    dry: float = DRY,
    per_bucket: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, block, slot, selected) for every row.

    ``weights`` are whole numbers by source (0 or absent: not in the mix);
    without them a source weighs the root of its characters, which tempers hot
    sources. Shares are rounded down to slots in a period of at least
    ``period``, but to one at least. The mix lasts until sources holding more
    than the share ``dry`` of it have run out: no document is used twice, and a
    tiny source can't cut the mix short. Documents whose block comes before
    that slot are ``selected``. A document belongs to the block in which its
    first character falls. Null sources are one source; null texts have no
    characters and lie where they fall; null ids count as the empty id; equal
    ids and repeated rows are taken one after another. Other columns are not
    read. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("__len"),
    ).withColumn("__h", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")))
    sizes = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum("__len").alias("n")).collect()]
    places, horizon = plan(sizes, weights, block, period, dry)
    turns = docs.sparkSession.createDataFrame(places, "__t string, __k int, __slots array<int>, __whole int")
    turns = F.broadcast(turns) if sum(len(x[2]) for x in places) <= 1_000_000 else turns
    b = F.floor(F.col("__at") / F.lit(block)).cast("long")
    return (
        _offsets(rows, per_bucket)
        .join(turns, F.col("source").eqNullSafe(F.col("__t")))
        .withColumn("block", b)
        .withColumn(
            "slot",
            F.when(
                F.col("__k") > 0,
                F.floor(F.col("block") / F.col("__k")).cast("long") * F.col("__whole")
                + F.element_at("__slots", (F.col("block") % F.greatest("__k", F.lit(1))).cast("int") + 1),
            ),
        )
        .select("doc_id", "source", "block", "slot", (F.coalesce(F.col("slot"), F.lit(horizon)) < horizon).alias("selected"))
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with their own columns."""
    ids = mix(docs).where("selected").select("doc_id")
    return common.only_ids(docs, ids, "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))


SQL = f"""
with recursive d as (
  select doc_id, source, coalesce(length(text), 0) as len, md5(cast(doc_id as varchar)) as h from documents),
sizes as (select source, sum(len) as n, cast(floor(sqrt(sum(len))) as bigint) as w from d group by source),
per as (select greatest({PERIOD}, 10 * count(*)) as p, sum(w) as total from sizes),
shares as (
  select source, n, row_number() over (order by source) as i,
         greatest(1, cast(p * w // total as bigint)) as k from sizes, per),
arr as (select list(k order by i) as ks, cast(sum(k) as bigint) as whole from shares),
sim(t, cnt, pick, ks, whole) as (
  select cast(-1 as bigint), list_transform(ks, lambda k: cast(0 as bigint)), cast(0 as bigint), ks, whole from arr
  union all
  select t + 1,
         list_transform(cnt, lambda c, i: c + case when i = best then 1 else 0 end),
         best, ks, whole
  from (select t, cnt, ks, whole,
          list_min(list_transform(cnt, lambda c, i:
            case when c < ks[i] and c * whole // ks[i] <= t + 1
                 then ((c + 1) * whole + ks[i] - 1) // ks[i] * 100000 + i
                 else 9000000000000000000 end)) % 100000 as best
        from sim where t + 1 < whole)),
places as (
  select s.source, row_number() over (partition by s.source order by t) - 1 as j, t
  from sim join shares s on s.i = sim.pick where t >= 0),
ends as (
  select s.source, s.k, (b - 1) // s.k * a.whole + p.t + 1 as finish
  from (select *, greatest(1, (n + {BLOCK - 1}) // {BLOCK}) as b from shares) s, arr a, places p
  where p.source = s.source and p.j = (b - 1) % s.k),
horizon as (
  select min(finish) as h from (
    select finish, sum(k) over (order by finish, k) as gone from ends), arr
  where gone > {DRY} * whole),
placed as (
  select doc_id, source, cast(coalesce(sum(len) over (partition by source order by h, doc_id
         rows between unbounded preceding and 1 preceding), 0) // {BLOCK} as bigint) as block from d)
select x.doc_id, x.source, x.block,
       x.block // s.k * a.whole + p.t as slot,
       x.block // s.k * a.whole + p.t < (select h from horizon) as selected
from placed x join shares s on x.source = s.source, arr a, places p
where p.source = x.source and p.j = x.block % s.k
"""
