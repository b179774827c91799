"""Source files as a table: discovery, one spelling of paths, bounded and forgiving reads."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import cut_lineage

SKIPPED = frozenset({".build", ".git", "DerivedData", ".swiftpm", "checkouts"})
FILES = "path string, source string, fingerprint string, detail string"


def canonical(path: str) -> str:
    """Absolute, without dots, links resolved."""
    return os.path.realpath(os.path.abspath(path))


def canonicalized(paths: list[str]) -> list[str]:
    """Canonical paths, each once, in the order of first sight."""
    return list(dict.fromkeys(canonical(p) for p in paths))


def discover(paths: list[str], suffix: str = ".swift", excluded=lambda path: False) -> list[str]:
    """Files named are taken as they are; folders are walked for ``suffix``, links followed, hidden and build folders skipped. Sorted, each once."""
    found: set[str] = set()
    for p in paths:
        p = os.path.abspath(p)
        if not os.path.isdir(p):
            found.add(p)
            continue
        stack, seen = [p], set()
        while stack:
            folder = stack.pop()
            if (real := os.path.realpath(folder)) in seen:
                continue
            seen.add(real)
            for e in os.scandir(folder):
                if e.name.startswith(".") or e.name in SKIPPED:
                    continue
                if e.is_dir():
                    stack.append(e.path)
                elif e.name.endswith(suffix) and not excluded(e.path):
                    found.add(e.path)
    return sorted(found)


@F.pandas_udf(T.StringType())
def _text(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def _told(raw: DataFrame, cap: int) -> DataFrame:
    path = F.regexp_replace("path", "^file:/+", "/")
    fits = F.col("length") <= cap
    return raw.select(
        path.alias("path"),
        F.when(fits, _text(F.when(fits, F.col("content")))).alias("source"),
        F.when(fits, F.concat_ws("-", F.md5("content"), F.col("length").cast("string"))).alias("fingerprint"),
        F.when(~fits, F.concat(F.lit("more than "), F.lit(cap).cast("string"), F.lit(" bytes"))).alias("detail"),
    )


def read_files(spark: SparkSession, paths: list[str], cap: int) -> DataFrame:
    """(path, source, fingerprint, detail) of the files named, read by the executors.

    A file that is missing, unreadable or larger than ``cap`` has no source, and
    ``detail`` says why; the others are read on. Bytes that are no UTF-8 become
    replacement marks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            for p in pdf["path"]:
                row = {"path": p, "source": None, "fingerprint": None, "detail": None}
                try:
                    if not os.path.isfile(p):
                        raise OSError("not a regular file")
                    with open(p, "rb") as f:
                        data = f.read(cap + 1)
                    if len(data) > cap:
                        raise OSError(f"more than {cap} bytes")
                    row |= {"source": data.decode("utf-8", "replace"), "fingerprint": f"{hashlib.md5(data).hexdigest()}-{len(data)}"}
                except OSError as e:
                    row["detail"] = e.strerror or str(e)
                yield pd.DataFrame([row])

    names = spark.createDataFrame([(p,) for p in paths], "path string")
    return names.repartition(max(1, min(len(paths) // 16 + 1, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, FILES)


def scan(spark: SparkSession, root: str, suffix: str = ".swift", cap: int = 10 << 20, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The same columns from a whole folder of any file system, listed by Spark; contents beyond the cap are not read into rows."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(root)
    for x in exclude:
        raw = raw.where(~F.contains("path", F.lit(x)))
    hidden = F.exists(F.split(F.substring(F.col("path"), len(root) + 1, 1 << 20), "/"), lambda s: s.startswith(".") | s.isin(*sorted(SKIPPED)))
    return _told(raw.where(~hidden), cap)


def numbered(files: DataFrame) -> DataFrame:
    """Adds ``unit``, which grows with the path, without gathering rows in one task; checkpointed, so that numbers stay."""
    return cut_lineage(files.orderBy("path").withColumn("unit", F.monotonically_increasing_id()))
