"""Facts of files already lexed, kept as a table keyed by path and content."""

from __future__ import annotations

import shutil
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexer
from ..operators.components import cut_lineage

VERSION = "echofold-1"
FACTS = "version string, path string, fingerprint string, " + lexer.UNITS.removeprefix("unit long, path string, ")
COLUMNS = ["path", "fingerprint", "toks", "bounds", "directives", "located"]


def load(spark: SparkSession, path: str | None) -> DataFrame:
    """Facts kept at ``path`` by this version; none if there are none or they can't be read."""
    empty = spark.createDataFrame([], FACTS)
    if not path:
        return empty.select(*COLUMNS)
    try:
        got = spark.read.schema(FACTS).parquet(path)
        got.where(F.col("version") == VERSION).select("path").limit(1).collect()
    except (PySparkException, Py4JJavaError):  # a damaged cache is no cache
        return empty.select(*COLUMNS)
    return got.where(F.col("version") == VERSION).select(*COLUMNS)


def units(files: DataFrame, known: DataFrame) -> tuple[DataFrame, int, int]:
    """Token units of ``files(unit, path, source, fingerprint)``, with how many came from ``known`` and how many were lexed anew."""
    keys = ["path", "fingerprint"]
    hit = files.select("unit", *keys).join(known, keys)
    missed = files.join(known.select(*keys), keys, "left_anti")
    made = lexer.units(missed.select("unit", "path", "source")).join(missed.select("path", "fingerprint"), "path")
    both = cut_lineage(hit.select("unit", *COLUMNS).unionByName(made.select("unit", *COLUMNS)))
    hits = hit.count()
    return both, hits, both.count() - hits


def save(units_: DataFrame, path: str) -> None:
    """Replaces the facts at ``path`` by those of this run's files alone, in one move."""
    tmp, at = Path(f"{path}.part"), Path(path)
    shutil.rmtree(tmp, ignore_errors=True)
    units_.select(F.lit(VERSION).alias("version"), *COLUMNS).write.mode("overwrite").parquet(str(tmp))
    if at.is_dir():
        shutil.rmtree(at, ignore_errors=True)
    elif at.exists():
        at.unlink()
    tmp.rename(at)


def changed(units_: DataFrame, known: DataFrame) -> bool:
    """Whether the files differ from those kept."""
    a, b = units_.select("path").distinct(), known.select("path").distinct()
    return a.exceptAll(b).limit(1).count() > 0 or b.exceptAll(a).limit(1).count() > 0
