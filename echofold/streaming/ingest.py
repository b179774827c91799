"""Files that arrive in a folder: facts are kept up to date, findings are those of the whole corpus.

Detection on a part of a corpus gives wrong results, not fewer, so each batch
only lexes what is new and then compares all units again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexer
from ..operators import reporting
from ..plans.config import Configuration
from ..plans.detect import detect
from ..sources import files as sources


def upsert(known: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Files (path, source, stamp) with the latest row of each path."""
    both = batch if known is None else known.unionByName(batch)
    w = Window.partitionBy("path").orderBy(F.col("stamp").desc(), F.xxhash64("source"))
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def findings_of(files: DataFrame, configuration: Configuration) -> DataFrame:
    units = lexer.units(sources.numbered(files.select("path", "source")))
    return reporting.findings(reporting.precedence(detect(units, configuration.settings())), configuration.severity)


def watch(spark: SparkSession, folder: str, corpus: str, out: str, checkpoint: str, configuration: Configuration = Configuration(), suffix: str = ".swift"):
    """Starts a query over files arriving below ``folder``.

    ``corpus`` keeps every version of the table of files, one folder a batch, so
    that a batch may be run again; ``out`` gets the findings of each batch.
    """
    stream = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )

    def step(batch: DataFrame, n: int) -> None:
        new = batch.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), sources._text(F.col("content")).alias("source"), F.col("modificationTime").alias("stamp"))
        known = spark.read.parquet(f"{corpus}/{n - 1}") if n else None
        upsert(known, new).write.mode("overwrite").parquet(f"{corpus}/{n}")
        findings_of(spark.read.parquet(f"{corpus}/{n}"), configuration).write.mode("overwrite").parquet(f"{out}/{n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
