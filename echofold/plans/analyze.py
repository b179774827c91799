"""The whole analysis: files to findings, with suppressions, scope, baseline and cache."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import embed_udf
from ..functions.lexer import snippet_table, units as lex_units
from ..operators import reporting, semantic
from ..operators.components import cut_lineage
from ..sources import facts, files as sources
from . import config as cfg
from .detect import detect

#: Name to a function of a text column that gives vectors; more can be registered.
PROVIDERS = {"ngrams": lambda: embed_udf()}


@dataclass(frozen=True)
class Semantic:
    provider: str = "ngrams"
    options: semantic.Options = semantic.PRESETS["balanced"]


@dataclass
class Report:
    """Findings, and what was set aside; all tables have the columns of findings."""

    findings: DataFrame
    suppressed: DataFrame
    out_of_scope: DataFrame
    degraded: DataFrame
    analyzed: int = 0
    hits: int = 0
    misses: int = 0
    cancelled: bool = False
    note: str | None = None
    baselined: int = 0
    extra: dict = field(default_factory=dict)

    def severity(self) -> str | None:
        """The highest severity among the findings."""
        told = {r[0] for r in self.findings.select("severity").distinct().collect()}
        return "error" if "error" in told else "warning" if told else None


COLUMNS = ["rule", "severity", "path", "line", "column", "message", "note", "related", "fingerprint"]


def semantic_members(files: DataFrame, how: Semantic) -> tuple[DataFrame | None, str]:
    """Members of the semantic groups of ``files(path, source)``, and a note on the pass. A provider that can't be had leaves the pass out."""
    made = PROVIDERS.get(how.provider)
    if made is None:
        return None, f"semantic pass left out: no provider {how.provider}"
    try:
        embed = made()
    except Exception as e:  # a provider is the caller's code; without it the other rules still hold
        return None, f"semantic pass left out: {e}"
    s = cut_lineage(snippet_table(files).withColumn("v", embed(F.col("code"))))
    got = semantic.discover(s, how.options)
    rows = got.join(s, F.col("node") == F.col("id")).select(
        F.lit("semantic").alias("type"),
        F.col("component").cast("string").alias("grp"),
        "file",
        "first",
        F.lit(1).alias("column"),
        "last",
        "tokens",
        "similarity",
        F.concat(F.lit("embedding-"), F.col("component").cast("string")).alias("fingerprint"),
    )
    return rows, f"semantic pass by {how.provider} over {s.count()} snippets"


def analyze(
    spark: SparkSession,
    paths: list[str] | None = None,
    configuration: cfg.Configuration = cfg.Configuration(),
    scope: list[str] | None = None,
    cache: str | None = None,
    how: Semantic | None = None,
    files: DataFrame | None = None,
    cancelled=lambda: False,
) -> Report:
    """Analyses the files at ``paths``, or a table ``files(path, source, fingerprint, detail)``.

    The whole corpus is always compared; ``scope`` narrows the report alone:
    None reports all, an empty list nothing. A cancelled run reports nothing.
    """
    if files is None:
        paths = sources.canonicalized(paths or [])
        if not paths:
            raise cfg.NoInputs("no files")
        files = sources.read_files(spark, paths, cfg.SOURCE_CAP)
    files = sources.numbered(files)
    degraded = files.where("detail is not null").select("path", "detail")
    good = files.where("detail is null")
    known = cut_lineage(facts.load(spark, cache))
    units, hits, misses = facts.units(good, known)
    if cache and (misses or facts.changed(units, known)):
        try:
            facts.save(units, cache)
        except OSError:  # a cache that can't be kept costs time, not results
            pass
    n = files.count()
    none = _empty(spark)
    if cancelled():
        return Report(none, none, none, degraded, n, hits, misses, cancelled=True)
    members, note = detect(units, configuration.settings()), None
    if how is not None and configuration.is_enabled("semantic-clone"):
        more, note = semantic_members(good.select("path", "source"), how)
        members = members if more is None else members.unionByName(more)
    found = reporting.findings(reporting.precedence(members), configuration.severity)
    root = cfg.common_root([r[0] for r in files.select("path").toLocalIterator()]) if paths else None
    anchored = F.col("path") if root is None else F.when(F.startswith("path", F.lit(root + "/")), F.substring(F.col("path"), len(root) + 2, 1 << 20)).otherwise(F.col("path"))
    found = cut_lineage(reporting.fingerprints(found, anchored))
    told = units.select(F.col("path").alias("file"), F.explode("directives").alias("d")).select("file", "d.*")
    judged = reporting.in_scope(reporting.suppressions(found, told), None if scope is None else spark.createDataFrame([(p,) for p in scope], "path string"))
    judged = cut_lineage(judged)
    order = ["path", "line", "column", "rule"]
    return Report(
        judged.where("in_scope and not suppressed").select(*COLUMNS).orderBy(*order),
        judged.where("suppressed").select(*COLUMNS, "reason").orderBy(*order),
        judged.where("not in_scope and not suppressed").select(*COLUMNS).orderBy(*order),
        degraded,
        n,
        hits,
        misses,
        note=note,
    )


def analyze_source(spark: SparkSession, source: str, path: str = "source.swift", configuration: cfg.Configuration = cfg.Configuration(), how: Semantic | None = None) -> Report:
    """One text as the whole corpus: no cache, paths as given."""
    table = spark.createDataFrame([(path, source, None, None)], sources.FILES).withColumn("fingerprint", F.md5("source"))
    return analyze(spark, configuration=configuration, files=table, how=how)


def against_baseline(report: Report, spark: SparkSession, fingerprints: list[str]) -> Report:
    """The report without findings already on the list."""
    known = spark.createDataFrame([(x,) for x in fingerprints], "fingerprint string")
    new, old = reporting.against(report.findings, known)
    report.findings, report.baselined = new.orderBy("path", "line", "column", "rule"), old.count()
    return report


def relativized(report: Report, root: str) -> Report:
    """Paths below ``root`` relative to it, in related places and notes too. Fingerprints stay."""
    root = root.rstrip("/")
    cut = lambda c: F.when(F.startswith(c, F.lit(root + "/")), F.substring(c, len(root) + 2, 1 << 20)).otherwise(c)

    def done(df: DataFrame) -> DataFrame:
        out = df.withColumn("related", F.transform("related", lambda r: F.struct(cut(r["path"]).alias("path"), r["line"].alias("line"), r["column"].alias("column")))).withColumn("path", cut(F.col("path")))
        places = F.array_join(F.transform("related", lambda r: F.concat(r["path"], F.lit(":"), r["line"].cast("string"))), ", ")
        return out.withColumn("note", F.concat(F.lit("duplicates: "), places))

    report.findings, report.suppressed, report.out_of_scope = done(report.findings), done(report.suppressed), done(report.out_of_scope)
    report.degraded = report.degraded.withColumn("path", cut(F.col("path")))
    return report


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "rule string, severity string, path string, line int, column int, message string, note string, related array<struct<path:string,line:int,column:int>>, fingerprint string")


def token_table(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Token units of ``files(path, source)``, numbered by path."""
    return lex_units(sources.numbered(files))
