"""Command line: ``python -m echofold.cli analyze PATH...`` and ``rules``.

Exit codes: 0 clean, 1 findings that fail the gate, 64 usage, 70 nothing could
be analysed or the run was cancelled, 78 bad configuration or baseline.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .operators import semantic
from .plans import analyze as plan
from .plans import config as cfg
from .sources import files, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=cfg.NAME)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("paths", nargs="+")
    a.add_argument("--config")
    a.add_argument("--format", choices=sorted(sinks.FORMATS), default="xcode")
    a.add_argument("--strict", action="store_true")
    a.add_argument("--baseline")
    a.add_argument("--write-baseline")
    a.add_argument("--only", action="append")
    a.add_argument("--only-from")
    a.add_argument("--relative-to")
    a.add_argument("--cache")
    a.add_argument("--no-cache", action="store_true")
    a.add_argument("--semantic", action="store_true")
    a.add_argument("--provider", default="ngrams")
    a.add_argument("--preset", choices=sorted(semantic.PRESETS), default="balanced")
    a.add_argument("--semantic-max-group", type=int)
    a.add_argument("--suffix", default=".swift")
    r = sub.add_parser("rules")
    r.add_argument("rule", nargs="?")
    return p


def checked(a: argparse.Namespace) -> None:
    if a.write_baseline and (a.only is not None or a.only_from):
        raise cfg.NoInputs("a baseline is of the whole corpus: --write-baseline goes with neither --only nor --only-from")
    if a.only_from == "-" and "-" in a.paths:
        raise cfg.NoInputs("standard input can be read once")


def scope_of(a: argparse.Namespace) -> list[str] | None:
    if a.only is None and not a.only_from:
        return None
    told = list(a.only or [])
    if a.only_from == "-":
        told += cfg.scope_entries(sys.stdin.read(cfg.SCOPE_CAP))
    elif a.only_from:
        told += cfg.scope_entries(cfg.read_bounded(a.only_from, cfg.SCOPE_CAP).decode("utf-8", "replace"))
    return files.canonicalized(told)


def run(a: argparse.Namespace, spark: SparkSession) -> int:
    checked(a)
    conf = cfg.Configuration.load(a.config)
    paths = files.discover(a.paths, a.suffix, conf.is_excluded)
    cache = None if a.no_cache else a.cache or cfg.default_cache(os.getcwd())
    how = None
    if a.semantic:
        o = semantic.PRESETS[a.preset]
        how = plan.Semantic(a.provider, o if a.semantic_max_group is None else semantic.Options(o.cosine, o.vocabulary, o.k, a.semantic_max_group))
    report = plan.analyze(spark, paths, conf, scope_of(a), cache, how)
    say = lambda x: print(x, file=sys.stderr)
    if report.analyzed and report.degraded.count() >= report.analyzed:
        say(f"{cfg.NAME}: no file could be read; nothing was analysed")
        return 70
    if report.cancelled:
        say(f"{cfg.NAME}: cancelled before the corpus was whole; nothing is reported")
        return 70
    if a.relative_to:
        report = plan.relativized(report, files.canonical(a.relative_to))
    if report.note:
        say(f"{cfg.NAME}: {report.note}")
    if a.write_baseline:
        told = [r[0] for r in report.findings.select("fingerprint").collect()]
        cfg.write_baseline(a.write_baseline, told)
        say(f"{cfg.NAME}: wrote {len(set(told))} fingerprint(s)")
        return 0
    if a.baseline:
        report = plan.against_baseline(report, spark, cfg.load_baseline(a.baseline))
    if text := sinks.FORMATS[a.format](report):
        print(text)
    say(sinks.summary(report))
    level = report.severity()
    return int(level is not None if a.strict else level == "error")


def rules(name: str | None) -> int:
    if name is not None and name not in cfg.RULES:
        print(f"no rule {name}", file=sys.stderr)
        return 64
    for rule, (_, line, told) in cfg.RULES.items():
        if name in (None, rule):
            print(f"{rule}: {line} [warning, enabled]" + (f"\n\n{told}" if name else ""))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 64 if e.code else 0
    if a.command == "rules":
        return rules(a.rule)
    try:
        return run(a, spark or SparkSession.builder.appName(cfg.NAME).getOrCreate())
    except cfg.AnalysisError as e:
        print(f"{cfg.NAME}: {e}", file=sys.stderr)
        return e.code


if __name__ == "__main__":
    sys.exit(main())
