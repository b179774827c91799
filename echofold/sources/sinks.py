"""Reports as text for editors, JSON and SARIF 2.1.0. Reports are small: they are collected."""

from __future__ import annotations

import json

from ..plans.analyze import Report
from ..plans.config import NAME, RULES, VERSION

DASH = " — "


def rows(df) -> list[dict]:
    out = []
    for r in df.collect():
        x = r.asDict(recursive=True)
        if not x.get("related"):
            x.pop("related", None)
        out.append({k: v for k, v in x.items() if v is not None})
    return out


def as_lines(report: Report) -> str:
    told = [f"{x['path']}:{x['line']}:{x['column']}: {x['severity']}: [{x['rule']}] {x['message']}" + (DASH + x["note"] if x.get("note") else "") for x in rows(report.findings)]
    told += [f"{x['path']}:1:1: warning: [{NAME}] file skipped: {x['detail']}" for x in rows(report.degraded)]
    return "\n".join(told)


def as_json(report: Report) -> str:
    body = {
        "findings": rows(report.findings),
        "suppressed": [{"finding": {k: v for k, v in x.items() if k != "reason"}, "reason": x.get("reason", "")} for x in rows(report.suppressed)],
        "outOfScope": rows(report.out_of_scope),
        "degradedFiles": rows(report.degraded),
        "analyzedFileCount": report.analyzed,
        "cacheHits": report.hits,
        "cacheMisses": report.misses,
        "wasCancelled": report.cancelled,
    }
    if report.note:
        body["semanticNote"] = report.note
    return json.dumps(body, indent=2, sort_keys=True, ensure_ascii=False)


def _place(path: str, line: int, column: int) -> dict:
    return {"physicalLocation": {"artifactLocation": {"uri": path}, "region": {"startLine": line, "startColumn": column}}}


def as_sarif(report: Report) -> str:
    results = []
    for x in rows(report.findings):
        one = {
            "ruleId": x["rule"],
            "level": x["severity"],
            "message": {"text": x["message"] + (DASH + x["note"] if x.get("note") else "")},
            "locations": [_place(x["path"], x["line"], x["column"])],
            "partialFingerprints": {f"{NAME}/v1": x["fingerprint"]},
        }
        if x.get("related"):
            one["relatedLocations"] = [_place(r["path"], r["line"], r["column"]) | {"message": {"text": "duplicate region"}} for r in x["related"]]
        results.append(one)
    results += [{"ruleId": f"{NAME}/degraded-file", "level": "note", "message": {"text": f"file skipped: {x['detail']}"}, "locations": [_place(x["path"], 1, 1)], "partialFingerprints": {}} for x in rows(report.degraded)]
    rules = [{"id": name, "shortDescription": {"text": line}, "help": {"text": told}} for name, (_, line, told) in RULES.items()]
    log = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": NAME, "version": VERSION, "rules": rules}}, "results": results}]}
    return json.dumps(log, indent=2, sort_keys=True, ensure_ascii=False)


FORMATS = {"xcode": as_lines, "json": as_json, "sarif": as_sarif}


def summary(report: Report) -> str:
    levels = [r[0] for r in report.findings.select("severity").collect()]
    errors = levels.count("error")
    line = f"{NAME}: {len(levels)} finding(s) ({errors} error(s), {len(levels) - errors} warning(s)) in {report.analyzed} file(s)"
    for n, what in ((report.suppressed.count(), "suppressed"), (report.degraded.count(), "file(s) degraded"), (report.baselined, "baselined"), (report.out_of_scope.count(), "out of scope")):
        line += f"; {n} {what}" if n else ""
    return line


def write_table(report: Report, path: str) -> None:
    """Findings as a Parquet table."""
    report.findings.write.mode("overwrite").parquet(path)
