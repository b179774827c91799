"""Configuration, rules, errors, baselines and scope lists: small files read on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.hashing import fnv1a
from .detect import Settings

NAME, VERSION = "echofold", "0.1.0"
CONFIG_CAP, SOURCE_CAP, CACHE_CAP, SCOPE_CAP = 1 << 20, 10 << 20, 256 << 20, 4 << 20
CONFIG_FILE = ".echofold.json"

#: rule: (type, one line, explanation)
RULES = {
    "exact-clone": ("exact", "regions whose tokens are the same, word for word", "The same tokens stand in two places or more. A change to one copy is easily missed in the others: keep one of them, or accept the repeat with a directive."),
    "near-clone": ("near", "regions that are the same once names and literals are set aside", "The regions differ in names and literals alone, as after copying and renaming. Make what differs a parameter."),
    "structural-clone": ("structural", "regions that share most of their shingles, in order", "The regions' shingles are similar beyond the threshold, though tokens differ. See whether the differences are meant; share what they have in common."),
    "semantic-clone": ("semantic", "regions whose embeddings and vocabularies are close", "The regions read alike to an embedding and share names, though no run of tokens need be the same. Reported only where no other rule holds the lines, and only on request."),
}


class AnalysisError(Exception):
    code = 70


class FileUnreadable(AnalysisError):
    pass


class ConfigurationUnreadable(AnalysisError):
    code = 78


class ConfigurationInvalid(AnalysisError):
    code = 78


class NoInputs(AnalysisError):
    code = 64


def read_bounded(path: str, cap: int, error: type[AnalysisError] = FileUnreadable) -> bytes:
    """A regular file's bytes, if no more than ``cap``."""
    p = Path(path)
    if not p.is_file():
        raise error(f"{path}: not a regular file")
    try:
        with p.open("rb") as f:
            data = f.read(cap + 1)
    except OSError as e:
        raise error(f"{path}: {e.strerror}") from e
    if len(data) > cap:
        raise error(f"{path}: more than {cap} bytes")
    return data


def read_json(path: str, cap: int = CONFIG_CAP):
    data = read_bounded(path, cap, ConfigurationUnreadable)
    try:
        return json.loads(data)
    except ValueError as e:
        raise ConfigurationInvalid(f"{path}: {e}") from e


@dataclass(frozen=True)
class Configuration:
    enabled: dict[str, bool] = field(default_factory=dict)
    severity: dict[str, str] = field(default_factory=dict)
    exclude: tuple[str, ...] = ()
    tokens: int = 50
    similarity: float = 0.8

    @staticmethod
    def of(data: dict) -> "Configuration":
        """All keys are optional; unknown rules and values out of range are errors."""
        if not isinstance(data, dict):
            raise ConfigurationInvalid("the configuration is no object")
        rules, dup = data.get("rules") or {}, data.get("duplication") or {}
        for name, r in rules.items():
            if name not in RULES:
                raise ConfigurationInvalid(f"unknown rule {name}")
            if r.get("severity") not in (None, "warning", "error"):
                raise ConfigurationInvalid(f"{name}: severity {r['severity']}")
        tokens, similarity = dup.get("minimumTokens", 50), dup.get("minimumSimilarity", 0.8)
        if isinstance(tokens, bool) or not isinstance(tokens, int) or not 1 <= tokens <= 10_000:
            raise ConfigurationInvalid(f"minimumTokens {tokens} is not from 1 to 10000")
        if isinstance(similarity, bool) or not isinstance(similarity, (int, float)) or not 0 <= similarity <= 1:
            raise ConfigurationInvalid(f"minimumSimilarity {similarity} is not from 0 to 1")
        return Configuration(
            {n: r["enabled"] for n, r in rules.items() if r.get("enabled") is not None},
            {n: r["severity"] for n, r in rules.items() if r.get("severity") is not None},
            tuple(data.get("exclude") or ()),
            tokens,
            float(similarity),
        )

    @staticmethod
    def load(path: str | None = None, folder: str = ".") -> "Configuration":
        """The file named, or the folder's own, or the defaults."""
        if path is None:
            path = os.path.join(folder, CONFIG_FILE)
            if not os.path.exists(path):
                return Configuration()
        return Configuration.of(read_json(path))

    def is_enabled(self, rule: str) -> bool:
        return self.enabled.get(rule, True)

    def severity_of(self, rule: str) -> str:
        return self.severity.get(rule, "warning")

    def is_excluded(self, path: str) -> bool:
        return any(x in path for x in self.exclude)

    def settings(self) -> Settings:
        return Settings(self.tokens, self.similarity, tuple(t for r, (t, *_) in RULES.items() if t != "semantic" and self.is_enabled(r)))


def load_baseline(path: str) -> list[str]:
    data = read_json(path, CACHE_CAP)
    if not isinstance(data, dict) or data.get("version") != 1 or not isinstance(data.get("fingerprints"), list):
        raise ConfigurationInvalid(f"{path}: not a baseline of version 1")
    return data["fingerprints"]


def write_baseline(path: str, fingerprints: list[str]) -> None:
    tmp = f"{path}.part"
    Path(tmp).write_text(json.dumps({"fingerprints": sorted(set(fingerprints)), "version": 1}, indent=2) + "\n")
    os.replace(tmp, path)


def scope_entries(text: str) -> list[str]:
    """Paths of a list, a line each; blanks trimmed, quotes of version control undone, empty lines dropped."""
    out = []
    for line in text.split("\n"):
        line = line.strip(" \t\r")
        if len(line) > 1 and line[0] == line[-1] == '"':
            line = line[1:-1].replace('\\"', '"').replace("\\\\", "\\")
        if line:
            out.append(line)
    return out


def root_of(path: str) -> str | None:
    """The nearest folder above that holds ``.git``."""
    at = os.path.dirname(os.path.normpath(path))
    while at and at != "/":
        if os.path.exists(os.path.join(at, ".git")):
            return at
        at = os.path.dirname(at)
    return None


def common_root(paths: list[str]) -> str | None:
    """The one root of all files, or None if they have none or several."""
    roots = {root_of(p) for p in paths}
    return roots.pop() if len(roots) == 1 else None


def relative(path: str, root: str) -> str:
    prefix = root if root.endswith("/") else root + "/"
    return path[len(prefix) :] if path.startswith(prefix) else path


def default_cache(folder: str) -> str:
    """A cache folder of this workspace's own."""
    root = root_of(os.path.join(folder, ".")) or folder
    return os.path.join(os.environ.get("XDG_CACHE_HOME", os.path.expanduser("~/.cache")), NAME, f"{fnv1a(root.encode()):x}", "facts.parquet")
