"""A lexer for brace-structured source code, the second front end beside plain text.

It yields what a parser's token stream has: the text, kind, line and column (in
bytes of UTF-8, from 1) of each token, string segments apart from their quotes,
the code inside interpolations as tokens of its own, comments on the side, and
the tokens that begin a top-level item. It needs no grammar: what depends on
context (generics, postfix marks, regular expressions, contextual keywords) is
told from the neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYWORD, IDENTIFIER, LITERAL, OPERATOR, PUNCTUATION, UNKNOWN = range(6)

RESERVED = frozenset(
    "Any Self as associatedtype break case catch class continue default defer deinit do else enum extension fallthrough false "
    "fileprivate for func guard if import in init inout internal is let nil operator precedencegroup private protocol public "
    "repeat rethrows return self static struct subscript super switch throw throws true try typealias var where while".split()
)
#: Keywords only where a declaration or an expression follows on the line.
CONTEXTUAL = frozenset(
    "actor async await borrowing consuming convenience dynamic final indirect infix isolated lazy macro mutating "
    "nonisolated nonmutating open optional override package postfix prefix required some any unowned weak".split()
)
ACCESSORS = frozenset("get set willSet didSet".split())
MODIFIERS = frozenset(
    "actor async convenience dynamic fileprivate final indirect infix internal lazy mutating nonisolated nonmutating open optional "
    "override package postfix prefix private public required static unowned weak".split()
)
KEPT = frozenset("Any AnyObject Array Bool Dictionary Double Error Float Int Optional Result Self Set String Void assert false fatalError nil precondition print self super true".split())
PARAM, NAME, TEXT, NUMBER = "$PARAM", "$ID", "$STR", "$NUM"
OPS = "/=-+!*%<>&|^~?"
WORD = re.compile(r"[^\W\d]\w*")
NUM = re.compile(r"0x[0-9A-Fa-f_]+(?:\.[0-9A-Fa-f_]+)?(?:[pP][+-]?[0-9_]+)?|0[bo][0-9_]+|[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?")
DOLLAR = re.compile(r"\$\w*")
OPEN_STRING = re.compile(r'(#*)("""|")')
LINE_END = re.compile(r"\r\n|\r|\n")
LOCATION = re.compile(r"(?:^|[\r\n])[ \t]*#sourceLocation")
IF_MARKS = ("#if", "#elseif", "#else", "#endif")


def literal_placeholder(text: str) -> str:
    """Quoted text is a string; what starts with a digit, minus or point is a number, string segments without quotes too; the rest are strings."""
    if text[:1] in ('"', "'"):
        return TEXT
    return NUMBER if text[:1].isnumeric() or text[:1] in ("-", ".") else TEXT


def normalized(kind: int, text: str, names: bool = True, literals: bool = True, params: bool = True, kept: frozenset = KEPT) -> str:
    """The normalized lane's text of a token; each of the three parts can be switched off."""
    if kind == IDENTIFIER:
        if params and text[:1] == "$" and all(c.isnumeric() for c in text[1:]):
            return PARAM
        return NAME if names and text not in kept else text
    if kind == LITERAL and literals:
        return literal_placeholder(text)
    return text


@dataclass
class Lexed:
    tokens: list[tuple[str, int, int, int]] = field(default_factory=list)  # text, kind, line, column
    ends: list[int] = field(default_factory=list)  # offset after each token
    comments: list[tuple[int, str]] = field(default_factory=list)  # line, text
    boundaries: list[int] = field(default_factory=list)
    located: bool = False


class _Places:
    def __init__(self, source: str):
        self.starts = [0] + [m.end() for m in LINE_END.finditer(source)]
        self.source, self.plain = source, source.isascii()
        self.line = 0

    def __call__(self, at: int) -> tuple[int, int]:
        starts, i = self.starts, self.line
        if starts[i] > at:
            i = 0
        while i + 1 < len(starts) and starts[i + 1] <= at:
            i += 1
        self.line = i
        head = at - starts[i] if self.plain else len(self.source[starts[i] : at].encode("utf-8", "replace"))
        return i + 1, head + 1


def lex(source: str) -> Lexed:
    """Tokens, comments and boundaries of one source text; any text is accepted."""
    out = Lexed(located=bool(LOCATION.search(source)))
    place = _Places(source)
    starts: list[int] = []

    def add(at: int, end: int, kind: int) -> None:
        out.tokens.append((source[at:end], kind, *place(at)))
        starts.append(at)
        out.ends.append(end)

    def string(at: int, pounds: str, quote: str) -> int:
        if pounds:
            add(at, at + len(pounds), UNKNOWN)
            at += len(pounds)
        add(at, at + len(quote), UNKNOWN)
        at += len(quote)
        close, escape = quote + pounds, "\\" + pounds
        begin, empty = at, True
        while at < len(source):
            c = source[at]
            if source.startswith(close, at):
                break
            if source.startswith(escape, at):
                if source.startswith("(", at + len(escape)):
                    if at > begin:
                        add(begin, at, LITERAL)
                    add(at, at + 1, PUNCTUATION)
                    if pounds:
                        add(at + 1, at + len(escape), UNKNOWN)
                    at += len(escape)
                    add(at, at + 1, PUNCTUATION)
                    at = code(at + 1, True)
                    begin, empty = at, False
                    continue
                at += len(escape) + 1
                continue
            if c in "\r\n":
                if quote == '"':
                    break  # not closed: the line ends it
                at += 2 if source.startswith("\r\n", at) else 1
                add(begin, at, LITERAL)
                begin, empty = at, False
                continue
            at += 1
        at = min(at, len(source))
        if at > begin or empty:
            add(begin, at, LITERAL)
        if source.startswith(close, at):
            add(at, at + len(quote), UNKNOWN)
            at += len(quote)
            if pounds:
                add(at, at + len(pounds), UNKNOWN)
                at += len(pounds)
        return at

    def code(at: int, inner: bool) -> int:
        """Lexes up to the end, or, inside an interpolation, past its closing parenthesis."""
        depth = 1
        n = len(source)
        while at < n:
            c = source[at]
            if c.isspace() or c in "﻿\0":
                at += 1
                continue
            two = source[at : at + 2]
            if two == "//":
                m = LINE_END.search(source, at)
                end = m.start() if m else n
                out.comments.append((place(at)[0], source[at:end]))
                at = end
                continue
            if two == "/*":
                nest, end = 1, at + 2
                while end < n and nest:
                    s = source[end : end + 2]
                    nest += (s == "/*") - (s == "*/")
                    end += 2 if s in ("/*", "*/") else 1
                out.comments.append((place(at)[0], source[at:end]))
                at = end
                continue
            m = OPEN_STRING.match(source, at)
            if m:
                at = string(at, m[1], m[2])
                continue
            if c == "`" and (m := re.compile(r"`[^`\r\n]+`").match(source, at)):
                add(at, m.end(), IDENTIFIER)
                at = m.end()
                continue
            m = WORD.match(source, at)
            if m:
                add(at, m.end(), _word(out, m[0], source, m.end()))
                at = m.end()
                continue
            if "0" <= c <= "9":
                m = NUM.match(source, at)
                add(at, m.end(), LITERAL)
                at = m.end()
                continue
            if c == "$":
                m = DOLLAR.match(source, at)
                add(at, m.end(), IDENTIFIER)
                at = m.end()
                continue
            if c == "#":
                m = re.compile(r"#(?:if|elseif|else|endif|sourceLocation)\b").match(source, at)
                if m:
                    add(at, m.end(), UNKNOWN)
                    at = m.end()
                else:
                    add(at, at + 1, PUNCTUATION)
                    at += 1
                continue
            if c == "/" and (end := _pattern(out, source, at)):
                add(at, at + 1, LITERAL)
                add(at + 1, end - 1, LITERAL)
                add(end - 1, end, LITERAL)
                at = end
                continue
            if c == "." or c in OPS:
                at = _operator(out, starts, source, at, add)
                continue
            if inner and c in "()":
                depth += 1 if c == "(" else -1
                add(at, at + 1, PUNCTUATION)
                at += 1
                if not depth:
                    return at
                continue
            add(at, at + 1, PUNCTUATION if c in "@\\`:,;{}()[]" else UNKNOWN)
            at += 1
        return at

    code(0, False)
    out.boundaries = _boundaries(out, source, starts)
    return out


def _word(out: Lexed, word: str, source: str, end: int) -> int:
    if word == "_":
        return UNKNOWN
    before = out.tokens[-1][0] if out.tokens else ""
    if before == "." and word not in ("self", "Type", "init"):
        return IDENTIFIER
    if word in RESERVED:
        return KEYWORD
    rest = source[end : end + 40].lstrip(" \t")
    if word in CONTEXTUAL and (rest[:1].isalpha() or rest[:1] in ("_", "@") or rest.startswith("->") or (rest[:1] == "{" and word == "async")):
        return KEYWORD
    if word in ACCESSORS and before in ("{", "}", ")") and rest[:1] in ("{", "}", "("):
        return KEYWORD
    return IDENTIFIER


def _pattern(out: Lexed, source: str, at: int) -> int:
    """End of a regular expression that begins here, or 0."""
    before = out.tokens[-1] if out.tokens else ("", OPERATOR, 0, 0)
    if before[0] not in ("(", "[", ",", ":", "=", "return", "{", "in") or source[at + 1 : at + 2].isspace():
        return 0
    i = at + 1
    while i < len(source) and source[i] not in "\r\n":
        if source[i] == "\\":
            i += 1
        elif source[i] == "/":
            return i + 1 if i > at + 1 else 0
        i += 1
    return 0


def _operator(out: Lexed, starts: list[int], source: str, at: int, add) -> int:
    c = source[at]
    joined = at > 0 and not source[at - 1].isspace() and source[at - 1] not in "([{,;:"
    if c == "." and source[at + 1 : at + 2] != ".":
        add(at, at + 1, PUNCTUATION)
        return at + 1
    end = at
    while end < len(source) and (source[end] in OPS or (source[end] == "." and c == ".")):
        if end > at and source[end : end + 2] in ("//", "/*"):
            break
        end += 1
    run = source[at:end]
    after = source[end : end + 1]
    loose = not after or after.isspace() or after in ")]},;:."
    if run == "&" and not joined:
        add(at, end, UNKNOWN)
        return end
    if c in "?!" and joined and run not in ("!=", "!==", "??"):
        add(at, at + 1, OPERATOR)
        return at + 1
    if c in "?!" and joined and run == "??" and loose and not after.isspace():
        add(at, at + 1, OPERATOR)
        return at + 1
    if c == ">" and joined and (loose or after == "("):
        add(at, at + 1, PUNCTUATION)
        return at + 1
    if run == "<" and joined and not loose:
        add(at, end, PUNCTUATION)
        return end
    add(at, end, OPERATOR)
    return end


JOINS_BACK = frozenset(". ? else catch where as is in { ) ] } , : ;".split())
JOINS_ON = frozenset(", ( [ { . : = @ -> & else in where case import".split())


def _boundaries(out: Lexed, source: str, starts: list[int]) -> list[int]:
    """Indexes of the tokens that begin a top-level item.

    An item begins on a line of its own, or after a semicolon, outside of all
    brackets and #if blocks, unless the token before asks for more or this one
    goes on with it, and unless only attributes and modifiers came before.
    """
    found, depth, blocks, fresh, opener = [], 0, 0, True, False
    last_line = 0
    for i, (text, kind, line, _) in enumerate(out.tokens):
        end_line = line + len(LINE_END.findall(text))
        if depth == 0 and blocks == 0 and not (text == "#endif"):
            begin = not found
            if not begin and (line > last_line or fresh):
                before, before_kind = out.tokens[i - 1][0], out.tokens[i - 1][1]
                spaced = source[starts[i] + len(text) : starts[i] + len(text) + 1].isspace()
                binary = kind == OPERATOR and spaced
                asks = before in JOINS_ON or (before_kind == OPERATOR and before not in ("?", "!") and source[starts[i - 1] - 1 : starts[i - 1]].isspace())
                begin = (fresh or not asks) and text not in JOINS_BACK and not binary and not opener
            if begin:
                found.append(i)
                opener = False
            opener = (begin or opener) and (text == "@" or (i and out.tokens[i - 1][0] == "@") or text in MODIFIERS)
        fresh = text == ";" and depth == 0
        if kind == PUNCTUATION:
            depth = max(0, depth + (text in "([{") - (text in ")]}"))
        elif text == "#if":
            blocks += 1
        elif text == "#endif":
            blocks = max(0, blocks - 1)
        last_line = end_line
    return found


RULES = ("exact-clone", "near-clone", "structural-clone", "semantic-clone")
SIGILS = ("echofold:", "ef:")
VERBS = {"accept": "accept", "accept:this": "accept:this", "accept:next": "accept:next", "disable": "disable", "enable": "enable"}


def directive(comment: str, line: int, sigils: tuple[str, ...] = SIGILS) -> dict | None:
    """A suppression directive in a comment: ``@ef:verb [rules] [-- reason]``, or None.

    Only two characters are taken off the comment's ends, so documentation
    comments hold none. ``all`` or no rules name every rule; unknown rules are
    passed over, but a directive of unknown rules alone suppresses nothing.
    """
    text = comment[2:] if comment[:2] in ("//", "/*") else comment
    text = (text[:-2] if text.endswith("*/") else text).strip()
    sigil = next((s for s in sigils if text.startswith("@" + s)), None)
    if sigil is None:
        return None
    text, dashes, reason = text[1 + len(sigil) :].partition("--")
    parts = text.replace("\t", " ").split(" ")
    parts = [p for p in parts if p]
    if not parts or parts[0] not in VERBS:
        return None
    words = [w for p in parts[1:] for w in p.split(",") if w]
    rules: list[str] = []
    if words and "all" not in words:
        rules = sorted(set(words) & set(RULES))
        if not rules:
            return None
    return {"line": line, "kind": VERBS[parts[0]], "rules": rules, "reason": reason.strip() if dashes else None}


def snippets(source: str, least: int = 5, most: int = 60) -> list[dict]:
    """Functions and initializers, nested ones too, that span ``least`` to ``most`` lines: lines, size and code with the comments before it."""
    x = lex(source)
    starts, _ends = [], x.ends
    for e, t in zip(x.ends, x.tokens):
        starts.append(e - len(t[0]))
    out, n = [], len(x.tokens)
    for i, (text, kind, line, _) in enumerate(x.tokens):
        if kind != KEYWORD or text not in ("func", "init") or (text == "init" and i and x.tokens[i - 1][0] == "."):
            continue
        if text == "init" and i + 1 < n and x.tokens[i + 1][0] not in ("(", "?", "!", "<"):
            continue
        first = i
        while first and (x.tokens[first - 1][0] in MODIFIERS or (first > 1 and x.tokens[first - 2][0] == "@")):
            first -= 2 if first > 1 and x.tokens[first - 2][0] == "@" else 1
        j, depth = i, 0
        while j < n and not (x.tokens[j][0] == "{" and x.tokens[j][1] == PUNCTUATION and depth == 0):
            t = x.tokens[j]
            if t[1] == PUNCTUATION:
                depth += (t[0] in "([") - (t[0] in ")]")
            if t[0] == "}" and t[1] == PUNCTUATION:
                break
            j += 1
        if j >= n or x.tokens[j][0] != "{":
            continue
        depth = 0
        while j < n:
            if x.tokens[j][1] == PUNCTUATION:
                depth += (x.tokens[j][0] == "{") - (x.tokens[j][0] == "}")
            if depth == 0:
                break
            j += 1
        if j >= n:
            continue
        begin, last = x.tokens[first][2], x.tokens[j][2]
        if least <= last - begin + 1 <= most:
            code = source[x.ends[first - 1] if first else 0 : x.ends[j]]
            out.append({"first": begin, "last": last, "tokens": max(1, len(code) // 4), "code": code})
    return out


UNITS = (
    "unit long, path string, toks array<struct<raw: string, norm: string, kind: tinyint, line: int, col: int>>, bounds array<int>, "
    "directives array<struct<line: int, kind: string, rules: array<string>, reason: string>>, located boolean"
)


def units(files: DataFrame, names: bool = True, literals: bool = True, params: bool = True) -> DataFrame:
    """Token units of ``files(unit, path, source)``, one row a file, lexed in Arrow batches.

    Null sources count as empty. The stream ends with an empty token, as a
    parser's does.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for unit, path, source in zip(pdf["unit"], pdf["path"], pdf["source"]):
                source = source or ""
                x = lex(source)
                place = _Places(source)(len(source))
                toks = [{"raw": t, "norm": normalized(k, t, names, literals, params), "kind": k, "line": n, "col": c} for t, k, n, c in [*x.tokens, ("", UNKNOWN, *place)]]
                told = [d for n, c in x.comments if (d := directive(c, n))]
                rows.append((unit, path, toks, x.boundaries, told, x.located))
            yield pd.DataFrame(rows, columns=["unit", "path", "toks", "bounds", "directives", "located"])

    return files.select("unit", "path", "source").mapInPandas(run, UNITS)


def snippet_table(files: DataFrame) -> DataFrame:
    """(id, file, first, last, tokens, code) of the functions in ``files(unit, path, source)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, s["first"], s["last"], s["tokens"], s["code"]) for p, text in zip(pdf["path"], pdf["source"]) for s in snippets(text or "")]
            yield pd.DataFrame(rows, columns=["file", "first", "last", "tokens", "code"])

    made = files.select("path", "source").mapInPandas(run, "file string, first int, last int, tokens int, code string")
    return made.withColumn("id", F.xxhash64("file", "first", "last", "code")).select("id", "file", "first", "last", "tokens", "code")
