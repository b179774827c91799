"""WordPiece: greedy longest pieces over cleaned words, as BERT-like encoders want them."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

SPECIAL = ("[CLS]", "[MASK]", "[PAD]", "[SEP]", "[UNK]")
CJK = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2F800, 0x2FA1F))


def is_space(c: str) -> bool:
    return c in " \t\n\r" or unicodedata.category(c) == "Zs"


def is_mark(c: str) -> bool:
    """Punctuation, with all ASCII signs that are neither letters nor digits."""
    n = ord(c)
    return 33 <= n <= 47 or 58 <= n <= 64 or 91 <= n <= 96 or 123 <= n <= 126 or unicodedata.category(c)[0] == "P"


def is_ideograph(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in CJK)


def clean(text: str, lower: bool = True) -> str:
    """Controls out, white space to blanks, ideographs apart; lower case without accents if ``lower``."""
    out = []
    for c in text:
        if c in "\0�":
            continue
        if is_space(c):
            out.append(" ")
        elif unicodedata.category(c) in ("Cc", "Cf", "Co", "Cs"):
            continue
        else:
            out.append(f" {c} " if is_ideograph(c) else c)
    done = "".join(out)
    if lower:
        done = "".join(c for c in unicodedata.normalize("NFD", done) if unicodedata.category(c) != "Mn").lower()
    return done


def words(text: str) -> list[str]:
    """Split at blanks, each mark a word of its own."""
    out, run = [], ""
    for c in text:
        if is_space(c) or is_mark(c):
            if run:
                out.append(run)
            run = ""
            if not is_space(c):
                out.append(c)
        else:
            run += c
    return [*out, run] if run else out


class WordPiece:
    """``vocabulary`` maps pieces to ids and must hold [UNK], [CLS] and [SEP]; ``added`` are literals taken whole, longest first."""

    def __init__(self, vocabulary: dict[str, int], added: dict[str, int] | None = None, lower: bool = True, join: str = "##", longest: int = 100):
        missing = [t for t in ("[UNK]", "[CLS]", "[SEP]") if t not in vocabulary]
        if missing:
            raise ValueError(f"the vocabulary has no {missing[0]}")
        self.vocabulary, self.lower, self.join, self.longest = vocabulary, lower, join, longest
        self.added = added or {t: vocabulary[t] for t in SPECIAL if t in vocabulary}
        self.literals = sorted(self.added, key=lambda t: (len(t), t), reverse=True)

    @staticmethod
    def load(folder: str, **kw) -> "WordPiece":
        """From ``vocab.txt``, a piece a line, or else ``tokenizer.json``."""
        table: dict[str, int] = {}
        if (p := Path(folder, "vocab.txt")).exists():
            lines = p.read_text("utf-8").split("\n")
            for i, line in enumerate(lines[:-1] if lines[-1] == "" else lines):
                table.setdefault(line.removesuffix("\r"), i)
        root = json.loads(p.read_text("utf-8")) if (p := Path(folder, "tokenizer.json")).exists() else {}
        table = table or root.get("model", {}).get("vocab", {})
        if not table:
            raise ValueError(f"{folder}: no vocabulary")
        return WordPiece(table, {e["content"]: e["id"] for e in root.get("added_tokens", [])}, **kw)

    def _runs(self, text: str) -> Iterator[str | int]:
        at, begin = 0, 0
        while at < len(text):
            hit = next((t for t in self.literals if text.startswith(t, at)), None) if text[at] in self.firsts else None
            if hit is None:
                at += 1
                continue
            if at > begin:
                yield text[begin:at]
            yield self.added[hit]
            at += len(hit)
            begin = at
        if begin < len(text):
            yield text[begin:]

    @property
    def firsts(self) -> set[str]:
        return {t[0] for t in self.literals if t}

    def pieces(self, word: str) -> list[int]:
        """Longest pieces from the left; one [UNK] if the word is too long or anything is left over."""
        if len(word) > self.longest:
            return [self.vocabulary["[UNK]"]]
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                got = self.vocabulary.get((self.join if at else "") + word[at:end])
                if got is not None:
                    break
            else:
                return [self.vocabulary["[UNK]"]]
            out.append(got)
            at = end
        return out

    def encode(self, text: str) -> list[int]:
        ids = [self.vocabulary["[CLS]"]]
        for run in self._runs(text):
            ids += [run] if isinstance(run, int) else [i for w in words(clean(run, self.lower)) for i in self.pieces(w)]
        return [*ids, self.vocabulary["[SEP]"]]


def encode_udf(tokenizer: WordPiece, longest: int | None = None):
    """Column function: text to ids, cut at ``longest`` with the last mark kept; nulls stay null."""

    @F.pandas_udf("array<int>")
    def encode(s: pd.Series) -> pd.Series:
        def one(t):
            ids = tokenizer.encode(t)
            return ids if longest is None or len(ids) <= longest else [*ids[: longest - 1], ids[-1]]

        return pd.Series([None if t is None else one(t) for t in s], dtype=object)

    return encode
