"""Token tables from any table of texts.

A text is a *unit* (a file, a document); a line is a *segment*, which repeats
never cross; a token is a word between single spaces. Each token has two lanes:
``raw``, the word, and ``norm``, the word in lower case without punctuation at
its ends, numbers as ``$NUM``. The code lexer in ``functions.lexer`` makes the
same table from source files; everything after it knows neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LITERAL, IDENTIFIER, PUNCTUATION, UNKNOWN = 2, 1, 4, 5


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def spread(df: DataFrame) -> DataFrame:
    """A table whose scan has fewer parts than there are cores, parted anew: few row groups would leave cores idle.

    Large tables have more parts than that and stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def kind(word: Column) -> Column:
    """Kind of a word: literal 2, identifier 1, punctuation 4, unknown 5."""
    return (
        F.when(word.rlike("^[0-9]"), LITERAL)
        .when(word.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"), IDENTIFIER)
        .when(word.rlike(r"^[^\p{L}\p{N}]+$"), PUNCTUATION)
        .otherwise(UNKNOWN)
    )


def norm(word: Column) -> Column:
    return F.when(word.rlike("^[0-9]"), "$NUM").otherwise(F.lower(F.regexp_replace(word, r"^[.,;:!?]+|[.,;:!?]+$", "")))


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(unit, line, raw, norm): the words of each line that has any, as arrays."""
    return (
        docs.select(F.col(id_col).alias("unit"), F.posexplode(split_lines(F.col(text_col))).alias("p", "l"))
        .select("unit", (F.col("p") + 1).alias("line"), line_words(F.col("l")).alias("raw"))
        .where(F.size("raw") > 0)
        .withColumn("norm", F.transform("raw", norm))
    )


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(unit, raw, line): all words of a text in order, with the line of each."""
    per_line = F.transform(
        split_lines(F.col(text_col)), lambda l, i: F.transform(line_words(l), lambda w: F.struct(w.alias("w"), (i + 1).alias("n")))
    )
    return docs.select(F.col(id_col).alias("unit"), F.flatten(per_line).alias("t")).select(
        "unit", F.transform("t", lambda t: t["w"]).alias("raw"), F.transform("t", lambda t: t["n"]).alias("line")
    )


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(unit, line, word, kind, norm): one row a token."""
    return segments(docs, id_col, text_col).select("unit", "line", F.explode("raw").alias("word")).withColumns({"kind": kind(F.col("word")), "norm": norm(F.col("word"))})


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, cf, df): every distinct word with its occurrences and texts."""
    t = segments(docs, id_col, text_col).select("unit", F.explode("raw").alias("word"))
    return t.groupBy("word", "unit").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("cf"), F.count("*").alias("df"))


def bounded(docs: DataFrame, cap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(unit, n_bytes, degraded): whether a text may be read under a cap on its bytes."""
    n = F.octet_length(text_col)
    return docs.select(F.col(id_col).alias("unit"), n.alias("n_bytes"), (n > cap).alias("degraded"))


def excluded(docs: DataFrame, parts: list[str], col: str) -> DataFrame:
    """Rows whose ``col`` holds none of ``parts``."""
    for p in parts:
        docs = docs.where(~F.contains(F.col(col), F.lit(p)))
    return docs


def line_text(text: Column, line: int) -> Column:
    """The 1-based line of a text, line ends of all three kinds; empty beyond the last."""
    return F.coalesce(F.get(F.split(text, "\r\n|\r|\n"), F.lit(line - 1)), F.lit(""))


def snippet(text: Column, first: int, last: int) -> Column:
    """Lines first to last of a text, joined by line feeds."""
    return F.array_join(F.slice(F.split(text, "\r\n|\r|\n"), first, last - first + 1), "\n")


def fingerprint(text: Column) -> Column:
    """Content fingerprint: md5 and length in bytes."""
    return F.concat_ws("-", F.md5(text), F.octet_length(text).cast("string"))


def has_location_directive(text: Column) -> Column:
    """Whether any line starts, after blanks, with ``#sourceLocation``, even inside comments and strings."""
    return F.coalesce(text.rlike(r"(^|[\r\n])[ \t]*#sourceLocation"), F.lit(False))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token units of any table of texts, in the columns that the code lexer gives; a word's column is its place in the line.

    ``unit`` is the id, ``path`` the id as text; each line that has words begins
    a segment. Null texts have no tokens. Words are of no kind: only code names
    are renamed in shingles.
    """
    per_line = F.transform(
        split_lines(F.coalesce(F.col(text_col), F.lit(""))),
        lambda l, i: F.transform(
            line_words(l),
            lambda w, j: F.struct(w.alias("raw"), norm(w).alias("norm"), F.lit(UNKNOWN).cast("tinyint").alias("kind"), (i + 1).alias("line"), (j + 1).alias("col")),
        ),
    )
    n = F.size("toks")
    every = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    new = F.filter(every, lambda i: (i == 0) | (F.get("toks", i)["line"] != F.get("toks", i - 1)["line"]))
    return docs.select(F.col(id_col).alias("unit"), F.col(id_col).cast("string").alias("path"), F.flatten(per_line).alias("toks")).select(
        "unit",
        "path",
        "toks",
        new.alias("bounds"),
        F.array().cast("array<struct<line:int,kind:string,rules:array<string>,reason:string>>").alias("directives"),
        F.lit(False).alias("located"),
    )


def unit_segments(units: DataFrame) -> DataFrame:
    """(unit, path, line, base, toks, raw, norm): token units cut at their boundaries; ``line`` numbers the segments of a unit.

    Units with a location directive are left out, as repeats in them have no lines to report.
    """
    starts = F.array_sort(F.array_union(F.array(F.lit(0)), F.col("bounds")))
    each = F.transform(
        F.col("__s"),
        lambda s, i: F.struct(i.alias("line"), s.alias("base"), F.slice("toks", s + 1, F.coalesce(F.get("__s", i + 1), F.size("toks")) - s).alias("toks")),
    )
    cut = units.where(~F.col("located")).withColumn("__s", starts).select("unit", "path", F.inline(each))
    return cut.withColumn("raw", F.transform("toks", lambda t: t["raw"])).withColumn("norm", F.transform("toks", lambda t: t["norm"]))
