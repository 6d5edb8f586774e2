"""Lines that several documents have stay in one of them only.

Lines are exploded under a key (the line without white space at its ends, A-Z lower-cased), keys are hashed to 128 bits, and
the distinct documents of each hash are counted. Lines whose key is in ``least_docs`` documents or more go from all documents
but the one with the smallest id; what is left is put together again by position.

A line that a third of all documents have is one row of facts: counts are combined before the shuffle, and the facts of hot
keys are broadcast (fewer than a thousand keys can be so hot), so that their lines never meet in a task.

Null and empty texts are one empty line, which stays. Documents are told apart by ``doc_id``: rows with the same id are one
document, so repeated rows keep the same lines; rows without an id are one document, which comes after all others. Equal lines
within a document stay or go together. A text may lose all lines and is empty then. An empty table gives an empty one. Columns
of the documents that are called ``n_lines`` or ``n_dropped`` are replaced, all others pass through, whatever they are called.
"""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidegrid.llm.common import free_name, join_hot, row_keys, staged

LEAST_CHARS, LEAST_DOCS = 10, 2
#: What is cut off at a line's ends.
BLANKS = " \t\n\x0b\x0c\r"


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in their order."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.transform(F.split(lowered, "\n", -1), lambda line: F.trim(line, F.lit(BLANKS)))


def exploded(docs: DataFrame, text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """k1, k2 (the row), doc, pos (from 0), h1 and h2 (the key's hash) of every line whose key has so many code points."""
    rows = docs.select(*row_keys("doc_id", text), F.col("doc_id").alias("doc"), F.posexplode(line_keys(F.col(text))).alias("pos", "key"))
    return rows.filter(F.char_length("key") >= least_chars).select("k1", "k2", "doc", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def shared_lines(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """h1, h2, ``first`` (the smallest document that has the line) and ``n_rows`` of the hashes in so many distinct documents."""
    nameless = F.max(F.col("doc").isNull().cast("long"))
    found = lines.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("n_rows"), (F.count_distinct("doc") + nameless).alias("n_docs"))
    return found.filter(F.col("n_docs") >= least_docs).drop("n_docs")


@F.pandas_udf(StringType())
def without(text: pd.Series, places: pd.Series) -> pd.Series:
    """The texts without the lines at these places; null stays null."""

    def left(t: str, gone: set[int]) -> str:
        return "\n".join(line for k, line in enumerate(t.split("\n")) if k not in gone)

    return pd.Series([None if t is None else left(t, set(p)) for t, p in zip(text, places)], dtype=object)


def dedup_lines(docs: DataFrame, text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with the lines that stay as their text, ``n_lines`` (before) and ``n_dropped``; null texts become empty ones."""
    lines = staged(exploded(docs, text, least_chars), "lines")
    shared = staged(shared_lines(lines, least_docs), "shared-lines")
    met = join_hot(lines, shared, ["h1", "h2"], "n_rows", lines.count())
    k1, k2, gone = (free_name(docs, n) for n in ("_k1", "_k2", "_gone"))
    places = met.filter(~F.col("doc").eqNullSafe(F.col("first"))).groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_set("pos").alias(gone))
    a, b = row_keys("doc_id", text)
    rows = docs.withColumns({k1: a, k2: b}).join(places, [k1, k2], "left")
    whole = F.coalesce(F.col(text), F.lit(""))
    counts = {"n_lines": F.size(F.split(whole, "\n", -1)).cast("long"), "n_dropped": F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")}
    names = [c for c in docs.columns if c not in counts]
    kept = F.coalesce(without(F.when(F.col(gone).isNotNull(), whole), F.col(gone)), whole).alias(text)
    return rows.select(*[kept if c == text else F.col(c) for c in names], *[v.alias(k) for k, v in counts.items()])
