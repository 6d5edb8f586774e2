"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Lengths are whole numbers up to the capacity, so the packing is planned on the counts by length, which Spark
sums, and which are at most ``capacity`` numbers for any corpus. Pieces over a third of the capacity fit at most twice in a
sequence: a greedy matching gives each, longest first, the longest partner that still fits. Shorter pieces
then go, longest first, where they leave the smallest gap. The plan has few kinds of sequences, each with a
number of copies; the pieces of a length take their places by rank. Ranks are counted within buckets of a
hash, so that a length which very many documents share is no task of its own.
"""

from __future__ import annotations

import functools
import json
import math
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import staged

CAPACITY = 2048
#: The pre-tokenising pattern that byte-level BPE files of this kind imply (``use_regex``); a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoder(path: str):
    """A tiktoken encoding with the vocabulary of a byte-level BPE file of the tokenizers library.

    Both give the same ids (the tests compare them); this one takes a fifth of the time. Strings of the file's added
    tokens within a text become those tokens, as the tokenizers library has it.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, special = whole["model"], {x["content"]: x["id"] for x in whole.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in model["vocab"].items() if all(c in byte_of for c in token)}
    ranks = {k: v for k, v in ranks.items() if v not in special.values()}
    return tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


#: White space as the pattern has it, and the characters of a run of it that are kept from the pattern, which runs out of stack
#: over about a million.
WHITE, LONG_RUN = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]", 100_000


@functools.cache
def _runs(path: str, least: int) -> re.Pattern:
    """A long run of white space, and whether the text, or an added token, ends it (then all of it is one piece)."""
    ends = "|".join(["$(?!\\n)", *map(re.escape, sorted(encoder(path).special_tokens_set))])
    return re.compile(f"{WHITE}{{{least},}}+(?P<end>(?={ends}))?")


def token_ids(text: str, path: str, least: int = LONG_RUN) -> np.ndarray:
    """The ids of a text. Of a long run of white space all but the last character is one piece, or all if nothing follows."""
    own = encoder(path)
    if len(text) < least or not (found := list(_runs(path, least).finditer(text))):
        return own.encode_to_numpy(text, allowed_special="all")
    parts, at = [], 0
    for run in found:
        end = run.end() if run["end"] is not None else run.end() - 1
        if end == run.start():
            continue
        parts += [own.encode_to_numpy(text[at : run.start()], allowed_special="all"), np.array(own._encode_single_piece(text[run.start() : end]), np.uint32)]
        at = end
    return np.concatenate([*parts, own.encode_to_numpy(text[at:], allowed_special="all")])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece: the ids of a text, then ``end_id``.

    Texts over the capacity are cut from their end, so that only the first piece may be shorter. Null texts
    are empty: one piece with the end alone. Every row is cut on its own, repeated rows too. The tokenizer's
    path must exist where the tasks run.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, value in zip(b["doc_id"], b["_text"]):
                ids = np.append(token_ids(value, tokenizer), end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInPandas(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of sequences: (copies, [(length, pieces of that length), ...]) for the counts by length.

    The number of kinds is at most about twice the number of lengths, whatever the counts are.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    rising = large[::-1]
    bins: list[tuple[int, list[tuple[int, int]]]] = []
    for a in large:
        while left.get(a):
            at = bisect_left(rising, capacity - a + 1) - 1
            while at >= 0 and not left[rising[at]]:
                rising.pop(at)
                at -= 1
            if at < 0:
                bins.append((left[a], [(a, 1)]))
                left[a] = 0
                break
            b = rising[at]
            if a == b:
                if left[a] == 1:  # alone of its length: the next shorter partner
                    rising.pop(at)
                    left[a] = 0
                    while at > 0 and not left[rising[at - 1]]:
                        rising.pop(at - 1)
                        at -= 1
                    if at > 0:
                        b = rising[at - 1]
                        left[b] -= 1
                        bins.append((1, [(a, 1), (b, 1)]))
                    else:
                        bins.append((1, [(a, 1)]))
                    break
                m = left[a] // 2
                left[a] -= 2 * m
                bins.append((m, [(a, 2)]))
            else:
                m = min(left[a], left[b])
                left[a] -= m
                left[b] -= m
                bins.append((m, [(a, 1), (b, 1)]))
    # Gaps in rising order: (gap, kind); kinds: [copies, places].
    kinds = [[m, places] for m, places in bins]
    gaps = sorted((capacity - sum(n * k for n, k in places), i) for i, (_, places) in enumerate(kinds))

    def put(i: int, s: int, q: int, gap: int, copies: int) -> None:
        """``copies`` of kind i take q pieces of length s; the others stay as they are."""
        if copies == kinds[i][0]:
            kinds[i][1] = [*kinds[i][1], (s, q)]
            insort(gaps, (gap - q * s, i))
        else:
            kinds[i][0] -= copies
            kinds.append([copies, [*kinds[i][1], (s, q)]])
            insort(gaps, (gap, i))
            insort(gaps, (gap - q * s, len(kinds) - 1))

    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(gaps, (s, -1))
            if at == len(gaps):
                q = capacity // s
                if n // q:
                    kinds.append([n // q, [(s, q)]])
                    insort(gaps, (capacity - q * s, len(kinds) - 1))
                if n % q:
                    kinds.append([1, [(s, n % q)]])
                    insort(gaps, (capacity - n % q * s, len(kinds) - 1))
                break
            gap, i = gaps.pop(at)
            q, m = gap // s, kinds[i][0]
            if full := min(m, n // q):
                put(i, s, q, gap, full)
                n -= full * q
            else:
                put(i, s, n, gap, 1)
                n = 0
    return [(m, places) for m, places in kinds]


def places_by_length(kinds: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, the runs of ranks: (first rank, first sequence, offset), rising by first rank."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for copies, places in kinds:
        offset = 0
        for n, k in places:
            for _ in range(k):
                runs.setdefault(n, []).append((used.get(n, 0), sequence, offset))
                used[n] = used.get(n, 0) + copies
                offset += n
        sequence += copies
    return {n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in runs.items()}


def ranked(pieces: DataFrame, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """The pieces with ``_rank`` (from 0 within their length), and the counts by length.

    There are as many buckets of a length as the root of the rows, so that neither the rows of a bucket nor the
    running sum over a length's buckets, which gives each bucket's first rank, grows with the rows themselves.
    """
    buckets = max(1, math.isqrt(rows))
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "_bucket", "_first")
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    numbered = bucketed.withColumn("_in", F.row_number().over(within) - 1)
    return numbered.join(first, ["length", "_bucket"]).withColumn("_rank", F.col("_in") + F.col("_first")).drop("_in", "_first", "_bucket"), by_length


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The columns of pieces, ``sequence_id`` and ``offset``; gapless from 0 within each sequence.

    ``length`` must be from 1 to the capacity. Repeated rows are packed each. An empty table gives an empty one.
    """
    pieces = staged(pieces, "pieces")
    rows, by_length = ranked(pieces, pieces.count())
    runs = places_by_length(plan(by_length, capacity))
    shared = pieces.sparkSession.sparkContext.broadcast(runs)  # a few runs for each of at most capacity lengths

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        out = np.zeros((len(n), 2), np.int64)
        for value in np.unique(n):
            at = np.flatnonzero(n == value)
            first, sequence, offset = shared.value[int(value)]
            k = np.searchsorted(first, r[at], side="right") - 1
            out[at, 0], out[at, 1] = sequence[k] + r[at] - first[k], offset[k]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return rows.withColumn("_to", place("length", "_rank")).select(*pieces.columns, "_to.sequence_id", "_to.offset")
