"""Drawing documents that are like a target set, by importance weights of hashed n-gram features.

Features are all runs of one to three words. A dictionary of the distinct strings of a block of texts is built, each of its
strings is hashed once to a bucket, and each document's counts by bucket are written down. These are summed over all documents
and all target texts; a bucket's gain is the logarithm of how much more frequent it is in the target, and the gains are joined
back to the documents' counts. Gumbel noise, from a hash of the id, makes the highest sums a draw without replacement.

A document has at most ``BUCKETS`` counts, however long it is; there are as many gains, which go along with the tasks. A word
that all texts have is a count in each block, never a group of rows. Ranks are counted within ranges of the score.

Null and empty texts have no features, a weight of 0 and a score of noise alone, and are never drawn, since they have fewer than
``LEAST_WORDS`` words. Every row is a document of its own, repeated rows too (they have one score and take ranks one after the
other). Rows without an id get the noise of the empty id and come after others of their score. Without target texts, or
without documents, all counts are 0 there and the rest holds. An empty table gives an empty one. Other columns don't count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import plain_words, raw_text, staged
from tidegrid.operators.graph import relabel

BUCKETS, RUNS, SEED = 10_000, 3, 42
LEAST_WORDS, PERCENT = 20, 5
#: Words that share a dictionary, about; longer texts are cut to as many.
BLOCK = 120_000


def features(texts: list[list[bytes]], runs: int = RUNS) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All runs of words of a block of texts as a dictionary array, and the text of each."""
    sizes = np.array([len(w) for w in texts], np.int64)
    words, of = pa.array([x for w in texts for x in w], pa.binary()), np.repeat(np.arange(len(texts)), sizes)
    parts, owners = [words], [of]
    for n in range(2, runs + 1):
        m = max(0, len(of) - n + 1)
        inside = of[n - 1 :] == of[:m]
        parts.append(pc.binary_join_element_wise(*[words.slice(k, m) for k in range(n)], b" ").filter(pa.array(inside)))
        owners.append(of[:m][inside])
    return pa.concat_arrays(parts).dictionary_encode(), np.concatenate(owners)


def hashed(strings: pa.BinaryArray, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each string: its bytes' CRC-32 modulo the number of buckets."""
    at, data = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].tolist(), memoryview(strings.buffers()[2] or b"")
    crc = zlib.crc32
    return np.fromiter((crc(data[a:b]) for a, b in zip(at, at[1:])), np.int64, len(strings)) % buckets


def counted(texts: list[list[bytes]], buckets: int = BUCKETS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The buckets (rising) that each text of a block has features in, and how many."""
    if not any(texts):
        return [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
    runs, of = features(texts)
    key, n = np.unique(of * buckets + hashed(runs.dictionary, buckets)[runs.indices.to_numpy()], return_counts=True)
    edges = np.searchsorted(key, np.arange(1, len(texts)) * buckets)
    return np.split(key % buckets, edges), np.split(n, edges)


def counted_long(words: list[bytes], block: int, buckets: int = BUCKETS, runs: int = RUNS) -> tuple[np.ndarray, np.ndarray]:
    """The same of one text, piece by piece: a piece's last words are the next one's first, whose own runs are taken off again."""
    out = np.zeros(buckets, np.int64)
    for a in range(0, len(words), block):
        for piece, sign in ((words[a : a + block + runs - 1], 1), (words[a + block : a + block + runs - 1], -1)):
            for bucket, n in zip(*counted([piece], buckets)):
                out[bucket] += sign * n
    return np.flatnonzero(out), out[out > 0]


def bucket_counts(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_features, ``buckets`` (rising) and ``counts`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [plain_words(raw) for raw in b["_raw"]]
            sizes = np.array([len(w) for w in words], np.int64)
            edges = [0, *(np.flatnonzero(np.diff(np.cumsum(np.minimum(sizes, block)) // block)) + 1), len(b)]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                found = list(zip(*counted([w if len(w) <= block else [] for w in words[lo:hi]])))
                for k in np.flatnonzero(sizes[lo:hi] > block):
                    found[k] = counted_long(words[lo + k], block)
                yield pd.DataFrame({
                    "doc_id": b["doc_id"].iloc[lo:hi].to_numpy(), "n_words": sizes[lo:hi], "n_features": [n.sum() for _, n in found],
                    "buckets": [x.astype(np.int16) for x, _ in found], "counts": [n.astype(np.int32) for _, n in found],
                })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", raw_text(text).alias("_raw")).mapInPandas(run, f"doc_id {kind}, n_words long, n_features long, buckets array<short>, counts array<int>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's counts begin, the buckets and the counts, of a batch with both lists."""
    size = pc.fill_null(pc.list_value_length(batch["buckets"]), 0).to_numpy()
    return np.append(0, np.cumsum(size)), pc.list_flatten(batch["buckets"]).to_numpy(), pc.list_flatten(batch["counts"]).to_numpy()


def totals(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The number of features in each bucket: sums by task first, and one row for each bucket at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for b in batches:
            _, bucket, n = _flat(b)
            own += np.bincount(bucket, n, buckets).astype(np.int64)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(own[at])})

    out = np.zeros(buckets, np.int64)
    for r in rows.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]  # at most ``buckets`` rows
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of how much more frequent a bucket is in the target, one added to each, rounded down."""
    s, t, k = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * float(source.sum() + k) / ((s + 1) * float(target.sum() + k)))).astype(np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """rows (of ``bucket_counts``) with ``weight``, the sum of the gains of their features, in place of the counts."""
    kept = rows.select("doc_id", "n_words", "n_features", "buckets", "counts")
    shared = rows.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, bucket, n = _flat(b)
            sums = np.append(0, np.cumsum(shared.value[bucket] * n))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(sums[start]))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: str, seed: int = SEED):
    """Gumbel noise in thousandths, from the SHA-256 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs; the rank is null where it isn't drawn.

    Drawn are ``percent`` in a hundred of those with enough words, by score, ties by doc_id.
    """
    rows = staged(bucket_counts(docs, text), "features")
    wanted = totals(bucket_counts(target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text"))))
    scored = weighted(rows, gains(totals(rows), wanted)).withColumn("score", F.col("weight") + noise("doc_id"))
    scored = staged(scored, "scores")
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    order = able.withColumns({"_up": -F.col("score"), "_none": F.col("doc_id").isNull(), "_id": F.monotonically_increasing_id()})
    ranked = relabel(order, ["_up", "_none", "doc_id", "n_features", "weight", "_id"]).drop("_up", "_none", "_id")
    rank = F.when(F.col("new_id") < drawn, F.col("new_id") + 1).cast("long").alias("rank")
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*names, rank).unionByName(rest)
