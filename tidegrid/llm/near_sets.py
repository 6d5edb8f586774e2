"""Near-duplicates by the Jaccard similarity of shingle sets, with SimHash fingerprints compared in bit slices.

A text's set are the hashes of its five-word shingles, its fingerprint the bits that over half of them have. Sets of
a similarity of 0.8 differ in about 10 of 64 bits, too many for buckets of agreeing bit blocks; buckets are dealt by
minima of the sets instead: of BANDS x ROWS minima under different hashes, ROWS together are a bucket's key, and two sets of
similarity s share one with probability 1 - (1 - s^ROWS)^BANDS, 0.999995 at 0.8 and more above it. Within the buckets
fingerprints are compared in bit slices, and pairs within RADIUS bits are confirmed by the exact similarity: only sets of 0.8
or more link, and a task hands on what joins their components, not the pairs. Equal sets are one node. To spare pairs, each set is held against the smallest one that it meets, then
against the smallest of each bucket, and only what isn't in one component by then is compared with all others.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import free_name, join_salted, raw_text, row_keys, small, staged
from tidegrid.llm.simhash import BLOCK, components, in_blocks, majority, merge, near_pairs

SHINGLE, SEED = 5, 42
BANDS, ROWS = 40, 6
#: Bits in which fingerprints of candidates may differ: at a similarity of 0.8 about 10 do, with a standard deviation of 3.
RADIUS = 24
#: Rows of a bucket, and hashes of their sets, over which it is split; 64-bit words of bit maps at a time.
PART, MOST_HASHES, MAP_WORDS = 1_024, 2_000_000, 4_000_000
#: Shingles that are hashed together: bounds a worker's memory for texts of any length.
STEP = 512
_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(raw: bytes) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; none without words, all words as one shingle if there are fewer."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([h(joined, SEED)], np.uint64)
    starts = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1, initial=0))
    return np.unique(np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts, starts[SHINGLE:])], np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """A set's key in each band; an empty set has none."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for a in range(0, len(own), STEP):
        np.minimum(least, ((own[a : a + STEP, None] ^ _FLIP) * _TIMES).min(0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), t) for t, r in enumerate(rows)], np.uint64).view(np.int64)


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the row's keys, ``node`` (the hash of the text's set), ``n`` (its size), ``fp`` and ``bands``. A narrow map of
    whole texts."""

    @F.pandas_udf("struct<node: long, n: int, fp: long, bands: array<long>>")
    def of(raw: pd.Series) -> pd.DataFrame:
        own = [shingles(r) for r in raw]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in own], np.uint64).view(np.int64)
        fp = np.array([majority(s) if len(s) else 0 for s in own], np.uint64).view(np.int64)
        return pd.DataFrame({"node": node, "n": [len(s) for s in own], "fp": fp, "bands": [bands(s) for s in own]})

    return docs.select("doc_id", *row_keys("doc_id", text), of(raw_text(text)).alias("s")).select("doc_id", "k1", "k2", "s.node", "s.n", "s.fp", "s.bands")


def _sets(docs: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """node and ``own``, its shingles' hashes, of ``nodes`` (node, k1, k2: a row that has the set)."""

    @F.pandas_udf("array<long>")
    def of(raw: pd.Series) -> pd.Series:
        return pd.Series([shingles(r).view(np.int64) for r in raw])

    texts = docs.select(*row_keys("doc_id", text), raw_text(text).alias("_raw")).join(small(nodes), ["k1", "k2"])
    return texts.dropDuplicates(["node"]).select("node", of("_raw").alias("own"))


def _close(a: str, b: str):
    """Whether sets of these sizes can have a similarity of 0.8."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose sets have a similarity of 0.8 or more, counted exactly."""
    u, v = (sets.select(F.col("node").alias(x), F.col("own").alias(f"_{x}")) for x in "uv")
    both = F.size(F.array_intersect("_u", "_v"))
    # v first: a set is the v of few pairs, but the u of a whole template's, whose hashes needn't be shuffled with each of them.
    met = join_salted(pairs.join(v, "v"), u, "u", "v", pairs)
    return met.filter(9 * both >= 4 * (F.size("_u") + F.size("_v"))).select("u", "v")


def _with(rows: DataFrame, facts: DataFrame, total: int) -> DataFrame:
    """rows joined with what is known of their ``key`` (one row each, with its number of rows ``_c``). Fewer than 1,000 keys have
    over a thousandth of the rows: their facts are broadcast, and their rows don't meet in the join."""
    hot = facts.filter(F.col("_c") > max(BLOCK, total // 1000))
    cold = facts.filter(F.col("_c") <= max(BLOCK, total // 1000))
    return rows.join(F.broadcast(hot), "key").unionByName(rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold, "key"))


def _common(sets: list[np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """How many members the sets i and j of a bucket have in common, for arrays of places: by bit maps over the members that
    more than one set has, or set by set where the maps would be large."""
    size = np.array([len(x) for x in sets])
    kinds, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    words = int((count > 1).sum() + 63) // 64
    if len(sets) * words > MAP_WORDS:
        return lambda i, j: np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    shared = np.flatnonzero((count > 1)[index])
    row, at = np.repeat(np.arange(len(sets)), size)[shared], place[index[shared]]
    maps = np.zeros((len(sets), max(1, words)), np.uint64)
    np.bitwise_or.at(maps, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    step = max(1, MAP_WORDS // max(1, words))

    def count_of(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bitwise_count(maps[i[a : a + step]] & maps[j[a : a + step]]).sum(1, dtype=np.int64) for a in range(0, len(i), step)])

    return count_of


def _linked(rest: DataFrame, radius: int = RADIUS, block: int = PART) -> DataFrame:
    """Edges (u, v) that join what links within the buckets of rest (key, node, n, root, fp, own: the set's hashes), beside equal
    roots: pairs within the radius by bit slices, of sizes that allow a similarity of 0.8, that have it. At most one edge for
    each row leaves a task, never the pairs of a bucket."""

    def work(df: pd.DataFrame, start: np.ndarray) -> Iterator[pd.DataFrame]:
        us, vs = [], []
        first = np.flatnonzero(start)
        for a, b in zip(first, [*first[1:], len(df)]):
            if b - a < 2:
                continue
            n, node, root = (df[c].to_numpy(np.int64)[a:b] for c in ("n", "node", "root"))
            before = np.unique(root, return_index=True)[1][np.unique(root, return_inverse=True)[1]]
            local, sets = before.copy(), [np.asarray(x).view(np.uint64) for x in df["own"].iloc[a:b]]
            if (local == local[0]).all():
                continue
            common = _common(sets)

            def open_at(s: int, m: int, n=n, local=local) -> np.ndarray:
                return (local[:m] != local[s : s + m]) & (5 * np.minimum(n[:m], n[s : s + m]) >= 4 * np.maximum(n[:m], n[s : s + m]))

            for i, j in near_pairs(df["fp"].to_numpy(np.int64)[a:b].view(np.uint64), np.full(b - a, b - a), open_at, radius):
                like = 9 * common(i, j) >= 4 * (n[i] + n[j])
                merge(local, i[like], j[like])
            moved = np.flatnonzero(local != before)
            us.append(node[moved])
            vs.append(node[local[moved]])
        if us:
            yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return in_blocks(rest, ["key"], "node", block, work, held_rows=20_000, weight="n", most_weight=MOST_HASHES)


def near_edges(docs: DataFrame, classes: DataFrame, text: str = "text", block: int = PART) -> DataFrame:
    """Edges (u, v) whose components are those of the sets that bands and similarity link; ``classes``: node, n, fp, bands, of."""
    dealt = classes.select("node", "n", "fp", F.explode("bands").alias("key"))
    least = dealt.groupBy("key").agg(F.min(F.struct("node", "n", "fp")).alias("least"), F.count("*").alias("_c")).filter("_c > 1")
    least = staged(least, "bucket-least")
    total = least.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    met = staged(_with(dealt, least, total).drop("_c"), "buckets")
    nodes = met.select("node").distinct().join(classes.select("node", "of.k1", "of.k2"), "node")
    sets = staged(_sets(docs, staged(nodes, "members"), text), "sets")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("least.fp"))) <= RADIUS
    pairs = met.filter((F.col("node") != F.col("least.node")) & _close("n", "least.n") & apart)
    pairs = staged(pairs.select(F.col("least.node").alias("u"), F.col("node").alias("v")).distinct(), "least-pairs")
    # Each with the smallest that it meets.
    edges = staged(_confirmed(pairs.groupBy("v").agg(F.min("u").alias("u")), sets), "first-edges")
    roots = components(edges)
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"_r{x}"))
    # With the smallest of each bucket.
    more = pairs.join(root("u"), "u", "left").join(root("v"), "v", "left").filter(F.coalesce("_ru", "u") != F.coalesce("_rv", "v")).select("u", "v")
    edges = staged(edges.unionByName(_confirmed(more, sets)), "more-edges")
    roots = components(edges)
    # With all others that are in another component.
    rest = met.filter(F.col("node") != F.col("least.node")).select("key", "node", "n", "fp").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rest.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count("*").alias("_c")).filter("_a <> _b").select("key", "_c")
    rest = _with(rest, staged(mixed, "mixed"), total).drop("_c").join(sets, "node")
    return edges.unionByName(staged(_linked(rest, block=block), "last-edges"))


def drop_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of docs for each component of texts with a similarity of 0.8 or more: that with the smallest doc_id (rows
    without one come last), and of rows with one id that with the smallest hash of its text. Of equal rows one stays.

    Null and empty texts are equal to each other and like no other. All columns are kept.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    own = sketches(docs, text).withColumn("of", order)
    classes = own.groupBy("node").agg(F.min("of").alias("of"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    classes = staged(classes, "classes")
    roots = components(near_edges(docs, classes, text)).withColumnRenamed("node", "_node")
    found = classes.join(roots, F.col("node") == F.col("_node"), "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("of").alias("of"))
    a, b = free_name(docs, "_k1"), free_name(docs, "_k2")
    keep = found.select(F.col("of.k1").alias(a), F.col("of.k2").alias(b))
    k1, k2 = row_keys("doc_id", text)
    keyed = docs.withColumns({a: k1, b: k2})
    return keyed.join(keep, [a, b], "left_semi").dropDuplicates([a, b]).select(*docs.columns)
