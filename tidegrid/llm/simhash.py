"""SimHash near-duplicates, compared in bit slices.

A fingerprint has a bit set if over half of the hashes of a text's shingles have it. Two fingerprints that
differ in at most r of 64 bits agree in some b - r of b blocks of bits (pigeonhole), so each distinct
fingerprint is dealt to one bucket for every choice of b - r blocks. Within the buckets that a task holds, bit
planes are stored vertically (word k of plane j has bit j of fingerprints 64k to 64k + 63) and shifted
against themselves: one step compares 64 pairs, counts their differing bits in carry-save counters, and leaves
out words once all their pairs are over the radius. Links are merged to components within the task; what
leaves it is one edge from each member to its root, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import free_name, raw_text, row_keys, staged

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Buckets with more distinct fingerprints are split to blocks, of which every two meet in some task.
BLOCK = 4096
#: Rows that a task holds at a time, beside the one bucket (at most two blocks) that is not complete yet.
HELD = 200_000
#: _SPREAD[b]: the eight bits of b, each in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text in UTF-8; 0 without words, all words as one shingle if there are fewer."""
    words = raw.lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(joined, SEED)]
    else:
        starts = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1, initial=0))
        hashes = [h(joined[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:])]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of some hashes have."""
    own = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(own, np.arange(0, len(own), 255), axis=0)  # a byte holds up to 255
    counts = sums.view(np.uint8).reshape(len(sums), 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(own), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """doc_id, ``fp`` (the fingerprint as a signed long) and the row's keys, of whole texts, as a narrow map."""

    @F.pandas_udf("long")
    def of(raw: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(r, shingle) for r in raw], np.uint64).view(np.int64))

    return docs.select("doc_id", of(raw_text(text)).alias("fp"), *row_keys("doc_id", text))


def _pack(bits: np.ndarray) -> np.ndarray:
    """Bits along the last axis to 64-bit words, padded with one empty word."""
    n = bits.shape[-1]
    wide = np.zeros((*bits.shape[:-1], (n + 63) // 64 * 64 + 64), np.uint8)
    wide[..., :n] = bits
    return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of i and j; roots are the smallest places."""
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root[:] = up


def near_pairs(fp: np.ndarray, size: np.ndarray, open_at: Callable[[int, int], np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, i + s), shift by shift, of fingerprints that differ in at most ``radius`` bits.

    ``size`` is each row's number of rows in its group, falling, so that the rows whose group is longer than the shift come
    first; ``open_at(s, m)`` says which pairs of the first m rows and those s later are compared.
    """
    n = len(fp)
    planes = _pack(np.unpackbits(fp.astype(np.uint64).view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T)
    planes = np.concatenate([planes, np.zeros((64, 1), np.uint64)], axis=1)
    depth = (radius + 1).bit_length() if radius & (radius + 1) else radius.bit_length()
    ahead = (1 << depth) - 1 - radius  # counters start here, so that they overflow just beyond the radius
    rising = size[::-1]
    for s in range(1, int(size[0])):
        m = n - int(np.searchsorted(rising, s, side="right"))  # rows of groups with more than s rows
        open_ = open_at(s, m - s)
        if not open_.any():
            continue
        mask = _pack(open_)
        at = np.flatnonzero(mask)
        mask = mask[at]
        word, bit = divmod(s, 64)
        last = planes.shape[1] - 1
        lo, hi = np.minimum(at + word, last), np.minimum(at + word + 1, last)
        counters = [np.full(len(at), 0xFFFFFFFFFFFFFFFF if ahead >> k & 1 else 0, np.uint64) for k in range(depth)]
        over = ~mask
        for j in range(64):
            plane = planes[j]
            other = plane[lo] >> np.uint64(bit) | (plane[hi] << np.uint64(64 - bit) if bit else np.uint64(0))
            carry = plane[at] ^ other
            for k in range(depth):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over = over | carry
            if j % 8 == 7:
                alive = over != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not alive.all():
                    at, lo, hi, over = at[alive], lo[alive], hi[alive], over[alive]
                    counters = [c[alive] for c in counters]
                    if not len(at):
                        break
        if len(at):
            near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, col = np.nonzero(near)
            i = at[row] * 64 + col
            yield i, i + s


def by_size(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which longer groups come first and each lies together, and the rows' group sizes in that order."""
    _, index, count = np.unique(group, return_inverse=True, return_counts=True)
    order = np.lexsort((index, -count[index]))
    return order, count[index[order]]


def link(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The root (smallest place) of each fingerprint's component; only equal groups, which lie together, link."""
    n = len(fp)
    root = np.arange(n)
    if n < 2:
        return root
    order, size = by_size(group)
    own = group[order]
    for i, j in near_pairs(fp[order], size, lambda s, m: (own[:m] == own[s : s + m]) & (root[:m] != root[s : s + m]), radius):
        merge(root, i, j)
    least = np.full(n, n)
    np.minimum.at(least, root, order)
    out = np.empty(n, np.int64)
    out[order] = least[root]
    return out


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """For each choice of blocks - radius blocks of bits, the mask of these bits."""
    cut = [64 * k // blocks for k in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(cut, cut[1:])]
    return [sum(c) for c in itertools.combinations(own, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_edges(distinct: DataFrame, n: int, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) whose components are those of the fingerprints within the radius; ``distinct``: fp, n rows.

    The number of blocks only sets how many bits a bucket's key has, so that buckets stay small as n grows;
    every choice finds all links.
    """
    blocks = next((b for b in range(radius + 1, 2 * radius + 3) if n / 2 ** (64 * (b - radius) / b) <= block), 2 * radius + 3)
    keys: list[Column] = [
        F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for k, m in enumerate(masks(blocks, radius))
    ]
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("_b")).select("fp", "_b.t", "_b.key")
    def work(df: pd.DataFrame, start: np.ndarray) -> Iterator[pd.DataFrame]:
        fp = df["fp"].to_numpy(np.int64)
        root = link(fp.view(np.uint64), np.cumsum(start), radius)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        yield pd.DataFrame({"u": fp[moved], "v": fp[root[moved]]})

    return in_blocks(dealt, ["t", "key"], "fp", block, work)


def in_blocks(
    dealt: DataFrame, key: list[str], by: str, block: int, work: Callable[[pd.DataFrame, np.ndarray], Iterator[pd.DataFrame]],
    held_rows: int = HELD, weight: str | None = None, most_weight: int = 0,
) -> DataFrame:
    """``work``'s pairs (u, v) over the buckets (rows with equal ``key``) of dealt, whole buckets together up to about ``held_rows``
    rows, or ``most_weight`` by the sum of ``weight``.

    Buckets of over ``block`` rows, or more weight, are split by a hash of ``by`` to blocks, of which every two meet in some
    task. work gets the rows and where a bucket starts.
    """
    parts = F.ceil(F.count("*") / block)
    if weight:
        parts = F.greatest(parts, F.ceil(F.sum(weight) / most_weight))
    large = dealt.groupBy(*key).agg(parts.cast("int").alias("_parts")).filter("_parts > 1")
    other = F.sequence(F.lit(0), F.col("_parts") - 1)
    place = F.pmod(F.xxhash64(by, F.lit(7)), F.col("_parts")).cast("int")
    met = (
        dealt.join(large, key, "left")
        .withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        .withColumn("_own", place)
        .withColumn("_pair", F.explode(F.when(F.col("_parts") == 1, F.array(F.lit(0))).otherwise(F.filter(other, lambda x: x != F.col("_own")))))
        .select(*dealt.columns, F.least("_own", "_pair").alias("_a"), F.greatest("_own", "_pair").alias("_b"))
    )
    whole = [*key, "_a", "_b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        load = 0.0

        def of(df: pd.DataFrame) -> float:
            return max(len(df) / held_rows, df[weight].sum() / most_weight if weight else 0)

        def done(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
            start = np.ones(len(df), bool)
            start[1:] = (df[whole].to_numpy()[1:] != df[whole].to_numpy()[:-1]).any(1)
            yield from work(df, start)

        for b in batches:
            if not len(b):
                continue
            held.append(b)
            load += of(b)
            if load >= 1:
                df = pd.concat(held, ignore_index=True)
                rest = (df[whole] == df[whole].iloc[-1]).all(axis=1)
                held, load = [df[rest]], of(df[rest])
                if not rest.all():
                    yield from done(df[~rest].reset_index(drop=True))
        if held:
            yield from done(pd.concat(held, ignore_index=True))

    return met.repartition(*whole).sortWithinPartitions(*whole, by).mapInPandas(run, "u long, v long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and ``root`` (the smallest node of its component) of every node with an edge.

    Alternating large-star and small-star steps; every round is written to the shared folder. Minima are
    combined before the shuffle, so a node with very many edges needs no single task.
    """
    edges = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = staged(small.filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components: no end after {most_rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """doc_id, ``fp`` and ``component_id`` (the smallest doc_id that links reach, its own included) of every row,
    with the row's keys k1 and k2 and ``root``, the smallest fingerprint of the component.

    Equal fingerprints are one node, so copies cost one row each and no pairs. Null and empty texts have
    fingerprint 0 and link like any other. Rows without doc_id count as members but name no component: if no
    member has an id, component_id is null. Repeated rows are all returned. Only doc_id and the text are read.
    """
    own = staged(fingerprints(docs, shingle, text), "fingerprints")
    classes = staged(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    total, rows = classes.agg(F.count("*"), F.sum("n")).first()
    roots = components(near_edges(classes.select("fp"), total, radius))
    joined = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(joined.join(least, "root").select("fp", "n", F.struct("component_id", "root").alias("to")), "named")
    # Fewer than 1,000 classes can have over a thousandth of the rows: these are broadcast, and their members don't meet in the join.
    hot = named.filter(F.col("n") > max(1, (rows or 0) // 1000)).select("fp", F.col("to").alias("_hot"))
    cold = named.select(F.col("fp").alias("_fp"), "to", F.lit(0).alias("_salt"))
    is_hot = F.col("_hot").isNotNull()
    return (
        own.join(F.broadcast(hot), "fp", "left")
        .withColumns({"_key": F.when(~is_hot, F.col("fp")), "_to": F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(4096))).otherwise(0)})
        .join(cold, (F.col("_key") == F.col("_fp")) & (F.col("_to") == F.col("_salt")), "left")
        .withColumn("to", F.coalesce("_hot", "to"))
        .select("doc_id", "fp", "to.component_id", "k1", "k2", "to.root")
    )


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """One row of docs for each component: that with the smallest doc_id (rows without one come last), and of
    rows with one id that with the smallest hash of its text. Of equal rows one stays. All columns are kept.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    found = near_duplicates(docs, radius, shingle, text).groupBy("root").agg(F.min(order).alias("of"))
    a, b = free_name(docs, "_k1"), free_name(docs, "_k2")
    keep = found.select(F.col("of.k1").alias(a), F.col("of.k2").alias(b))
    k1, k2 = row_keys("doc_id", text)
    keyed = docs.withColumns({a: k1, b: k2})
    return keyed.join(keep, [a, b], "left_semi").dropDuplicates([a, b]).select(*docs.columns)
