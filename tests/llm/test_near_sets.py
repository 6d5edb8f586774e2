"""Near duplicates by shingle sets against brute-force Jaccard."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegrid.llm import near_sets
from tidegrid.llm.common import join_salted

from .conftest import make


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept_brute(rows):
    """The smallest doc_id of each component of sets with a Jaccard similarity of 0.8 or more (equal sets: 1)."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    last = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    return sorted((min(last(k) for k in range(len(rows)) if find(k) == r) for r in {find(k) for k in range(len(rows))}))


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_are_those_of_jaccard(spark, sf, seed):
    """Some words of random texts replaced: similarities on both sides of 0.8, chains of them among these."""
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for k in range(8):
            rows.append((base * 100 + k, " ".join(words)))
            for _ in range(rng.randrange(1, 9)):
                words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
    found = corpus_pipeline.near_dedup(spark, make(spark, rows), sf).collect()
    want = kept_brute(rows)
    assert 12 < len(want) < len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == want


def test_near_duplicates_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == kept_brute([(r.doc_id, r.text) for r in docs.collect()])


def test_near_duplicates_of_odd_rows(spark, sf, odd, odd_rows, empty):
    found = corpus_pipeline.near_dedup(spark, odd, sf).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == kept_brute(odd_rows)
    assert corpus_pipeline.near_dedup(spark, empty, sf).count() == 0


def test_template_of_very_many_near_copies(spark):
    """One template with thousands of near copies: all are found, and pairs with it are dealt over salts."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[: 20 + k % 30], f"x{k}", *base[20 + k % 30 :]])) for k in range(3_000)] + [(9_000 + k, f"other text number {k} " * 3) for k in range(20)]
    kept = near_sets.drop_near_duplicates(make(spark, rows))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [0, *range(9_000, 9_020)]
    pairs = spark.createDataFrame([(1, k) for k in range(5_000)] + [(k, k) for k in range(2, 50)], "u long, v long")
    facts = spark.range(50).select(F.col("id").alias("u"), (F.col("id") * 2).alias("x"))
    met = join_salted(pairs, facts, "u", "v", pairs)
    assert sorted(map(tuple, met.select("u", "v", "x").collect())) == sorted([(1, k, 2) for k in range(5_000)] + [(k, k, 2 * k) for k in range(2, 50)])


@pytest.mark.parametrize("words", [near_sets.MAP_WORDS, 0])
def test_common_members(monkeypatch, words):
    monkeypatch.setattr(near_sets, "MAP_WORDS", words)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    assert near_sets._common(sets)(i, j).tolist() == [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j)]


def test_buckets_of_several_clusters(spark):
    """Buckets in blocks of any size: the edges join just what links; no more of them than rows."""
    rng = random.Random(3)
    rows, k = [], 0
    for base in range(6):
        own = rng.sample(range(10**6), 60)
        for _ in range(50):
            other = list(own)
            for _ in range(rng.randrange(9)):
                other[rng.randrange(60)] = rng.randrange(10**6, 10**9)
            own = other if rng.random() < 0.3 else own
            hashes = np.array(sorted({x * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for x in other}), np.uint64)
            fp = near_sets.majority(hashes)
            rows.append((base % 2, k, len(hashes), k if k % 7 else -base - 1, fp - (1 << 64) if fp >> 63 else fp, hashes.view(np.int64).tolist()))
            k += 1
    frame = spark.createDataFrame(rows, "key long, node long, n int, root long, fp long, own array<long>")

    def joined(edges):
        root = {r[1]: r[1] for r in rows}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        known = {}
        for r in rows:
            known.setdefault(r[3], r[1])
        for u, v in [*edges, *((r[1], known[r[3]]) for r in rows)]:
            a, b = sorted((find(u), find(v)))
            root[b] = a
        return {x: find(x) for x in root}

    sets = {r[1]: set(r[5]) for r in rows}
    want = joined((a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and 5 * len(sets[a[1]] & sets[b[1]]) >= 4 * len(sets[a[1]] | sets[b[1]]))
    assert 10 < len(set(want.values())) < 200
    for block in (4096, 16):
        found = [tuple(r) for r in near_sets._linked(frame, block=block).collect()]
        assert joined(found) == want and (block < 100 or len(found) < len(rows))
