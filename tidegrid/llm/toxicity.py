"""Toxicity: a counterfactual-regularised classifier.

A logistic regression on the distinct words of a text and their beginnings, which stand for stems. In every labelled text that names a group of people
the identity terms are swapped for others of their kind; the loss holds the squared change of the score
under that swap, so that the mention of a group alone moves no score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import bounded_sample, crc_fold, labelled, plain_words, raw_text, staged

#: Terms that name a group, by kind; a swap takes the next one of the same kind.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("immigrants", "citizens", "refugees", "natives"),
    ("old", "young"), ("disabled", "able"), ("femmes", "hommes"), ("frauen", "männer"), ("mujeres", "hombres"),
)
SWAP = {a.encode(): kind[(i + 1) % len(kind)].encode() for kind in IDENTITY_TERMS for i, a in enumerate(kind)}


#: Bytes of the beginnings of words; each length has a hash seed of its own, whole words have 0.
STEMS = range(4, 9)
#: Words in fewer documents, or with a share of toxic ones within so many standard errors of the mean, are left out.
LEAST_DOCS, LEAST_Z = 5, 3.0
#: Bytes of text whose words are looked up together.
STEP = 4_000_000


def word_ids(words: set[bytes]) -> np.ndarray:
    """Hashes of the words and of their beginnings that are shorter than the word, each once."""
    h = xxhash.xxh64_intdigest
    ids = [h(w) for w in words]
    for k in STEMS:
        ids += [h(x, k) for x in {w[:k] for w in words if len(w) > k}]
    return np.array(ids, np.uint64)


@dataclass
class ToxicModel:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0

    def __post_init__(self) -> None:
        order = sorted(self.weights)
        self.ids = np.array(order, np.uint64)
        self.values = np.array([self.weights[k] for k in order])

    def score(self, raw: bytes) -> float:
        return float(self.score_all([raw])[0])

    def score_all(self, texts: list[bytes]) -> np.ndarray:
        """Of texts, in steps of about STEP bytes: the weights of all their words are looked up together and summed by text."""
        z = np.full(len(texts), self.bias)
        at, step, held = [], [], 0
        for k, raw in enumerate(texts):
            at.append(k)
            step.append(word_ids({*plain_words(raw)}))
            held += len(raw)
            if len(self.ids) and (held >= STEP or k == len(texts) - 1):
                ids = np.concatenate(step)
                place = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
                known = np.flatnonzero(self.ids[place] == ids)
                owner = np.repeat(np.arange(len(at)), [len(x) for x in step])[known]
                z[at] += np.bincount(owner, weights=self.values[place[known]], minlength=len(at))
                at, step, held = [], [], 0
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def fit(
    rows: list[np.ndarray], swapped: list[np.ndarray | None], y: np.ndarray,
    least_docs: int = LEAST_DOCS, least_z: float = LEAST_Z, l2: float = 3e-4, swap_penalty: float = 1.0, rounds: int = 300,
) -> ToxicModel:
    """Fit on word ids by document. Words in under ``least_docs`` documents, or whose share among toxic ones
    is within ``least_z`` standard errors of that among the others, are left out; identity terms stay."""
    n = len(rows)
    if not n or y.min() == y.max():
        return ToxicModel({}, 6.0 if n and y.min() == 1 else -6.0)
    flat, lens = np.concatenate(rows), np.array([len(r) for r in rows])
    vocab, index, df = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), lens)
    pos = np.bincount(index, weights=y[owner], minlength=len(vocab))
    share = y.mean()
    z = (pos - df * share) / np.sqrt(df * share * (1 - share) + 1e-9)
    identity = np.isin(vocab, word_ids({*SWAP}))
    keep = ((df >= least_docs) & (np.abs(z) >= least_z)) | identity
    place = np.where(keep, np.cumsum(keep), 0)  # 0 is the bias
    vocab = vocab[keep]
    use = keep[index]
    idx = np.concatenate([np.zeros(n, np.int64), place[index[use]]])
    own = np.concatenate([np.arange(n), owner[use]])
    size = len(vocab) + 1
    known = {int(v): i + 1 for i, v in enumerate(vocab)}
    d_idx, d_own, d_val, pairs = [], [], [], 0
    for a, b in zip(rows, swapped):
        if b is not None:
            gone, new = np.setdiff1d(a, b), np.setdiff1d(b, a)
            for ids, sign in ((gone, 1.0), (new, -1.0)):
                at = [known[int(v)] for v in ids if int(v) in known]
                d_idx += at
                d_own += [pairs] * len(at)
                d_val += [sign] * len(at)
            pairs += 1
    d_idx, d_own, d_val = np.array(d_idx, np.int64), np.array(d_own, np.int64), np.array(d_val)
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    w[0] = np.log(share / (1 - share))
    for t in range(1, rounds + 1):
        p = 1.0 / (1.0 + np.exp(-np.clip(np.bincount(own, weights=w[idx], minlength=n), -30, 30)))
        g = np.bincount(idx, weights=(p - y)[own], minlength=size) / n
        g[1:] += l2 * w[1:]
        if pairs:
            change = np.bincount(d_own, weights=w[d_idx] * d_val, minlength=pairs)
            g += 2 * swap_penalty / pairs * np.bincount(d_idx, weights=change[d_own] * d_val, minlength=size)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return ToxicModel({int(k): float(x) for k, x in zip(vocab, w[1:])}, float(w[0]))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, fold: tuple[int, int] | None = None) -> ToxicModel:
    """Learn from about ``most_rows`` labelled documents (a documented bound; the number differs by a few times its square
    root), chosen by a hash of doc_id, so that any layout of the tables gives the same model.

    An id with both labels counts once with each; of several texts with one id that with the least word hashes is taken.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if fold:
        known = known.filter(crc_fold(F.col("doc_id"), fold[0]) != fold[1])
    known = bounded_sample(known.select("doc_id", F.col("toxic").cast("int").alias("_y")).distinct(), ["doc_id"], most_rows)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, y, raw in zip(b["_k"], b["_y"], b["_raw"]):
                words = set(plain_words(raw))
                named = words & SWAP.keys()
                other = np.sort(word_ids((words - named) | {SWAP[w] for w in named}).view(np.int64)) if named else None
                out.append((k, y, np.sort(word_ids(words).view(np.int64)), other))
            yield pd.DataFrame(out, columns=["_k", "_y", "ids", "swapped"])

    rows = (
        labelled(docs, known)
        .select(F.xxhash64("doc_id").alias("_k"), "_y", "_raw")
        .mapInPandas(extract, "_k long, _y int, ids array<long>, swapped array<long>")
        .groupBy("_k", "_y")
        .agg(F.min(F.struct("ids", "swapped")).alias("of"))
    )
    rows = staged(rows.select("_k", "_y", "of.ids", "of.swapped"), "toxic-words")
    # Screened by Spark: what the driver gets are the words that tell something, and each text's share of them.
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    share = toxic / max(n, 1)
    counts = rows.select("_y", F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df"), F.sum("_y").alias("pos"))
    far = F.abs(F.col("pos") - F.col("df") * share) >= LEAST_Z * F.sqrt(F.col("df") * share * (1 - share))
    kept = counts.filter((F.col("df") >= LEAST_DOCS) & far).select("id").toPandas()["id"].to_numpy(np.int64)
    kept = np.unique(np.concatenate([kept, word_ids({*SWAP}).view(np.int64)]))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = lambda ids: None if ids is None else np.intersect1d(ids, kept).tobytes()
        for b in batches:
            yield pd.DataFrame({"_k": b["_k"], "_y": b["_y"], "ids": b["ids"].map(own), "swapped": [own(x) for x in b["swapped"]]})

    got = rows.mapInPandas(reduce, "_k long, _y int, ids binary, swapped binary").toPandas().sort_values(["_k", "_y"])
    of = lambda x: None if x is None else np.frombuffer(x, np.uint64)
    return fit([of(x) for x in got["ids"]], [of(x) for x in got["swapped"]], got["_y"].to_numpy(float))


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """All columns of docs and ``toxic_score`` (0 to 1). A narrow map of whole texts.

    Null and empty texts get the score of a text without known words; repeated rows get equal scores; a
    column that is already called toxic_score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as many weights as the bounded sample's words

    @F.pandas_udf("double")
    def score(raw: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score_all(list(raw)))

    return docs.withColumn("toxic_score", score(raw_text()))
