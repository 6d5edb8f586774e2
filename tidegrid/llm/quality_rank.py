"""Quality classifier by Bradley-Terry pairwise ranking.

Every preference pair (a document marked good, one marked bad) says that the good one's score should be
the larger: minus log sigmoid(w . (x_good - x_bad)) is the loss, so there is no intercept. The cut between
keep and reject is a quantile of the learned scores, at the share of bad documents among the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import FUNCTION_WORDS, bounded_sample, crc_fold, labelled, raw_text

#: score at the cut; a document at or over it is predicted good.
CUT = 0.7
N_FEATURES = 20


def features(raw: bytes) -> list[float]:
    """Shares and rates of one text; all zero for a text without words."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * (N_FEATURES - 1) + [1.0]
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, upper, lower = len(raw), int(h[65:91].sum()), int(h[97:123].sum())
    high = int(h[128:].sum())
    letters = max(1, upper + lower + high // 2)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    symbols = sum(int(h[c]) for c in b"#*$%&|<>")
    distinct = len(set(words))
    return [
        np.log1p(n) / 5,
        min(n, 20) / 20,
        upper / letters,
        float(upper > 0.5 * letters),
        min(symbols / n, 2.0),
        float(symbols > 0.1 * n),
        min(int(h[33]) / n, 2.0),
        min(int(h[124]) / n, 1.0),
        int(h[48:58].sum()) / size,
        min((int(h[44]) + int(h[46])) / n, 1.0),
        min(size / n, 30.0) / 10,
        distinct / n,
        1 - pairs / max(1, n - 1),
        float(pairs < 0.7 * (n - 1)),
        1 - len(set(lines)) / len(lines),
        len(lines) / n,
        sum(map(FUNCTION_WORDS.__contains__, words)) / n,
        letters / size,
        min((int(h[64]) + raw.count(b"://")) / n, 1.0),
        0.0,
    ]


@dataclass
class RankModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    width: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, CUT at the quantile that parts keep from reject."""
        z = (((x - self.mean) / self.scale) @ self.weights - self.cut) / self.width + np.log(CUT / (1 - CUT))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def pair_sums(z: np.ndarray, w: np.ndarray, good: np.ndarray, bad: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the mean loss over all pairs, good ones in blocks.

    sigmoid(a - b) is e^a / (e^a + e^b): a pair costs one division, and features meet its row and column sums alone.
    """
    s = np.clip(z @ w, -300, 300)
    a, b, x, y = np.exp(s[good]), np.exp(s[bad]), z[good], z[bad]
    grad, hess, col, col2 = np.zeros(len(w)), np.zeros((len(w), len(w))), np.zeros(len(bad)), np.zeros(len(bad))
    for k in range(0, len(good), block):
        p = a[k : k + block, None] / (a[k : k + block, None] + b)
        lost = 1 - p
        own, row = x[k : k + block], lost.sum(1)
        grad -= own.T @ row
        col += lost.sum(0)
        p *= lost
        col2 += p.sum(0)
        cross = own.T @ (p @ y)
        hess += (own * p.sum(1)[:, None]).T @ own - cross - cross.T
    n = len(good) * len(bad)
    return (grad + y.T @ col) / n, (hess + (y * col2[:, None]).T @ y) / n


def fit_pairs(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 25) -> RankModel:
    """Newton steps on the pairwise logistic loss over every good document with every bad one; without both labels all
    weights are zero."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    scale = np.where(scale < 1e-6, 1.0, scale)
    w = np.zeros(N_FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return RankModel(mean, scale, w, -1.0 if len(good) or not len(bad) else 1.0, 1.0)
    z = (x - mean) / scale
    for _ in range(rounds):
        grad, hess = pair_sums(z, w, good, bad)
        step = np.linalg.solve(hess + l2 * np.eye(N_FEATURES), grad + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    # The quantile at the share of bad documents, moved to the middle of the gap that it falls in.
    share = len(bad) / len(y)
    cut = 0.5 * (np.quantile(s, share, method="lower") + np.quantile(s, min(1.0, share + 1 / len(s)), method="higher"))
    return RankModel(mean, scale, w, float(cut), float(max(s.std(), 1e-6) / 2))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, fold: tuple[int, int] | None = None) -> RankModel:
    """Learn from about ``most_rows`` labelled documents (a documented bound; the number differs by a few times its square
    root), chosen by a hash of doc_id, so that any layout of the tables gives the same model.

    An id with both labels counts once with each; of several texts with one id that with the least features is taken.
    ``fold`` = (folds, held out): rows whose crc32(doc_id) modulo folds is the second are not learned from.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if fold:
        known = known.filter(crc_fold(F.col("doc_id"), fold[0]) != fold[1])
    known = bounded_sample(known.select("doc_id", F.col("quality").cast("int").alias("_y")).distinct(), ["doc_id"], most_rows)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_k": b["_k"], "_y": b["_y"], "x": [features(r) for r in b["_raw"]]})

    rows = (
        labelled(docs, known)
        .select(F.xxhash64("doc_id").alias("_k"), "_y", "_raw")
        .mapInPandas(extract, "_k long, _y int, x array<double>")
        .groupBy("_k", "_y")
        .agg(F.min("x").alias("x"))
        .toPandas()
        .sort_values(["_k", "_y"])
    )
    x = np.array(rows["x"].tolist(), float).reshape(-1, N_FEATURES)
    return fit_pairs(x, rows["_y"].to_numpy())


def quality(model: RankModel, text: str = "text") -> Column:
    """The score of whole texts as a column (0 to 1; CUT or more: keep); nulls score like texts without words."""

    @F.pandas_udf("double")
    def score(raw: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(r) for r in raw], float).reshape(-1, N_FEATURES)))

    return score(raw_text(text))


def score_quality(docs: DataFrame, model: RankModel) -> DataFrame:
    """All columns of docs and ``quality_score``. A narrow map of whole texts.

    Null and empty texts get the score of a text without words; repeated rows get equal scores; a column
    that is already called quality_score is replaced.
    """
    return docs.withColumn("quality_score", quality(model))
