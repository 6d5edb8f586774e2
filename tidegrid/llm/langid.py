"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams are summed by Spark to one log-probability matrix (buckets x languages), which
is broadcast. Scoring a batch is a sparse product: the n-grams of all texts form one index vector, the
matrix rows at these indices are summed between the texts' borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import crc_fold, free_name

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
_LETTER = regex.compile(r"\p{L}")
_GAP = re.compile(r"[\W\d_]+")
#: Characters whose n-grams are hashed at a time; longer texts go on in the next step, none is cut.
STEP = 2_000_000


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other than letters one blank."""
    return np.frombuffer(f" {_GAP.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(c: np.ndarray, order: int, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of the n-gram that starts at each place."""
    h = np.full(len(c) - order + 1, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for i in range(order):
        h ^= c[i : len(c) - order + 1 + i]
        h *= np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return h & np.uint32(buckets - 1)


@dataclass
class LangModel:
    langs: list[str]
    log_prob: np.ndarray  # float32 [buckets, languages]
    prior: np.ndarray


def train(docs: DataFrame, fold: tuple[int, int] | None = None, buckets: int = BUCKETS, smooth: float = 0.1) -> LangModel:
    """Learn from text and lang of all documents: only counts, languages x buckets of them, come to the driver."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    if fold:
        known = known.filter(F.coalesce(crc_fold(F.col("doc_id"), fold[0]) != fold[1], F.lit(False)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        docs_in: dict[str, int] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"]):
                docs_in[lang] = docs_in.get(lang, 0) + 1
                own = sums.setdefault(lang, np.zeros(buckets, np.int64))
                c = codes(text)
                for n in ORDERS:
                    if len(c) >= n:
                        own += np.bincount(hashed(c, n, buckets), minlength=buckets)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": own[at]})
            yield pd.DataFrame({"lang": [lang], "bucket": [-1], "n": [docs_in[lang]]})

    summed = known.select("text", "lang").mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = summed.toPandas()  # at most languages x (buckets + 1) rows
    langs = sorted(rows["lang"].unique())
    m, prior = np.zeros((buckets, len(langs))), np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        prior[k] = own.loc[own["bucket"] < 0, "n"].sum()
        own = own[own["bucket"] >= 0]
        m[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    log_prob = np.log(m + smooth) - np.log(m.sum(0) + smooth * buckets)
    return LangModel(langs, log_prob.astype(np.float32), np.log(prior / max(1.0, prior.sum())) if len(langs) else prior)


def log_likelihood(texts: list[str], model: LangModel) -> np.ndarray:
    """log P(n-grams, language) of each text: [texts, languages]."""
    out = np.tile(model.prior, (len(texts), 1))
    buckets = len(model.log_prob)
    batch: list[tuple[int, np.ndarray, int]] = []  # text, code points, n-grams that start here
    held = 0

    def flush() -> None:
        for n in ORDERS:
            index = [(k, hashed(c, n, buckets)[:most]) for k, c, most in batch if len(c) >= n]
            if index:
                starts = np.cumsum([0] + [len(h) for _, h in index[:-1]])
                sums = np.add.reduceat(model.log_prob[np.concatenate([h for _, h in index])], starts, axis=0, dtype=np.float64)
                np.add.at(out, [k for k, _ in index], sums)
        batch.clear()

    for k, text in enumerate(texts):
        c = codes(text)
        for a in range(0, len(c), STEP):
            part = c[a : a + STEP + max(ORDERS) - 1]
            batch.append((k, part, STEP))
            held += len(part)
            if held > STEP:
                flush()
                held = 0
    flush()
    return out


def identify(docs: DataFrame, model: LangModel, spark: SparkSession | None = None) -> DataFrame:
    """All columns of docs, ``lang_pred`` and ``lang_score`` (the posterior of that language, 0 to 1).

    ``und`` with score 0 if the text is null or has no letter (Unicode categories L*), or nothing was learned. Ties go to the first
    language by name. Existing columns of these names are replaced. A narrow map; only the matrix, of
    buckets x languages, is broadcast.
    """
    shared = (spark or docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, lang_score: double>")
    def predict(text: pd.Series) -> pd.DataFrame:
        m = shared.value
        lang, score = np.full(len(text), "und", object), np.zeros(len(text))
        at = [i for i, t in enumerate(text) if t and m.langs and _LETTER.search(t)]
        if at:
            ll = log_likelihood([text.iloc[i] for i in at], m)
            best = ll.argmax(1)
            lang[at] = np.array(m.langs, object)[best]
            score[at] = 1.0 / np.exp(ll - ll.max(1, keepdims=True)).sum(1)
        return pd.DataFrame({"lang_pred": lang, "lang_score": score})

    own = free_name(docs, "_found")
    found = docs.withColumn(own, predict(F.col("text")))
    return found.withColumns({"lang_pred": F.col(f"{own}.lang_pred"), "lang_score": F.col(f"{own}.lang_score")}).drop(own)
