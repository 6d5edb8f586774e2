"""Quality rules by labelling the lines of a text.

A linear-chain conditional random field over the lines (content or boilerplate) is trained by maximum
likelihood on a bounded sample of documents; lines that plain rules can't name stay unlabelled in training
and are summed over. Viterbi decoding marks the lines of every document; the share of words in content
lines, after fixed counts of words, symbols and repeats, decides whether the document stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import FUNCTION_WORDS, bounded_sample, free_name, raw_text, row_keys

CONTENT, BOILERPLATE, UNKNOWN = 0, 1, -1
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)
#: White space and the continuation bytes of UTF-8: what isn't the first byte of a code point in a word.
_NOT_WORD_CHARS = bytes([32, *range(9, 14), *range(0x80, 0xC0)])
_NOT_LETTERS = bytes(c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122)) + bytes(range(0x80, 0xC0))
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)
N_FEATURES = 18
#: A document stays if at least this share of its words is in content lines.
LEAST_CONTENT = 0.5
STEP = 64


def count_repeats(words: list[bytes]) -> int:
    """Words in windows of three that are found twice or more in the text, the first one included."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    size = len(ids)
    pair = at[:-1] * size + at[1:]
    if size < 2_000_000:
        key = pair[:-1] * size + at[2:]
    else:  # three numbers don't fit in 63 bits: number the pairs first
        key = np.unique(pair, return_inverse=True)[1][:-1] * size + at[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : n + k] |= hit
    return int(covered.sum())


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(raw.translate(None, _NOT_WORD_CHARS)),
        len(raw.translate(None, _NOT_SYMBOLS)),
        len(lines) - len(set(lines)),
        count_repeats(words),
    )


def line_features(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, word counts and rule marks (CONTENT, BOILERPLATE or UNKNOWN) of the lines with a word.

    What the marks' own tests look at (repeats, and shares of letters, capitals, symbols and pipes) is no feature of the line itself,
    only of the lines beside it: the field learns what such lines look like from the rest of their make-up and from where they stand.
    """
    xs, marks = [], []
    seen: set[bytes] = set()
    for line in raw.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        letters = len(line.translate(None, _NOT_LETTERS))
        upper = len(line.translate(None, _NOT_UPPER))
        symbols = len(line.translate(None, _NOT_SYMBOLS))
        digits = len(line.translate(None, _NOT_DIGITS))
        pipes = line.count(b"|")
        xs.append((n, size, letters, upper, symbols, digits, pipes, line.count(b","), sum(map(FUNCTION_WORDS.__contains__, words)), words[-1][-1:] in b".!?"))
        again = line in seen
        seen.add(line)
        if again or (upper > 0.5 * max(letters, 1) and letters > 3) or symbols > 0.2 * n or pipes > 0.2 * n or letters < 0.3 * size:
            marks.append(BOILERPLATE)
        elif n >= 5 and letters >= 0.6 * size:
            marks.append(CONTENT)
        else:
            marks.append(UNKNOWN)
    if not xs:
        return np.zeros((0, N_FEATURES)), np.zeros(0, np.int64), np.zeros(0, np.int8)
    n, size, letters, upper, symbols, digits, pipes, commas, plain, ends = np.array(xs, np.float64).T
    x = np.zeros((len(xs), N_FEATURES))
    x[:, 0] = 1.0
    x[:, 1] = np.minimum(np.log1p(n) / 4, 2.0)
    x[:, 2] = np.minimum(size / n / 8, 2.0)
    x[:, 3] = digits / size
    x[:, 4] = np.minimum(commas / n, 1.0)
    x[:, 5] = plain / n
    x[:, 6] = ends
    x[:, 7] = plain > 0
    beside = np.stack([x[:, 1], letters / size, upper / np.maximum(letters, 1), np.minimum(symbols / n, 2.0), np.minimum(pipes / n, 1.0)], 1)
    x[1:, 8:13] = beside[:-1]  # the line before, zero at the edge
    x[:-1, 13:18] = beside[1:]  # the line after
    return x, n.astype(np.int64), np.array(marks, np.int8)


@dataclass
class LineModel:
    """Scores of the labels: weights [features, 2], and of label to next label: moves [2, 2]."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Viterbi: the best label sequence of one document, ties to CONTENT."""
        if not len(scores):
            return np.zeros(0, np.int8)
        (aa, ab), (ba, bb) = self.moves.tolist()
        rows = scores.tolist()
        a, b = rows[0]
        back = []
        for x, y in rows[1:]:
            a1, b1, a2, b2 = a + aa, b + ba, a + ab, b + bb
            back.append((b1 > a1, b2 > a2))
            a, b = (b1 if b1 > a1 else a1) + x, (b2 if b2 > a2 else a2) + y
        out = [int(b > a)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return np.array(out[::-1], np.int8)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis)
    return m + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis))


def _expected(node: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward over all sequences [sequences, lines, 2] at once: label and move marginals."""
    s, t, _ = node.shape
    f, b = np.zeros_like(node), np.zeros_like(node)
    f[:, 0] = node[:, 0]
    for k in range(1, t):
        f[:, k] = np.where(mask[:, k, None], _log_sum(f[:, k - 1, :, None] + moves, 1) + node[:, k], f[:, k - 1])
    for k in range(t - 2, -1, -1):
        b[:, k] = np.where(mask[:, k + 1, None], _log_sum(moves + (node[:, k + 1] + b[:, k + 1])[:, None, :], 2), 0.0)
    total = _log_sum(f[:, -1], 1)
    labels = np.exp(f + b - total[:, None, None]) * mask[:, :, None]
    pair = np.exp(f[:, :-1, :, None] + moves + (node[:, 1:] + b[:, 1:])[:, :, None, :] - total[:, None, None, None])
    return labels, (pair * mask[:, 1:, None, None]).sum((0, 1))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, l2: float = 1e-3) -> LineModel:
    """Maximum likelihood by gradient steps; (features, marks) by document, longer ones in runs of STEP lines."""
    seqs = [(x[a : a + STEP], m[a : a + STEP]) for x, m in docs for a in range(0, len(x), STEP)]
    w, moves = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    if not seqs:
        return LineModel(w, moves)
    t = max(len(x) for x, _ in seqs)
    x, mask, held = np.zeros((len(seqs), t, N_FEATURES)), np.zeros((len(seqs), t), bool), np.zeros((len(seqs), t, 2))
    for k, (own, marks) in enumerate(seqs):
        x[k, : len(own)], mask[k, : len(own)] = own, True
        held[k, : len(own), BOILERPLATE][marks == CONTENT] = -1e4
        held[k, : len(own), CONTENT][marks == BOILERPLATE] = -1e4
    lines = mask.sum()
    g2w, g2m = np.zeros_like(w), np.zeros_like(moves)
    for _ in range(rounds):
        node = x @ w
        free, free_moves = _expected(node, moves, mask)
        known, known_moves = _expected(node + held, moves, mask)
        gw = np.einsum("stf,stl->fl", x, known - free) / lines - l2 * w
        gm = (known_moves - free_moves) / lines - l2 * moves
        g2w, g2m = g2w + gw * gw, g2m + gm * gm
        w, moves = w + 0.5 * gw / (np.sqrt(g2w) + 1e-8), moves + 0.5 * gm / (np.sqrt(g2m) + 1e-8)
    return LineModel(w, moves)


def train(docs: DataFrame, most_rows: int = 1_000) -> LineModel:
    """Learn from the lines of about ``most_rows`` documents (a documented bound; the number differs by a few times its square
    root), chosen by a hash of doc_id and text, so that any layout gives the same model; of equal rows one is learned from."""
    rows = bounded_sample(docs.filter(F.col("text").isNotNull()).select("doc_id", "text"), ["doc_id", "text"], most_rows)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [line_features(r) for r in b["_raw"]]
            yield pd.DataFrame({"k1": b["k1"], "k2": b["k2"], "x": [x.tobytes() for x, _, _ in found], "m": [m.tobytes() for _, _, m in found]})

    lines = rows.select(*row_keys("doc_id", "text"), raw_text().alias("_raw")).mapInPandas(extract, "k1 long, k2 int, x binary, m binary")
    got = lines.dropDuplicates(["k1", "k2"]).toPandas().sort_values(["k1", "k2"])
    return fit([(np.frombuffer(x).reshape(-1, N_FEATURES), np.frombuffer(m, np.int8)) for x, m in zip(got["x"], got["m"])])


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, content_share double, line_marks string"
)


def verdict(model: LineModel, least_content: float = LEAST_CONTENT, text: str = "text") -> Column:
    """A struct of ``SCHEMA`` for each whole text."""

    @F.pandas_udf(f"struct<{SCHEMA.replace(' ', ': ').replace(',: ', ', ')}>")
    def judge(raw: pd.Series) -> pd.DataFrame:
        out = []
        for own in raw:
            n, *counts, repeats = base_counts(own)
            xs, sizes, _ = line_features(own)
            marks = model.decode(xs @ model.weights)
            share = float(sizes[marks == CONTENT].sum() / n) if n else 0.0
            failed = n < 50 or 100 * repeats > 50 * n
            out.append((n, *counts, repeats, failed, not failed and share >= least_content, share, marks.tobytes().translate(_LETTERS).decode()))
        return pd.DataFrame(out, columns=NAMES)

    return judge(raw_text(text))


def apply_rules(docs: DataFrame, model: LineModel, least_content: float = LEAST_CONTENT) -> DataFrame:
    """All columns of docs and those of ``SCHEMA``; ``line_marks`` has C or B for every line with a word.

    Null and empty texts have no words, so they fail the base rules. Repeated rows get equal results. Columns
    of docs that are called like those of the result are replaced. A narrow map of whole texts.
    """
    at = free_name(docs, "_found")
    found = docs.withColumn(at, verdict(model, least_content))
    return found.withColumns({c: F.col(f"{at}.{c}") for c in NAMES}).drop(at)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_LETTERS = bytes([67, 66]) + bytes(range(2, 256))
