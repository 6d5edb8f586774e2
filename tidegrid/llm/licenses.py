"""License scans by fuzzy search for short notices.

Each notice of length m that may hold up to k edits is split into k + 1 pieces: a text with at most k
edits still holds one piece unchanged (pigeonhole). All pieces go into one Aho-Corasick automaton whose
hits give candidate places; the regex library's bounded-error matching then verifies the edits around
each and reports the span. Short phrases with k = 0 are sought whole, with their word borders.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import WORD_TABLE, raw_text


@dataclass(frozen=True)
class Notice:
    """A notice in lower-case words; ``edits`` is the most characters that may differ."""

    label: str
    phrase: str
    edits: int
    base: bool = False


#: Fixed phrases and labels of the base result.
BASE_NOTICES = (
    Notice("cc-by", "cc by", 0, True),
    Notice("gpl", "general public license", 0, True),
    Notice("reserved", "all rights reserved", 0, True),
)
#: Notices sought with edits.
FUZZY_NOTICES = (
    Notice("gpl", "general public license", 2),
    Notice("reserved", "all rights reserved", 2),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("apache-2.0", "licensed under the apache license", 3),
    Notice("apache-2.0", "apache license version 2 0", 2),
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge", 4),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("mpl-2.0", "mozilla public license", 2),
    Notice("lgpl", "lesser general public license", 2),
    Notice("cc0", "no rights reserved", 1),
    Notice("unlicense", "released into the public domain", 3),
)
SCHEMA = (
    "n_words long, exact array<struct<label: string, word: long>>, "
    "fuzzy array<struct<label: string, start: long, stop: long, edits: long, matched: string>>, score double"
)


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of near-equal length, with their offsets."""
    cut = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cut, cut[1:])]


@functools.cache
def _search(notices: tuple[Notice, ...]):
    """The automaton over all pieces, and the compiled pattern of each notice."""
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for n, notice in enumerate(notices):
        phrase = f" {notice.phrase} " if notice.edits == 0 else notice.phrase
        for offset, piece in pieces(phrase, notice.edits):
            seeds.setdefault(piece, []).append((n, offset))
        patterns.append(regex.compile(f"(?e)(?:{regex.escape(phrase)}){{e<={notice.edits}}}"))
    automaton = ahocorasick.Automaton()
    for piece, places in seeds.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    return automaton, patterns


def scan_text(raw: bytes, notices: tuple[Notice, ...]) -> tuple[int, list, list, float]:
    """n_words, exact places (label, word), fuzzy spans (label, first word, word after, edits, text), score."""
    words = raw.translate(WORD_TABLE).split()
    text = f" {b' '.join(words).decode()} "
    automaton, patterns = _search(notices)
    hits, windows = [], {}
    for end, (length, places) in automaton.iter(text):
        for n, offset in places:
            notice, start = notices[n], end + 1 - length - offset
            if notice.edits == 0:
                hits.append((notice.label, start))
            else:
                windows.setdefault(n, []).append(
                    (max(0, start - notice.edits), start + len(notice.phrase) + notice.edits)
                )
    if not hits and not windows:
        return len(words), [], [], 0.0
    # Blanks stand before each word: a place's word is found by bisection, whatever the text's length.
    blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
    before = lambda places: np.searchsorted(blanks, places).tolist()
    exact = [(label, at) for (label, _), at in zip(hits, before([start for _, start in hits]))]
    fuzzy, score = [], 1.0 if exact else 0.0
    for n, spans in windows.items():
        notice, joined = notices[n], []
        for lo, hi in sorted(spans):
            if joined and lo <= joined[-1][1]:
                joined[-1][1] = max(hi, joined[-1][1])
            else:
                joined.append([lo, hi])
        # From the left, each match with its edits made as few as they get: none stands before a better one unseen.
        found = [m for lo, hi in joined for m in patterns[n].finditer(text, lo, min(hi, len(text)))]
        first = before([m.start() + 1 for m in found])
        last = before([m.end() for m in found])
        for m, a, b in zip(found, first, last):
            edits = sum(m.fuzzy_counts)
            fuzzy.append((notice.label, max(a - 1, 0), b, edits, m.group()))
            score = max(score, 1.0 - edits / len(notice.phrase))
    return len(words), exact, sorted(fuzzy, key=lambda x: (x[1], x[0], x[2])), score


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = BASE_NOTICES + FUZZY_NOTICES
) -> DataFrame:
    """Notices in every whole text: the id column, then ``SCHEMA``.

    ``exact`` lists the places of notices without edits (overlapping ones too), ``fuzzy`` the verified
    spans of the others; words count from 0. ``score`` is 1 less the share of edits of the best match, 0
    without one. One row per input row, repeated ids too; null and empty texts have no words and no
    notices; other columns are not read, so their names cannot clash. A narrow map: no shuffle.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [scan_text(x, notices) for x in b["_raw"]]
            out = pd.DataFrame(
                [
                    (n, [{"label": a, "word": w} for a, w in e], [dict(zip(("label", "start", "stop", "edits", "matched"), f)) for f in z], s)
                    for n, e, z, s in rows
                ],
                columns=["n_words", "exact", "fuzzy", "score"],
            )
            out.insert(0, id_col, b[id_col].to_numpy())
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, raw_text(text_col).alias("_raw")).mapInPandas(scan, f"`{id_col}` {kind}, {SCHEMA}")


def license_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of a scan: counts, first and last place, labels."""
    names = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    places = F.transform("exact", lambda x: x["word"])
    return found.select(
        id_col,
        "n_words",
        F.size("exact").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(names(F.col("exact"))).alias("base_labels"),
        joined(F.concat(names(F.col("exact")), names(F.col("fuzzy")))).alias("labels"),
        "score",
        F.transform("fuzzy", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["edits"].alias("edits"))).alias("spans"),
    )
