"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index holds a posting (term, document, position) for every word of the documents that any benchmark item
has, sorted by term within each part. Of each window of item words the two rarest terms, by their postings,
are intersected first: postings are moved to the place where the item would begin (position less offset), and
only starts that both lists have go on. What is left is held against the postings of all the other terms. Proximity
matches let words stand some places off, and one word of a whole window be another.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidegrid.llm.common import free_name, row_keys, small, staged

WINDOW = 10
KEY = ["k1", "k2"]
#: Proximity: words by which a term may be off its place, and terms of a whole window that may be missing.
SLOP, MISS = 3, 1
#: Words of the stretches of text that candidates are looked up in.
STRETCH = 32


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; none for null."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def item_terms(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (ik, item_id, n) and their words (ik, ipos, term, tid); equal rows once, items without words not at all."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0).distinct()
    items = staged(items.withColumn("ik", F.monotonically_increasing_id()), "items")
    at = items.select("ik", F.posexplode("w").alias("ipos", "term"))
    terms = staged(at.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "terms")
    return items.select("ik", "item_id", F.size("w").alias("n")), staged(at.join(terms, "term"), "item-terms")


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (tid, k1, k2, pos) of the words in ``terms`` (term, tid), written to the shared folder.

    k1 and k2, hashes of id and text, name a document: null and repeated ids need no care, equal rows have
    equal postings. The first word of a document (or its lack) has a row in any case, with the id and
    the number of words, so that one scan of the texts gives both postings and lengths; ``pos`` and ``tid``
    are null where there is none.
    """
    own = docs.select(
        F.col(id_col).alias("id"), *row_keys(id_col, text_col), words(F.col(text_col)).alias("w")
    ).select("id", "k1", "k2", F.size("w").cast("long").alias("n_words"), F.posexplode_outer("w").alias("pos", "term"))
    found = own.join(small(terms), "term", "left").filter("tid is not null or pos = 0 or pos is null")
    first = F.coalesce("pos", F.lit(0)) == 0
    return staged(found.select("tid", "k1", "k2", "pos", F.when(first, F.struct("id", "n_words")).alias("doc")).sortWithinPartitions("tid"), "postings")


def documents_of(index: DataFrame) -> DataFrame:
    """id, k1, k2 and n_words of every document row."""
    return index.filter("doc is not null").select("doc.id", "k1", "k2", "doc.n_words")


def frequencies(index: DataFrame, at: DataFrame) -> DataFrame:
    """The items' words (ik, ipos, tid) with ``f``, the number of postings of each; staged."""
    if "f" in at.columns:
        return at
    freq = index.filter("tid is not null").groupBy("tid").agg(F.count("*").alias("f"))
    return staged(at.join(freq, "tid", "left").select("ik", "ipos", "tid", F.coalesce("f", F.lit(0)).alias("f")), "frequencies")


def _ranks(items: DataFrame, at: DataFrame, window: int) -> DataFrame:
    """Windows (ik, start, len), a row for each of their words: ipos, tid, f and ``r``, 1 for the rarest."""
    last = F.greatest(F.col("n") - window, F.lit(0))
    starts = items.select("ik", F.least(F.col("n"), F.lit(window)).alias("len"), F.explode(F.sequence(F.lit(0), last)).alias("start"))
    places = starts.select("ik", "start", "len", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("ipos"))
    order = Window.partitionBy("ik", "start").orderBy("f", "ipos")
    return places.join(at, ["ik", "ipos"]).withColumn("r", F.row_number().over(order))


def _ranked(items: DataFrame, at: DataFrame, window: int) -> DataFrame:
    """Windows (ik, start, len, and of its two rarest terms p1, t1, p2, t2) whose terms all have postings."""
    pick = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    windows = _ranks(items, at, window).groupBy("ik", "start", "len").agg(
        F.min("f").alias("f"), pick("ipos", 1).alias("p1"), pick("tid", 1).alias("t1"), pick("ipos", 2).alias("p2"), pick("tid", 2).alias("t2")
    )
    return staged(windows.filter("f > 0").drop("f"), "windows")


def rare_postings(index: DataFrame, items: DataFrame, at: DataFrame, window: int = WINDOW, rarest: int = MISS + 2) -> DataFrame:
    """The postings of all terms that are among the ``rarest`` of a window: what candidates are made of, read from the index once."""
    rare = _ranks(items, at, window).filter(F.col("r") <= rarest).select("tid").distinct()
    return staged(index.filter("tid is not null").select("tid", *KEY, "pos").join(small(staged(rare, "rare-terms")), "tid", "left_semi"), "rare-postings")


def _stretches(cand: DataFrame, first: Column, last: Column) -> DataFrame:
    """The stretches of text (k1, k2, _at) from place ``first`` to ``last`` of each candidate."""
    return cand.select(*KEY, F.explode(F.sequence(F.floor(F.greatest(first, F.lit(0)) / STRETCH), F.floor(last / STRETCH))).alias("_at"))


def postings_near(index: DataFrame, spots: DataFrame) -> DataFrame:
    """The postings of all terms in these stretches, read from the index once for all searches."""
    near = index.filter("tid is not null").select("tid", *KEY, "pos").withColumn("_at", F.floor(F.col("pos") / STRETCH))
    return staged(near.join(small(staged(spots.distinct(), "spots")), [*KEY, "_at"], "left_semi").drop("_at"), "near-postings")


def phrase_candidates(postings: DataFrame, items: DataFrame, at: DataFrame, window: int = WINDOW) -> DataFrame:
    """k1, k2, ik, diag (where the item would begin), starts of windows and len, where the two rarest terms of a window stand."""
    windows = _ranked(items, at, window)
    first = windows.select(F.col("t1").alias("tid"), "ik", "p1").distinct()
    found = postings.join(small(first), "tid").select("k1", "k2", "ik", "p1", (F.col("pos") - F.col("p1")).alias("diag"))
    # The second rarest term must stand where the first one says.
    pairs = windows.filter("p2 is not null").select("ik", "p1", "p2", F.col("t2").alias("tid")).distinct()
    second = postings.join(small(pairs.select("tid").distinct()), "tid", "left_semi")
    both = (
        found.join(small(pairs), ["ik", "p1"])
        .withColumn("pos", F.col("diag") + F.col("p2"))
        .join(second, [*KEY, "tid", "pos"], "left_semi")
        .select(*KEY, "ik", "p1", "p2", "diag")
    )
    short = windows.filter("p2 is null").select("ik", "p1", F.lit(None).cast("int").alias("p2"))
    both = both.unionByName(found.join(small(short), ["ik", "p1"]).select(*KEY, "ik", "p1", "p2", "diag"))
    spans = windows.select("ik", "p1", F.coalesce("p2", F.lit(-1)).alias("p2"), "start", "len")
    cand = (
        both.withColumn("p2", F.coalesce("p2", F.lit(-1)))
        .join(small(spans), ["ik", "p1", "p2"])
        .filter("diag + start >= 0")
        .groupBy(*KEY, "ik", "diag")
        .agg(F.collect_set("start").alias("starts"), F.max("len").alias("len"))
    )
    return staged(cand, "candidates")


def phrase_spots(cand: DataFrame) -> DataFrame:
    return _stretches(cand, F.col("diag") + F.array_min("starts"), F.col("diag") + F.array_max("starts") + F.col("len") - 1)


def whole_phrases(cand: DataFrame, near: DataFrame, at: DataFrame) -> DataFrame:
    """Of the candidates k1, k2, ik and ``hits``, by the postings near them: all words of a window at their places."""
    run = lambda s: F.sequence(s, s + F.col("len") - 1)
    wanted = cand.select(*KEY, "ik", "diag", F.explode(F.array_distinct(F.flatten(F.transform("starts", run)))).alias("ipos"))
    wanted = wanted.join(small(at.select("ik", "ipos", "tid")), ["ik", "ipos"]).withColumn("pos", F.col("diag") + F.col("ipos"))
    right = wanted.join(near, [*KEY, "tid", "pos"], "left_semi").groupBy(*KEY, "ik", "diag").agg(F.collect_set("ipos").alias("right"))
    whole = F.filter("starts", lambda s: F.size(F.array_except(run(s), F.col("right"))) == 0)
    hits = F.array_distinct(F.flatten(F.transform("whole", run)))
    return (
        right.join(cand, [*KEY, "ik", "diag"])
        .withColumn("whole", whole)
        .filter(F.size("whole") > 0)
        .select(*KEY, "ik", F.transform(hits, lambda p: p + F.col("diag")).alias("hits"))
    )


def phrase_matches(index: DataFrame, items: DataFrame, at: DataFrame, window: int = WINDOW) -> DataFrame:
    """k1, k2, ik and the document positions ``hits`` (array) inside any occurrence of a window of the item.

    A window is ``window`` words in a row; an item of fewer is one window.
    """
    at = frequencies(index, at)
    cand = phrase_candidates(rare_postings(index, items, at, window, 2), items, at, window)
    return whole_phrases(cand, postings_near(index, phrase_spots(cand)), at)


def proximity_matches(index: DataFrame, items: DataFrame, at: DataFrame, slop: int = SLOP, miss: int = MISS, window: int = WINDOW) -> DataFrame:
    """k1, k2, ik, start, len, spread and ``n_found``: every place of a document where an item's window nearly stands.

    The place is named by a posting of one of the window's ``miss`` + 1 rarest terms (ties: the earlier one) and begins where
    that term says (start, below 0 if the document begins within the window). There all words of the window, or all but ``miss``
    if it is a whole one, stand at most ``slop`` words from where they would in an exact occurrence; spread is the largest such
    distance. Exact occurrences are among them, with spread 0 and len words found. Items of fewer than ``window`` words are one
    window. Of the miss + 2 rarest terms two must be there, so only places where two rare terms agree are looked at; the lists of
    rare terms of neighbouring windows then leave out most of these.
    """
    at = frequencies(index, at)
    cand = proximity_candidates(rare_postings(index, items, at, window, miss + 2), items, at, slop, miss, window)
    return near_phrases(cand, postings_near(index, proximity_spots(cand, slop)), at, slop, miss, window)


def proximity_candidates(postings: DataFrame, items: DataFrame, at: DataFrame, slop: int = SLOP, miss: int = MISS, window: int = WINDOW) -> DataFrame:
    """k1, k2, ik, diag, start and len where enough of a window's rare terms agree."""
    spare = F.when(F.col("len") == window, miss).otherwise(0)
    rare = staged(_ranks(items, at, window).filter(F.col("r") <= spare + 2).select("ik", "start", "len", "ipos", "tid", (F.col("r") <= spare + 1).alias("anchor")), "rare")
    lists = postings.join(small(rare.select("tid", "ik", "ipos", (F.col("len") == 1).alias("alone")).distinct()), "tid")
    beside = Window.partitionBy(*KEY, "ik").orderBy("diag").rangeBetween(-slop, slop)
    agreed = (
        lists.select(*KEY, "ik", "ipos", "alone", (F.col("pos") - F.col("ipos")).alias("diag"))
        .withColumns({"_lo": F.min("ipos").over(beside), "_hi": F.max("ipos").over(beside)})
        .filter("_lo < _hi or alone")
    )
    agreed = staged(agreed.select(*KEY, "ik", "ipos", "diag"), "agreed")
    # Of all the item's listed places within the window of an anchor, no more than the spare ones may be missing.
    every = rare.groupBy("ik").agg(F.collect_set("ipos").alias("every"))
    others = F.filter("every", lambda x: (x >= F.col("start")) & (x < F.col("start") + F.col("len")) & (x != F.col("ipos")))
    anchors = rare.filter("anchor").join(every, "ik").select("ik", "ipos", "start", "len", others.alias("others"))
    cand = (
        agreed.withColumn("_by", F.collect_set("ipos").over(beside))
        .join(small(staged(anchors, "anchors")), ["ik", "ipos"])
        .filter(F.size(F.array_intersect("_by", "others")) >= F.size("others") - spare)
    )
    return staged(cand.select(*KEY, "ik", "diag", "start", "len").distinct(), "near-candidates")


def proximity_spots(cand: DataFrame, slop: int = SLOP) -> DataFrame:
    return _stretches(cand, F.col("diag") + F.col("start") - slop, F.greatest(F.col("diag") + F.col("start") + F.col("len") - 1 + slop, F.lit(0)))


def near_phrases(cand: DataFrame, near: DataFrame, at: DataFrame, slop: int = SLOP, miss: int = MISS, window: int = WINDOW) -> DataFrame:
    """Of the candidates those that ``proximity_matches`` gives, by the postings near them."""
    spare = F.when(F.col("len") == window, miss).otherwise(0)
    wanted = cand.select(*KEY, "ik", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("ipos")).distinct()
    wanted = wanted.join(small(at.select("ik", "ipos", "tid")), ["ik", "ipos"])
    words_of = wanted.join(near, [*KEY, "tid"]).select(*KEY, "ik", "ipos", (F.col("pos") - F.col("ipos")).alias("at"))
    reach = cand.select(*KEY, "ik", "diag").distinct().withColumn("at", F.explode(F.sequence(F.col("diag") - slop, F.col("diag") + slop)))
    off = reach.join(words_of, [*KEY, "ik", "at"]).groupBy(*KEY, "ik", "diag", "ipos").agg(F.min(F.abs(F.col("at") - F.col("diag"))).alias("off"))
    there = off.groupBy(*KEY, "ik", "diag").agg(F.collect_list(F.struct("ipos", "off")).alias("there"))  # an item's words at most
    inside = F.filter("there", lambda x: (x["ipos"] >= F.col("start")) & (x["ipos"] < F.col("start") + F.col("len")))
    return (
        cand.join(there, [*KEY, "ik", "diag"])
        .withColumn("inside", inside)
        .filter(F.size("inside") >= F.col("len") - spare)
        .select(
            *KEY, "ik", (F.col("diag") + F.col("start")).alias("start"), "len",
            F.array_max(F.transform("inside", lambda x: x["off"])).alias("spread"), F.size("inside").alias("n_found"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256, contaminated, n_near, near_items and ``items`` (their ids) of every row.

    The first ones are of exact phrases; near_items are the sorted, comma-joined ids of the items with a proximity match,
    exact ones among them, and n_near is their number. Null and empty texts have no words and are clean; an empty benchmark
    leaves all clean. Repeated rows get equal results each; repeated items count once. Items with the same id and other texts
    are one item. Extra columns are not read.
    """
    items, at = item_terms(benchmark)
    index = build_index(docs, at.select("term", "tid").distinct(), id_col, text_col)
    at = frequencies(index, at)
    rare = rare_postings(index, items, at, window)
    exact, loose = phrase_candidates(rare, items, at, window), proximity_candidates(rare, items, at, window=window)
    close = postings_near(index, phrase_spots(exact).unionByName(proximity_spots(loose)))
    ids = small(items.select("ik", F.col("item_id").cast("string").alias("item")))
    named = lambda c: F.sort_array(F.collect_set(c))
    found = (
        whole_phrases(exact, close, at)
        .join(ids, "ik")
        .groupBy(*KEY)
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"), named("item").alias("items"))
    )
    near = near_phrases(loose, close, at, window=window).select(*KEY, "ik").distinct().join(ids, "ik").groupBy(*KEY).agg(named("item").alias("near"))
    none = F.array().cast("array<string>")
    return (
        documents_of(index)
        .join(found, KEY, "left")
        .join(near, KEY, "left")
        .select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), *(F.coalesce(c, none).alias(c) for c in ("items", "near")))
        .select(
            id_col,
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
            F.size("near").cast("long").alias("n_near"),
            F.array_join("near", ",").alias("near_items"),
            "items",
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that no window of a benchmark item occurs in."""
    items, at = item_terms(benchmark)
    index = build_index(docs, at.select("term", "tid").distinct(), id_col, text_col)
    a, b = free_name(docs, "_k1"), free_name(docs, "_k2")
    hit = phrase_matches(index, items, at, window).select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    k1, k2 = row_keys(id_col, text_col)
    return docs.withColumns({a: k1, b: k2}).join(hit, [a, b], "left_anti").select(*docs.columns)
