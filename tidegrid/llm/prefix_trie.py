"""The tree of all openings that conversations share.

A conversation is its turns (role and text) in order; each distinct sequence of first d turns is a node of depth d, from the
root (d = 0), and the conversations that begin with it are its members. A node belongs to its smallest member. Whoever owns an
opening owns all longer openings of its own, so a conversation's owned nodes are a chain from its first owned depth to its
end: that depth is found by binary search, all conversations at once, each round a join of (conversation, depth) with the
minima by digest. Chains hang on the chain that owns the opening one turn shorter, and totals go up this tree of chains by
doubling, so that rounds grow with the logarithm of a conversation's length and of the nesting.

Digests are 128 bits, the exclusive or of hashes of (place, role, text) over the first d turns: a running aggregate, which is
worked out within stretches of 1,024 turns and carried on between these, as are ranks and suffix sums. So a conversation that
has a third of all rows is dealt over tasks as well. Openings that a thousandth of all rows have are broadcast (fewer than a
thousand can be so frequent), and what hangs on a node is summed before the shuffle.

Turns are ordered by ``turn`` (null first), ties by role and by the MD5 of the text (equal rows are repeated turns). Null roles
and texts are empty. Rows without ``conv_id`` are in no conversation. Without conversations there is no tree: the result is
empty. Other columns, whatever they are called, don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import crc_fold, join_hot, staged

#: Turns of a stretch, and ids that are joined at a time.
STRETCH, IDS = 1_024, 4_096
#: Conversations whose openings may come from one of them, and the limit of borrowed turns.
FAMILY, MOST = 100, 6


def running(rows: DataFrame, key: str, at: str, sums: dict[str, tuple[Callable, Callable]]) -> DataFrame:
    """rows with running aggregates along ``at`` (0, 1, ... within the key), the current row included, in place of the columns named.

    ``sums``: column to (aggregate, how two parts add up). Stretches are worked out on their own; what goes on between them is a
    row for each stretch, so no task orders a whole key. ``rows`` is read twice.
    """
    own = rows.withColumn("_stretch", F.floor(F.col(at) / STRETCH))
    earlier = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(key, "_stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = own.groupBy(key, "_stretch").agg(*[f(c).alias(f"_{c}") for c, (f, _) in sums.items()])
    before = parts.select(key, "_stretch", *[f(f"_{c}").over(earlier).alias(f"_{c}") for c, (f, _) in sums.items()]).filter("_stretch > 0")
    done = own.withColumns({c: f(c).over(within) for c, (f, _) in sums.items()}).join(before, [key, "_stretch"], "left")
    return done.withColumns({c: add(F.col(c), F.coalesce(f"_{c}", F.lit(0))) for c, (_, add) in sums.items()}).drop("_stretch", *[f"_{c}" for c in sums])


_XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
_SUM = (F.sum, lambda a, b: a + b)


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, r: 1, 2, ... in order, role, m: MD5 and n: code points of the text), and conversations (conv_id, own: turns).

    Rows are dealt by ranges of (conv_id, turn, ...), so that a long conversation lies in several parts; ranks within a part go on
    where the earlier parts of the conversation end.
    """
    text = F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.md5(text.cast("binary")).alias("m"), F.char_length(text).alias("n"))
    rows = rows.withColumn("_id", F.monotonically_increasing_id())  # equal rows may part
    order = [F.asc_nulls_first("turn"), "role", "m", "_id"]
    parts = staged(rows.repartitionByRange("conv_id", *order).withColumn("_part", F.spark_partition_id()), "turns")
    counts = parts.groupBy("conv_id", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv_id", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy(*order))
    turns = parts.join(before, ["conv_id", "_part"]).withColumn("r", rank + F.col("_before"))
    return turns.select("conv_id", "r", "role", "m", "n"), counts.groupBy("conv_id").agg(F.sum("_n").alias("own"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, d, role, m, n) and conversations (conv_id, length) where each conversation c takes its first h turns, h the
    CRC-32 of the id modulo 6, from conversation c - c % 100 (fewer if that has fewer) and goes on with its own ones after h."""
    turns, sizes = numbered(conversations)
    turns = staged(turns, "numbered")
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    heads = sizes.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("_of"))
    convs = sizes.select("conv_id", "own", base, crc_fold(F.col("conv_id"), MOST).alias("h")).join(heads, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("_of", F.lit(0))))
    convs = staged(convs.select("conv_id", "base", "own", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    facts = convs.select("conv_id", "h", "taken", "own")
    after = join_hot(turns, facts, ["conv_id"], "own", turns.count()).filter("r > h")
    after = after.select("conv_id", (F.col("taken") + F.col("r") - F.col("h")).alias("d"), "role", "m", "n")
    first = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("r") < MOST)).withColumnRenamed("conv_id", "base")
    lent = first.join(convs.select("conv_id", "base", "h"), "base").filter("r <= h").select("conv_id", F.col("r").alias("d"), "role", "m", "n")
    return after.unionByName(lent), convs.select("conv_id", "length")


def first_owned(prefixes: DataFrame, minima: DataFrame, lengths: DataFrame, total: int, longest: int) -> DataFrame:
    """conv_id, length and f, the first depth from 1 whose opening the conversation owns (length + 1 if none): binary search."""
    digests = prefixes.select("conv_id", F.col("d").alias("mid"), "p1", "p2")
    owners = minima.select(F.col("d").alias("mid"), "p1", "p2", "owner", "n_convs")
    state = lengths.select("conv_id", "length", F.lit(1).cast("long").alias("lo"), (F.col("length") + 1).alias("hi"))
    for _ in range(longest.bit_length()):
        probes = state.filter("lo < hi").withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2)).join(digests, ["conv_id", "mid"])
        met = join_hot(probes, owners, ["mid", "p1", "p2"], "n_convs", total)
        mine = F.col("owner") == F.col("conv_id")
        moved = met.select("conv_id", "length", F.when(mine, F.col("lo")).otherwise(F.col("mid") + 1).alias("lo"), F.when(mine, F.col("mid")).otherwise(F.col("hi")).alias("hi"))
        state = staged(moved.unionByName(state.filter("lo >= hi")), "search")
    return state.select("conv_id", "length", F.col("lo").alias("f"))


def summed_up(chains: DataFrame) -> DataFrame:
    """conv_id, leaves and saved of each chain with all chains that hang below it; chains: conv_id, up (the chain it hangs on, null
    at the top), leaves and saved of its own.

    Doubling: after k rounds a chain has the totals of all chains less than 2^k steps below it, and knows the chain 2^k steps up.
    """
    now = staged(chains.select("conv_id", "up", "leaves", "saved"), "chains")
    n = now.count()
    while True:
        below = staged(now.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"), F.count("*").alias("_c")), "below")
        if below.isEmpty():
            return now.select("conv_id", "leaves", "saved")
        facts = below.select(F.col("conv_id").alias("up"), "_c").join(now.select(F.col("conv_id").alias("up"), F.col("up").alias("_up")), "up")
        climbed = join_hot(now.filter("up IS NOT NULL"), facts, ["up"], "_c", n).select("conv_id", F.col("_up").alias("up"), "leaves", "saved")
        climbed = climbed.unionByName(now.filter("up IS NULL")).join(below, "conv_id", "left")
        now = staged(climbed.select("conv_id", "up", *[(F.col(c) + F.coalesce(p, F.lit(0))).alias(c) for c, p in (("leaves", "_l"), ("saved", "_s"))]), "chains")


def listed(rows: DataFrame, keys: list[str], of: str) -> DataFrame:
    """keys and sha256, the SHA-256 of the key's ``of`` (distinct numbers) in rising order, comma-joined.

    Numbers are joined in parts of ranges, so that many tasks share a hot key; its digest then goes through a few long strings,
    one after the other.
    """
    kinds = ", ".join(f"{c} long" for c in keys)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:  # sorted: a key's rows lie together
            if not len(b):
                continue
            key, ids = b[keys].to_numpy(), b[of].to_numpy()
            start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)) | (np.arange(len(b)) % IDS == 0))
            joined = [",".join(map(str, x)) for x in np.split(ids, start[1:])]
            yield pd.DataFrame(key[start], columns=keys).assign(first=ids[start], ids=joined)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, hashlib.sha256()
        for b in batches:
            done = []
            for *now, ids in b[[*keys, "ids"]].itertuples(index=False):
                if now != key:
                    if key is not None:
                        done.append([*key, state.hexdigest()])
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=[*keys, "sha256"])
        if key is not None:
            yield pd.DataFrame([[*key, state.hexdigest()]], columns=[*keys, "sha256"])

    parts = rows.select(*keys, of).repartitionByRange(*keys, of).sortWithinPartitions(*keys, of).mapInPandas(join, f"{kinds}, first long, ids string")
    return parts.repartition(*keys).sortWithinPartitions(*keys, "first").mapInPandas(digest, f"{kinds}, sha256 string")


def tree(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of turns (conv_id, d from 1, role, m, n: what the turn costs) and conversations (conv_id, length).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes from here down),
    saved_tokens (n_convs - 1 times n, from here down) and ends_sha256 (of the members that end here).
    """
    root, longest = lengths.agg(F.min("conv_id"), F.max("length")).first()
    if root is None:
        return lengths.sparkSession.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in COLUMNS))
    hashed = turns.select("conv_id", "d", F.xxhash64("d", "role", "m").alias("p1"), F.xxhash64(F.lit(1), "d", "role", "m").alias("p2"), "n", (F.col("d") - 1).alias("_at"))
    prefixes = staged(running(staged(hashed, "hashed"), "conv_id", "_at", {"p1": _XOR, "p2": _XOR}).drop("_at"), "prefixes")
    total = prefixes.count()
    minima = staged(prefixes.groupBy("d", "p1", "p2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("n").cast("long").alias("n")), "minima")
    found = first_owned(prefixes, minima, lengths, total, longest)
    # Whose opening stands a turn before the first owned one: there a chain hangs, or a conversation without a chain ends.
    probes = found.filter("f > 1").withColumn("d", F.col("f") - 1).join(prefixes.select("conv_id", "d", "p1", "p2"), ["conv_id", "d"])
    met = join_hot(probes, minima.select("d", "p1", "p2", "owner", "n_convs"), ["d", "p1", "p2"], "n_convs", total).select("conv_id", "length", "f", F.col("owner").alias("up"))
    top = F.when(F.col("conv_id") != root, F.lit(root)).cast("long").alias("up")
    found = staged(met.unionByName(found.filter("f = 1").select("conv_id", "length", "f", top)), "found")
    has_chain = (F.col("f") <= F.col("length")) | (F.col("conv_id") == root)
    ends = found.select(F.when(has_chain, F.col("conv_id")).otherwise(F.col("up")).alias("owner"), F.col("length").alias("depth"), "conv_id")
    chains = found.filter(has_chain)
    # Chains: whether the last node is a leaf, what the own nodes save; then with all that hangs below.
    on = chains.filter(F.col("up").isNotNull()).select("conv_id", "up", (F.col("f") - 1).alias("depth"))
    last = on.select(F.col("up").alias("conv_id"), F.col("depth").alias("length")).distinct().withColumn("_goes_on", F.lit(True))
    own = minima.groupBy(F.col("owner").alias("conv_id")).agg(F.sum((F.col("n_convs") - 1) * F.col("n")).alias("saved"))
    chains = chains.join(last, ["conv_id", "length"], "left").join(own, "conv_id", "left")
    leaf = F.when(F.col("_goes_on"), 0).otherwise(1).cast("long").alias("leaves")
    chains = staged(chains.select("conv_id", "length", "f", "up", leaf, F.coalesce("saved", F.lit(0)).alias("saved")), "own-chains")
    hung = on.join(summed_up(chains), "conv_id").groupBy(F.col("up").alias("conv_id"), "depth").agg(F.count("*").alias("_c"), F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
    # Nodes: what hangs on them, and suffix sums along their chains.
    n = lengths.count()
    nodes = minima.select(F.col("owner").alias("conv_id"), F.col("d").alias("depth"), "n_convs", (F.col("n") * (F.col("n_convs") - 1)).alias("saved"))
    zero = chains.filter(F.col("conv_id") == root).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(n).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("saved"))
    facts = chains.select("conv_id", "length", "f", "up", F.col("leaves").alias("_leaf"), (F.col("length") - F.col("f") + 2).alias("_w"))
    nodes = join_hot(nodes.unionByName(zero), facts, ["conv_id"], "_w", minima.count()).join(hung, ["conv_id", "depth"], "left")
    deep = F.col("depth") < F.col("length")
    nodes = nodes.select(
        "conv_id", "depth", "n_convs", F.when(F.col("depth") > 0, F.when(F.col("depth") > F.col("f"), F.col("conv_id")).otherwise(F.coalesce("up", "conv_id"))).alias("parent_conv_id"),
        (deep.cast("long") + F.coalesce("_c", F.lit(0))).alias("n_children"), (F.when(deep, 0).otherwise(F.col("_leaf")) + F.coalesce("_l", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved_tokens"), (F.col("length") - F.col("depth")).alias("_at"),
    )
    nodes = running(staged(nodes, "nodes"), "conv_id", "_at", {"n_leaves": _SUM, "saved_tokens": _SUM})
    marks = listed(staged(ends, "ends"), ["owner", "depth"], "conv_id").withColumnRenamed("owner", "conv_id")
    none = F.lit(hashlib.sha256().hexdigest())
    return nodes.join(marks, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("sha256", none)).select(*COLUMNS)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_tree(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """The nodes of all openings of the conversations, rebuilt first (or as they are)."""
    if rebuild:
        turns, lengths = rebuilt(conversations)
    else:
        turns, sizes = numbered(conversations)
        turns, lengths = turns.withColumnRenamed("r", "d"), sizes.withColumnRenamed("own", "length")
    return tree(turns, staged(lengths, "lengths"))
