"""What the text operators share: byte-level word rules, staged tables, bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z, keeps digits, letters and every non-ASCII byte, turns the rest into blanks.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

#: The most frequent function words of the languages of the corpus.
FUNCTION_WORDS = frozenset(
    b"the of and to in a is that it for on was be with as by this are at from de la le les des et un une en que qui est pour "
    b"der die das und den von zu mit sich ein eine nicht ist el los las y por con una para al".split()
)


def plain_words(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes after lower-casing A-Z."""
    return raw.translate(WORD_TABLE).split() if raw else []


def blank_words(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes; ``bytes.split`` parts at just these bytes."""
    return raw.split() if raw else []


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key written as text, modulo the number of folds (null key: null)."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(folds)


def raw_text(text: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty: Python workers then get bytes without decoding."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def bound_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Hand texts to Python workers by so many rows at most: what a worker and its buffers hold is bounded by the rows, whose
    texts may be long. Sets the session's Arrow batches (``build_session`` does so from the start); a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """k1 and k2: 96 bits of hashes of id and text that name a row. They are never null, and only equal rows share them."""
    return F.xxhash64(id_col, text_col).alias("k1"), F.hash(text_col, id_col).alias("k2")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set (tests, all in one process), one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark.sparkContext, "_tidegrid_dir", None) or tempfile.mkdtemp(prefix="tidegrid-")
        spark.sparkContext._tidegrid_dir = found
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidegrid-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    This cuts the lineage and keeps what several later steps read from being computed twice; the files
    outlive any executor. They stay until a ``scratch`` that they were written in ends, or the folder is cleared.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[], None]]:
    """Within it, the function that it gives deletes all tables staged so far but the last one, whose maker has ended by then."""
    paths: list[str] = []
    token = _SCRATCH.set(paths)

    def clear() -> None:
        for at in paths[:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del paths[:-1]

    try:
        yield clear
    finally:
        _SCRATCH.reset(token)


def bounded_sample(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The rows whose keys' hash is under a bound: about ``most`` of them if every key has one row; all if there are no more.

    The keys' values alone decide, so any layout, order or second try of a task chooses the same rows. Rows with equal keys are
    chosen or left out together: callers keep one row of each key, which bounds what they gather.
    """
    total = rows.count()
    if total <= most:
        return rows
    share = int(most / total * (1 << 32))
    return rows.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 32)) < share)


def labelled(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, _y and _raw of the rows of docs that ``known`` (doc_id, _y; a bounded number) labels, repeated ids too."""
    return docs.select("doc_id", raw_text(text).alias("_raw")).join(F.broadcast(known), "doc_id").select("doc_id", "_y", "_raw")


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, total: int, least: int = 1_000, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with ``facts``, one row for each key, of which ``weight`` says how many of the ``total`` rows have it.

    Fewer than 1,000 keys have over a thousandth of the rows: their facts are broadcast, and their rows don't meet in one task;
    the others are an ordinary join. ``weight`` isn't in the result.
    """
    bound = max(least, total // 1000)
    hot, cold = facts.filter(F.col(weight) > bound).drop(weight), facts.filter(F.col(weight) <= bound).drop(weight)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys, how))


def join_salted(rows: DataFrame, facts: DataFrame, key: str, spread: str, counted: DataFrame, most: int = 1_000) -> DataFrame:
    """rows joined with ``facts``, one row for each key, where facts may be too large to broadcast: of a key with over ``most`` rows these
    are dealt by a hash of ``spread``, and its facts are copied to as many places, so that about ``most`` meet in one.

    Fewer than a ``most``-th of the rows are keys of that kind; which they are is known from ``counted``, which has a row with the key
    for each of rows, by a count that is combined before the shuffle.
    """
    salt, places = free_name(rows, "_salt"), free_name(rows, "_places")
    hot = counted.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias(places)).filter(F.col(places) > 1)
    hot = small(staged(hot, "hot-keys"))
    dealt = rows.join(hot, key, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(spread), F.col(places)).cast("int"), F.lit(0)))
    copied = facts.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(places) - 1, F.lit(0)))))
    return dealt.drop(places).join(copied.drop(places), [key, salt]).drop(salt)


#: Rows up to which a table is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if it has at most ``most`` rows; else Spark joins it by a shuffle, splitting skewed keys."""
    return F.broadcast(df) if df.count() <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
