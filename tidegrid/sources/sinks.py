"""Writers: versioned Parquet, CSV, JSON lines and GeoJSON, all by Spark's own sources."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cached(spark: SparkSession, path: str, version: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table under path for this version, made and written if it is not there; older versions stay untouched.

    A maker writes to a folder of its own; what readers follow is a manifest with that folder's name, which is created last, and
    by one maker alone: of several the first to be done counts, and the others give its table and delete their own. So neither
    a write that broke off nor two makers at once are ever read by halves. A manifest whose writer died before it had
    the name in it is replaced.
    """
    at = f"{path.rstrip('/')}/version={version}"
    files = _Files(spark, at)
    if found := files.published():
        return spark.read.parquet(f"{at}/{found}")
    own = f"table-{uuid.uuid4().hex}"
    make().write.parquet(f"{at}/{own}")
    found = files.publish(own)
    if found != own:
        files.delete(own)
    return spark.read.parquet(f"{at}/{found}")


class _Files:
    """The few small files of a versioned table, on whatever file system Spark has for its folder."""

    NAME = "CURRENT"

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def published(self) -> str | None:
        if not self.fs.exists(self.path(self.NAME)):
            return None
        with_end = self.jvm.org.apache.commons.io.IOUtils.toString(stream := self.fs.open(self.path(self.NAME)), "UTF-8")
        stream.close()
        return with_end.strip() if with_end.endswith("\n") else None

    def publish(self, name: str) -> str:
        """The name that is published by now: this one, or that of another maker who was first."""
        for last in (False, True):
            try:
                out = self.fs.create(self.path(self.NAME), False)  # fails if it is there
                out.write(bytearray(f"{name}\n".encode()))
                out.close()
                return name
            except Py4JJavaError:
                for _ in range(20):
                    if found := self.published():
                        return found
                    time.sleep(0.1)
                if not last:
                    self.fs.delete(self.path(self.NAME), False)  # nobody has finished it
        raise OSError(f"{self.folder}: no manifest can be published")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def purge(path: str) -> None:
    """Delete a cache with all its versions; nothing happens if it isn't there."""
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    if files.get_file_info(at).type != fs.FileType.NotFound:
        files.delete_dir(at)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_events(df: DataFrame, path: str, by: str) -> None:
    """Series as Parquet, in a folder for each event; rows are dealt by it first, so each folder has few files."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def features(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One GeoJSON feature a row, as text (``value``)."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def write_geojson_lines(df: DataFrame, path: str, lon: str = "lon", lat: str = "lat") -> None:
    features(df, lon, lat).write.mode("overwrite").text(path)


def write_weights(spark: SparkSession, weights: dict, path: str) -> None:
    """Layers as rows (layer, i, j, w): read back without unpickling anything."""
    rows = [(k, int(i), int(j), float(x)) for k, a in weights.items() for i, row in enumerate(a.reshape(-1, a.shape[-1])) for j, x in enumerate(row)]
    spark.createDataFrame(rows, "layer string, i int, j int, w double").write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str, shapes: dict) -> dict:
    import numpy as np

    out = {k: np.zeros((int(np.prod(s[:-1])), s[-1])) for k, s in shapes.items()}
    for r in spark.read.parquet(path).toLocalIterator():
        out[r.layer][r.i, r.j] = r.w
    return {k: out[k].reshape(s) for k, s in shapes.items()}
