"""What the training-data operators share: the tables, the shared scratch folder, lineage cuts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting that removes a query's shuffle files when the query ends; a lost one is made anew by its stage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, that all executors see.

    Where the setting is unset, a local session (tests) gets a folder of its own; on a cluster this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        base = tempfile.mkdtemp(prefix="partita-")
        spark.conf.set("spark.checkpoint.dir", base)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/partita-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may have ended first
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside give their shuffle files back when they end. For queries whose result is written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """From now on Arrow batches between Spark and Python hold at most so many rows and about so many bytes, unless the session asks for less.

    A batch is held several times over, by the JVM outside its heap and by each worker.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key).lower())
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet into the shared folder: a lineage cut that survives lost executors.

    The file sizes are then known, so a later join broadcasts it only under
    spark.sql.autoBroadcastJoinThreshold and shuffles it beyond that.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with dropping_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Tables:
    """Tables written for one result. drop() removes a table when its last reader has run; the rest go with the driver's Python."""

    def __init__(self) -> None:
        self.at: dict[int, tuple[SparkSession, str]] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        self.at[id(out)] = (df.sparkSession, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(*self.at.pop(id(t)))


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def stream_groups(keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame]):
    """mapInPandas function over rows sorted by keys: fn gets each group of two rows or more, put together over batch borders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if pdf.empty:
                continue
            k = pdf[keys]
            starts = np.flatnonzero((k != k.shift()).any(axis=1).to_numpy())
            rest = pdf.iloc[starts[-1] :]
            got = [fn(pdf.iloc[s:e]) for s, e in zip(starts[:-1], starts[1:], strict=True) if e - s > 1]
            if got:
                yield pd.concat(got, ignore_index=True)
        if rest is not None and len(rest) > 1:
            yield fn(rest)

    return run


def slices(col: pa.Array, most: int = 1 << 26) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a string column whose bytes together are at most `most`, a longer one by itself."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0))
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of df as one struct, so that columns joined to it can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpacked(columns: list[str], name: str = "row") -> list[Column]:
    return [F.col(f"{name}.`{c}`").alias(c) for c in columns]
