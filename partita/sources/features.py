"""Adapters: where decoding and neural models would come in. Features are columns; the extraction function is the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of image files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def extract(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 64) -> DataFrame:
    """fn over batches of at most `rows` rows; a batch for which memory runs out is done again row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), rows):
                part = pdf.iloc[at : at + rows]
                try:
                    yield fn(part)
                except MemoryError:
                    for k in range(len(part)):
                        yield fn(part.iloc[k : k + 1])

    return df.mapInPandas(run, schema)


def mask_cleaned(df: DataFrame, mask: str = "mask", width: str = "width") -> DataFrame:
    """Masks (flat arrays) with their area share, centrality and bounding box."""

    @F.pandas_udf("area double, central double, x0 int, y0 int, x1 int, y1 int")
    def stats(m: pd.Series, w: pd.Series) -> pd.DataFrame:
        out = []
        for flat, cols in zip(m, w, strict=True):
            a = np.asarray(flat, bool).reshape(-1, int(cols))
            y, x = np.nonzero(a)
            if not len(x):
                out.append((0.0, 0.0, 0, 0, 0, 0))
                continue
            h, k = a.shape
            off = np.hypot((x.mean() + 0.5) / k - 0.5, (y.mean() + 0.5) / h - 0.5)
            out.append((a.mean(), max(0.0, 1 - 2 * off), x.min(), y.min(), x.max() + 1, y.max() + 1))
        return pd.DataFrame(out, columns=["area", "central", "x0", "y0", "x1", "y1"])

    return df.withColumn("_s", stats(mask, width)).select(*df.columns, "_s.*")


def template_scores(pairs: DataFrame, a: str = "ra", b: str = "rb", width: int = 8) -> DataFrame:
    """pairs of flat rasters with score, transform, dx, dy, stack: best alignment and sharpness gain there."""

    @F.pandas_udf("score double, transform int, dx int, dy int, stack double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for p, q in zip(x, y, strict=True):
            u, v = (np.asarray(z, np.float64).reshape(-1, width) for z in (p, q))
            m = np.ones(u.shape, bool)
            s, t, dx, dy = kernels.template_match(u, m, v, m)
            out.append((s, t, dx, dy, kernels.stack_gain(u, m, kernels.transforms(v)[t], m, dx, dy)))
        return pd.DataFrame(out, columns=["score", "transform", "dx", "dy", "stack"])

    return pairs.withColumn("_s", run(a, b)).select(*pairs.columns, "_s.*")


def descriptor_matches(pairs: DataFrame, a: str = "da", b: str = "db", floor: float = 0.72) -> DataFrame:
    """pairs of descriptor sets with matches and mean_conf of mutual nearest descriptors."""

    @F.pandas_udf("matches int, mean_conf double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for p, q in zip(x, y, strict=True):
            got = kernels.mutual_matches(np.stack(p) if len(p) else np.empty((0, 1)), np.stack(q) if len(q) else np.empty((0, 1)), floor)
            out.append((len(got), float(np.mean([s for *_, s in got])) if got else 0.0))
        return pd.DataFrame(out, columns=["matches", "mean_conf"])

    return pairs.withColumn("_s", run(a, b)).select(*pairs.columns, "_s.*")
