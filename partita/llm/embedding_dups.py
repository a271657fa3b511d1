"""Near-duplicate embeddings by spherical-cap filters with structured random product codes.

After a random rotation (fixed seed) a vector's coordinates are cut into parts; each part has a random code, and a filter direction
is one code word of every part side by side. The directions whose inner product with the vector exceeds the cap's height are
list-decoded from the parts' products; several such codes are used, and a vector that none exceeds in one takes its best there. Vectors that share a direction (and a label) are compared by their cosine in double precision.

Equal vectors are compared once, with their number. Filters that hold one vector are left out before vectors travel. A filter with
many vectors is cut into cells of bounded size; each pair of cells is one block product. Blocks give sums of links and, for
components, each vector's smallest partner in the block: never lists of pairs. A pair counts in the first filter that it shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stream_groups, table, written
from .components import connected

THRESHOLD = 0.98
#: Parts that a direction is put together from; independent codes; filters per code that a vector exceeds, on average.
PARTS, CODES, LIST = 2, 12, 1.0
PROBES = 64
#: Vectors of one cell of a filter, on average.
CELL = 512


def code_words(n: int) -> int:
    """Code words of a part, so that each code has 4 filters for each of n vectors (up to 16 million filters)."""
    return int(min(4096, max(16, np.ceil((4 * max(n, 1)) ** (1 / PARTS)))))


class _Code:
    """One rotation with one code per part."""

    def __init__(self, dim: int, words: int, rng: np.random.Generator, size: float):
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.array_split(np.arange(dim), PARTS)
        self.words = []
        for c in self.cuts:
            w = rng.standard_normal((words, len(c)))
            self.words.append(w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12))
        # The cap's height, from random directions alone: on average `size` directions exceed it.
        probe = rng.standard_normal((PROBES, dim))
        want = max(1, int(size * PROBES))
        tops = []
        for a, b in zip(*self.products(probe / np.linalg.norm(probe, axis=1, keepdims=True)), strict=True):
            a, b = np.sort(a)[::-1][:want], np.sort(b)[::-1][:want]
            tops.append(np.sort((a[:, None] + b[None, :]).ravel())[::-1][:want])
        self.height = float(np.sort(np.concatenate(tops))[::-1][want - 1])

    def products(self, x: np.ndarray) -> list[np.ndarray]:
        y = x @ self.rotation
        return [y[:, c] @ w.T for c, w in zip(self.cuts, self.words, strict=True)]


class CapFilters:
    """CODES rotations; the filters of a vector in each are all directions above the cap's height, or its best one where none is."""

    def __init__(self, dim: int, words: int, codes: int = CODES, list_size: float = LIST, seed: int = 20240501):
        rng = np.random.default_rng(seed)
        self.codes = [_Code(dim, words, rng, list_size) for _ in range(codes)]
        self.words = words

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector its filters, ascending. A code word only goes on if it can reach the height with the other part's best."""
        out: list[list[np.ndarray]] = [[] for _ in x]
        for k, code in enumerate(self.codes):
            for v, (a, b) in enumerate(zip(*code.products(x), strict=True)):
                i = np.flatnonzero(a >= code.height - b.max())
                j = np.flatnonzero(b >= code.height - a.max())
                r, c = np.nonzero(a[i][:, None] + b[j][None, :] >= code.height)
                got = i[r] * len(b) + j[c] if len(r) else np.array([a.argmax() * len(b) + b.argmax()])
                out[v].append(np.sort(got).astype(np.int64) + k * self.words**2)
        return [np.concatenate(fs) for fs in out]


@lru_cache(maxsize=4)
def filters(dim: int, words: int) -> CapFilters:
    return CapFilters(dim, words)


def _units(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decoder(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                for at in range(0, len(part), 512):
                    p = part.iloc[at : at + 512]
                    yield pd.DataFrame({"rid": p["rid"], "label": p["label"], "dim": p["dim"], "fs": filters(dim, words).decode(_units(p["v"]))})

    return run


def _roots(near: np.ndarray) -> np.ndarray:
    """Smallest index reachable over a symmetric adjacency with a full diagonal."""
    n = len(near)
    lab = np.arange(n)
    while True:
        new = np.where(near, lab[None, :], n).min(axis=1)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _compare(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One block: cells left and right of one filter (or one cell with itself). Links per vector, and its root in the block."""
    pdf = pdf.sort_values("rid").reset_index(drop=True)
    n = len(pdf)
    x = _units(pdf["v"])
    near = x @ x.T >= threshold
    cell = pdf["cell"].to_numpy()
    if pdf["pi"].iloc[0] != pdf["pj"].iloc[0]:
        near &= cell[:, None] != cell[None, :]
    np.fill_diagonal(near, False)
    if not near.any():
        return pd.DataFrame({"rid": [], "links": [], "root": []}).astype("int64")
    # A pair counts here unless it shares an earlier filter.
    f = pdf["f"].iloc[0]
    rows = np.flatnonzero(near.any(axis=1))
    earlier = [np.asarray(fs)[np.asarray(fs) < f] for fs in pdf["fs"].iloc[rows]]
    names, place = np.unique(np.concatenate([*earlier, np.empty(0, np.int64)]), return_inverse=True)
    first = near[np.ix_(rows, rows)]
    if len(names):
        has = np.zeros((len(rows), len(names)), np.float32)
        has[np.repeat(np.arange(len(rows)), [len(e) for e in earlier]), place] = 1
        has = has[:, has.sum(axis=0) > 1]
        if has.shape[1]:
            first = first & (has @ has.T == 0)
    mult = pdf["mult"].to_numpy()
    links = np.zeros(n, np.int64)
    links[rows] = first @ mult[rows]
    np.fill_diagonal(near, True)
    rid = pdf["rid"].to_numpy()
    out = pd.DataFrame({"rid": rid, "links": links, "root": rid[_roots(near)]})
    return out[(out["links"] > 0) | (out["root"] != out["rid"])]


def near_duplicates(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, cell: int = CELL
) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (smallest id reachable by links), kept.

    Links: cosine of at least threshold, equal labels. A vector that is null, empty, zero or holds null or non-finite components, or whose
    label is null, links with nothing; nor do vectors of different lengths. A row without id links with nothing, has no component and
    is kept. Repeated rows are vectors of their own with a common id. No rows: no rows. Other columns are left out.
    """
    v = F.col(vector)
    fine = F.coalesce(
        F.col(key).isNotNull() & F.col(label).isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) <= 1.7e308, F.lit(False)) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )
    rows = df.select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.size(v).alias("dim"),
        F.xxhash64(v).alias("k1"), F.hash(v).alias("k2"), v.alias("v"), fine.alias("fine"),
    )
    own = ["label", "dim", "k1", "k2"]
    reps = rows.where("fine").groupBy(*own).agg(F.min("vec_id").alias("rid"), F.count(F.lit(1)).alias("mult"), F.min_by("v", "vec_id").alias("v"))
    reps, _ = written(reps, "vectors")
    words = code_words(reps.count())
    lists = reps.select("rid", "label", "dim", "v").mapInPandas(_decoder(words), "rid long, label string, dim int, fs array<long>")
    lists, _ = written(lists, "filters")
    spread = lists.select("rid", "label", "dim", F.explode("fs").alias("f"))
    # Filters of one vector compare nothing; the others get as many cells as their vectors fill.
    full = spread.groupBy("label", "dim", "f").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    full = full.select("label", "dim", "f", F.ceil(F.col("n") / cell).cast("int").alias("cells"))
    member = spread.join(full, ["label", "dim", "f"]).join(lists.select("rid", "fs"), "rid").join(reps.select("rid", "mult", "v"), "rid")
    member = member.withColumn("cell", F.pmod(F.xxhash64("rid"), F.col("cells")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("cells") - 1), lambda j: F.struct(F.least("cell", j).alias("pi"), F.greatest("cell", j).alias("pj"))
    )
    blocks = member.withColumn("p", F.explode(pairs)).select("label", "dim", "f", "p.pi", "p.pj", "rid", "mult", "cell", "fs", "v")
    keys = ["label", "dim", "f", "pi", "pj"]
    found = blocks.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(stream_groups(keys, partial(_compare, threshold=threshold)), "rid long, links long, root long")
    found, _ = written(found, "links")
    parts = connected(found.where("root <> rid").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("rid").agg(F.sum("links").alias("links"))
    known = (
        reps.select(*own, "rid", "mult").join(degree, "rid", "left").join(parts.withColumnRenamed("id", "rid"), "rid", "left")
        .select(*own, (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rid").alias("component_id"), F.lit(True).alias("fine"))
    )
    out = rows.drop("v").join(known, [*own, "fine"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: vec_id, n_links, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CASE WHEN list_bool_and([isfinite(x) AND x IS NOT NULL for x in embedding]) THEN embedding::DOUBLE[] END AS v FROM embeddings
), u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE v IS NOT NULL AND label IS NOT NULL),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) >= 0.98 * a.n * b.n
), r AS (SELECT a AS id, b AS far FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.far = l.a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.m, e.vec_id)) AS kept
FROM e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) d ON d.a = e.vec_id
LEFT JOIN (SELECT id, min(far) AS m FROM r GROUP BY id) c ON c.id = e.vec_id
"""
