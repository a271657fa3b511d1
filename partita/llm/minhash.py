"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Shingles are five lower-cased words, as 64-bit hashes. A shingle weighs tf * idf with idf = 1 + ln((1+N)/(1+df)) / ln(2+N), which is the
usual smoothed idf with its logarithm scaled to 0..1 at any N: unscaled, what thousands of copies share would weigh a fifth of
what one copy alone has, and large groups of near copies would part. Document frequencies are counted over all documents in
PLACES hashed places, less what other shingles add to a place on average; what is left of that has a standard error of sqrt(T / PLACES) for
T shingles in all, so that frequencies are told apart down to it: with N, ln(N / df) is right up to half of ln N and beyond.
A signature holds BANDS * ROWS consistent weighted samples; two texts of weighted Jaccard similarity s agree in each with probability s.

Texts with equal words are one from the start. In every bucket (band, samples) each text is compared with the bucket's head: the text whose
buckets are largest together (ties: smallest id), as that is nearest to the middle of a group of near copies. That alone
joins a group in linear time. Where a bucket then still holds texts outside its head's component, these are held
against all texts of the bucket, cell by cell: a cell multiplies its texts' shingle weights and returns a link for each two components
that it joins, so neither rows nor links are as many as pairs. Every candidate pair is verified on the whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, stream_groups, table, written
from .components import connected

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 9, 3
#: Places that document frequencies are counted in: what is sent to all tasks, whatever the input.
PLACES = 1 << 18
#: Draws that the samples' random variates are taken from.
POOL = 1 << 16
#: Shingles of the texts that a second-round cell holds on each side.
CELL = 250_000
#: Shingles that a cell multiplies at a time.
STEP = 4096

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_ODD = np.array([(2 * k + 1) * _GOLD % (1 << 64) for k in range(1, 65)], np.uint64)


def _mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def word_hashes(text: Column) -> Column:
    """array<long>: a hash per lower-cased word; null: empty."""
    w = F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES, -1)
    return F.transform(F.filter(w, lambda x: x != ""), lambda x: F.xxhash64(x))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash for each run of `size` words; a shorter text is one shingle, an empty one has none."""
    w = words.view(np.uint64)
    if len(w) == 0:
        return w
    n = max(1, len(w) - size + 1)
    acc = np.zeros(n, np.uint64)
    for j in range(min(size, len(w))):
        acc += _mix(w[j : j + n] + _ODD[j])
        acc *= _M2
    return _mix(acc)


def weighted(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles ascending and their weights."""
    h, tf = np.unique(shingles(words), return_counts=True)
    return h, tf * idf[(h & np.uint64(PLACES - 1)).astype(np.int64)]


@lru_cache(maxsize=1)
def _variates() -> tuple[np.ndarray, ...]:
    """r, 1/r, ln c and beta of the sampling scheme: POOL draws from a fixed seed; (shingle, sample) picks one of them by a hash."""
    rng = np.random.default_rng(20100101)
    r, c = rng.gamma(2.0, 1.0, POOL), rng.gamma(2.0, 1.0, POOL)
    return tuple(x.astype(np.float32) for x in (r, 1 / r, np.log(c), rng.random(POOL)))


def signature(h: np.ndarray, w: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """k consistent weighted samples (Ioffe, 2010) as 64-bit values of (shingle, quantised weight). Shingles ascending; ties go to the first."""
    r, inv, lc, beta = _variates()
    odd = _ODD[16 : 16 + k, None]
    best, pick, quant = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64), np.zeros(k, np.int64)
    for at in range(0, len(h), 4096):
        x, lw = h[at : at + 4096], np.log(w[at : at + 4096]).astype(np.float32)
        i = ((x[None, :] * odd) >> np.uint64(48)).view(np.int64)
        b = beta[i]
        t = np.floor(lw * inv[i] + b)
        ln_a = lc[i] - r[i] * (t - b + np.float32(1))
        j = ln_a.argmin(axis=1)
        low = ln_a[np.arange(k), j]
        new = low < best
        best[new], pick[new], quant[new] = low[new], x[j[new]], t[np.arange(k), j][new].astype(np.int64)
    return pick ^ _mix(quant.astype(np.uint64) + _ODD[:k])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of minima over sum of maxima. Nothing on either side: 0."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    low = np.minimum(wa[i], wb[j]).sum()
    return float(low / (wa.sum() + wb.sum() - low))


def _lists(col: pa.Array) -> Iterator[np.ndarray]:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = col.offsets.to_numpy()
    values = col.values.to_numpy(zero_copy_only=False)
    for s, e in zip(off[:-1], off[1:], strict=True):
        yield values[s:e]


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(PLACES, np.int64), 0
    for rb in batches:
        for words in _lists(rb.column("w")):
            n += 1
            if len(words):
                total[np.unique(shingles(words) & np.uint64(PLACES - 1)).astype(np.int64)] += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": np.append(at, -1), "n": np.append(total[at], n)})


def idf_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """idf per hashed place, from all documents: PLACES numbers, whatever the input."""
    counts = docs.select(word_hashes(F.col(text)).alias("w")).mapInArrow(_count_buckets, "bucket long, n long")
    got = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # PLACES + 1 rows at most
    total = np.zeros(PLACES, np.int64)
    rest = got[got["bucket"] >= 0]
    total[rest["bucket"].to_numpy(np.int64)] = rest["n"].to_numpy(np.int64)
    n = int(got.loc[got["bucket"] < 0, "n"].sum())
    df = np.maximum(total - total.sum() / PLACES, 1)
    return (1 + np.log((1 + n) / (1 + df)) / math.log(n + 2)).astype(np.float32).astype(np.float64)


def _sign(idf) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sig = [signature(*weighted(w, idf.value)).view(np.int64) if len(w) else None for w in _lists(rb.column("w"))]
            size = pa.array([len(w) for w in _lists(rb.column("w"))], pa.int64())
            columns = [rb.column("doc_id"), rb.column("k1"), rb.column("k2"), size, pa.array(sig, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "n_words", "sig"])

    return run


def _verify(idf, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for rb in batches:
            a, b = rb.column("a").to_pylist(), rb.column("b").to_pylist()
            ok = []
            for x, wa, wb in zip(a, _lists(rb.column("wa")), _lists(rb.column("wb")), strict=True):
                if x != last:
                    last, known = x, weighted(wa, idf.value)
                ok.append(similarity(known, weighted(wb, idf.value)) >= threshold)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "ok": pa.array(ok, pa.bool_())})

    return run


def _expanded(words: np.ndarray) -> np.ndarray:
    """The shingles as a set: the k-th occurrence of one is a value of its own, with the place of the shingle in its low bits."""
    h, tf = np.unique(shingles(words), return_counts=True)
    low = h & np.uint64(PLACES - 1)
    if (tf > 1).any():
        nth = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
        h, low = np.repeat(h, tf) + nth.astype(np.uint64) * _ODD[40], np.repeat(low, tf)
        h = np.where(nth > 0, _mix(h), h)
    return (h & ~np.uint64(PLACES - 1)) | low


def overlaps(left: list[np.ndarray], right: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Sums of the weights that each of left has in common with each of right, in single precision."""
    out = np.zeros((len(left), len(right)), np.float32)
    row = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (left, right)]
    value = [np.concatenate(x) for x in (left, right)]
    common = np.intersect1d(*value)
    sides = []
    for r, v in zip(row, value, strict=True):
        at = np.searchsorted(common, v)
        hit = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == v) if len(common) else np.zeros(len(v), bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((r[hit][order], at[hit][order]))
    weight = idf[(common & np.uint64(PLACES - 1)).astype(np.int64)].astype(np.float32)
    for start in range(0, len(common), STEP):
        block = []
        for (r, at), x in zip(sides, (left, right), strict=True):
            s, e = np.searchsorted(at, [start, start + STEP])
            m = np.zeros((len(x), min(STEP, len(common) - start)), np.float32)
            m[r[s:e], at[s:e] - start] = 1
            block.append(m)
        out += (block[0] * weight[start : start + STEP]) @ block[1].T
    return out


def _links_in_cell(idf, threshold: float) -> Callable:
    """Second round: outsiders of one cell (role 0) against the bucket's texts of another (role 1); a link for each two components that meet."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        none = pd.DataFrame({"a": [], "b": []}).astype("int64")
        if left.empty or right.empty:
            return none
        words = [[np.asarray(w, np.int64) for w in x["w"]] for x in (left, right)]
        sets = [[_expanded(w) for w in x] for x in words]
        total = [np.array([idf.value[(v & np.uint64(PLACES - 1)).astype(np.int64)].sum() for v in x]) for x in sets]
        low = overlaps(*sets, idf.value)
        near = low / (total[0][:, None] + total[1][None, :] - low)
        comp = [x["comp"].to_numpy() for x in (left, right)]
        i, j = np.nonzero((near >= threshold - 1e-4) & (comp[0][:, None] != comp[1][None, :]))
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                x = parent[x] = parent[up]
            return x

        rid = [x["rid"].to_numpy() for x in (left, right)]
        out = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(int(comp[0][x])), find(int(comp[1][y]))
            if p != q and similarity(weighted(words[0][x], idf.value), weighted(words[1][y], idf.value)) >= threshold:
                parent[max(p, q)] = min(p, q)
                out.append((min(rid[0][x], rid[1][y]), max(rid[0][x], rid[1][y])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64") if out else none

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, class_id (smallest id of its group of near duplicates), kept (it is that one).

    Null, empty or blank text: similar to nothing. Fewer than five words: one shingle. Very long texts are taken whole; a worker
    needs some 100 bytes a word of the longest. Ties: the smallest id of a group stays. A row without id is similar to nothing,
    has no class and is kept. Rows of one id are one document. No rows: no rows. Other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
    idf = spark.sparkContext.broadcast(idf_table(rows, "t"))
    hashed = rows.select("doc_id", word_hashes(F.col("t")).alias("w")).select("doc_id", "w", F.xxhash64("w").alias("k1"), F.hash("w").cast("long").alias("k2"))
    signed, _ = written(hashed.mapInArrow(_sign(idf), "doc_id long, k1 long, k2 long, n_words long, sig array<long>"), "signatures")
    live = signed.where("doc_id is not null and sig is not null")
    reps, _ = written(live.groupBy("k1", "k2").agg(F.min("doc_id").alias("rid"), F.min_by("sig", "doc_id").alias("sig"), F.max("n_words").alias("n_words")), "texts")
    band = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.struct(i.alias("band"), F.xxhash64(*[F.get(F.col("sig"), i * ROWS + j) for j in range(ROWS)]).alias("h")),
    )
    bands, _ = written(reps.select("rid", F.explode(band).alias("x")).select("x.band", "x.h", "rid"), "bands")
    sizes = bands.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared, _ = written(bands.join(sizes, ["band", "h"]), "shared")
    rank = shared.groupBy("rid").agg(F.sum("n").alias("met"))
    heads = shared.join(rank, "rid").groupBy("band", "h").agg(F.max(F.struct("met", (-F.col("rid")).alias("least"))).alias("head"))
    member, _ = written(shared.join(heads.select("band", "h", (-F.col("head.least")).alias("head")), ["band", "h"]), "members")

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda x: rows.select(F.col("doc_id").alias(x), F.col("t").alias(f"t{x}")).where(F.col(x).isNotNull())
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        both = both.select("a", "b", word_hashes(F.col("ta")).alias("wa"), word_hashes(F.col("tb")).alias("wb"))
        return written(both.mapInArrow(_verify(idf, threshold), "a long, b long, ok boolean"), "verified")[0]

    first = verified(member.where("rid <> head").select(F.least("rid", "head").alias("a"), F.greatest("rid", "head").alias("b")).distinct())
    parts, _ = written(connected(first.where("ok")), "parts")
    labelled = member.join(parts.withColumnRenamed("id", "rid"), "rid", "left").withColumn("comp", F.coalesce("component", "rid")).drop("component")
    heads = labelled.where("rid = head").select("band", "h", F.col("comp").alias("head_comp"))
    labelled = labelled.join(heads, ["band", "h"])
    sized = reps.select("rid", F.greatest(F.col("n_words") - SHINGLE + 1, F.lit(1)).alias("size"))
    sized = labelled.join(sized, "rid")
    away = sized.groupBy("band", "h").agg(F.sum(F.when(F.col("comp") != F.col("head_comp"), F.col("size"))).alias("left"), F.sum("size").alias("right"))
    open_, _ = written(sized.join(away.where("left is not null"), ["band", "h"]), "open")
    if not open_.limit(1).count():
        whole = parts
    else:
        cells = lambda n: F.ceil(F.col(n) / CELL).cast("int")
        spot = lambda n: F.pmod(F.xxhash64("rid"), cells(n)).cast("int")
        lefts = open_.where("comp <> head_comp").withColumn("ci", spot("left")).withColumn("cj", F.explode(F.sequence(F.lit(0), cells("right") - 1)))
        rights = open_.withColumn("cj", spot("right")).withColumn("ci", F.explode(F.sequence(F.lit(0), cells("left") - 1)))
        keys = ["band", "h", "ci", "cj"]
        facing = lefts.select(*keys, "rid", "comp", F.lit(0).alias("role")).unionByName(rights.select(*keys, "rid", "comp", F.lit(1).alias("role")))
        texts = rows.join(open_.select(F.col("rid").alias("doc_id")).distinct(), "doc_id").dropDuplicates(["doc_id"])
        vectors, _ = written(texts.select(F.col("doc_id").alias("rid"), word_hashes(F.col("t")).alias("w")), "vectors")
        dealt = facing.join(vectors, "rid").repartition(*keys).sortWithinPartitions(*keys)
        second, _ = written(dealt.mapInPandas(stream_groups(keys, _links_in_cell(idf, threshold)), "a long, b long").distinct(), "second")
        whole = connected(first.where("ok").select("a", "b").unionByName(second))
    classes = reps.select("k1", "k2", "rid").join(whole.withColumnRenamed("id", "rid"), "rid", "left")
    classes = classes.select("k1", "k2", F.coalesce("component", "rid").alias("class_id"), F.lit(True).alias("live"))
    out = signed.select("doc_id", "k1", "k2", (F.col("doc_id").isNotNull() & F.col("sig").isNotNull()).alias("live"))
    out = out.join(classes, ["k1", "k2", "live"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, kept of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
