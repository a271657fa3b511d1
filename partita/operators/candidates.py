"""Candidate pairs: blocked similarity joins, nearest neighbours, votes, budgets.

Similarity joins are exact. Items are cut into cells of bounded size; a task holds two cells of one group and multiplies
them, and gives each item's best `k` of the cell only, so no task and no result holds all pairs of a group.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from decimal import ROUND_HALF_UP, Decimal
from hashlib import md5
from heapq import nsmallest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 1024


def _best_of_cells(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each left item's k most similar right items, itself excluded by id; ties by id."""
    empty = pd.DataFrame({"a": [], "b": [], "sim": []}).astype({"a": "int64", "b": "int64", "sim": "float64"})
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].sort_values("id")
    if left.empty or right.empty:
        return empty
    sim = np.stack(left["v"].to_numpy()).astype(np.float64) @ np.stack(right["v"].to_numpy()).astype(np.float64).T
    ids, own = right["id"].to_numpy(), left["id"].to_numpy()
    sim[own[:, None] == ids[None, :]] = -np.inf
    top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
    best = np.take_along_axis(sim, top, axis=1)
    a = np.repeat(own, top.shape[1])
    out = pd.DataFrame({"a": a, "b": ids[top].ravel(), "sim": best.ravel()})
    return out[np.isfinite(out["sim"])]


def top_k(queries: DataFrame, gallery: DataFrame, k: int, group: str = "species", key: str = "image_id", vector: str = "v", cell: int = CELL) -> DataFrame:
    """(group, a, b, sim, rank): for each query a the k most similar gallery items b of its group, b <> a; ties by b.

    Vectors are unit vectors. The number of cells follows from the group sizes, which are counted first.
    """
    sizes = gallery.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("nr"))
    qsizes = queries.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("nq"))
    cells = sizes.join(qsizes, group)
    base = lambda df: df.select(group, F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).join(cells, group)
    left = base(queries).withColumn("ci", F.pmod(F.xxhash64("id"), "nq")).withColumn("cj", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)))
    right = base(gallery).withColumn("cj", F.pmod(F.xxhash64("id"), "nr").cast("int")).withColumn("ci", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    cols = [group, F.col("ci").cast("int").alias("ci"), "cj", "id", "v"]
    both = left.select(*cols, F.lit(0).alias("side")).unionByName(right.select(*cols, F.lit(1).alias("side")))
    schema = both.select(group).schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _best_of_cells(pdf, k).assign(**{group: pdf[group].iloc[0]})[[group, "a", "b", "sim"]]

    near = both.groupBy(group, "ci", "cj").applyInPandas(run, f"{schema}, a long, b long, sim double")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def mutual(neighbours: DataFrame) -> DataFrame:
    """Edges a < b that are in each other's lists, with their similarity."""
    back = neighbours.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return neighbours.where("a < b").join(back, ["a", "b"], "left_semi").select("a", "b", "sim")


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def best_pairs(pairs: DataFrame, score: str = "sim") -> DataFrame:
    """The best score of each unordered pair."""
    a, b = pair_key(F.col("a"), F.col("b"))
    return pairs.groupBy(a.alias("a"), b.alias("b")).agg(F.max(score).alias(score))


def across(neighbours: DataFrame, labels: DataFrame, k: int, same: bool = False, label: str = "cluster", key: str = "image_id") -> DataFrame:
    """Of each item's neighbours (given up to a first rank limit) the first k whose label differs (or, same=True, is equal), as distinct pairs."""
    la = labels.select(F.col(key).alias("a"), F.col(label).alias("la"))
    lb = labels.select(F.col(key).alias("b"), F.col(label).alias("lb"))
    kept = neighbours.join(la, "a").join(lb, "b").where(F.col("la") == F.col("lb") if same else F.col("la") != F.col("lb"))
    kept = kept.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("rank"))).where(F.col("r") <= k)
    return best_pairs(kept)


def within_pairs(labels: DataFrame, label: str = "cluster", key: str = "image_id") -> DataFrame:
    """All pairs a < b of equal label, as the operator's result is; its size is that of the clusters squared."""
    a = labels.select(F.col(label).alias("l"), F.col(key).alias("a"))
    return a.join(labels.select(F.col(label).alias("l"), F.col(key).alias("b")), "l").where("a < b").select("a", "b", F.col("l").alias(label))


def all_pairs(items: DataFrame, group: str = "species", key: str = "image_id") -> DataFrame:
    """(a, b, group): every pair a < b of a group, as the operator's result is. For groups that are meant to be compared in full; top_k is the way for others."""
    return within_pairs(items, group, key)


def margin_assign(neighbours: DataFrame, identities: DataFrame, key: str = "image_id", identity: str = "identity") -> DataFrame:
    """Per query the identity of its nearest gallery image, its similarity, and the margin over the second image."""
    named = neighbours.join(identities.select(F.col(key).alias("b"), F.col(identity).alias("identity")), "b")
    top = named.groupBy("a").agg(
        F.max(F.when(F.col("rank") == 1, F.col("identity"))).alias("identity"),
        F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("top1"),
        F.max(F.when(F.col("rank") == 2, F.col("sim"))).alias("top2"),
    )
    return top.select(F.col("a").alias(key), "identity", "top1", (F.col("top1") - F.coalesce("top2", F.lit(-1.0))).alias("margin"))


def neighbour_ranks(pairs: DataFrame, score: str = "sim") -> DataFrame:
    """(a, b, score, rank_ab, rank_ba): each pair's rank among the pairs of either end; ties by the other id."""
    both = pairs.select("a", "b", score).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), score))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc(score), "b")))
    there = ranked.where("a < b").withColumnRenamed("rank", "rank_ab")
    back = ranked.where("a > b").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("rank").alias("rank_ba"))
    return there.join(back, ["a", "b"])


def pair_votes(partitions: DataFrame, cap: int, current: str | None = None, source: str = "source", key: str = "image_id", label: str = "cluster") -> DataFrame:
    """How many alternate partitions put a pair together. Groups of one, or of more than cap, vote for nothing; `current` does not vote."""
    rows = partitions.where(F.col(source) != current) if current else partitions
    small = rows.groupBy(source, label).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") <= cap))
    rows = rows.join(small, [source, label], "left_semi")
    a = rows.select(source, label, F.col(key).alias("a"))
    b = rows.select(source, label, F.col(key).alias("b"))
    return a.join(b, [source, label]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"))


def budget(pairs: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n pairs by an explicit order, ids last: a top-k, not a sort of all."""
    return pairs.orderBy(*order, "a", "b").limit(n)


def near_threshold(pairs: DataFrame, thr: float, floor: float, n: int, score: str = "sim") -> DataFrame:
    """Pairs not under thr - floor that are nearest to thr."""
    return budget(pairs.where(F.col(score) >= thr - floor), n, F.abs(F.col(score) - thr))


def query_expansion(features: DataFrame, neighbours: DataFrame, k: int, alpha: float = 0.5, key: str = "image_id", vector: str = "v") -> DataFrame:
    """v + alpha * mean of the k nearest, itself the first of them, of length 1. Means are taken by position, not by collecting vectors."""
    take = neighbours.where(F.col("rank") < k).select("a", "b").unionByName(features.select(F.col(key).alias("a"), F.col(key).alias("b")))
    v = features.select(F.col(key).alias("b"), F.col(vector).alias("v"))
    spread = take.join(v, "b").select("a", F.posexplode("v").alias("pos", "x"))
    mean = spread.groupBy("a", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = mean.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    from ..functions.vectors import blend

    return features.join(mean, F.col(key) == F.col("a")).select(key, blend(F.col(vector), F.col("mean"), 1.0, alpha).alias(vector))


def sampled_pairs(pairs: DataFrame, n: int, seed: int, by: str | None = None) -> DataFrame:
    """n pairs (of each value of `by`) in the order of md5(seed|a|b): a sample that any engine can repeat."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("a").cast("string"), F.col("b").cast("string")))
    if by is None:
        return pairs.withColumn("draw", draw).orderBy("draw").limit(n).drop("draw")
    w = Window.partitionBy(by).orderBy("draw")
    return pairs.withColumn("draw", draw).withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("draw", "r")


def _first_drawn(left: list[int], right: list[int], one: bool, n: int, seed: int) -> list[tuple[bytes, int, int]]:
    """(md5, i, j) of the n pairs of left and right ids with the smallest md5(seed|a|b), a < b; right is sorted, and is left itself if `one`."""
    text, best, most = [b"%d" % y for y in right], [], b"\xff" * 17
    for i, x in enumerate(left):
        above = bisect_right(right, x)
        head = b"%d|%d|" % (seed, x)
        got = [(h, i, j) for j, y in enumerate(text[above:], above) if (h := md5(head + y).digest()) < most]
        if not one:
            head, tail = b"%d|" % seed, b"|%d" % x
            got += [(h, i, j) for j, y in enumerate(text[: bisect_left(right, x)]) if (h := md5(head + y + tail).digest()) < most]
        if got:
            best = nsmallest(n, best + got)
            most = best[-1][0] if len(best) == n else most
    return best


def _least_similar(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, pair: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(i, j) of the n pairs of least product by 9 digits, then a, b. Products are summed in order, as Spark and SQL do; a missing one is last."""
    sim = np.where(pair, np.nan_to_num(x @ y.T, nan=np.inf), np.nan)
    bound = np.partition(sim[pair], n - 1)[n - 1] + 1e-8 if pair.sum() > n else np.inf
    i, j = np.nonzero(pair & (sim <= bound))
    exact = np.zeros(len(i))
    for d in range(x.shape[1]):
        exact = exact + x[i, d] * y[j, d]
    value, place = np.unique(exact, return_inverse=True)
    cut = [float(Decimal(repr(v)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) if np.isfinite(v) else np.inf for v in value.tolist()]
    order = np.lexsort((b[i, j], a[i, j], np.array(cut)[place]))[:n]
    return list(zip(i[order].tolist(), j[order].tolist(), strict=True))


def first_within(labels: DataFrame, n: int, seed: int, label: str, key: str = "image_id", vector: str | None = None, hard: int = 0, whole: int = 0, cell: int = CELL) -> DataFrame:
    """(label, a, b, pairs): of each two cells of a label's items the n pairs a < b of the smallest md5(seed|a|b), and the `hard` least similar ones.

    All pairs of a label are drawn from, none is shuffled: a task holds two cells of at most about `cell` items. Cells of up to `whole` pairs give
    all. A row without ids gives how many pairs two cells have, as `pairs`. Null labels and ids have no pairs.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(label).alias("l"), F.col(key).cast("long").alias("id"), *([F.col(vector).alias("v")] if vector else []))
    sizes = known.groupBy("l").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("nc"))
    dealt = known.join(sizes, "l").withColumn("c", F.pmod(F.xxhash64("id"), "nc").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)))
    dealt = dealt.withColumn("ci", F.least("c", "o")).withColumn("cj", F.greatest("c", "o")).drop("nc", "o")
    kind = dealt.schema["l"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        one = bool(pdf["ci"].iloc[0] == pdf["cj"].iloc[0])
        left, right = (pdf, pdf) if one else (pdf[pdf["c"] == pdf["ci"]], pdf[pdf["c"] == pdf["cj"]])
        x, y = left["id"].to_numpy(), right["id"].to_numpy()
        pair = x[:, None] < y[None, :] if one else x[:, None] != y[None, :]
        count = int(pair.sum())
        if count <= max(whole, n):
            chosen = set(zip(*[p.tolist() for p in np.nonzero(pair)], strict=True))
        else:
            chosen = {(i, j) for _, i, j in _first_drawn(x.tolist(), y.tolist(), one, n, seed)}
            if hard:
                none = np.full(max((len(v) for v in pdf["v"] if v is not None), default=1), np.nan)
                vx, vy = (np.stack([none if v is None else np.asarray(v, np.float64) for v in side["v"]]) for side in (left, right))
                chosen |= set(_least_similar(vx, vy, np.minimum(x[:, None], y[None, :]), np.maximum(x[:, None], y[None, :]), pair, hard))
        met = sorted((int(min(x[i], y[j])), int(max(x[i], y[j]))) for i, j in chosen)
        rows = [(a, b, None) for a, b in met] + [(None, None, count)]
        return pd.DataFrame(rows, columns=["a", "b", "pairs"], dtype="object").assign(l=pdf["l"].iloc[0])[["l", "a", "b", "pairs"]]

    # A cell's rows are few and its pairs many, so partitions are not to be merged by their bytes.
    dealt = dealt.repartition(int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")), "l", "ci", "cj")
    return dealt.groupBy("l", "ci", "cj").applyInPandas(run, f"l {kind}, a long, b long, pairs long").withColumnRenamed("l", label)


def sampled_within(labels: DataFrame, n: int, seed: int, label: str, key: str = "image_id") -> DataFrame:
    """(label, a, b): the n pairs of each label that sampled_pairs() takes of within_pairs(), without a row for every pair."""
    return sampled_pairs(first_within(labels, n, seed, label, key).where("a is not null").drop("pairs"), n, seed, label)


def drawn_negatives(items: DataFrame, n: int, seed: int, identity: str = "identity", key: str = "image_id", spare: int = 2) -> DataFrame:
    """(a, b): up to n pairs of different identity, drawn by hash without pairing all items.

    Each item draws partners by number, spare * n in all; of the distinct pairs the n of the smallest md5(seed|a|b) stay.
    """
    from .order import numbered

    no = numbered(items.select(key, identity), key, "no")
    size = no.agg(F.count(F.lit(1)).alias("size"))
    each = F.sequence(F.lit(0), F.ceil(F.lit(spare * n) / F.col("size")).cast("int"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("r").cast("string"))), 1, 12), 16, 10).cast("long")
    drawn = no.crossJoin(F.broadcast(size)).withColumn("r", F.explode(each)).select(F.col(key).alias("x"), F.col(identity).alias("ix"), (draw % F.col("size")).alias("no"))
    met = drawn.join(no.select("no", F.col(key).alias("y"), F.col(identity).alias("iy")), "no").where("ix <> iy")
    return sampled_pairs(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), n, seed)


def training_pairs(
    items: DataFrame, neighbours: DataFrame, limit: int, seed: int = 7, many: int = 50, hard: int = 20, rand: int = 30, per_item: int = 10, most_random: int = 5000,
    identity: str = "identity", key: str = "image_id", vector: str = "v",
) -> DataFrame:
    """(a, b, label): at most limit pairs, half of them positives where there are enough.

    Positives: all pairs of an identity; where it has more than `many`, its `hard` least similar ones and `rand` others by hash. Negatives: each
    item's first per_item neighbours of other identity, and pairs drawn by hash until there are min(limit / 2, most_random). Both are cut in
    the order of md5(seed|a|b).
    """
    from ..functions.vectors import dot
    from .components import cut

    named = items.where(F.col(identity).isNotNull())
    v = lambda s: named.select(F.col(key).alias(s), F.col(vector).alias(f"v{s}"))
    drawn = cut(first_within(named, rand, seed, identity, key, vector, hard, many))
    size = drawn.where("a is null").groupBy(identity).agg(F.sum("pairs").alias("n"))
    pos = drawn.where("a is not null").drop("pairs").join(v("a"), "a").join(v("b"), "b").withColumn("sim", F.round(dot(F.col("va"), F.col("vb")), 9)).drop("va", "vb")
    w = Window.partitionBy(identity)
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("a").cast("string"), F.col("b").cast("string")))
    pos = pos.join(size, identity).withColumn("easy", F.row_number().over(w.orderBy(F.asc_nulls_last("sim"), "a", "b"))).withColumn("r", F.row_number().over(w.orderBy(draw)))
    pos = pos.where((F.col("n") <= many) | (F.col("easy") <= hard) | (F.col("r") <= rand)).select("a", "b")
    near = cut(across(neighbours, named, per_item, label=identity, key=key).select("a", "b"))
    need = min(limit // 2, most_random)
    extra = drawn_negatives(named, need, seed, identity, key).join(near, ["a", "b"], "left_anti")
    lacking = F.greatest(F.lit(need) - F.col("have"), F.lit(0))
    extra = extra.withColumn("r", F.row_number().over(Window.orderBy(draw))).crossJoin(near.agg(F.count(F.lit(1)).alias("have"))).where(F.col("r") <= lacking).select("a", "b")
    half = limit // 2
    pos = sampled_pairs(pos, half, seed).select("a", "b", F.lit(1).alias("label"))
    neg = sampled_pairs(near.unionByName(extra), limit, seed).select("a", "b", F.lit(0).alias("label"))
    return budget(pos.unionByName(neg), limit, F.desc("label"), draw)


def chamfer(a: DataFrame, b: DataFrame, best: int = 80, scale: float = 0.055) -> DataFrame:
    """Point sets of pairs (pair, x, y): exp(-mean of the `best` nearest distances, both ways, / scale)."""
    d = lambda p, q: F.sqrt(F.pow(F.col(f"{p}.x") - F.col(f"{q}.x"), 2) + F.pow(F.col(f"{p}.y") - F.col(f"{q}.y"), 2))

    def one_way(p: DataFrame, q: DataFrame) -> DataFrame:
        near = p.alias("p").join(q.alias("q"), F.col("p.pair") == F.col("q.pair")).groupBy("p.pair", "p.x", "p.y", "p.point").agg(F.min(d("p", "q")).alias("d"))
        r = F.row_number().over(Window.partitionBy("pair").orderBy("d", "point"))
        return near.withColumn("r", r).where(F.col("r") <= best).groupBy("pair").agg(F.avg("d").alias("m"))

    there, back = one_way(a, b), one_way(b, a)
    return there.join(back.withColumnRenamed("m", "m2"), "pair").select("pair", F.exp(-((F.col("m") + F.col("m2")) / 2) / scale).alias("score"))


def patch_similarity(pairs: DataFrame, a: str = "pa", b: str = "pb", m: int = 16) -> DataFrame:
    """pairs with patch: mean of the m largest row maxima and of the m largest column maxima of the patch products."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            s = np.stack(p).astype(np.float64) @ np.stack(q).astype(np.float64).T
            rows, cols = (np.sort(s.max(axis=i))[::-1][:m].mean() for i in (1, 0))
            out.append((rows + cols) / 2)
        return pd.Series(out)

    return pairs.withColumn("patch", score(F.col(a), F.col(b)))
