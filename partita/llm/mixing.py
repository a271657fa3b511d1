"""Mixing sources to target weights by entropy balancing.

Each source gets a token target (weights, capped at ``most`` times its size by water filling). Within a source the document
rates nearest to 1 in relative entropy that meet the target are r = min(most, exp(lam * size / scale)), with one dual variable lam per
source. Newton iterations on the convex dual find all lam at once; each is one aggregation over the histogram of (source, size),
as the rate depends on these alone, and lam stays a distributed table.

Rates are rounded to six places, so the order in which a rerun adds its sums does not show. They become copies by error diffusion over a source's sizes, largest first, so a source misses its target by about half
of its smallest document at most. Within a (source, size) the documents with the smallest hashes get the additional copy.
They are ranked in parts of bounded length, so a size that a third of all documents share is not ranked by one task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, packed, table, unpacked, written

MOST = 3.0
#: Rows of one (source, size) that one task ranks at most, on average.
PART = 2_000


def words(text: str = "text"):
    """Number of words; null: 0. Counts the places where a word starts, without making an array of them."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(hist: DataFrame, weights=(1, 2, 3), most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, size, n). The k-th source by code point (null last) weighs weights[k % len].

    The share of the total is capped at most times the source's size; the excess goes to the others by weight until none is above its cap:
    with sources in order of cap per weight, the first k are at their caps for the smallest k whose level suits the next.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    sources = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = sources.withColumn("k", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    sources = sources.withColumn("w", F.get(w, (F.col("k") % len(weights)).cast("int"))).withColumn("cap", most * F.col("source_size"))
    up = Window.orderBy(F.col("cap") / F.col("w"), "k")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    fits = sources.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    final = F.first(F.when(F.col("fits"), F.col("level")), True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    fits = fits.withColumn("final", final)
    return fits.select(
        "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("w"), F.col("cap"))).alias("target")
    )


def dual(hist: DataFrame, goal: DataFrame, most: float = MOST, rounds: int = 60, tol: float = 1e-6) -> DataFrame:
    """(source, lam, scale) with sum(size * min(most, exp(lam * size / scale))) = target, by Newton iterations kept within a bracket.

    A source at most times its size has lam = inf (rate ``most`` for all); one with target 0 has lam = -inf.
    Stops with an error if a source's words are not within tol of its target after ``rounds`` rounds.
    """
    scale = hist.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("size") * F.col("n")) / F.greatest(F.sum(F.col("size") * F.col("n")), F.lit(1))).alias("scale")
    )
    state = goal.join(scale, goal["source"].eqNullSafe(scale["source"])).select(
        goal["source"], "source_size", "target", F.greatest("scale", F.lit(1.0)).alias("scale")
    )
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = state.withColumn("lam", F.when(F.col("source_size") == 0, 0.0).when(full, math.inf).when(F.col("target") <= 0, -math.inf).otherwise(0.0))
    state = cut(state.withColumn("lo", F.lit(-1e6)).withColumn("hi", F.col("scale") * math.log(most) + 1.0).withColumn("off", F.lit(1.0)))
    cells = hist.where("size > 0").select(F.col("source").alias("s"), "size", "n")
    for _ in range(rounds):
        x = F.col("size") / F.col("scale")
        raw = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        rate = F.least(F.lit(most), raw)
        slope = F.when(raw < most, F.col("n") * F.col("size") * x * raw).otherwise(0.0)
        sums = cells.join(state.select(F.col("source").alias("t"), "lam", "scale"), F.col("s").eqNullSafe(F.col("t"))).groupBy("s").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("taken"), F.sum(slope).alias("slope")
        )
        miss = F.coalesce(F.col("taken"), F.lit(0.0)) - F.col("target")
        open_ = ~F.col("lam").isin(math.inf, -math.inf) & (F.col("source_size") > 0)
        lo, hi = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo")), F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - miss / F.col("slope")
        inside = (F.col("slope") > 0) & (step > lo) & (step < hi)
        state = cut(
            state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "scale",
                F.when(open_ & (miss != 0), F.when(inside, step).otherwise((lo + hi) / 2)).otherwise(F.col("lam")).alias("lam"),
                lo.alias("lo"), hi.alias("hi"),
                F.when(open_, F.abs(miss) / F.col("target")).otherwise(0.0).alias("off"),
            )
        )
        if (state.agg(F.max("off")).first()[0] or 0.0) < tol:
            return state.select("source", "source_size", "target", "lam", "scale")
    raise RuntimeError(f"the rates have not settled after {rounds} rounds")


def _diffuse(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies for each size of one source, largest first; what a size misses goes to the next. Only distinct sizes: bounded by the longest text."""
    pdf = pdf.sort_values("size", ascending=False)
    carry, out = 0.0, []
    for size, n, rate, most in pdf[["size", "n", "rate", "most"]].itertuples(index=False):
        carry += size * n * rate
        copies = min(int(math.floor(carry / size + 0.5)), int(n * most)) if size else 0
        copies = max(copies, 0)
        carry -= copies * size
        out.append(copies)
    return pdf[["source", "size", "n"]].assign(copies=out)


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights=(1, 2, 3), most: float = MOST) -> DataFrame:
    """Per document: _key, _source, h (hash of key and text), size, source_size, target, copies.

    Null text: size 0, never taken. Null source: a source of its own, last in order. Repeated rows and repeated keys count as
    documents of their own; equal rows are interchangeable, and ties of size go by the hash. Very long texts count whole. No rows: no
    rows. Other columns are left out, whatever their names.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), words(text).alias("size"), F.xxhash64(F.col(key), F.col(text)).alias("h"))
    rows, _ = written(rows, "sizes")
    hist = cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    state = dual(hist, cut(targets(hist, weights, most)), most)
    rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0))))
    cells = hist.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "size", "n", F.when(F.col("size") > 0, F.round(rate, 6)).otherwise(0.0).alias("rate"), F.lit(float(most)).alias("most"), "source_size", "target"
    )
    copies = cells.groupBy("source").applyInPandas(_diffuse, "source string, size long, n long, copies long")
    plan = cut(
        copies.alias("c").join(state.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select(
            F.col("c.source").alias("s"), F.col("c.size").alias("z"), "n", "copies", "source_size", "target"
        )
    )
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).withColumn(
        "part", F.pmod(F.shiftright("h", 20), F.floor(F.col("n") / PART) + 1)
    )
    # Rank by (part, hash, key) within (source, size): the parts' lengths first, then the rank within a part.
    lengths = placed.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("len"))
    ahead = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.select(
        F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("part").alias("p2"), F.coalesce(F.sum("len").over(ahead), F.lit(0)).alias("from")
    )
    ranked = placed.withColumn("i", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "_key")))
    ranked = ranked.join(lengths, F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")) & (F.col("part") == F.col("p2")))
    spare = F.col("from") + F.col("i") <= F.col("copies") % F.col("n")
    return ranked.select(
        "_key", F.col("source").alias("_source"), "h", "size", "source_size", "target",
        (F.floor(F.col("copies") / F.col("n")) + F.when(spare, 1).otherwise(0)).alias("copies"),
    )


def take(docs: DataFrame, mixed: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The mix itself: each row of docs as often as mix() says. Rows equal in key, text and source share what the mix takes of them."""
    per = mixed.groupBy("_key", "_source", "h").agg(F.sum("copies").alias("every"), F.count(F.lit(1)).alias("rows")).where("every > 0")
    rows = docs.select(packed(docs), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("hash"))
    k, s = F.col(f"row.`{key}`"), F.col(f"row.`{source}`")
    rows = rows.join(per, (F.col("hash") == F.col("h")) & k.eqNullSafe(F.col("_key")) & s.eqNullSafe(F.col("_source")))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("hash", "_key", "_source").orderBy("hash")))
    times = F.floor(F.col("every") / F.col("rows")) + F.when(F.col("i") <= F.col("every") % F.col("rows"), 1).otherwise(0)
    rows = rows.withColumn("times", times.cast("int")).where("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select(*unpacked(docs.columns))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, size, source_size, target, taken (+ copies)."""
    got = mix(table(spark, sf_dir, "documents"))
    return got.select(F.col("_key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
