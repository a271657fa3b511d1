"""Records of candidate pairs: similarities of views, matches of views, the best of each, and the features of a calibrator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import canonical_orientation, orientation_relation
from ..functions.vectors import dot

#: View combinations of each form, in the order that settles ties: name, view of a, view of b.
COMBINATIONS = {
    "flank": (("orig", "orig", "orig"),),
    "views": (("orig", "orig", "orig"), ("norm", "norm", "norm")),
    "mirrored": (("orig_orig", "orig", "orig"), ("hflip_hflip", "hflip", "hflip"), ("orig_hflip", "orig", "hflip"), ("hflip_orig", "hflip", "orig")),
}
_NO_MATCH = {"local_score": 0.0, "matches": 0, "inliers": 0, "mean_conf": 0.0}
RELATIONS = ("same_flank", "opposite_flank", "same_axial", "mixed", "unknown")


def first_best(candidates: list[Column], *order: str) -> Column:
    """Of structs the one that is largest in the named fields; of equal ones the first listed."""
    keyed = [F.struct(*[c[o].alias(f"k{n}") for n, o in enumerate(order)], F.lit(-i).alias("place"), c.alias("it")) for i, c in enumerate(candidates)]
    return F.array_max(F.array(*keyed))["it"]


def pair_records(pairs: DataFrame, items: DataFrame, matches: DataFrame, kind: str, key: str = "image_id") -> DataFrame:
    """pairs (a, b and what else they have) with the record of one form.

    items: image_id, orientation, one vector column per view, and lum_mean for 'flank'. matches: a, b, view (name of the combination), local_score,
    matches, inliers, mean_conf; what a pair lacks counts as no match. Columns: sim_<name> and local_<name> of each combination, sim_best,
    sim_best01, sim_best_view, local_best, local_best_view, matches, inliers, mean_conf, orientation_a, orientation_b; 'flank' adds lum_gap and
    relation; 'mirrored' adds sim_cross and local_cross, the better of its two crossed combinations.
    """
    names = COMBINATIONS[kind]
    views = sorted({v for _, x, y in names for v in (x, y)})
    extra = ["lum_mean"] if kind == "flank" else []
    own = lambda s: items.select(F.col(key).alias(s), *[F.col(c).alias(f"_{c}_{s}") for c in ("orientation", *views, *extra)])
    packed = F.struct(*_NO_MATCH)
    found = matches.groupBy("a", "b").agg(*[F.max(F.when(F.col("view") == n, packed)).alias(f"_m_{n}") for n, _, _ in names])
    x = pairs.join(own("a"), "a").join(own("b"), "b").join(found, ["a", "b"], "left")
    none = F.struct(*[F.lit(v).alias(c) for c, v in _NO_MATCH.items()])
    x = x.select(
        *pairs.columns,
        *[F.coalesce(F.col(f"_orientation_{s}"), F.lit("")).alias(f"orientation_{s}") for s in "ab"],
        *[dot(F.col(f"_{va}_a"), F.col(f"_{vb}_b")).alias(f"sim_{n}") for n, va, vb in names],
        *[F.coalesce(f"_m_{n}", none).alias(f"_m_{n}") for n, _, _ in names],
        *([F.abs(F.coalesce("_lum_mean_a", F.lit(0.0)) - F.coalesce("_lum_mean_b", F.lit(0.0))).alias("lum_gap")] if extra else []),
    )
    sim = first_best([F.struct(F.col(f"sim_{n}").alias("v"), F.lit(n).alias("view")) for n, _, _ in names], "v")
    local = first_best([F.struct(F.col(f"_m_{n}.local_score").alias("v"), F.lit(n).alias("view"), F.col(f"_m_{n}").alias("m")) for n, _, _ in names], "v")
    x = x.withColumn("_sim", sim).withColumn("_local", local)
    out = [*pairs.columns, "orientation_a", "orientation_b", *[f"sim_{n}" for n, _, _ in names], *[F.col(f"_m_{n}.local_score").alias(f"local_{n}") for n, _, _ in names]]
    out += [F.col("_sim.v").alias("sim_best"), ((F.col("_sim.v") + 1.0) * 0.5).alias("sim_best01"), F.col("_sim.view").alias("sim_best_view")]
    out += [F.col("_local.v").alias("local_best"), F.col("_local.view").alias("local_best_view"), *[F.col(f"_local.m.{c}").alias(c) for c in ("matches", "inliers", "mean_conf")]]
    if kind == "flank":
        out += ["lum_gap", orientation_relation(canonical_orientation(F.col("orientation_a")), canonical_orientation(F.col("orientation_b"))).alias("relation")]
    if kind == "mirrored":
        out += [F.greatest("sim_orig_hflip", "sim_hflip_orig").alias("sim_cross"), F.greatest("_m_orig_hflip.local_score", "_m_hflip_orig.local_score").alias("local_cross")]
    return x.select(*out)


def features(kind: str) -> list[Column]:
    """The calibrator's features of a record: 11 of 'flank', 12 of 'views', 16 of 'mirrored'. NaN, null and -inf: 0; +inf: 1."""
    c = F.col
    flag = lambda x: x.cast("double")
    share = lambda x, most: F.when(c(x) <= most, c(x) / most).when((c(x) > most) & ~F.isnan(c(x).cast("double")), 1.0)
    to01 = lambda x: (c(x) + 1.0) * 0.5
    same = flag(c("orientation_a") == c("orientation_b"))
    if kind == "flank":
        out = [c("sim_best01"), c("local_best"), share("matches", 60.0), share("inliers", 22.0), c("mean_conf"), share("lum_gap", 0.20)]
        out += [flag(c("relation") == r) for r in RELATIONS]
    elif kind == "views":
        out = [c("sim_best01"), to01("sim_orig"), to01("sim_norm"), c("local_best"), c("local_orig"), c("local_norm"), share("matches", 60.0), share("inliers", 24.0), c("mean_conf")]
        out += [flag(c("sim_best_view") == "norm"), flag(c("local_best_view") == "norm"), same]
    else:
        has = lambda x: flag(c(x).contains("hflip"))
        crossed = lambda x: flag(c(x).isin("orig_hflip", "hflip_orig"))
        out = [c("sim_best01"), to01("sim_orig_orig"), to01("sim_hflip_hflip"), to01("sim_cross"), c("local_best"), c("local_orig_orig"), c("local_hflip_hflip"), c("local_cross")]
        out += [share("matches", 60.0), share("inliers", 24.0), c("mean_conf"), has("sim_best_view"), has("local_best_view"), crossed("sim_best_view"), crossed("local_best_view"), same]
    clean = lambda x: F.when(x.isNull() | F.isnan(x) | (x == float("-inf")), 0.0).when(x == float("inf"), 1.0).otherwise(x)
    return [clean(x.cast("double")).alias(f"f{i}") for i, x in enumerate(out)]


def visual_similarity(parts: list[Column], similarities: list[Column]) -> Column:
    """struct visual, part_score, part_cells, part_overlap: the best of part pairings (structs of score, overlap, cells; by score, then cells), and the best of it and of the whole similarities."""
    best = first_best(parts, "score", "cells")
    whole = F.greatest(*similarities, best["score"])
    return F.struct(whole.alias("visual"), best["score"].alias("part_score"), best["cells"].alias("part_cells"), best["overlap"].alias("part_overlap"))


def has_evidence(score: Column, point: Column, stack: Column, keep: float, min_point: float, min_stack: float) -> Column:
    """A score that points or stacking bear out: correlation alone is not enough. Nulls are no evidence."""
    return F.coalesce((score >= keep) & ((point >= min_point) | (stack >= min_stack)), F.lit(False))


def brightness(pixels: Column, dark: float = 0.12, bright: float = 0.88) -> Column:
    """struct lum_mean, lum_std (of all pixels), dark_frac, bright_frac of an array of grey values in 0..1; no pixels: nulls."""
    n = F.nullif(F.size(pixels), F.lit(0))
    total = lambda f: F.aggregate(F.transform(pixels, lambda x: f(x.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    mean = total(lambda x: x) / n
    share = lambda f: F.size(F.filter(pixels, f)) / n
    std = F.sqrt(total(lambda x: (x - mean) * (x - mean)) / n)
    return F.struct(mean.alias("lum_mean"), std.alias("lum_std"), share(lambda x: x < dark).alias("dark_frac"), share(lambda x: x > bright).alias("bright_frac"))
