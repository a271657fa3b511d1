"""Scalar rules on item metadata: orientations, labels, paths, penalties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing orientation.
NULL_LIKE = ("", "nan", "none", "null", "unknown")


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def split_from_path(path: Column) -> Column:
    return F.when(F.contains(slashes(path), F.lit("/test/")), "test").otherwise("train")


def dataset_from_path(path: Column) -> Column:
    """Second segment of a path, null if there is none."""
    return F.get(F.split(slashes(path), "/"), F.lit(1))


def truthy(c: Column) -> Column:
    return F.lower(c.cast("string")).isin("true", "1", "yes")


def side_bucket(o: Column) -> Column:
    """left before right; neither: null."""
    low = F.lower(F.coalesce(o, F.lit("")))
    return F.when(F.contains(low, F.lit("left")), "left").when(F.contains(low, F.lit("right")), "right")


def canonical_orientation(o: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(o, F.lit(""))))
    return F.when(low.isin(*NULL_LIKE), "unknown").otherwise(low)


def orientation_relation(a: Column, b: Column) -> Column:
    """same_flank, opposite_flank, same_axial, unknown, mixed: the first that holds, from canonical orientations."""
    sa, sb = side_bucket(a), side_bucket(b)
    return (
        F.when(sa == sb, "same_flank")
        .when(sa.isNotNull() & sb.isNotNull(), "opposite_flank")
        .when((a == b) & a.isin("front", "back", "top", "bottom"), "same_axial")
        .when((a == "unknown") | (b == "unknown"), "unknown")
        .otherwise("mixed")
    )


def orientation_compatible(a: Column, b: Column) -> Column:
    """False for opposite flanks and for front against back; an unknown side passes."""
    sa, sb = side_bucket(a), side_bucket(b)
    flanks = F.coalesce(sa != sb, F.lit(False))
    axial = ((a == "front") & (b == "back")) | ((a == "back") & (b == "front"))
    return ~(flanks | axial)


def subtractive_penalty(sim: Column, a: Column, b: Column, penalty: float) -> Column:
    sa, sb = side_bucket(a), side_bucket(b)
    return sim - F.when(sa.isNotNull() & sb.isNotNull() & (sa != sb), penalty).otherwise(0.0)


def multiplicative_penalty(a: Column, b: Column, opposite: float = 0.55, weak: float = 0.84) -> Column:
    relation = orientation_relation(a, b)
    return F.when(relation == "opposite_flank", opposite).when(relation == "mixed", weak).otherwise(1.0)


def context_factor(a: Column, b: Column, kind_a: Column, kind_b: Column, boosted: Column, flanked: Column, bodied: Column) -> Column:
    """0 if blocked. Equal known orientations: 1.05 in boosted groups; others: 0.92 in flanked groups. In bodied groups equal body kinds
    1.04, and 0.88 if they differ and one is partial_or_head. All other cases 1."""
    same = (a == b) & (a != "unknown")
    side = F.when(same & boosted, 1.05).when(~same & flanked, 0.92).otherwise(1.0)
    partial = (kind_a == "partial_or_head") | (kind_b == "partial_or_head")
    body = F.when(bodied & (kind_a == kind_b), 1.04).when(bodied & partial, 0.88).otherwise(1.0)
    return F.when(~orientation_compatible(a, b), 0.0).otherwise(side * body)


def unit(x: Column) -> Column:
    """A cosine as a number from 0 to 1."""
    return (x + 1) / 2


def saturate(x: Column, at: float) -> Column:
    return F.least(x / at, F.lit(1.0))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def finite(x: Column) -> Column:
    """NaN and null: 0, +inf: 1, -inf: 0."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x == float("-inf")), 0.0).when(x == float("inf"), 1.0).otherwise(x)


def best_view(views: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(best value, name of the first view that has it)."""
    best = F.greatest(*[c for _, c in views])
    name = F.when(F.lit(False), F.lit(""))
    for n, c in views:
        name = name.when(c == best, F.lit(n))
    return best, name


def safe_label(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")


def label_key(c: Column) -> Column:
    """(prefix, number at the end, text); without a number 10**9, so it comes last."""
    number = F.regexp_extract(c, r"_(\d+)$", 1)
    return F.struct(
        F.when(number == "", c).otherwise(F.regexp_replace(c, r"_\d+$", "")).alias("prefix"),
        F.when(number == "", F.lit(10**9)).otherwise(number.try_cast("long")).cast("long").alias("number"),
        c.alias("text"),
    )


def first_path(*paths: Column) -> Column:
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in paths])


def log_ratio(v: Column, t: Column) -> Column:
    one = F.lit(1.0)
    return F.abs(F.log(F.greatest(one, v + 1) / F.greatest(one, t + 1)))
