"""Pair scores from counts and similarities, one expression each. Weights and scales are fixed values of the formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clip, saturate


def local_match(inliers: Column, matches: Column, conf: Column, inlier_scale: float = 16, match_scale: float = 42, weights=(0.58, 0.27, 0.15)) -> Column:
    wi, wm, wc = weights
    return saturate(inliers, inlier_scale) * wi + saturate(matches, match_scale) * wm + clip(conf) * wc


def local_match_wide(inliers: Column, matches: Column, conf: Column) -> Column:
    return local_match(inliers, matches, conf, 18, 48)


def binary_match(inliers: Column, matches: Column, conf: Column) -> Column:
    return local_match(inliers, matches, conf, 18, 56, (0.56, 0.29, 0.15))


def keypoint_match(matches: Column, inlier_ratio: Column) -> Column:
    return saturate(matches, 120) * 0.65 + F.least(inlier_ratio, F.lit(1.0)) * 0.35


def coarse_match(good: Column, inlier: Column, coarse: Column) -> Column:
    return saturate(good, 80) * 0.62 + inlier * 0.23 + F.greatest(coarse, F.lit(0.0)) * 0.15


def masked_match(good: Column, inlier: Column) -> Column:
    return saturate(good, 80) * 0.72 + inlier * 0.28


def guarded_local(inliers: Column, good: Column, quality: Column) -> Column:
    ratio = F.when(good > 0, inliers / good).otherwise(0.0)
    return (saturate(inliers, 18) * 0.46 + saturate(good, 70) * 0.28 + ratio * 0.26) * quality


def guarded_fused(cos: Column, local: Column, has_local: Column, factor: Column, w_cos: float = 0.56, w_local: float = 0.44) -> Column:
    """Blend of cosine and local score; without descriptors 0.40 of the cosine. Both times the context factor."""
    vec = F.greatest(cos, F.lit(0.0))
    return F.when(has_local, vec * w_cos + local * w_local).otherwise(vec * 0.40) * factor


def fingerprint(inl: Column, ratio: Column, coverage: Column, part: Column, overlap: Column, visual: Column, matches: Column, quality: Column, scale: float = 0.68) -> Column:
    base = inl * 0.42 + ratio * 0.24 + coverage * 0.10 + part * 0.16 + overlap * 0.04 + visual * 0.04
    full = F.least(F.lit(1.0), base / scale) * F.least(F.lit(1.0), quality * 0.35 + 0.65)
    return F.when(matches < 4, F.greatest(visual, F.lit(0.0)) * 0.12).otherwise(full)


def template(map_score: Column, points: Column, cos: Column, overlap: Column, penalty: Column, quality: Column, weights=(0.58, 0.30, 0.12), min_overlap: float = 0.08) -> Column:
    wm, wp, wc = weights
    return (map_score * wm + points * wp + cos * wc) * F.least(F.lit(1.0), overlap * (0.30 / max(0.08, min_overlap)) + 0.70) * penalty * quality


def dots(corr: Column, points: Column, stack: Column, cos: Column, flipped: Column, quality: Column) -> Column:
    base = corr * 0.34 + points * 0.31 + stack * 0.23 + F.greatest(cos, F.lit(0.0)) * 0.12
    return base * F.when(flipped, 0.92).otherwise(1.0) * quality


def boundary(corr: Column, points: Column, stack: Column, cos: Column, min_points: Column, quality: Column) -> Column:
    base = corr * 0.25 + points * 0.42 + stack * 0.25 + F.greatest(cos, F.lit(0.0)) * 0.08
    return base * F.when(min_points < 12, 0.82).otherwise(1.0) * quality


def reused(inliers: Column, ratio: Column, good: Column, scale: float = 28) -> Column:
    return saturate(inliers, scale) * 0.55 + saturate(ratio, 0.25) * 0.30 + saturate(good, 60) * 0.15


def rerank_local(g: Column, local: Column, thr: float) -> Column:
    """Promotes to just above thr, or demotes to just below it; without a local score g stays."""
    s = g * 0.82 + local * 0.18
    up = (local > 0.55) & (g > thr - 0.10)
    down = (local < 0.08) & (g < thr + 0.025)
    return F.when(local.isNull(), g).when(up, F.greatest(s, F.lit(thr + 0.01))).when(down, F.least(s, F.lit(thr - 0.01))).otherwise(s)


def rerank_patch(g: Column, patch: Column, thr: float) -> Column:
    s = g * 0.58 + patch * 0.42
    return F.when(patch.isNull(), g).when((patch > thr + 0.03) & (g > thr - 0.10), F.greatest(s, F.lit(thr + 0.01))).otherwise(s)


def rerank_match(g: Column, score: Column, good: Column, least: int, thr: float) -> Column:
    s = g * 0.84 + score * 0.16
    up = (good >= least) & (score > 0.30)
    down = (good < 6) & (g < thr + 0.02)
    return F.when(score.isNull(), g).when(up, F.greatest(s, F.lit(thr + 0.01))).when(down, F.least(s, F.lit(thr - 0.01))).otherwise(s)


def vote_relaxed(votes: Column, inliers: Column, ratio: Column, score: Column, part: Column, min_inliers: int, min_ratio: float, min_score: float, floors=(6, 0.08, 0.20), part_floor: float = 0.25) -> Column:
    """Gates that votes of other partitions lower, down to floors; the parts must agree in any case."""
    inl = F.greatest(min_inliers - F.least(F.lit(6), votes * 2), F.lit(floors[0]))
    rat = F.greatest(min_ratio - F.least(F.lit(0.04), votes * 0.012), F.lit(floors[1]))
    sco = F.greatest(min_score - F.least(F.lit(0.06), votes * 0.018), F.lit(floors[2]))
    return (inliers >= inl) & (ratio >= rat) & (score >= sco) & (part >= part_floor)


def mask_choice(score: Column, area: Column, central: Column, weights=(0.65, 0.20, 0.15), area_range=(0.01, 0.95)) -> Column:
    """Weighted score of one mask; null where its area is out of range, so max_by leaves it out."""
    ws, wa, wc = weights
    return F.when(area.between(*area_range), score * ws + F.least(area * 2, F.lit(1.0)) * wa + central * wc)
