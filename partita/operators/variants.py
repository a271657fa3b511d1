"""Whole variants of a partition: split-and-merge, preserve-and-regroup, profiles, and parameter searches over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import calibration, candidates, components, lineage, order, partition

#: Merge profiles: score floor, size cap, accepted edges.
PROFILES = {"conservative": (0.45, 5, 10), "balanced": (0.38, 5, 18), "swing": (0.30, 7, 28)}


def split_merge(part: DataFrame, pairs: DataFrame, keep: float, merge: float, max_rank: int, score: str = "sim", cap: int = 1 << 30, key: str = "image_id") -> DataFrame:
    """image_id, species, cluster: clusters cut at `keep`, then parts joined across clusters by pairs of mutual rank up to max_rank with score >= merge, up to cap.

    A part that is a whole cluster keeps its label; the others are <label>_<smallest id>.
    """
    cut = partition.split_clusters(part, pairs, score, keep, key=key)
    n = cut.groupBy("cluster").agg(F.countDistinct("part").alias("parts"))
    label = F.when(F.col("parts") == 1, F.col("cluster")).otherwise(F.concat_ws("_", "cluster", F.col("part").cast("string")))
    own = part.select(key, "species").join(cut, key).join(n, "cluster").select(key, "species", label.alias("cluster"))
    ranked = candidates.neighbour_ranks(pairs, score).where((F.greatest("rank_ab", "rank_ba") <= max_rank) & (F.col(score) >= merge))
    edges = partition.cluster_edges(ranked.select("a", "b", score), own, score)
    roots = partition.capped_merge(partition.cluster_nodes(own), edges, [F.desc(score)], cap)
    return partition.relabel(own, roots)


def preserve_and_regroup(part: DataFrame, pairs: DataFrame, small: int, accept: Column, key: str = "image_id") -> DataFrame:
    """(image_id, component): clusters of at most `small` items stay whole; all items are regrouped by accepted pairs on top of that."""
    n = part.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    seeds = part.join(n.where(F.col("n") <= small), "cluster").select(F.col("first").alias("a"), F.col(key).alias("b"))
    edges = pairs.where(accept).select("a", "b").unionByName(seeds)
    return components.threshold_components(part, edges, F.lit(True), key)


def build_variants(part: DataFrame, pairs: DataFrame, profiles: dict = PROFILES, score: str = "sim") -> DataFrame:
    """variant, image_id, species, cluster: the partition itself (passthrough) and a capped merge for each profile."""
    base = part.select("image_id", "species", "cluster")
    edges = partition.cluster_edges(pairs.select("a", "b", score), part, score)
    out = [base.withColumn("variant", F.lit("passthrough"))]
    for name, (floor, cap, most) in profiles.items():
        roots = partition.capped_merge(partition.cluster_nodes(part), edges.where(F.col(score) >= floor), [F.desc(score)], cap, most)
        out.append(partition.relabel(base, roots).withColumn("variant", F.lit(name)))
    return reduce(DataFrame.unionByName, out).select("variant", "image_id", "species", "cluster")


def variant_shapes(variants: DataFrame) -> DataFrame:
    """The shape report of each variant."""
    return lineage.shape(variants.withColumn("species", F.struct("variant", "species"))).select("species.*", "n_images", "n_clusters", "max_cluster_size", "singletons")


def search_threshold(items: DataFrame, pairs: DataFrame, grid: list[float], score: str = "sim", truth: str = "identity", key: str = "image_id") -> DataFrame:
    """(threshold, ari) for each threshold of the grid; the first best is the one to take."""
    rows = []
    for t in grid:
        parts = components.threshold_components(items, pairs, F.col(score) >= t, key)
        got = items.select(key, truth).join(parts, key)
        rows.append(calibration.adjusted_rand(got, truth, "component").select(F.lit(t).alias("threshold"), "ari"))
    return reduce(DataFrame.unionByName, rows)


def best_threshold(search: DataFrame) -> DataFrame:
    return search.orderBy(F.desc("ari"), "threshold").limit(1)


def validation_pairs(items: DataFrame, neighbours: DataFrame, per_identity: int = 10, negatives: int = 1000, seed: int = 11, identity: str = "identity", key: str = "image_id") -> DataFrame:
    """(a, b, label): up to per_identity positive pairs of each identity, and as many negatives by hash order as asked for."""
    pos = candidates.sampled_within(items, per_identity, seed, identity, key).select("a", "b", F.lit(1).alias("label"))
    neg = candidates.across(neighbours, items, 1 << 20, label=identity, key=key)
    return pos.unionByName(candidates.sampled_pairs(neg, negatives, seed).select("a", "b", F.lit(0).alias("label")))


def ranking_metrics(pairs: DataFrame, score: str = "score", truth: str = "label") -> tuple[float, float]:
    """(area under ROC, area under precision-recall) by MLlib."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    raw = pairs.select(F.col(score).cast("double").alias("rawPrediction"), F.col(truth).cast("double").alias("label"))
    return tuple(BinaryClassificationEvaluator(metricName=m).evaluate(raw) for m in ("areaUnderROC", "areaUnderPR"))


def dense_ids(items: DataFrame, group: str = "species", identity: str = "identity") -> DataFrame:
    """items with entity (group::identity) and entity_no, numbered from 0 in sorted order of the distinct entities."""
    named = items.withColumn("entity", F.concat_ws("::", group, identity))
    numbers = order.numbered(named.select("entity").distinct(), "entity", "entity_no")
    return named.join(numbers, "entity")
