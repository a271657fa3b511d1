"""Partition operators: greedy capped and guarded merging, splitting, agglomeration, anchoring, relabelling, replay.

Greedy merging depends on the order of its edges, so it runs as one grouped-map task per group (species): over cluster nodes and
candidate edges only, sorted by evidence and then by ids. Everything that does not depend on order is a DataFrame plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import label_key
from .components import connected


class Forest:
    """Union-find over any ids, with the number of items of each root."""

    def __init__(self, sizes: dict):
        self.parent, self.size = {k: k for k in sizes}, dict(sizes)

    def find(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a, b, cap: float = float("inf")) -> int | None:
        """The new size, or None if the two are one already or the sum is over cap. The smaller root stays."""
        a, b = sorted((self.find(a), self.find(b)))
        if a == b or self.size[a] + self.size[b] > cap:
            return None
        self.parent[b] = a
        self.size[a] += self.size[b]
        return self.size[a]


def _schema(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def capped_merge(nodes: DataFrame, edges: DataFrame, order: list[Column], cap: int, max_edges: int = 1 << 31, group: str = "species") -> DataFrame:
    """(group, node, root, step, size_after): greedy unions of cluster nodes (group, node, n) along edges (group, a, b).

    Edges go by `order`, then a, b. One that joins what is joined, or whose sum of sizes is over cap, is gone; the first max_edges accepted
    ones count. step and size_after are those of the union that the node's edge made (null for none). Per group: its nodes and edges.
    """
    w = Window.partitionBy(group).orderBy(*order, "a", "b")
    ranked = edges.select(group, "a", "b", F.row_number().over(w).alias("pos"))
    t = _schema(nodes, "node")
    left = nodes.select(group, "node", F.col("n").cast("long").alias("n"))

    def run(key: tuple, own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        f, step, said = Forest(dict(zip(own["node"], own["n"], strict=True))), 0, {}
        for a, b in pairs.sort_values("pos")[["a", "b"]].itertuples(index=False):
            if step >= max_edges:
                break
            if a in f.parent and b in f.parent and (size := f.union(a, b, cap)) is not None:
                step += 1
                said[b] = (step, size)
        return pd.DataFrame(
            {
                group: key[0],
                "node": own["node"],
                "root": [f.find(x) for x in own["node"]],
                "step": pd.array([said.get(x, (None, None))[0] for x in own["node"]], "Int64"),
                "size_after": pd.array([said.get(x, (None, None))[1] for x in own["node"]], "Int64"),
            }
        )

    return left.groupBy(group).cogroup(ranked.groupBy(group)).applyInPandas(run, f"{group} {_schema(nodes, group)}, node {t}, root {t}, step long, size_after long")


def cluster_nodes(partition: DataFrame, group: str = "species", label: str = "cluster") -> DataFrame:
    """Clusters as nodes, so that existing clusters stay together in merges."""
    return partition.groupBy(group, F.col(label).alias("node")).agg(F.count(F.lit(1)).alias("n"))


def cluster_edges(pairs: DataFrame, partition: DataFrame, score: str = "score", group: str = "species", label: str = "cluster", key: str = "image_id") -> DataFrame:
    """Item pairs as edges between their clusters: the best score of each cluster pair, a < b."""
    p = partition.select(group, F.col(key), F.col(label))
    x = p.select(F.col(group), F.col(key).alias("a"), F.col(label).alias("la"))
    y = p.select(F.col(key).alias("b"), F.col(label).alias("lb"))
    both = pairs.join(x, "a").join(y, "b").where("la <> lb")
    return both.groupBy(group, F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.max(score).alias(score))


def relabel(partition: DataFrame, roots: DataFrame, group: str = "species", label: str = "cluster") -> DataFrame:
    """partition with each cluster's label replaced by its root's."""
    to = roots.select(group, F.col("node").alias(label), "root")
    return partition.join(to, [group, label], "left").withColumn(label, F.coalesce("root", label)).drop("root")


def guarded_merge(items: DataFrame, edges: DataFrame, max_rank: int, max_degree: int, cap: int, gate: Column, order: list[Column], group: str = "species", key: str = "image_id") -> DataFrame:
    """(group, image_id, root): greedy unions of items under guards: both ranks at most max_rank, the gate holds, degrees under max_degree, size at most cap.

    edges: group, a, b, rank_ab, rank_ba and what the gate uses.
    """
    fine = edges.where((F.greatest("rank_ab", "rank_ba") <= max_rank) & gate)
    ranked = fine.select(group, "a", "b", F.row_number().over(Window.partitionBy(group).orderBy(*order, "a", "b")).alias("pos"))

    def run(k: tuple, own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        f, degree = Forest({x: 1 for x in own[key]}), dict.fromkeys(own[key], 0)
        for a, b in pairs.sort_values("pos")[["a", "b"]].itertuples(index=False):
            if a in degree and b in degree and degree[a] < max_degree and degree[b] < max_degree and f.union(a, b, cap) is not None:
                degree[a] += 1
                degree[b] += 1
        return pd.DataFrame({group: k[0], key: own[key], "root": [f.find(x) for x in own[key]]})

    return items.select(group, key).groupBy(group).cogroup(ranked.groupBy(group)).applyInPandas(run, f"{group} {_schema(items, group)}, {key} long, root long")


def label_merge(partition: DataFrame, label_edges: DataFrame, label: str = "cluster") -> DataFrame:
    """Unions of labels along (a, b), without a cap: order does not matter, so it is distributed. The smallest label by label_key stays."""
    parts = connected(label_edges)
    best = parts.groupBy("component").agg(F.min_by("id", label_key(F.col("id"))).alias("kept"))
    to = parts.join(best, "component").select(F.col("id").alias(label), "kept")
    return partition.join(to, label, "left").withColumn(label, F.coalesce("kept", label)).drop("kept").select(*partition.columns)


def replay_actions(partition: DataFrame, actions: DataFrame, label: str = "cluster") -> DataFrame:
    """Replays merge actions (cluster_a, cluster_b) on a partition."""
    return label_merge(partition, actions.select(F.col("cluster_a").alias("a"), F.col("cluster_b").alias("b")), label)


def split_clusters(
    partition: DataFrame, pairs: DataFrame, score: str, keep: float, label: str = "cluster", key: str = "image_id", least: int = 3, small_cluster: int = 7,
    least_edges: int = 0, evidence: Column | None = None,
) -> DataFrame:
    """image_id, cluster, part, decision: clusters cut into the components of their trusted inner pairs, under guards.

    Trusted: score >= keep and, where given, the evidence condition over the pairs' columns (of several kinds, any may do).
    Decisions, the first that holds: small (fewer than `least` items), no_scores (no inner pair scored), no_trusted (no trusted pair), connected (one component),
    atomised (all components but one at most are single items, and the cluster has at most small_cluster items), unsupported (a component of several items
    has fewer than least_edges trusted pairs); all of these keep the cluster as it is. Else split: part is the component's smallest id.
    """
    p = partition.select(key, label)
    inner = (
        pairs.join(p.select(F.col(key).alias("a"), F.col(label).alias("la")), "a").join(p.select(F.col(key).alias("b"), F.col(label).alias("lb")), "b").where("la = lb")
    )
    trust = F.coalesce((F.col(score) >= keep) & (F.lit(True) if evidence is None else evidence), F.lit(False))
    trusted = inner.where(trust)
    placed = p.join(connected(trusted).withColumnRenamed("id", key), key, "left").withColumn("part", F.coalesce("component", key)).drop("component")
    edges = trusted.join(placed.select(F.col(key).alias("a"), "part"), "a").groupBy(F.col("la").alias(label), "part").agg(F.count(F.lit(1)).alias("edges"))
    sizes = placed.groupBy(label, "part").agg(F.count(F.lit(1)).alias("size")).join(edges, [label, "part"], "left")
    per = sizes.groupBy(label).agg(
        F.sum("size").alias("n"),
        F.count(F.lit(1)).alias("n_parts"),
        F.count_if(F.col("size") == 1).alias("n_single"),
        F.min(F.when(F.col("size") > 1, F.coalesce("edges", F.lit(0)))).alias("fewest"),
    )
    scored = inner.groupBy(F.col("la").alias(label)).agg(F.count(score).alias("n_scored"), F.count_if(trust).alias("n_trusted"))
    rule = per.join(scored, label, "left").select(
        label,
        F.when(F.col("n") < least, "small")
        .when(F.coalesce("n_scored", F.lit(0)) == 0, "no_scores")
        .when(F.col("n_trusted") == 0, "no_trusted")
        .when(F.col("n_parts") == 1, "connected")
        .when((F.col("n_single") >= F.col("n_parts") - 1) & (F.col("n") <= small_cluster), "atomised")
        .when(F.coalesce(F.col("fewest") < least_edges, F.lit(False)), "unsupported")
        .otherwise("split")
        .alias("decision"),
    )
    first = placed.groupBy(label).agg(F.min(key).alias("first"))
    out = placed.join(rule, label).join(first, label)
    return out.select(key, label, F.when(F.col("decision") == "split", F.col("part")).otherwise(F.col("first")).alias("part"), "decision")


def reattach_small(split: DataFrame, pairs: DataFrame, score: str, small: int = 2, under: float = 0.34, label: str = "cluster", key: str = "image_id") -> DataFrame:
    """Safe mode of a split: a part goes back to its cluster's major part unless it has at most `small` items and no pair with the major part reaches `under`."""
    n = split.groupBy(label, "part").agg(F.count(F.lit(1)).alias("n"))
    major = n.groupBy(label).agg(F.min_by("part", F.struct(-F.col("n"), F.col("part"))).alias("major"))
    at = split.select(key, label, "part").join(major, label)
    ends = at.select(F.col(key).alias("a"), F.col("part").alias("pa"), F.col("major").alias("ma")), at.select(F.col(key).alias("b"), F.col("part").alias("pb"), F.col("major").alias("mb"))
    facing = pairs.join(ends[0], "a").join(ends[1], "b").where("ma = mb and pa <> pb and (pa = ma or pb = mb)")
    best = facing.groupBy(F.when(F.col("pa") == F.col("ma"), F.col("pb")).otherwise(F.col("pa")).alias("part")).agg(F.max(score).alias("best"))
    rule = n.join(major, label).join(best, "part", "left")
    away = (F.col("n") <= small) & (F.coalesce("best", F.lit(0.0)) < under)
    rule = rule.select(label, "part", F.when((F.col("part") == F.col("major")) | away, F.col("part")).otherwise(F.col("major")).alias("final"))
    return split.join(rule, [label, "part"]).withColumn("part", F.col("final")).drop("final").select(*split.columns)


def _average_linkage(x: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster numbers: pairs of least mean cosine distance merge while it is under threshold; ties (to 12 digits) by place.

    Of vectors of length 1 at most, two clusters' mean distance is 1 less the product of their means, so no matrix of all pairs is held. Each
    row keeps its nearest later one. After a merge the rows nearest to either part keep their distance as a lower bound, as the mean with the union
    is no less than with the nearer part; such a row is computed again when it comes first.
    """
    n = len(x)
    parent, place, size = np.arange(n), np.arange(n), np.ones(n)
    mean, gone, stale = x.copy(), np.zeros(n), np.zeros(n, bool)
    best, near = np.full(n, np.inf), np.zeros(n, np.int64)

    def look(k: int) -> None:
        stale[k], best[k] = False, np.inf
        if k + 1 < len(mean):
            d = np.round(np.clip(1 - mean[k + 1 :] @ mean[k], 0, 2), 12) + gone[k + 1 :]
            j = int(np.argmin(d))
            best[k], near[k] = d[j], k + 1 + j

    for k in range(n):
        look(k)
    left = n
    while left > 1:
        i = int(np.argmin(best))
        if not best[i] < threshold:
            break
        if stale[i]:
            look(i)
            continue
        j = int(near[i])
        mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
        size[i] += size[j]
        parent[place[j]] = place[i]
        gone[j] = best[j] = np.inf
        left -= 1
        stale |= ((near == i) | (near == j)) & (gone == 0)
        look(i)
        if left < len(mean) // 2:  # what is gone goes, in the same order
            stay = gone == 0
            to = np.cumsum(stay) - 1
            stale |= np.isin(near, np.flatnonzero(~stay))
            near = to[near]
            place, size, mean, gone, stale, best, near = (v[stay] for v in (place, size, mean, gone, stale, best, near))
    for k in range(n):  # a part's root is before it
        parent[k] = parent[parent[k]]
    return parent


def agglomerate(items: DataFrame, threshold: float, group: str = "species", key: str = "image_id", vector: str = "v", most: int | None = None) -> DataFrame:
    """(group, image_id, root): average linkage per group until the least distance is not under threshold.

    Vectors have length 1 at most; a longer one is an error. A group is one task: its memory grows with its items, its time with their square. Where
    `most` is given, a group of more items is an error.
    """

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if most is not None and len(pdf) > most:
            raise ValueError(f"group {k[0]!r} has {len(pdf)} items; average linkage takes {most} at most")
        pdf = pdf.sort_values(key)
        ids = pdf[key].to_numpy()
        x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
        if (x * x).sum(axis=1).max() > 1 + 1e-3:
            raise ValueError(f"group {k[0]!r} has a vector longer than 1")
        return pd.DataFrame({group: k[0], key: ids, "root": ids[_average_linkage(x, threshold)]})

    return items.select(group, key, vector).groupBy(group).applyInPandas(run, f"{group} {_schema(items, group)}, {key} long, root long")


def inner_similarity(partition: DataFrame, features: DataFrame, label: str = "cluster", key: str = "image_id", vector: str = "v") -> DataFrame:
    """(cluster, n, mean_sim): mean similarity of a cluster's pairs of unit vectors, from the sum vector alone: (|sum|^2 - n) / (n (n-1)). No pairs are made."""
    spread = partition.join(features.select(key, vector), key).select(label, F.posexplode(vector).alias("pos", "x"))
    sums = spread.groupBy(label, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.pow(F.col("x").cast("double"), 2)).alias("q"), F.count(F.lit(1)).alias("n"))
    per = sums.groupBy(label).agg(F.sum(F.pow("s", 2)).alias("ss"), F.sum("q").alias("qq"), F.max("n").alias("n"))
    return per.select(label, "n", F.when(F.col("n") > 1, (F.col("ss") - F.col("qq")) / (F.col("n") * (F.col("n") - 1))).alias("mean_sim"))


def refine_large(partition: DataFrame, features: DataFrame, cap: int, floor: float, threshold: float, label: str = "cluster", key: str = "image_id") -> DataFrame:
    """Clusters of more than cap items whose mean inner similarity is under floor are clustered anew at threshold: image_id, cluster, part."""
    bad = inner_similarity(partition, features, label, key).where((F.col("n") > cap) & (F.col("mean_sim") < floor)).select(label)
    chosen = partition.join(bad, label, "left_semi").join(features.select(key, "v"), key)
    parts = agglomerate(chosen, threshold, group=label, key=key).select(key, F.col("root").alias("part"))
    first = partition.groupBy(label).agg(F.min(key).alias("first"))
    return partition.select(key, label).join(first, label).join(parts, key, "left").select(key, label, F.coalesce("part", "first").alias("part"))


def anchored_components(edges: DataFrame, anchors: DataFrame, thr: float, penalty: float = 0.035, score: str = "sim", key: str = "image_id") -> DataFrame:
    """Components over edges that do not join two known identities and reach thr (thr + penalty between a known and an unknown item)."""
    known = anchors.where(F.col("identity").isNotNull())
    a, b = known.select(F.col(key).alias("a"), F.col("identity").alias("ia")), known.select(F.col(key).alias("b"), F.col("identity").alias("ib"))
    e = edges.join(a, "a", "left").join(b, "b", "left")
    mixed = F.col("ia").isNull() != F.col("ib").isNull()
    clash = F.coalesce(F.col("ia") != F.col("ib"), F.lit(False))
    return connected(e.where(~clash & (F.col(score) >= F.lit(thr) + F.when(mixed, penalty).otherwise(0.0))).select("a", "b"))


def component_labels(components: DataFrame, labels: DataFrame, key: str = "image_id") -> DataFrame:
    """(component, label): the most frequent label of a component; ties to the label of the smallest id."""
    named = components.join(labels.where(F.col("identity").isNotNull()), key)
    n = named.groupBy("component", "identity").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    return n.groupBy("component").agg(F.min_by("identity", F.struct(-F.col("n"), F.col("first"))).alias("label"))


def anchor_buckets(assigned: DataFrame, pairs: DataFrame, thr: float, cap: int, floor: float = 0.5, slack: float = 0.035, key: str = "image_id") -> DataFrame:
    """Pairs of items that have the same top identity, in buckets of at most cap items, with sim >= max(floor, thr - slack)."""
    fit = assigned.groupBy("identity").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") <= cap))
    own = assigned.join(fit, "identity", "left_semi").select(key, "identity")
    e = pairs.join(own.select(F.col(key).alias("a"), F.col("identity").alias("ia")), "a").join(own.select(F.col(key).alias("b"), F.col("identity").alias("ib")), "b")
    return e.where((F.col("ia") == F.col("ib")) & (F.col("sim") >= max(floor, thr - slack))).select("a", "b", "sim", F.col("ia").alias("identity"))


def compact_labels(partition: DataFrame, group: str = "species", label: str = "cluster", key: str = "image_id") -> DataFrame:
    """cluster_<group>_<index>: clusters numbered within their group by their smallest id."""
    first = partition.groupBy(group, label).agg(F.min(key).alias("m"))
    number = first.withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy("m")) - 1)
    new = F.concat(F.lit("cluster_"), F.col(group), F.lit("_"), F.col("i").cast("string"))
    return partition.join(number.select(group, label, new.alias("_new")), [group, label]).withColumn(label, F.col("_new")).drop("_new").select(*partition.columns)


def compact_lexical(partition: DataFrame, group: str = "species", label: str = "cluster") -> DataFrame:
    """The same, numbered by the old label's text order within the group."""
    names = partition.select(group, label).distinct()
    number = names.withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy(label)) - 1)
    new = F.concat(F.lit("cluster_"), F.col(group), F.lit("_"), F.col("i").cast("string"))
    return partition.join(number.select(group, label, new.alias("_new")), [group, label]).withColumn(label, F.col("_new")).drop("_new").select(*partition.columns)
