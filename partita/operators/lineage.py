"""Partition states and their transitions: splicing, overriding, checks, equivalence, shape and change reports, choosing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def onto_universe(universe: DataFrame, partition: DataFrame, key: str = "image_id") -> DataFrame:
    """The partition on all ids of the universe; ids that it lacks get a null label. Order is a column of the universe."""
    return universe.join(partition, key, "left")


def override(partition: DataFrame, update: DataFrame, key: str = "image_id", label: str = "cluster") -> DataFrame:
    new = update.select(key, F.col(label).alias("_new"))
    return partition.join(new, key, "left").withColumn(label, F.coalesce("_new", label)).drop("_new").select(*partition.columns)


def splice(universe: DataFrame, sources: dict[str, DataFrame], species: str = "species", key: str = "image_id", label: str = "cluster") -> DataFrame:
    """Each species' labels from the partition named for it; an id that this lacks gets cluster_missing_<id>."""
    parts = None
    for name, p in sources.items():
        own = universe.where(F.col(species) == name).join(p.select(key, label), key, "left")
        parts = own if parts is None else parts.unionByName(own)
    missing = F.concat(F.lit("cluster_missing_"), F.col(key).cast("string"))
    return parts.withColumn(label, F.coalesce(label, missing))


def contract(partition: DataFrame, universe: DataFrame, longest: int = 64, key: str = "image_id", label: str = "cluster") -> DataFrame:
    """One row of counts that are all 0 for a valid partition: missing, foreign, repeated ids, null and too long labels."""
    u, p = universe.select(F.col(key).alias("u")), partition.select(F.col(key).alias("p"), F.col(label).alias("l"))
    both = u.join(p, F.col("u") == F.col("p"), "full")
    once = both.groupBy(F.coalesce("u", "p").alias("id")).agg(
        F.max(F.col("p").isNull().cast("int")).alias("missing"),
        F.max(F.col("u").isNull().cast("int")).alias("foreign"),
        (F.count("p") - 1).alias("extra"),
        F.sum((F.col("p").isNotNull() & F.col("l").isNull()).cast("int")).alias("nulls"),
        F.sum((F.char_length("l") > longest).cast("int")).alias("long"),
    )
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return once.agg(
        z("missing").alias("missing"),
        z("foreign").alias("foreign"),
        z(F.greatest("extra", F.lit(0))).alias("repeated"),
        z("nulls").alias("null_labels"),
        z("long").alias("long_labels"),
    )


def equivalent(a: DataFrame, b: DataFrame, key: str = "image_id", label: str = "cluster") -> DataFrame:
    """One row: whether two partitions have the same ids and their labels map one to one."""
    pairs = a.select(key, F.col(label).alias("la")).join(b.select(F.col(key).alias("k2"), F.col(label).alias("lb")), F.col(key) == F.col("k2"), "full")
    gaps = pairs.agg(F.sum(F.when(F.col(key).isNull() | F.col("k2").isNull(), 1).otherwise(0)).alias("gaps"))
    cells = pairs.select("la", "lb").distinct()
    one = cells.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("la").alias("na"), F.countDistinct("lb").alias("nb"))
    return gaps.crossJoin(one).select(
        F.coalesce("gaps", F.lit(0)).cast("long").alias("id_gaps"), ((F.coalesce("gaps", F.lit(0)) == 0) & (F.col("n") == F.col("na")) & (F.col("n") == F.col("nb"))).alias("equivalent")
    )


def shape(partition: DataFrame, group: str = "species", label: str = "cluster") -> DataFrame:
    """Per species: n_images, n_clusters, max_cluster_size, singletons. Rows without species are left out."""
    per = partition.where(F.col(group).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(group).agg(
        F.sum("n").alias("n_images"),
        F.count(F.lit(1)).alias("n_clusters"),
        F.max("n").alias("max_cluster_size"),
        F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("singletons"),
    )


def top_sizes(partition: DataFrame, k: int = 10, group: str = "species", label: str = "cluster") -> DataFrame:
    """Per species its k largest cluster sizes as text."""
    per = partition.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), label))
    top = per.withColumn("r", r).where(F.col("r") <= k).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("r", "n"))).alias("t"))
    return top.select(group, F.array_join(F.transform("t", lambda x: x["n"].cast("string")), ",").alias("top_sizes"))


def label_changes(partition: DataFrame, reference: DataFrame | None, group: str = "species", key: str = "image_id", label: str = "cluster") -> DataFrame:
    """Per species the ids whose label is not the reference's; -1 without a reference."""
    if reference is None:
        return partition.groupBy(group).agg(F.lit(-1).cast("long").alias("changed"))
    both = partition.join(reference.select(key, F.col(label).alias("_ref")), key, "left")
    return both.groupBy(group).agg(F.sum(F.when(F.col(label).eqNullSafe(F.col("_ref")), 0).otherwise(1)).cast("long").alias("changed"))


def membership_changes(partition: DataFrame, reference: DataFrame, group: str = "species", key: str = "image_id", label: str = "cluster") -> DataFrame:
    """Per species the ids whose set of co-members differs. A set is the same exactly if the cluster pair's common members are all of both; so sizes are compared, not sets."""
    both = partition.join(reference.select(key, F.col(label).alias("_ref")), key)
    cell = both.groupBy(group, label, "_ref").agg(F.count(F.lit(1)).alias("n"))
    a = partition.groupBy(label).agg(F.count(F.lit(1)).alias("na"))
    b = reference.groupBy(F.col(label).alias("_ref")).agg(F.count(F.lit(1)).alias("nb"))
    same = (F.col("n") == F.col("na")) & (F.col("n") == F.col("nb"))
    return cell.join(a, label).join(b, "_ref").groupBy(group).agg(F.sum(F.when(same, 0).otherwise(F.col("n"))).cast("long").alias("changed_members"))


def variant_summary(pairs: DataFrame, score: str = "score", same: str = "same_cluster") -> DataFrame:
    """One row: 95th percentile, mean within clusters, 99th percentile across."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    return pairs.agg(
        q(F.col(score), 0.95).alias("p95"), F.avg(F.when(F.col(same), F.col(score))).alias("same_mean"), q(F.when(~F.col(same), F.col(score)), 0.99).alias("cross_p99")
    )


def shape_score(report: DataFrame, targets: DataFrame, group: str = "species") -> DataFrame:
    """Per species the distance of its shape from a target, and notes (array<string>).

    targets: t_clusters, t_max, t_singletons, the ranges lo_clusters..hi_clusters, lo_max..hi_max, and hi_singletons. Distances are log ratios of
    counts; leaving a range costs more. One cluster of several items: 999, collapsed. A species without target: 0.
    """
    x = report.join(targets, group, "left")
    ratio = lambda v, t: F.abs(F.log(F.greatest(F.col(v) + 1.0, F.lit(1.0)) / F.greatest(F.col(t) + 1.0, F.lit(1.0))))
    s = 2.6 * ratio("n_clusters", "t_clusters") + 1.4 * ratio("max_cluster_size", "t_max") + 0.55 * ratio("singletons", "t_singletons")
    ranges = (
        (F.col("n_clusters") < F.col("lo_clusters"), 3.0, "n_clusters", "lo_clusters", "too_few_clusters"),
        (F.col("n_clusters") > F.col("hi_clusters"), 3.0, "n_clusters", "hi_clusters", "too_many_clusters"),
        (F.col("max_cluster_size") < F.col("lo_max"), 1.6, "max_cluster_size", "lo_max", "max_cluster_too_small"),
        (F.col("max_cluster_size") > F.col("hi_max"), 12.0, "max_cluster_size", "hi_max", "max_cluster_too_large"),
        (F.col("singletons") > F.col("hi_singletons"), 1.5, "singletons", "hi_singletons", "too_many_singletons"),
    )
    for out, weight, v, t, _ in ranges:
        s = s + F.when(out, weight * ratio(v, t)).otherwise(0.0)
    known, collapsed = F.col("t_clusters").isNotNull(), (F.col("n_clusters") <= 1) & (F.col("n_images") > 1)
    notes = F.array_compact(F.array(*[F.when(out, F.lit(note)) for out, _, _, _, note in ranges]))
    return x.select(
        group,
        F.when(~known, 0.0).when(collapsed, 999.0).otherwise(s).alias("shape_score"),
        F.when(~known, F.array().cast("array<string>")).when(collapsed, F.array(F.lit("collapsed"))).otherwise(notes).alias("notes"),
    )


def choose_by_score(scores: DataFrame, name: str = "variant", score: str = "shape_score", bias: Column | None = None) -> DataFrame:
    """The variant with the least summed score: one row."""
    total = scores.groupBy(name).agg(F.sum(score).alias("total"))
    total = total.withColumn("total", F.col("total") + bias) if bias is not None else total
    return total.orderBy("total", name).limit(1)


def choose_safe(report: DataFrame, order=("balanced", "strict", "mild"), changed=(0, 70), clusters=(80, 92), largest: int = 26, fallback: str = "passthrough") -> DataFrame:
    """One row, chosen: the first variant in order whose changes, clusters and largest cluster are within bounds, else the fallback."""
    ok = (F.col("changed") > changed[0]) & (F.col("changed") <= changed[1]) & F.col("n_clusters").between(*clusters) & (F.col("max_cluster_size") <= largest)
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("variant"))
    return report.where(ok & (place > 0)).agg(F.coalesce(F.min_by("variant", place), F.lit(fallback)).alias("chosen"))


def differs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
