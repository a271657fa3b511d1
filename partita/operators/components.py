"""Connected components of an edge table by large-star and small-star steps, and threshold components on top of them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets a folder of this machine; on a cluster this raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        base = tempfile.mkdtemp(prefix="partita-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder: survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def connected(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component) of every id on an edge between two ids; component is the smallest id reachable.

    Edges stay distributed and are checkpointed each round; rounds grow with the logarithm of the graph's width. Loops and null
    ends are left out. Order of edges does not matter. Stops with an error if it has not settled after ``rounds``.
    """
    edge = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    real = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    now, before = cut(edges.where(real).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(edge(F.col("u"), F.col("m")), edge(F.col("v"), F.col("m")))).alias("e"))
        now = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        before = state
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def threshold_components(items: DataFrame, edges: DataFrame, accept: Column, key: str = "image_id") -> DataFrame:
    """items' ids with the component over accepted edges; an item without edges is its own."""
    parts = connected(edges.where(accept))
    return items.select(key).join(parts.withColumnRenamed("id", key), key, "left").select(key, F.coalesce("component", key).alias("component"))


def size_distribution(parts: DataFrame, component: str = "component") -> DataFrame:
    """(size, components): how many components have a size."""
    return parts.groupBy(component).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


def members(parts: DataFrame, component: str = "component", key: str = "image_id", at_most: int = 1000) -> DataFrame:
    """(component, chunk, ids): each component's ids in order, in lists of ids of one hash chunk, so that no list grows with its component much beyond at_most."""
    size = parts.groupBy(component).agg(F.ceil(F.count(F.lit(1)) / at_most).alias("chunks"))
    dealt = parts.join(size, component).withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int"))
    return dealt.groupBy(component, "chunk").agg(F.array_sort(F.collect_list(key)).alias("ids"))
