"""Items, partitions and pairs that the queries use, derived from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize
from ..operators import candidates
from ..session import table

K = 10


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, species, split, orientation, identity, cluster, v (unit vector)."""
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    o = F.element_at(F.array(*[F.lit(x) for x in ("left", "right", "front", "back", "Left-Side", "", None)]), (i % 7 + 1).cast("int"))
    return e.select(
        i.alias("image_id"),
        F.concat(F.lit("sp"), (i % 4).cast("string")).alias("species"),
        F.when(i % 5 < 2, "test").otherwise("train").alias("split"),
        o.alias("orientation"),
        F.col("label").cast("string").alias("identity"),
        F.concat(F.lit("c"), (i % 4).cast("string"), F.lit("_"), (F.col("label") * 7 + i % 7).cast("string")).alias("cluster"),
        l2_normalize(F.col("embedding")).alias("v"),
    )


def second_partition(it: DataFrame) -> DataFrame:
    """Another partition of the same ids."""
    i = F.col("image_id")
    return it.select("image_id", "species", F.concat(F.lit("d"), (i % 4).cast("string"), F.lit("_"), (F.floor(i / 8) % 9).cast("string")).alias("cluster"))


def neighbours(it: DataFrame, k: int = K) -> DataFrame:
    return candidates.top_k(it, it, k)


def scored_pairs(it: DataFrame) -> DataFrame:
    """Neighbour pairs a < b with sim and with match counts made up from the ids, as a matcher would give them."""
    p = candidates.best_pairs(neighbours(it))
    a, b = F.col("a"), F.col("b")
    same = it.select(F.col("image_id").alias("a"), F.col("species"), F.col("identity").alias("ia"), F.col("cluster").alias("ca"), F.col("orientation").alias("oa"))
    other = it.select(F.col("image_id").alias("b"), F.col("identity").alias("ib"), F.col("cluster").alias("cb"), F.col("orientation").alias("ob"))
    return p.join(same, "a").join(other, "b").select(
        "species", "a", "b", "sim", "oa", "ob", "ca", "cb",
        ((a * 7 + b * 3) % 20).alias("inliers"),
        ((a * 5 + b) % 60).alias("matches"),
        (((a + b) % 100) / 100.0).cast("double").alias("conf"),
        (((a * 3 + b) % 50) / 50.0).cast("double").alias("ratio"),
        ((a + b * 2) % 4).alias("votes"),
        (F.col("ia") == F.col("ib")).cast("int").alias("label"),
    )


ITEMS = """items AS (
  SELECT vec_id AS image_id, 'sp' || (vec_id % 4)::VARCHAR AS species, CASE WHEN vec_id % 5 < 2 THEN 'test' ELSE 'train' END AS split,
    (['left', 'right', 'front', 'back', 'Left-Side', '', NULL])[(vec_id % 7 + 1)::INT] AS orientation, label::VARCHAR AS identity,
    'c' || (vec_id % 4)::VARCHAR || '_' || (label * 7 + vec_id % 7)::VARCHAR AS cluster,
    list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12)) AS v
  FROM embeddings
), other AS (
  SELECT image_id, species, 'd' || (image_id % 4)::VARCHAR || '_' || ((image_id // 8) % 9)::VARCHAR AS cluster FROM items
)"""
SIMS = f"""{ITEMS}, sims AS (
  SELECT x.species, x.image_id AS a, y.image_id AS b, list_dot_product(x.v, y.v) AS sim
  FROM items x JOIN items y ON x.species = y.species AND x.image_id <> y.image_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM sims),
knn AS (SELECT * FROM ranked WHERE rank <= {K})"""
PAIRS = f"""{SIMS}, base AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(sim) AS sim FROM knn GROUP BY 1, 2),
pairs AS (
  SELECT x.species, p.a, p.b, sim, x.orientation AS oa, y.orientation AS ob, x.cluster AS ca, y.cluster AS cb, (p.a * 7 + p.b * 3) % 20 AS inliers, (p.a * 5 + p.b) % 60 AS matches,
    ((p.a + p.b) % 100)::DOUBLE / 100 AS conf, ((p.a * 3 + p.b) % 50)::DOUBLE / 50 AS ratio, (p.a + p.b * 2) % 4 AS votes,
    (x.identity = y.identity)::INT AS label
  FROM base p JOIN items x ON x.image_id = p.a JOIN items y ON y.image_id = p.b
)"""
