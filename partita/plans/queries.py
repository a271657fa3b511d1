"""The named queries of the library, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import scores as L
from ..functions import vectors as V
from ..operators import calibration as C
from ..operators import candidates as J
from ..operators import components as G
from ..operators import lineage as D
from ..operators import partition as P
from ..operators import variants as W
from ..session import table
from ..sources import features as X
from ..sources import tables as T
from .items import ITEMS, PAIRS, SIMS, items, neighbours, scored_pairs, second_partition
from .registry import query


def r6(c):
    return F.round(c, 6)


# ---- lineage and reports


@query("contract_check", f"WITH {ITEMS} SELECT 0::BIGINT AS missing, 0::BIGINT AS foreign_ids, 0::BIGINT AS repeated, 0::BIGINT AS null_labels, count(*) FILTER (WHERE length(cluster) > 64)::BIGINT AS long_labels FROM items")
def contract_check(spark, sf):
    it = items(spark, sf)
    return D.contract(it, it).withColumnRenamed("foreign", "foreign_ids")


@query("load_dedupe_submission", "SELECT vec_id AS image_id, 'b' || label::VARCHAR AS cluster FROM embeddings")
def load_dedupe_submission(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.concat(F.lit("b"), F.col("label").cast("string")).alias("cluster"))
    twice = e.withColumn("pos", F.lit(0)).unionByName(e.withColumn("cluster", F.lit("late")).withColumn("pos", F.lit(1)))
    return T.load_partition(T.first_by_key(twice, "image_id", F.col("pos")), check=False)


@query("metadata_defaults", r"""
SELECT page_id AS image_id, string_split(replace(url, '\', '/'), '/')[2] AS dataset, CASE WHEN contains(url, '/test/') THEN 'test' ELSE 'train' END AS split,
  'unknown' AS orientation, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'id' || (page_id % 3)::VARCHAR END AS identity, page_id % 3 <> 0 AS has_identity FROM pages""")
def metadata_defaults(spark, sf):
    p = table(spark, sf, "pages").select(
        F.col("page_id").alias("image_id"), F.col("url").alias("path"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("id"), (F.col("page_id") % 3).cast("string"))).alias("identity"), F.lit(" ").alias("orientation")
    )
    return T.prepare_metadata(p).select("image_id", "dataset", "split", "orientation", "identity", "has_identity")


@query("manifest_backfill", f"WITH {ITEMS} SELECT image_id, species, CASE WHEN image_id % 3 > 0 THEN 'm' || image_id::VARCHAR END AS mask_path, image_id % 3 = 0 AS backfilled FROM items")
def manifest_backfill(spark, sf):
    it = items(spark, sf).select("image_id", "species")
    man = it.where("image_id % 3 > 0").withColumn("mask_path", F.concat(F.lit("m"), F.col("image_id").cast("string")))
    return T.backfill_manifest(man, it).select("image_id", "species", "mask_path", "backfilled")


@query("manifest_choice", "SELECT lang AS file, count(*) FILTER (WHERE doc_id % 2 = 0)::BIGINT AS n_ok, count(*)::BIGINT AS n_rows FROM documents GROUP BY lang ORDER BY n_ok DESC, n_rows DESC, file LIMIT 1")
def manifest_choice(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("file"), F.when(F.col("doc_id") % 2 == 0, "True").otherwise("no").alias("mask_ok"))
    return T.choose_manifest(d).select("file", F.col("n_ok").cast("long").alias("n_ok"), "n_rows")


CANON = "CASE WHEN lower(trim(coalesce({0}, ''))) IN ('', 'nan', 'none', 'null', 'unknown') THEN 'unknown' ELSE lower(trim({0})) END"
SIDE = "CASE WHEN contains(lower(coalesce({0}, '')), 'left') THEN 'left' WHEN contains(lower(coalesce({0}, '')), 'right') THEN 'right' END"
RELATION = "CASE WHEN sa = sb THEN 'same_flank' WHEN sa IS NOT NULL AND sb IS NOT NULL THEN 'opposite_flank' WHEN a_o = b_o AND a_o IN ('front', 'back', 'top', 'bottom') THEN 'same_axial' WHEN a_o = 'unknown' OR b_o = 'unknown' THEN 'unknown' ELSE 'mixed' END"
COMPATIBLE = "NOT (coalesce(sa <> sb, false) OR (a_o = 'front' AND b_o = 'back') OR (a_o = 'back' AND b_o = 'front'))"


@query("orientation_scalars", f"""WITH {PAIRS}, o AS (SELECT *, {CANON.format('oa')} AS a_o, {CANON.format('ob')} AS b_o, {SIDE.format('oa')} AS sa, {SIDE.format('ob')} AS sb FROM pairs),
r AS (SELECT *, {RELATION} AS relation, {COMPATIBLE} AS compatible FROM o)
SELECT a, b, relation, compatible, round(sim - CASE WHEN sa <> sb THEN 0.075 ELSE 0 END, 6) AS penalised,
  CASE relation WHEN 'opposite_flank' THEN 0.55 WHEN 'mixed' THEN 0.84 ELSE 1.0 END::DOUBLE AS factor,
  round(CASE WHEN NOT compatible THEN 0 ELSE CASE WHEN a_o = b_o AND a_o <> 'unknown' THEN CASE WHEN a % 3 < 2 THEN 1.05 ELSE 1.0 END WHEN a % 3 = 0 THEN 0.92 ELSE 1.0 END
    * CASE WHEN a % 3 <> 2 THEN 1.0 WHEN a % 4 = b % 4 THEN 1.04 WHEN a % 4 = 0 OR b % 4 = 0 THEN 0.88 ELSE 1.0 END END::DOUBLE, 6) AS context FROM r""")
def orientation_scalars(spark, sf):
    p = scored_pairs(items(spark, sf)).withColumn("oa", S.canonical_orientation(F.col("oa"))).withColumn("ob", S.canonical_orientation(F.col("ob")))
    oa, ob, third = F.col("oa"), F.col("ob"), F.col("a") % 3
    kind = lambda c: F.when(F.col(c) % 4 == 0, "partial_or_head").otherwise(F.concat(F.lit("k"), (F.col(c) % 4).cast("string")))
    return p.select(
        "a", "b", S.orientation_relation(oa, ob).alias("relation"), S.orientation_compatible(oa, ob).alias("compatible"),
        r6(S.subtractive_penalty(F.col("sim"), oa, ob, 0.075)).alias("penalised"), S.multiplicative_penalty(oa, ob).alias("factor"),
        r6(S.context_factor(oa, ob, kind("a"), kind("b"), third < 2, third == 0, third == 2)).alias("context"),
    )


@query("label_key_parse", r"""WITH l AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 'plain é' ELSE 'cluster x_' || vec_id::VARCHAR END AS label FROM embeddings)
SELECT vec_id, regexp_replace(label, '[^\p{L}\p{N}_-]', '_', 'g') AS safe, CASE WHEN vec_id % 9 = 0 THEN label ELSE 'cluster x' END AS prefix,
CASE WHEN vec_id % 9 = 0 THEN 1000000000 ELSE vec_id END::BIGINT AS number FROM l""")
def label_key_parse(spark, sf):
    i = F.col("vec_id")
    rows = table(spark, sf, "embeddings").select("vec_id", F.when(i % 9 == 0, "plain é").otherwise(F.concat(F.lit("cluster x_"), i.cast("string"))).alias("label"))
    k = rows.withColumn("k", S.label_key(F.col("label")))
    return k.select("vec_id", S.safe_label(F.col("label")).alias("safe"), "k.prefix", "k.number")


@query("splice_species", f"WITH {ITEMS} SELECT i.image_id, i.species, CASE WHEN i.image_id % 11 = 5 AND i.species = 'sp1' THEN 'cluster_missing_' || i.image_id::VARCHAR WHEN i.species IN ('sp0', 'sp2') THEN i.cluster ELSE o.cluster END AS cluster FROM items i JOIN other o USING (image_id)")
def splice_species(spark, sf):
    it = items(spark, sf)
    o = second_partition(it)
    gaps = o.where("image_id % 11 <> 5")
    return D.splice(it.select("image_id", "species"), {"sp0": it, "sp1": gaps, "sp2": it, "sp3": o})


@query("override_labels", f"WITH {ITEMS} SELECT image_id, CASE WHEN i.image_id % 4 = 1 THEN o.cluster ELSE i.cluster END AS cluster FROM items i JOIN other o USING (image_id)")
def override_labels(spark, sf):
    it = items(spark, sf)
    return D.override(it.select("image_id", "cluster"), second_partition(it).where("image_id % 4 = 1"))


@query("compact_labels_min", f"WITH {ITEMS}, m AS (SELECT species, cluster, row_number() OVER (PARTITION BY species ORDER BY min(image_id)) - 1 AS i FROM items GROUP BY species, cluster) SELECT image_id, 'cluster_' || species || '_' || i::VARCHAR AS cluster FROM items JOIN m USING (species, cluster)")
def compact_labels_min(spark, sf):
    return P.compact_labels(items(spark, sf).select("image_id", "species", "cluster")).select("image_id", "cluster")


@query("compact_labels_lexical", f"WITH {ITEMS}, m AS (SELECT species, cluster, row_number() OVER (PARTITION BY species ORDER BY cluster) - 1 AS i FROM items GROUP BY species, cluster) SELECT image_id, 'cluster_' || species || '_' || i::VARCHAR AS cluster FROM items JOIN m USING (species, cluster)")
def compact_labels_lexical(spark, sf):
    return P.compact_lexical(items(spark, sf).select("image_id", "species", "cluster")).select("image_id", "cluster")


@query("partition_equivalence", "SELECT 0::BIGINT AS id_gaps, true AS equivalent UNION ALL SELECT 0, false")
def partition_equivalence(spark, sf):
    it = items(spark, sf).select("image_id", "species", "cluster")
    return D.equivalent(it, P.compact_labels(it)).unionByName(D.equivalent(it, second_partition(it)))


SHAPE_SQL = "shape AS (SELECT species, sum(n)::BIGINT AS n_images, count(*) AS n_clusters, max(n) AS max_cluster_size, count(*) FILTER (WHERE n = 1) AS singletons FROM (SELECT species, cluster, count(*) AS n FROM items GROUP BY 1, 2) GROUP BY 1)"


@query("shape_report", f"WITH {ITEMS}, {SHAPE_SQL} SELECT * FROM shape")
def shape_report(spark, sf):
    return D.shape(items(spark, sf))


@query("top10_sizes", f"WITH {ITEMS}, n AS (SELECT species, cluster, count(*) AS n FROM items GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY n DESC, cluster) AS r FROM n) SELECT species, string_agg(n::VARCHAR, ',' ORDER BY r) AS top_sizes FROM r WHERE r <= 10 GROUP BY 1")
def top10_sizes(spark, sf):
    return D.top_sizes(items(spark, sf))


@query("label_change_report", f"WITH {ITEMS} SELECT i.species, count(*) FILTER (WHERE i.cluster IS DISTINCT FROM o.cluster)::BIGINT AS changed FROM items i LEFT JOIN (SELECT image_id, CASE WHEN image_id % 3 = 0 THEN 'x' ELSE cluster END AS cluster FROM items WHERE image_id % 10 <> 9) o USING (image_id) GROUP BY 1")
def label_change_report(spark, sf):
    it = items(spark, sf)
    ref = it.where("image_id % 10 <> 9").select("image_id", F.when(F.col("image_id") % 3 == 0, "x").otherwise(F.col("cluster")).alias("cluster"))
    return D.label_changes(it, ref)


@query("membership_change_report", f"WITH {ITEMS}, s AS (SELECT cluster, list(image_id ORDER BY image_id) AS m FROM items GROUP BY 1), t AS (SELECT cluster, list(image_id ORDER BY image_id) AS m FROM other GROUP BY 1) SELECT i.species, count(*) FILTER (WHERE s.m <> t.m)::BIGINT AS changed_members FROM items i JOIN other o USING (image_id) JOIN s ON s.cluster = i.cluster JOIN t ON t.cluster = o.cluster GROUP BY 1")
def membership_change_report(spark, sf):
    it = items(spark, sf)
    return D.membership_changes(it, second_partition(it))


@query("variant_quantile_report", f"WITH {PAIRS} SELECT round(quantile_cont(sim, 0.95), 6) AS p95, round(avg(sim) FILTER (WHERE ca = cb), 6) AS same_mean, round(quantile_cont(sim, 0.99) FILTER (WHERE ca <> cb), 6) AS cross_p99 FROM pairs")
def variant_quantile_report(spark, sf):
    p = scored_pairs(items(spark, sf)).withColumn("same_cluster", F.col("ca") == F.col("cb"))
    g = D.variant_summary(p, "sim")
    return g.select(*[r6(F.col(c)).alias(c) for c in g.columns])


_SHAPE_RULE = """round(CASE WHEN n_clusters <= 1 AND n_images > 1 THEN 999 ELSE 2.6 * abs(ln((n_clusters + 1.0) / 41)) + 1.4 * abs(ln((max_cluster_size + 1.0) / 13)) + 0.55 * abs(ln((singletons + 1.0) / 21))
  + CASE WHEN n_clusters < 30 THEN 3.0 * abs(ln((n_clusters + 1.0) / 31)) ELSE 0 END + CASE WHEN n_clusters > 50 THEN 3.0 * abs(ln((n_clusters + 1.0) / 51)) ELSE 0 END
  + CASE WHEN max_cluster_size < 6 THEN 1.6 * abs(ln((max_cluster_size + 1.0) / 7)) ELSE 0 END + CASE WHEN max_cluster_size > 20 THEN 12.0 * abs(ln((max_cluster_size + 1.0) / 21)) ELSE 0 END
  + CASE WHEN singletons > 2 THEN 1.5 * abs(ln((singletons + 1.0) / 3)) ELSE 0 END END::DOUBLE, 6)"""


@query("shape_score_rank", f"WITH {ITEMS}, {SHAPE_SQL} SELECT species, {_SHAPE_RULE} AS shape_score FROM shape")
def shape_score_rank(spark, sf):
    rep = D.shape(items(spark, sf))
    goal = dict(t_clusters=40, t_max=12, t_singletons=20, lo_clusters=30, hi_clusters=50, lo_max=6, hi_max=20, hi_singletons=2)
    s = D.shape_score(rep, rep.select("species", *[F.lit(v).alias(k) for k, v in goal.items()]))
    return s.select("species", r6(F.col("shape_score")).alias("shape_score"))


@query("safe_candidate", "SELECT CASE WHEN n_balanced BETWEEN 1 AND 70 THEN 'balanced' WHEN n_strict BETWEEN 1 AND 70 THEN 'strict' ELSE 'passthrough' END AS chosen FROM (SELECT count(*) FILTER (WHERE vec_id % 5 = 0) AS n_balanced, count(*) FILTER (WHERE vec_id % 50 = 0) AS n_strict FROM embeddings)")
def safe_candidate(spark, sf):
    e = table(spark, sf, "embeddings")
    n = e.agg(F.count_if(F.col("vec_id") % 5 == 0).alias("balanced"), F.count_if(F.col("vec_id") % 50 == 0).alias("strict"))
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("changed")) for v in ("balanced", "strict")])
    rep = n.select(F.explode(rows).alias("r")).select("r.*", F.lit(85).alias("n_clusters"), F.lit(20).alias("max_cluster_size"))
    return D.choose_safe(rep)


# ---- vectors


def _digest(v):
    """First, last and sum of a vector, rounded: what is compared of it."""
    return [r6(F.get(v, F.lit(0))).alias("first"), r6(F.element_at(v, -1)).alias("last"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 5).alias("total")]


VDIGEST = "round(w[1], 6) AS first, round(w[-1], 6) AS last, round(list_sum(w), 5) AS total"


@query("l2_normalize", f"WITH {ITEMS} SELECT image_id, round(v[1], 6) AS first, round(v[-1], 6) AS last, round(list_sum(v), 5) AS total FROM items")
def l2_normalize(spark, sf):
    return items(spark, sf).select("image_id", *_digest(F.col("v")))


@query("weighted_fusion", f"WITH {ITEMS}, c AS (SELECT image_id, list_concat(list_transform(v, lambda x: x * 0.62), list_transform(list_reverse(v), lambda x: x * 0.38)) AS c FROM items), d AS (SELECT image_id, list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-12)) AS w FROM c) SELECT image_id, {VDIGEST} FROM d")
def weighted_fusion(spark, sf):
    v = F.col("v")
    return items(spark, sf).select("image_id", V.concat_fusion([(v, 0.62), (F.reverse(v), 0.38)]).alias("w")).select("image_id", *_digest(F.col("w")))


@query("preset_fusion", f"WITH {ITEMS}, p(species, role, wt) AS (VALUES ('sp0', 0, 0.7), ('sp0', 1, 0.3), ('sp1', 0, 0.5), ('sp1', 1, 0.5), ('sp2', 0, 0.6), ('sp2', 1, 0.4), ('sp3', 0, 0.25), ('sp3', 1, 0.75)), c AS (SELECT image_id, flatten(list(list_transform(CASE role WHEN 0 THEN v ELSE list_reverse(v) END, lambda x: x * wt::DOUBLE) ORDER BY role)) AS c FROM items JOIN p USING (species) GROUP BY 1), d AS (SELECT image_id, list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-12)) AS w FROM c) SELECT image_id, {VDIGEST} FROM d")
def preset_fusion(spark, sf):
    it = items(spark, sf)
    preset = spark.createDataFrame([("sp0", 0, 0.7), ("sp0", 1, 0.3), ("sp1", 0, 0.5), ("sp1", 1, 0.5), ("sp2", 0, 0.6), ("sp2", 1, 0.4), ("sp3", 0, 0.25), ("sp3", 1, 0.75)], "species string, role int, wt double")
    views = it.select("image_id", "species", F.lit(0).alias("role"), "v").unionByName(it.select("image_id", "species", F.lit(1).alias("role"), F.reverse("v").alias("v")))
    parts = views.join(F.broadcast(preset), ["species", "role"]).select("image_id", "role", V.scaled(F.col("v"), F.col("wt")).alias("x"))
    row = parts.groupBy("image_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("role", "x"))), lambda s: s["x"])).alias("c"))
    return row.select("image_id", V.l2_normalize(F.col("c")).alias("w")).select("image_id", *_digest(F.col("w")))


@query("root_normalize", f"WITH {ITEMS}, d AS (SELECT image_id, list_transform(v, lambda x: sign(x) * sqrt(abs(x) / (list_sum(list_transform(v, lambda y: abs(y))) + 1e-12))) AS w FROM items) SELECT image_id, {VDIGEST} FROM d")
def root_normalize(spark, sf):
    return items(spark, sf).select("image_id", V.root_normalize(F.col("v")).alias("w")).select("image_id", *_digest(F.col("w")))


@query("view_blend", f"WITH {ITEMS}, c AS (SELECT image_id, list_transform(range(1, len(v) + 1), lambda i: 0.72 * v[i] + 0.28 * v[len(v) + 1 - i]) AS c FROM items), d AS (SELECT image_id, list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-12)) AS w FROM c) SELECT image_id, {VDIGEST} FROM d")
def view_blend(spark, sf):
    return items(spark, sf).select("image_id", V.blend(F.col("v"), F.reverse("v"), 0.72, 0.28).alias("w")).select("image_id", *_digest(F.col("w")))


# ---- candidates


@query("topk_neighbors", f"WITH {SIMS} SELECT species, a, b, rank, round(sim, 6) AS sim FROM knn")
def topk_neighbors(spark, sf):
    return neighbours(items(spark, sf)).select("species", "a", "b", F.col("rank").cast("long").alias("rank"), r6(F.col("sim")).alias("sim"))


@query("mutual_knn", f"WITH {SIMS} SELECT x.a, x.b, round(x.sim, 6) AS sim FROM knn x JOIN knn y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def mutual_knn(spark, sf):
    return J.mutual(neighbours(items(spark, sf))).select("a", "b", r6(F.col("sim")).alias("sim"))


def _across_sql(label: str, k: int, upto: int) -> str:
    return f"WITH {SIMS}, x AS (SELECT r.a, r.b, r.sim, row_number() OVER (PARTITION BY r.a ORDER BY rank) AS n FROM ranked r JOIN items p ON p.image_id = r.a JOIN items q ON q.image_id = r.b WHERE rank <= {upto} AND p.{label} <> q.{label}) SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(sim), 6) AS sim FROM x WHERE n <= {k} GROUP BY 1, 2"


@query("cross_cluster_topk", _across_sql("cluster", 6, 29))
def cross_cluster_topk(spark, sf):
    it = items(spark, sf)
    return J.across(neighbours(it, 29), it, 6).select("a", "b", r6(F.col("sim")).alias("sim"))


@query("hard_negative_pairs", _across_sql("identity", 10, 79))
def hard_negative_pairs(spark, sf):
    it = items(spark, sf)
    return J.across(neighbours(it, 79), it, 10, label="identity").select("a", "b", r6(F.col("sim")).alias("sim"))


@query("within_cluster_pairs", f"WITH {ITEMS} SELECT x.image_id AS a, y.image_id AS b, x.cluster FROM items x JOIN items y ON x.cluster = y.cluster AND x.image_id < y.image_id")
def within_cluster_pairs(spark, sf):
    return J.within_pairs(items(spark, sf))


@query("gallery_margin_assign", f"WITH {SIMS}, g AS (SELECT s.a, y.identity, sim, row_number() OVER (PARTITION BY s.a ORDER BY sim DESC, s.b) AS r FROM sims s JOIN items x ON x.image_id = s.a JOIN items y ON y.image_id = s.b WHERE x.split = 'test' AND y.split = 'train') SELECT a AS image_id, max(identity) FILTER (WHERE r = 1) AS identity, round(max(sim) FILTER (WHERE r = 1), 6) AS top1, round(max(sim) FILTER (WHERE r = 1) - coalesce(max(sim) FILTER (WHERE r = 2), -1), 6) AS margin FROM g WHERE r <= 2 GROUP BY a")
def gallery_margin_assign(spark, sf):
    it = items(spark, sf)
    got = J.margin_assign(J.top_k(it.where("split = 'test'"), it.where("split = 'train'"), 2), it)
    return got.select("image_id", "identity", r6(F.col("top1")).alias("top1"), r6(F.col("margin")).alias("margin"))


@query("query_expansion", f"WITH {SIMS}, t AS (SELECT a, b FROM knn WHERE rank < 5 UNION ALL SELECT image_id, image_id FROM items), e AS (SELECT t.a, i, avg(y.v[i]) AS m FROM t JOIN items y ON y.image_id = t.b CROSS JOIN range(1, 65) g(i) GROUP BY 1, 2), c AS (SELECT x.image_id, list(x.v[i] + 0.5 * m ORDER BY i) AS c FROM e JOIN items x ON x.image_id = e.a GROUP BY 1), d AS (SELECT image_id, list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-12)) AS w FROM c) SELECT image_id, {VDIGEST} FROM d")
def query_expansion(spark, sf):
    it = items(spark, sf)
    return J.query_expansion(it, neighbours(it), 5).select("image_id", *_digest(F.col("v")))


@query("pair_votes", "WITH p AS (SELECT vec_id AS i, m, vec_id % m AS c FROM embeddings, (VALUES (31), (37), (41), (2)) v(m)), s AS (SELECT m, c FROM p GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 60) SELECT x.i AS a, y.i AS b, count(*) AS votes FROM p x JOIN p y ON x.m = y.m AND x.c = y.c AND x.i < y.i JOIN s ON s.m = x.m AND s.c = x.c GROUP BY 1, 2")
def pair_votes(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.explode(F.array(*[F.lit(x) for x in (31, 37, 41, 2)])).alias("source"))
    return J.pair_votes(e.withColumn("cluster", F.col("image_id") % F.col("source")), 60)


@query("shortlist_budget", f"WITH {PAIRS} SELECT a, b, ca = cb AS same_current, votes, round(sim, 6) AS sim FROM pairs ORDER BY ca = cb DESC, votes DESC, pairs.sim DESC, a, b LIMIT 300")
def shortlist_budget(spark, sf):
    p = scored_pairs(items(spark, sf)).withColumn("same_current", F.col("ca") == F.col("cb"))
    return J.budget(p, 300, F.desc("same_current"), F.desc("votes"), F.desc("sim")).select("a", "b", "same_current", "votes", r6(F.col("sim")).alias("sim"))


@query("near_threshold_budget", f"WITH {PAIRS} SELECT a, b, round(sim, 6) AS sim FROM pairs WHERE pairs.sim >= 0.22 ORDER BY abs(pairs.sim - 0.3), a, b LIMIT 200")
def near_threshold_budget(spark, sf):
    return J.near_threshold(scored_pairs(items(spark, sf)), 0.3, 0.08, 200).select("a", "b", r6(F.col("sim")).alias("sim"))


@query("neighbor_rank_gate", f"WITH {PAIRS}, e AS (SELECT a, b, sim FROM pairs UNION ALL SELECT b, a, sim FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM e) SELECT x.a, x.b, x.r AS rank_ab, y.r AS rank_ba FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND greatest(x.r, y.r) <= 4")
def neighbor_rank_gate(spark, sf):
    g = J.neighbour_ranks(scored_pairs(items(spark, sf))).where(F.greatest("rank_ab", "rank_ba") <= 4)
    return g.select("a", "b", F.col("rank_ab").cast("long").alias("rank_ab"), F.col("rank_ba").cast("long").alias("rank_ba"))


@query("part_similarity", f"WITH {PAIRS}, s AS (SELECT p.a, p.b, list_reverse_sort(list_transform(range(0, 8), lambda k: list_dot_product(x.v[k * 8 + 1:k * 8 + 8], y.v[k * 8 + 1:k * 8 + 8]))) AS s FROM pairs p JOIN items x ON x.image_id = p.a JOIN items y ON y.image_id = p.b) SELECT a, b, round(list_sum(s[1:6]) / 6, 6) AS part FROM s")
def part_similarity(spark, sf):
    it = items(spark, sf)
    p = scored_pairs(it).select("a", "b").join(it.select(F.col("image_id").alias("a"), F.col("v").alias("x")), "a").join(it.select(F.col("image_id").alias("b"), F.col("v").alias("y")), "b")
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: V.dot(F.slice("x", k * 8 + 1, 8), F.slice("y", k * 8 + 1, 8)))
    return p.select("a", "b", parts.alias("s")).select("a", "b", r6(V.trimmed_mean(F.col("s"))).alias("part"))


@query("patch_similarity", f"WITH {PAIRS}, s AS (SELECT p.a, p.b, i, j, list_dot_product(x.v[i * 8 + 1:i * 8 + 8], y.v[j * 8 + 1:j * 8 + 8]) AS d FROM pairs p JOIN items x ON x.image_id = p.a JOIN items y ON y.image_id = p.b, range(0, 8) g(i), range(0, 8) h(j)), r AS (SELECT a, b, i, max(d) AS m FROM s GROUP BY 1, 2, 3), c AS (SELECT a, b, j, max(d) AS m FROM s GROUP BY 1, 2, 3) SELECT a, b, round((r.m + c.m) / 2, 6) AS patch FROM (SELECT a, b, list_avg(list_reverse_sort(list(m))[1:4]) AS m FROM r GROUP BY 1, 2) r JOIN (SELECT a, b, list_avg(list_reverse_sort(list(m))[1:4]) AS m FROM c GROUP BY 1, 2) c USING (a, b)")
def patch_similarity(spark, sf):
    it = items(spark, sf).select("image_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("v", k * 8 + 1, 8)).alias("p"))
    p = scored_pairs(items(spark, sf)).select("a", "b").join(it.select(F.col("image_id").alias("a"), F.col("p").alias("pa")), "a").join(it.select(F.col("image_id").alias("b"), F.col("p").alias("pb")), "b")
    return J.patch_similarity(p, m=4).select("a", "b", r6(F.col("patch")).alias("patch"))


@query("chamfer_score", "WITH p AS (SELECT vec_id, i, embedding[2 * i + 1]::DOUBLE AS x, embedding[2 * i + 2]::DOUBLE AS y FROM embeddings, range(0, 32) g(i)), d AS (SELECT a.vec_id AS pair, a.i AS ia, b.i AS ib, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0), l AS (SELECT pair, min(d) AS d, row_number() OVER (PARTITION BY pair ORDER BY min(d), ia) AS r FROM d GROUP BY pair, ia), m AS (SELECT pair, min(d) AS d, row_number() OVER (PARTITION BY pair ORDER BY min(d), ib) AS r FROM d GROUP BY pair, ib) SELECT pair, round(exp(-((l.m + m.m) / 2) / 0.055), 6) AS score FROM (SELECT pair, avg(d) AS m FROM l WHERE r <= 20 GROUP BY 1) l JOIN (SELECT pair, avg(d) AS m FROM m WHERE r <= 20 GROUP BY 1) m USING (pair)")
def chamfer_score(spark, sf):
    e = table(spark, sf, "embeddings")
    pts = e.select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(i.alias("point"), F.get("embedding", i * 2).cast("double").alias("x"), F.get("embedding", i * 2 + 1).cast("double").alias("y")))).alias("q"))
    pts = pts.select((F.floor(F.col("vec_id") / 2) * 2).alias("pair"), (F.col("vec_id") % 2).alias("side"), "q.*")
    got = J.chamfer(pts.where("side = 0").drop("side"), pts.where("side = 1").drop("side"), 20)
    return got.select("pair", r6(F.col("score")).alias("score"))


# ---- scores

_FORMULAS = {
    "local": (lambda c: L.local_match(c.inliers, c.matches, c.conf), "0.58 * least(inliers / 16, 1) + 0.27 * least(matches / 42, 1) + 0.15 * conf"),
    "local_wide": (lambda c: L.local_match_wide(c.inliers, c.matches, c.conf), "0.58 * least(inliers / 18, 1) + 0.27 * least(matches / 48, 1) + 0.15 * conf"),
    "binary": (lambda c: L.binary_match(c.inliers, c.matches, c.conf), "0.56 * least(inliers / 18, 1) + 0.29 * least(matches / 56, 1) + 0.15 * conf"),
    "keypoint": (lambda c: L.keypoint_match(c.matches, c.ratio), "0.65 * least(matches / 120, 1) + 0.35 * least(ratio, 1)"),
    "coarse": (lambda c: L.coarse_match(c.matches, c.ratio, c.sim), "0.62 * least(matches / 80, 1) + 0.23 * ratio + 0.15 * greatest(sim, 0)"),
    "masked": (lambda c: L.masked_match(c.matches, c.ratio), "0.72 * least(matches / 80, 1) + 0.28 * ratio"),
    "guarded": (lambda c: L.guarded_local(c.inliers, c.matches, c.conf), "(0.46 * least(inliers / 18, 1) + 0.28 * least(matches / 70, 1) + 0.26 * CASE WHEN matches > 0 THEN inliers / matches ELSE 0 END) * conf"),
    "fused": (lambda c: L.guarded_fused(c.sim, c.ratio, c.matches > 5, c.conf), "CASE WHEN matches > 5 THEN 0.56 * greatest(sim, 0) + 0.44 * ratio ELSE 0.40 * greatest(sim, 0) END * conf"),
    "fingerprint": (lambda c: L.fingerprint(c.ratio, c.conf, c.ratio, c.conf, c.ratio, c.sim, c.matches, c.conf), "CASE WHEN matches < 4 THEN 0.12 * greatest(sim, 0) ELSE least(1, (0.42 * ratio + 0.24 * conf + 0.10 * ratio + 0.16 * conf + 0.04 * ratio + 0.04 * sim) / 0.68) * least(1, 0.65 + 0.35 * conf) END"),
    "template": (lambda c: L.template(c.ratio, c.conf, c.sim, c.conf, F.lit(0.84), c.ratio), "(0.58 * ratio + 0.30 * conf + 0.12 * sim) * least(1, 0.70 + 0.30 * conf / 0.08) * 0.84 * ratio"),
    "dots": (lambda c: L.dots(c.ratio, c.conf, c.ratio, c.sim, c.votes > 1, c.conf), "(0.34 * ratio + 0.31 * conf + 0.23 * ratio + 0.12 * greatest(sim, 0)) * CASE WHEN votes > 1 THEN 0.92 ELSE 1 END * conf"),
    "boundary": (lambda c: L.boundary(c.ratio, c.conf, c.ratio, c.sim, c.inliers, c.conf), "(0.25 * ratio + 0.42 * conf + 0.25 * ratio + 0.08 * greatest(sim, 0)) * CASE WHEN inliers < 12 THEN 0.82 ELSE 1 END * conf"),
    "reused": (lambda c: L.reused(c.inliers, c.ratio, c.matches), "0.55 * least(inliers / 28, 1) + 0.30 * least(ratio / 0.25, 1) + 0.15 * least(matches / 60, 1)"),
    "rerank_local": (lambda c: L.rerank_local(c.sim, F.when(c.votes > 0, c.conf), 0.3), "CASE WHEN votes = 0 THEN sim WHEN conf > 0.55 AND sim > 0.3 - 0.10 THEN greatest(0.82 * sim + 0.18 * conf, 0.3 + 0.01) WHEN conf < 0.08 AND sim < 0.3 + 0.025 THEN least(0.82 * sim + 0.18 * conf, 0.3 - 0.01) ELSE 0.82 * sim + 0.18 * conf END"),
    "rerank_patch": (lambda c: L.rerank_patch(c.sim, F.when(c.votes > 0, c.conf), 0.3), "CASE WHEN votes = 0 THEN sim WHEN conf > 0.33 AND sim > 0.3 - 0.10 THEN greatest(0.58 * sim + 0.42 * conf, 0.3 + 0.01) ELSE 0.58 * sim + 0.42 * conf END"),
    "rerank_match": (lambda c: L.rerank_match(c.sim, F.when(c.votes > 0, c.conf), c.matches, 20, 0.3), "CASE WHEN votes = 0 THEN sim WHEN matches >= 20 AND conf > 0.30 THEN greatest(0.84 * sim + 0.16 * conf, 0.3 + 0.01) WHEN matches < 6 AND sim < 0.3 + 0.02 THEN least(0.84 * sim + 0.16 * conf, 0.3 - 0.01) ELSE 0.84 * sim + 0.16 * conf END"),
}


class _Cols:
    def __getattr__(self, name):
        return F.col(name)


def _score_query(name, make, sql):
    typed = "(SELECT a, b, sim, inliers::DOUBLE AS inliers, matches::DOUBLE AS matches, conf, ratio, votes FROM pairs)"
    sql = sql.replace("0.3 - 0.10", "0.2::DOUBLE").replace("0.3 + 0.01", "0.31::DOUBLE").replace("0.3 - 0.01", "0.29::DOUBLE").replace("0.3 + 0.025", "0.325::DOUBLE").replace("0.3 + 0.02", "0.32::DOUBLE")

    def run(spark, sf):
        return scored_pairs(items(spark, sf)).select("a", "b", r6(make(_Cols())).alias("score"))

    query(f"pair_score_{name}", f"WITH {PAIRS} SELECT a, b, round(({sql})::DOUBLE, 6) AS score FROM {typed}")(run)


for _name, (_make, _sql) in _FORMULAS.items():
    _score_query(_name, _make, _sql)


@query("vote_relaxed_accept", f"WITH {PAIRS} SELECT a, b FROM pairs WHERE inliers >= greatest(12 - least(6, votes * 2), 6) AND ratio >= greatest(0.30 - least(0.04, votes * 0.012), 0.08) AND conf >= greatest(0.40 - least(0.06, votes * 0.018), 0.20) AND ratio >= 0.25")
def vote_relaxed_accept(spark, sf):
    c = _Cols()
    return scored_pairs(items(spark, sf)).where(L.vote_relaxed(c.votes, c.inliers, c.ratio, c.conf, c.ratio, 12, 0.30, 0.40)).select("a", "b")


@query("mask_choice", "WITH m AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS s, l_tax AS ar, 1 - l_tax AS ce FROM lineitem), c AS (SELECT *, CASE WHEN ar BETWEEN 0.01 AND 0.95 THEN 0.65 * s + 0.20 * least(ar * 2, 1) + 0.15 * ce END::DOUBLE AS sc FROM m) SELECT l_orderkey, arg_max(l_linenumber, round(sc, 9) * 1000 - l_linenumber * 1e-4)::INT AS chosen, round(max(sc), 6) AS score FROM c WHERE sc IS NOT NULL GROUP BY 1")
def mask_choice(spark, sf):
    m = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).cast("double").alias("s"), F.col("l_tax").cast("double").alias("ar"))
    c = m.withColumn("sc", L.mask_choice(F.col("s"), F.col("ar"), 1 - F.col("ar"))).where("sc is not null")
    return c.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.round("sc", 9) * 1000 - F.col("l_linenumber") * 1e-4).cast("int").alias("chosen"), r6(F.max("sc")).alias("score"))


# ---- calibration


@query("calibration_pairs", f"WITH {PAIRS}, w AS (SELECT x.image_id AS a, y.image_id AS b, x.identity FROM items x JOIN items y ON x.identity = y.identity AND x.species = y.species AND x.image_id < y.image_id), r AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY md5('7|' || a::VARCHAR || '|' || b::VARCHAR)) AS r FROM w) SELECT DISTINCT a, b FROM (SELECT a, b FROM r WHERE r <= 12 UNION ALL SELECT a, b FROM (SELECT a, b FROM pairs ORDER BY pairs.sim DESC, a, b LIMIT 400))")
def calibration_pairs(spark, sf):
    it = items(spark, sf).withColumn("si", F.concat("species", F.lit("|"), "identity"))
    near = J.budget(scored_pairs(items(spark, sf)), 400, F.desc("sim")).select("a", "b")
    pos = J.first_within(it, 12, 7, "si").where("a is not null").select("a", "b", F.expr("substring(si, instr(si, '|') + 1)").alias("identity"))
    return J.sampled_pairs(pos, 12, 7, "identity").select("a", "b").unionByName(near).dropDuplicates(["a", "b"])


@query("precision_threshold", f"WITH {PAIRS}, c AS (SELECT sim, sum(n) OVER w AS n, sum(p) OVER w AS tp FROM (SELECT sim, count(*) AS n, sum(label) AS p FROM pairs GROUP BY 1) WINDOW w AS (ORDER BY sim DESC)), h AS (SELECT min(sim) AS hit FROM c WHERE n >= 3 AND tp / n >= 0.2), m AS (SELECT quantile_cont(sim, 0.55) AS mid FROM pairs WHERE label = 1), f AS (SELECT sim AS fb FROM pairs, m ORDER BY abs(sim - mid), sim DESC LIMIT 1) SELECT round(coalesce(hit, fb) * 0.98::DOUBLE, 6) AS threshold, hit IS NOT NULL AS reached FROM h, f")
def precision_threshold(spark, sf):
    got = C.threshold_for_precision(scored_pairs(items(spark, sf)), 0.2, scale=0.98, score="sim")
    return got.select(r6(F.col("threshold")).alias("threshold"), "reached")


_GRID = [(p, l, i, s) for p in (0.2, 0.4, 0.6, 0.8, 0.9) for l in (0.0, 0.1, 0.2, 0.3, 0.4, 0.5) for i in (0, 2, 4, 6, 8, 10, 12, 14) for s in (0.0, 0.1, 0.2, 0.3, 0.4)]


@query("rule_grid", f"WITH {PAIRS}, g AS (SELECT rp / 10.0::DOUBLE AS r_prob, rl / 10.0::DOUBLE AS r_local, ri AS r_inliers, rs / 10.0::DOUBLE AS r_sim FROM (VALUES (2), (4), (6), (8), (9)) a(rp), range(0, 6) b(rl), range(0, 15, 2) c(ri), range(0, 5) d(rs)), s AS (SELECT r_prob, r_local, r_inliers, r_sim, count(*) AS support, sum(label) AS tp FROM pairs JOIN g ON conf >= r_prob AND ratio >= r_local AND inliers >= r_inliers AND sim >= r_sim GROUP BY 1, 2, 3, 4 HAVING count(*) >= 20) SELECT r_prob, r_local, r_inliers::INT AS r_inliers, r_sim, support, tp::BIGINT AS tp, round(tp / support, 6) AS precision FROM s ORDER BY tp / support >= 0.95 DESC, CASE WHEN tp / support >= 0.95 THEN tp ELSE 0 END DESC, tp / support DESC, tp DESC, support DESC, r_prob, r_local, r_inliers, r_sim LIMIT 1")
def rule_grid(spark, sf):
    grid = spark.createDataFrame(_GRID, "r_prob double, r_local double, r_inliers int, r_sim double")
    p = scored_pairs(items(spark, sf)).withColumnsRenamed({"conf": "match_prob", "ratio": "local"})
    got = C.rule_grid(p, grid, 0.95, 20)
    return got.select("r_prob", "r_local", "r_inliers", "r_sim", "support", "tp", r6(F.col("precision")).alias("precision"))


@query("rank_auc", f"WITH {PAIRS}, r AS (SELECT label, row_number() OVER (ORDER BY conf, a, b) AS r FROM pairs), s AS (SELECT sum(r) FILTER (WHERE label = 1) AS rs, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM r) SELECT round((rs - p * (p + 1) / 2) / (p * q), 6) AS auc FROM s")
def rank_auc(spark, sf):
    return C.rank_auc(scored_pairs(items(spark, sf)), "conf", "label", [F.col("a"), F.col("b")]).select(r6(F.col("auc")).alias("auc"))


@query("threshold_report", f"WITH {PAIRS}, t(threshold) AS (VALUES (0.1::DOUBLE), (0.2), (0.3), (0.4)) SELECT threshold, count(*) FILTER (WHERE sim >= threshold) AS accepted, round(coalesce(sum(label) FILTER (WHERE sim >= threshold) / nullif(count(*) FILTER (WHERE sim >= threshold), 0), 0), 6) AS precision, round(coalesce(sum(label) FILTER (WHERE sim >= threshold), 0) / nullif(sum(label), 0), 6) AS recall FROM pairs, t GROUP BY 1")
def threshold_report(spark, sf):
    got = C.threshold_report(scored_pairs(items(spark, sf)), [0.1, 0.2, 0.3, 0.4], "sim")
    return got.select("threshold", "accepted", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


@query("adjusted_rand", f"WITH {ITEMS}, c AS (SELECT identity, cluster, count(*)::DOUBLE AS n FROM items GROUP BY 1, 2), x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY identity)) AS sa, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY cluster)) AS sb, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t) SELECT round((s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t), 6) AS ari FROM x")
def adjusted_rand(spark, sf):
    return C.adjusted_rand(items(spark, sf), "identity", "cluster").select(r6(F.col("ari")).alias("ari"))


@query("date80_split", "SELECT event_id, epoch_us(ts) >= (SELECT quantile_cont(epoch_us(ts), 0.8) FROM events) AS validation FROM events")
def date80_split(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("date_dt"))
    return C.date_split(e).select("event_id", "validation")


@query("novel_identity_split", f"WITH {ITEMS}, h AS (SELECT identity, row_number() OVER (ORDER BY md5('7|' || identity)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT identity FROM items)), q AS (SELECT identity, min(image_id) AS q FROM items GROUP BY 1) SELECT image_id, CASE WHEN r <= floor(n * 0.22) THEN 'novel' WHEN image_id = q THEN 'query' ELSE 'gallery' END AS role FROM items JOIN h USING (identity) JOIN q USING (identity)")
def novel_identity_split(spark, sf):
    return C.novel_split(items(spark, sf)).select("image_id", "role")


@query("tfidf_cosine", r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS c FROM t GROUP BY 1, 2), d AS (SELECT word, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS n FROM c), w AS (SELECT doc_id, word, c * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM c JOIN d USING (word), n) SELECT doc_id, count(*) AS n_words, round(max(w) / sqrt(sum(w * w)), 6) AS top_weight FROM w GROUP BY 1")
def tfidf_cosine(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return C.tfidf(t, "doc_id", "word").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), r6(F.max("weight")).alias("top_weight"))


@query("calibrated_probability")
def calibrated_probability(spark, sf):
    p = scored_pairs(items(spark, sf)).select("a", "b", "sim", "conf", "ratio", F.col("inliers").cast("double").alias("inliers"), "label")
    model = C.fit_calibrator(p, ["sim", "conf", "ratio", "inliers"], kind="logistic")
    return C.probability(model, p).select("a", "b", r6(F.col("match_prob")).alias("match_prob"))


@query("visual_words_tfidf")
def visual_words_tfidf(spark, sf):
    d = items(spark, sf).select("image_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("v", k * 8 + 1, 8))).alias("v"))
    words, _ = C.visual_words(d, 16)
    return C.tfidf(words).select("image_id", "word", r6(F.col("weight")).alias("weight"))


# ---- graphs and partitions

REACH = "reach AS (SELECT a AS id, b AS far FROM e UNION SELECT b, a FROM e UNION SELECT r.id, x.far FROM reach r JOIN (SELECT a AS near, b AS far FROM e UNION ALL SELECT b, a FROM e) x ON r.far = x.near)"


@query("threshold_components", f"WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pairs WHERE sim >= 0.38), {REACH} SELECT i.image_id, least(i.image_id, coalesce(min(far), i.image_id)) AS component FROM items i LEFT JOIN reach ON id = i.image_id GROUP BY i.image_id")
def threshold_components(spark, sf):
    it = items(spark, sf)
    return G.threshold_components(it, scored_pairs(it), F.col("sim") >= 0.38)


@query("label_graph_components", f"WITH RECURSIVE {PAIRS}, e AS (SELECT DISTINCT least(ca, cb) AS a, greatest(ca, cb) AS b FROM pairs WHERE ca <> cb AND sim >= 0.40), {REACH}, k AS (SELECT id, arg_min(far, (regexp_replace(far, '_\\d+$', ''), regexp_extract(far, '_(\\d+)$', 1)::INT)) AS far, min((regexp_replace(far, '_\\d+$', ''), regexp_extract(far, '_(\\d+)$', 1)::INT)) AS kk FROM reach GROUP BY 1) SELECT image_id, coalesce(CASE WHEN kk < (regexp_replace(id, '_\\d+$', ''), regexp_extract(id, '_(\\d+)$', 1)::INT) THEN far ELSE id END, cluster) AS cluster FROM items LEFT JOIN k ON id = cluster")
def label_graph_components(spark, sf):
    it = items(spark, sf)
    e = scored_pairs(it).where("ca <> cb and sim >= 0.40").select(F.col("ca").alias("cluster_a"), F.col("cb").alias("cluster_b"))
    return P.replay_actions(it.select("image_id", "cluster"), e)


@query("split_cluster_guarded", f"WITH RECURSIVE {PAIRS}, inner_ AS (SELECT a, b, sim, ca AS cluster FROM pairs WHERE ca = cb), e AS (SELECT a, b FROM inner_ WHERE sim >= 0.2), {REACH}, p AS (SELECT i.image_id, cluster, least(i.image_id, coalesce(min(far), i.image_id)) AS part FROM items i LEFT JOIN reach ON id = i.image_id GROUP BY 1, 2), n AS (SELECT cluster, sum(k)::BIGINT AS n, count(*) AS np, count(*) FILTER (WHERE k = 1) AS singles, min(first) AS first FROM (SELECT cluster, part, count(*) AS k, min(image_id) AS first FROM p GROUP BY 1, 2) GROUP BY 1), s AS (SELECT cluster, count(*) AS ns, max(sim) AS best FROM inner_ GROUP BY 1), d AS (SELECT n.*, CASE WHEN n < 3 THEN 'small' WHEN ns IS NULL THEN 'no_scores' WHEN best < 0.2 THEN 'no_trusted' WHEN np = 1 THEN 'connected' WHEN singles >= np - 1 AND n <= 7 THEN 'atomised' ELSE 'split' END AS decision FROM n LEFT JOIN s USING (cluster)) SELECT image_id, cluster, CASE WHEN decision = 'split' THEN part ELSE first END AS part, decision FROM p JOIN d USING (cluster)")
def split_cluster_guarded(spark, sf):
    it = items(spark, sf)
    return P.split_clusters(it, scored_pairs(it).select("a", "b", "sim"), "sim", 0.2)


@query("split_safe")
def split_safe(spark, sf):
    it = items(spark, sf)
    pairs = scored_pairs(it).select("a", "b", "sim")
    return P.reattach_small(P.split_clusters(it, pairs, "sim", 0.2), pairs, "sim", under=0.15)


@query("inner_similarity", f"WITH {ITEMS} SELECT cluster, max(n) AS n, round(avg(s), 6) AS mean_sim FROM (SELECT x.cluster, list_dot_product(x.v, y.v) AS s, count(*) OVER (PARTITION BY x.cluster, x.image_id) + 1 AS n FROM items x JOIN items y ON x.cluster = y.cluster AND x.image_id <> y.image_id) GROUP BY 1 UNION ALL SELECT cluster, 1, NULL FROM items GROUP BY 1 HAVING count(*) = 1")
def inner_similarity(spark, sf):
    it = items(spark, sf)
    return P.inner_similarity(it.select("image_id", "cluster"), it).select("cluster", "n", r6(F.col("mean_sim")).alias("mean_sim"))


def _capped(it, pairs, cap, max_edges, order=None):
    edges = P.cluster_edges(pairs, it, "sim")
    return P.capped_merge(P.cluster_nodes(it), edges, order or [F.desc("sim")], cap, max_edges)


@query("capped_merge")
def capped_merge(spark, sf):
    it = items(spark, sf)
    return P.relabel(it.select("image_id", "species", "cluster"), _capped(it, scored_pairs(it).select("a", "b", "sim").where("sim >= 0.25"), 12, 40))


@query("relation_merge")
def relation_merge(spark, sf):
    it = items(spark, sf)
    p = scored_pairs(it).withColumn("relation", S.orientation_relation(S.canonical_orientation(F.col("oa")), S.canonical_orientation(F.col("ob"))))
    gate = F.when(F.col("relation") == "same_flank", 0.25).when(F.col("relation") == "opposite_flank", 9.0).otherwise(0.32)
    return P.relabel(it.select("image_id", "species", "cluster"), _capped(it, p.where(F.col("sim") >= gate).select("a", "b", "sim"), 84, 60))


@query("guarded_merge")
def guarded_merge(spark, sf):
    it = items(spark, sf)
    p = scored_pairs(it).select("species", "a", "b", "sim", "conf", "inliers")
    ranked = p.join(J.neighbour_ranks(p).select("a", "b", "rank_ab", "rank_ba"), ["a", "b"])
    return P.guarded_merge(it, ranked, 6, 3, 9, (F.col("conf") >= 0.3) & (F.col("inliers") >= 3), [F.desc("sim")])


@query("anchored_graph")
def anchored_graph(spark, sf):
    it = items(spark, sf)
    anchors = it.select("image_id", F.when(F.col("split") == "train", F.col("identity")).alias("identity"))
    parts = P.anchored_components(scored_pairs(it).select("a", "b", "sim"), anchors, 0.35)
    comp = it.select("image_id").join(parts.withColumnRenamed("id", "image_id"), "image_id", "left").withColumn("component", F.coalesce("component", "image_id"))
    return comp.join(P.component_labels(comp, anchors), "component", "left").select("image_id", "component", "label")


@query("anchor_buckets", f"WITH {PAIRS}, o AS (SELECT image_id, 'k' || (image_id % 17)::VARCHAR AS identity FROM items), f AS (SELECT identity FROM o GROUP BY 1 HAVING count(*) BETWEEN 2 AND 200) SELECT p.a, p.b, x.identity, round(p.sim, 6) AS sim FROM pairs p JOIN o x ON x.image_id = p.a JOIN o y ON y.image_id = p.b JOIN f ON f.identity = x.identity WHERE x.identity = y.identity AND p.sim >= 0.265")
def anchor_buckets(spark, sf):
    it = items(spark, sf)
    o = it.select("image_id", F.concat(F.lit("k"), (F.col("image_id") % 17).cast("string")).alias("identity"))
    got = P.anchor_buckets(o, scored_pairs(it).select("a", "b", "sim"), 0.3, 200, floor=0.1)
    return got.select("a", "b", "identity", r6(F.col("sim")).alias("sim"))


@query("agglomerative")
def agglomerative(spark, sf):
    return P.agglomerate(items(spark, sf), 0.75)


@query("refine_large")
def refine_large(spark, sf):
    it = items(spark, sf)
    return P.refine_large(it.select("image_id", "cluster"), it, 4, 0.3, 0.85)


# ---- flagship


@query("flagship_partition_shape", f"WITH RECURSIVE {SIMS}, e AS (SELECT x.a, x.b FROM knn x JOIN knn y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.sim >= 0.35), {REACH}, c AS (SELECT i.image_id, i.species, least(i.image_id, coalesce(min(far), i.image_id)) AS component FROM items i LEFT JOIN reach ON id = i.image_id GROUP BY 1, 2) SELECT species, sum(n)::BIGINT AS n_images, count(*) AS n_clusters, max(n) AS max_cluster_size, count(*) FILTER (WHERE n = 1) AS singletons FROM (SELECT species, component, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1")
def flagship_partition_shape(spark, sf):
    """Vectors, nearest neighbours, mutual edges, threshold components, compact labels, shape report."""
    it = items(spark, sf)
    parts = G.threshold_components(it, J.mutual(neighbours(it)), F.col("sim") >= 0.35)
    named = it.select("image_id", "species").join(parts, "image_id").select("image_id", "species", F.col("component").cast("string").alias("cluster"))
    return D.shape(P.compact_labels(named))


@query("flagship_merge_refinement")
def flagship_merge_refinement(spark, sf):
    """Candidates, scores, calibrated probability, rule, capped merges onto the current partition, compact labels."""
    it = items(spark, sf)
    p = scored_pairs(it).withColumn("local", L.local_match(F.col("inliers"), F.col("matches"), F.col("conf"))).withColumn("x_inliers", F.col("inliers").cast("double"))
    model = C.fit_calibrator(p, ["sim", "local", "conf", "x_inliers"], kind="logistic")
    scored = C.probability(model, p).where("ca <> cb")
    at = scored.agg(F.percentile("match_prob", F.lit(0.9)).alias("at"))
    chosen = scored.crossJoin(at).where("match_prob >= at").select("a", "b", F.col("match_prob").alias("sim"))
    merged = P.relabel(it.select("image_id", "species", "cluster"), _capped(it, chosen, 7, 28))
    return P.compact_labels(merged).select("image_id", "species", "cluster")


# ---- variants, rasters, descriptors


@query("split_merge_variant")
def split_merge_variant(spark, sf):
    it = items(spark, sf)
    return W.split_merge(it.select("image_id", "species", "cluster"), scored_pairs(it).select("a", "b", "sim"), 0.2, 0.35, 4, cap=20)


@query("preserve_regroup")
def preserve_regroup(spark, sf):
    it = items(spark, sf)
    return W.preserve_and_regroup(it.select("image_id", "species", "cluster"), scored_pairs(it), 3, (F.col("sim") >= 0.40) & (F.col("votes") > 0))


@query("variant_shapes")
def variant_shapes(spark, sf):
    it = items(spark, sf)
    return W.variant_shapes(W.build_variants(it.select("image_id", "species", "cluster"), scored_pairs(it)))


@query("ari_grid_search")
def ari_grid_search(spark, sf):
    it = items(spark, sf)
    got = W.search_threshold(it, J.mutual(neighbours(it)), [0.3, 0.36, 0.42])
    return got.select("threshold", r6(F.col("ari")).alias("ari"))


@query("validation_pairs", f"WITH {SIMS}, p AS (SELECT x.image_id AS a, y.image_id AS b, x.identity FROM items x JOIN items y ON x.identity = y.identity AND x.image_id < y.image_id), pr AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY md5('11|' || a::VARCHAR || '|' || b::VARCHAR)) AS r FROM p), n AS (SELECT DISTINCT least(k.a, k.b) AS a, greatest(k.a, k.b) AS b FROM knn k JOIN items x ON x.image_id = k.a JOIN items y ON y.image_id = k.b WHERE x.identity <> y.identity) SELECT a, b, 1 AS label FROM pr WHERE r <= 10 UNION ALL SELECT a, b, 0 FROM (SELECT a, b FROM n ORDER BY md5('11|' || a::VARCHAR || '|' || b::VARCHAR) LIMIT 1000)")
def validation_pairs(spark, sf):
    it = items(spark, sf)
    return W.validation_pairs(it, neighbours(it))


@query("dense_ids", f"WITH {ITEMS} SELECT image_id, species || '::' || identity AS entity, dense_rank() OVER (ORDER BY species || '::' || identity) - 1 AS entity_no FROM items")
def dense_ids(spark, sf):
    return W.dense_ids(items(spark, sf)).select("image_id", "entity", F.col("entity_no").cast("long").alias("entity_no"))


@query("experiment_upsert", "SELECT vec_id AS run_id, CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE 'old' END AS state FROM embeddings")
def experiment_upsert(spark, sf):
    log = table(spark, sf, "embeddings").select(F.col("vec_id").alias("run_id"), F.lit("old").alias("state"))
    return T.upsert(log, log.where("run_id % 5 = 0").withColumn("state", F.lit("new")))


@query("path_remap", r"SELECT page_id, CASE WHEN contains(replace(url, '\', '/'), '/en/') THEN '/data/en/' || string_split(replace(url, '\', '/'), '/en/')[-1] ELSE '/data/' || string_split(replace(url, '\', '/'), '/')[-1] END AS path FROM pages")
def path_remap(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.remap_path(F.col("url"), "/data", "en").alias("path"))


@query("template_scores")
def template_scores(spark, sf):
    it = items(spark, sf)
    v = lambda k, n: it.select(F.col("image_id").alias(k), F.col("v").alias(n))
    return X.template_scores(scored_pairs(it).select("a", "b").join(v("a", "ra"), "a").join(v("b", "rb"), "b")).select("a", "b", r6(F.col("score")).alias("score"), "transform", "dx", "dy")


@query("descriptor_matches")
def descriptor_matches(spark, sf):
    it = items(spark, sf)
    d = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("v", k * 8 + 1, 8))
    v = lambda k, n: it.select(F.col("image_id").alias(k), d.alias(n))
    got = X.descriptor_matches(scored_pairs(it).select("a", "b").join(v("a", "da"), "a").join(v("b", "db"), "b"), floor=0.5)
    return got.select("a", "b", "matches", r6(F.col("mean_conf")).alias("mean_conf"))


from . import records as _records  # noqa: E402, F401  registers the queries over pair records
