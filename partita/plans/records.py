"""Queries over pair records, training pairs, reports and row numbers, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as C
from ..operators import candidates as J
from ..operators import components as G
from ..operators import order as O
from ..operators import records as R
from ..session import table
from ..sources import tables as T
from .items import ITEMS, PAIRS, SIMS, items, neighbours, scored_pairs
from .queries import CANON, RELATION, SIDE, r6
from .registry import query

_SCALE = (1.0, -1.0, 0.5)


def _records(spark, sf, kind):
    it = items(spark, sf)
    i = F.col("image_id")
    by = F.element_at(F.array(*[F.lit(x) for x in _SCALE]), (i % 3 + 1).cast("int"))
    other = F.transform("v", lambda x: x * by)
    views = it.select("image_id", "orientation", F.col("v").alias("orig"), other.alias("norm"), other.alias("hflip"), (i % 10 / 10.0).alias("lum_mean"))
    pairs = scored_pairs(it).select("a", "b")
    a, b = F.col("a"), F.col("b")
    found = None
    for k, (name, _, _) in enumerate(R.COMBINATIONS[kind]):
        m = pairs.where((a + b + k) % 5 != 0).select(
            "a", "b", F.lit(name).alias("view"), ((a * 3 + b * (k + 1)) % 50 / 50.0).alias("local_score"),
            ((a * 7 + b * 3 + k) % 90).alias("matches"), ((a + b * 5 + k) % 40).alias("inliers"), ((a + b + k) % 100 / 100.0).alias("mean_conf"),
        )
        found = m if found is None else found.unionByName(m)
    got = R.pair_records(pairs, views, found, kind)
    said = [F.round(c, 6).alias(c.replace("local_best", "local_top")) for c in ("sim_best01", "local_best", "mean_conf")]
    return got.select("a", "b", "sim_best_view", "local_best_view", "matches", "inliers", *said, *[F.round(f, 6).alias(f"f{n}") for n, f in enumerate(R.features(kind))])


def _records_sql(kind: str) -> str:
    names = R.COMBINATIONS[kind]
    n = range(len(names))
    view = {"orig": "v", "norm": "w", "hflip": "w"}
    have = lambda k, e: f"CASE WHEN (p.a + p.b + {k}) % 5 <> 0 THEN {e} ELSE 0 END"
    cols = [f"list_dot_product(x.{view[va]}, y.{view[vb]}) AS s{k}" for k, (_, va, vb) in enumerate(names)]
    for k in n:
        cols += [have(k, f"((p.a * 3 + p.b * {k + 1}) % 50)::DOUBLE / 50") + f" AS l{k}", have(k, f"(p.a * 7 + p.b * 3 + {k}) % 90") + f" AS m{k}"]
        cols += [have(k, f"(p.a + p.b * 5 + {k}) % 40") + f" AS i{k}", have(k, f"((p.a + p.b + {k}) % 100)::DOUBLE / 100") + f" AS c{k}"]
    first = lambda c, out: "CASE " + " ".join(f"WHEN {c}{k} = {c}x THEN {out(k)}" for k in n) + " END"
    name = lambda k: f"'{names[k][0]}'"
    same = "(oa = ob)::INT"
    f01 = lambda e: f"({e} + 1) / 2"
    tail = ["least(mb / 60.0, 1)", f"least(ib / {22 if kind == 'flank' else 24}.0, 1)", "cb"]
    if kind == "flank":
        fs = [f01("sx"), "lx", *tail, "least(abs(xa - xb) / 0.2, 1)", *[f"(relation = '{r}')::INT" for r in R.RELATIONS]]
    elif kind == "views":
        fs = [f01("sx"), f01("s0"), f01("s1"), "lx", "l0", "l1", *tail, "(sv = 'norm')::INT", "(lv = 'norm')::INT", same]
    else:
        flip, cross = "({} <> 'orig_orig')::INT", "({} IN ('orig_hflip', 'hflip_orig'))::INT"
        fs = [f01("sx"), f01("s0"), f01("s1"), f01("greatest(s2, s3)"), "lx", "l0", "l1", "greatest(l2, l3)", *tail]
        fs += [flip.format("sv"), flip.format("lv"), cross.format("sv"), cross.format("lv"), same]
    return f"""WITH {PAIRS}, views AS (
  SELECT image_id, coalesce(orientation, '') AS o, (image_id % 10)::DOUBLE / 10 AS lum, v, list_transform(v, lambda x: x * ([1.0, -1.0, 0.5]::DOUBLE[])[(image_id % 3 + 1)::INT]) AS w FROM items
), r AS (SELECT p.a, p.b, x.o AS oa, y.o AS ob, x.lum AS xa, y.lum AS xb, {', '.join(cols)} FROM pairs p JOIN views x ON x.image_id = p.a JOIN views y ON y.image_id = p.b),
t AS (SELECT *, {'greatest(' + ', '.join(f's{k}' for k in n) + ')'} AS sx, {'greatest(' + ', '.join(f'l{k}' for k in n) + ')'} AS lx,
  {CANON.format('oa')} AS a_o, {CANON.format('ob')} AS b_o, {SIDE.format('oa')} AS sa, {SIDE.format('ob')} AS sb FROM r),
u AS (SELECT *, {RELATION} AS relation, {first('s', name)} AS sv, {first('l', name)} AS lv, {first('l', lambda k: f'm{k}')} AS mb, {first('l', lambda k: f'i{k}')} AS ib, {first('l', lambda k: f'c{k}')} AS cb FROM t)
SELECT a, b, sv AS sim_best_view, lv AS local_best_view, mb AS matches, ib AS inliers, round({f01('sx')}, 6) AS sim_best01, round(lx, 6)::DOUBLE AS local_top, round(cb, 6)::DOUBLE AS mean_conf,
  {', '.join(f'round(({e})::DOUBLE, 6) AS f{k}' for k, e in enumerate(fs))} FROM u"""


for _kind in R.COMBINATIONS:  # three forms
    query(f"pair_records_{_kind}", _records_sql(_kind))(lambda spark, sf, kind=_kind: _records(spark, sf, kind))


@query("visual_similarity", f"""WITH {PAIRS}, c AS (SELECT a, b, sim, unnest([0, 1, 2, 3]) AS k FROM pairs),
s AS (SELECT *, ((a * 3 + b * (k + 1)) % 7)::DOUBLE / 7 AS score, (a + b + k) % 3 AS cells, ((a + k) % 5)::DOUBLE / 5 AS overlap FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, cells DESC, k) AS r FROM s)
SELECT a, b, round(greatest(sim, sim / 2, score), 6) AS visual, round(score, 6) AS part_score, cells AS part_cells, overlap AS part_overlap FROM t WHERE r = 1""")
def visual_similarity(spark, sf):
    a, b = F.col("a"), F.col("b")
    parts = [F.struct(((a * 3 + b * (k + 1)) % 7 / 7.0).alias("score"), ((a + k) % 5 / 5.0).alias("overlap"), ((a + b + k) % 3).alias("cells")) for k in range(4)]
    got = scored_pairs(items(spark, sf)).withColumn("s", R.visual_similarity(parts, [F.col("sim"), F.col("sim") / 2]))
    return got.select("a", "b", r6(F.col("s.visual")).alias("visual"), r6(F.col("s.part_score")).alias("part_score"), "s.part_cells", "s.part_overlap")


@query("evidence_filter", f"WITH {PAIRS} SELECT a, b FROM pairs WHERE sim >= 0.1 AND (conf >= 0.6 OR ratio >= 0.5)")
def evidence_filter(spark, sf):
    c = F.col
    return scored_pairs(items(spark, sf)).where(R.has_evidence(c("sim"), c("conf"), c("ratio"), 0.1, 0.6, 0.5)).select("a", "b")


@query("brightness_metrics", """WITH p AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: least(abs(x), 1.0)) AS g FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, round(list_avg(g), 6) AS lum_mean, round(list_stddev_pop(g), 6) AS lum_std, round(len(list_filter(g, lambda x: x < 0.12)) / len(g), 6) AS dark_frac,
  round(len(list_filter(g, lambda x: x > 0.88)) / len(g), 6) AS bright_frac FROM p""")
def brightness_metrics(spark, sf):
    e = table(spark, sf, "embeddings").where("embedding is not null")
    got = e.select("vec_id", R.brightness(F.transform(F.col("embedding").cast("array<double>"), lambda x: F.least(F.abs(x), F.lit(1.0)))).alias("m"))
    return got.select("vec_id", *[r6(F.col(f"m.{c}")).alias(c) for c in ("lum_mean", "lum_std", "dark_frac", "bright_frac")])


_DRAW = "('0x' || substr(md5('{seed}|' || {x}::VARCHAR || '|' || {r}::VARCHAR), 1, 12))::BIGINT"
_MD5 = "md5('7|' || a::VARCHAR || '|' || b::VARCHAR)"


@query("training_pairs", f"""WITH {SIMS}, n AS (SELECT image_id, identity, v, row_number() OVER (ORDER BY image_id) - 1 AS no FROM items WHERE identity IS NOT NULL),
size AS (SELECT count(*) AS n FROM n),
w AS (SELECT x.image_id AS a, y.image_id AS b, x.identity, round(list_dot_product(x.v, y.v), 9) AS sim FROM n x JOIN n y ON x.identity = y.identity AND x.image_id < y.image_id),
p AS (SELECT a, b, count(*) OVER (PARTITION BY identity) AS n, row_number() OVER (PARTITION BY identity ORDER BY sim, a, b) AS easy, row_number() OVER (PARTITION BY identity ORDER BY {_MD5}) AS r FROM w),
pos AS (SELECT a, b, 1 AS label FROM p WHERE n <= 50 OR easy <= 20 OR r <= 30 ORDER BY {_MD5} LIMIT 300),
x AS (SELECT k.a, k.b, row_number() OVER (PARTITION BY k.a ORDER BY rank) AS r FROM knn k JOIN n i ON i.image_id = k.a JOIN n j ON j.image_id = k.b WHERE i.identity <> j.identity),
near AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM x WHERE r <= 10),
d AS (SELECT n.image_id AS x, identity, r, {_DRAW.format(seed=7, x='n.image_id', r='r')} % size.n AS no FROM n, size, LATERAL (SELECT unnest(range(0, ceil(2 * 300.0 / size.n)::BIGINT + 1)) AS r)),
e AS (SELECT DISTINCT least(d.x, n.image_id) AS a, greatest(d.x, n.image_id) AS b FROM d JOIN n USING (no) WHERE d.identity <> n.identity),
f AS (SELECT a, b FROM e ORDER BY {_MD5} LIMIT 300), g AS (SELECT a, b FROM f ANTI JOIN near USING (a, b)),
h AS (SELECT a, b FROM (SELECT *, row_number() OVER (ORDER BY {_MD5}) AS r FROM g) WHERE r <= greatest(300 - (SELECT count(*) FROM near), 0)),
neg AS (SELECT a, b, 0 AS label FROM (SELECT * FROM near UNION ALL SELECT * FROM h) ORDER BY {_MD5} LIMIT 600)
SELECT * FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg) ORDER BY label DESC, {_MD5} LIMIT 600""")
def training_pairs(spark, sf):
    it = items(spark, sf)
    return J.training_pairs(it, neighbours(it), 600)


@query("drawn_negatives", f"""WITH {ITEMS}, n AS (SELECT image_id, identity, row_number() OVER (ORDER BY image_id) - 1 AS no FROM items), size AS (SELECT count(*) AS n FROM n),
d AS (SELECT image_id AS x, identity, {_DRAW.format(seed=3, x='image_id', r='r')} % size.n AS no FROM n, size, LATERAL (SELECT unnest(range(0, ceil(2 * 500.0 / size.n)::BIGINT + 1)) AS r)),
e AS (SELECT DISTINCT least(d.x, n.image_id) AS a, greatest(d.x, n.image_id) AS b FROM d JOIN n USING (no) WHERE d.identity <> n.identity)
SELECT a, b FROM e ORDER BY md5('3|' || a::VARCHAR || '|' || b::VARCHAR) LIMIT 500""")
def drawn_negatives(spark, sf):
    return J.drawn_negatives(items(spark, sf), 500, 3)


@query("all_species_pairs", f"WITH {ITEMS} SELECT x.image_id AS a, y.image_id AS b, x.species FROM items x JOIN items y ON x.species = y.species AND x.image_id < y.image_id")
def all_species_pairs(spark, sf):
    return J.all_pairs(items(spark, sf))


@query("group_summary", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_quantity) AS n_values, round(avg(l_quantity)::DOUBLE, 6) AS mean, median(l_quantity)::DOUBLE AS median, round(avg((l_tax > 0.04)::INT), 6) AS share FROM lineitem GROUP BY 1")
def group_summary(spark, sf):
    got = C.summary(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", F.col("l_tax") > 0.04)
    return got.select("l_returnflag", "n", "n_values", r6(F.col("mean").cast("double")).alias("mean"), F.col("median").cast("double").alias("median"), r6(F.col("share")).alias("share"))


_AT = (35, 45, 55, 65)


@query("validation_report", f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY conf, a, b) AS r FROM pairs WHERE label IS NOT NULL),
s AS (SELECT species, count(*) AS n_pairs, sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS q, sum(r) FILTER (WHERE label = 1) AS ranks, coalesce(median(inliers) FILTER (WHERE label = 1), 0)::DOUBLE AS mp,
  coalesce(median(inliers) FILTER (WHERE label = 0), 0)::DOUBLE AS mn, {', '.join(f'count(*) FILTER (WHERE conf >= {t / 100}) AS n{t}, count(*) FILTER (WHERE conf >= {t / 100} AND label = 1) AS t{t}' for t in _AT)} FROM r GROUP BY species)
SELECT species, n_pairs, p AS n_positive, q AS n_negative, round(CASE WHEN p > 0 AND q > 0 THEN (ranks - p * (p + 1) / 2) / (p * q) ELSE 0.5 END, 6) AS auc, mp AS median_inliers_positive, mn AS median_inliers_negative,
  {', '.join(f'round(t{t} / greatest(n{t}, 1), 6) AS precision_{t}, round(t{t} / greatest(p, 1), 6) AS recall_{t}, n{t} AS accepted_{t}' for t in _AT)} FROM s""")
def validation_report(spark, sf):
    got = C.validation_report(scored_pairs(items(spark, sf)).where("label is not null").withColumnRenamed("conf", "score"))
    return got.select(*[r6(F.col(c)).alias(c) if c.startswith(("auc", "precision", "recall")) else c for c in got.columns])


@query("row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders")
def row_index(spark, sf):
    return O.numbered(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("running_total", "SELECT l_extendedprice AS price, n, sum(n) OVER (ORDER BY l_extendedprice DESC)::BIGINT AS run_n FROM (SELECT l_extendedprice, count(*) AS n FROM lineitem GROUP BY 1)")
def running_total(spark, sf):
    per = table(spark, sf, "lineitem").groupBy(F.col("l_extendedprice").alias("price")).agg(F.count(F.lit(1)).alias("n"))
    return O.running(per, "price", ["n"], descending=True)


@query("prune_and_first", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 25")
def prune_and_first(spark, sf):
    return T.first_items(T.prune(table(spark, sf, "orders"), ["o_orderkey", "absent", "o_orderstatus"]), 25, "o_orderkey")


@query("digest_verification", "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN sha256(coalesce(text, '')) END AS found, doc_id % 5 <> 0 AND doc_id % 3 <> 0 AS verified FROM documents")
def digest_verification(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    manifest = d.withColumn("sha256", F.when(F.col("doc_id") % 3 == 0, "0").otherwise(F.col("sha256")))
    return T.verify_digests(d.where("doc_id % 5 <> 0"), manifest, "doc_id").select("doc_id", "found", "verified")


@query("size_distribution", "WITH n AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1) SELECT size, count(*) AS components FROM n GROUP BY 1")
def size_distribution(spark, sf):
    return G.size_distribution(table(spark, sf, "embeddings"), "label")


@query("component_members", "SELECT label AS component, unnest(ids) AS image_id, generate_subscripts(ids, 1) - 1 AS place FROM (SELECT label, list(vec_id ORDER BY vec_id) AS ids FROM embeddings WHERE label IS NOT NULL GROUP BY 1)")
def component_members(spark, sf):
    e = table(spark, sf, "embeddings").where("label is not null").select(F.col("label").alias("component"), F.col("vec_id").alias("image_id"))
    lists = G.members(e, at_most=1 << 30)
    return lists.select("component", F.posexplode("ids").alias("place", "image_id")).select("component", "image_id", F.col("place").cast("long").alias("place"))
