"""Hand-computed cases and properties of operators that SQL cannot express."""

import random
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.functions import scalars as S
from partita.functions import vectors as V
from partita.operators import calibration, candidates, components, lineage, partition
from partita.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def merged(spark, sizes, edges, cap, most=99):
    nodes = frame(spark, [("s", k, n) for k, n in sizes.items()], "species string, node string, n long")
    pairs = frame(spark, [("s", a, b, w) for a, b, w in edges], "species string, a string, b string, w double")
    got = partition.capped_merge(nodes, pairs, [F.desc("w")], cap, most)
    return {r.node: r.root for r in got.collect()}, sorted((r.step, r.size_after) for r in got.collect() if r.step)


def test_capped_merge_skips_what_is_over_the_cap_for_good(spark):
    roots, steps = merged(spark, {"a": 2, "b": 2, "c": 1}, [("a", "b", 0.9), ("b", "c", 0.8)], 4)
    assert roots == {"a": "a", "b": "a", "c": "c"} and steps == [(1, 4)]


def test_capped_merge_ties_go_by_ids_and_joined_edges_do_not_count(spark):
    sizes = dict.fromkeys("abcd", 1)
    roots, steps = merged(spark, sizes, [("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 0.5), ("c", "d", 0.5)], 9, 3)
    assert set(roots.values()) == {"a"} and [s for s, _ in steps] == [1, 2, 3]


def test_capped_merge_of_nothing(spark):
    assert merged(spark, {"a": 1}, [], 3)[0] == {"a": "a"}


def brute_components(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find_and_ignore_order(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    want = brute_components(150, edges)
    df = frame(spark, edges[::-1] + [(5, None), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components.connected(df).collect()}
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}


def test_components_of_nothing(spark):
    assert components.connected(frame(spark, [], "a long, b long")).count() == 0


def test_top_k_in_many_cells_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, f"s{i % 2}", [rng.gauss(0, 1) for _ in range(5)]) for i in range(120)]
    it = frame(spark, rows, "image_id long, species string, v array<double>").withColumn("v", V.l2_normalize(F.col("v")))
    vs = {r.image_id: (r.species, r.v) for r in it.collect()}
    got = {}
    for r in candidates.top_k(it, it, 4, cell=16).collect():
        got.setdefault(r.a, []).append((r["rank"], r.b))
    for i, (s, v) in vs.items():
        best = sorted((-sum(x * y for x, y in zip(v, w)), j) for j, (t, w) in vs.items() if t == s and j != i)[:4]
        assert [b for _, b in sorted(got[i])] == [j for _, j in best]


def test_agglomeration_stops_at_the_threshold(spark):
    rows = [(1, "s", [1.0, 0.0]), (2, "s", [0.999, 0.0447]), (3, "s", [0.0, 1.0])]
    it = frame(spark, rows, "image_id long, species string, v array<double>")
    assert {r.image_id: r.root for r in partition.agglomerate(it, 0.5).collect()} == {1: 1, 2: 1, 3: 3}
    with pytest.raises(Exception, match="takes 2 at most"):
        partition.agglomerate(it, 0.5, most=2).collect()


def test_split_guards(spark):
    p = frame(spark, [(i, "A") for i in range(4)] + [(9, "B"), (10, "B")], "image_id long, cluster string")
    e = frame(spark, [(0, 1, 0.9), (2, 3, 0.9), (1, 2, 0.1)], "a long, b long, s double")
    got = {r.image_id: (r.part, r.decision) for r in partition.split_clusters(p, e, "s", 0.5).collect()}
    assert got == {0: (0, "split"), 1: (0, "split"), 2: (2, "split"), 3: (2, "split"), 9: (9, "small"), 10: (9, "small")}


def test_compaction_is_idempotent_and_keeps_membership(spark):
    p = frame(spark, [(3, "s", "z"), (1, "s", "b"), (2, "s", "z"), (4, "t", "z")], "image_id long, species string, cluster string")
    once = partition.compact_labels(p)
    assert {r.image_id: r.cluster for r in once.collect()} == {1: "cluster_s_0", 2: "cluster_s_1", 3: "cluster_s_1", 4: "cluster_t_0"}
    assert sorted(partition.compact_labels(once).collect()) == sorted(once.collect())


def test_replay_keeps_the_smallest_label_key(spark):
    p = frame(spark, [(1, "c_10"), (2, "c_2"), (3, "c_3"), (4, "c_7")], "image_id long, cluster string")
    a = frame(spark, [("c_10", "c_2"), ("c_3", "c_10")], "cluster_a string, cluster_b string")
    assert {r.image_id: r.cluster for r in partition.replay_actions(p, a).collect()} == {1: "c_2", 2: "c_2", 3: "c_2", 4: "c_7"}


def test_contract_counts(spark):
    u = frame(spark, [(1,), (2,), (3,)], "image_id long")
    p = frame(spark, [(1, "a"), (1, "b"), (4, None), (2, "x" * 65)], "image_id long, cluster string")
    r = lineage.contract(p, u).first()
    assert (r.missing, r.foreign, r.repeated, r.null_labels, r.long_labels) == (1, 1, 1, 1, 1)


def test_adjusted_rand_of_equal_partitions(spark):
    x = frame(spark, [(1, "a", "q"), (2, "a", "q"), (3, "b", "r")], "i long, t string, p string")
    assert calibration.adjusted_rand(x, "t", "p").first().ari == 1.0
    assert calibration.adjusted_rand(x, "t", "t").first().ari == 1.0


def test_precision_threshold_takes_the_last_prefix_or_falls_back(spark):
    rows = [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 1), (0.5, 0), (0.4, 0)]
    x = frame(spark, rows, "score double, label int")
    assert calibration.threshold_for_precision(x, 0.75).first().threshold == 0.6
    r = calibration.threshold_for_precision(x, 0.99).first()
    assert not r.reached and r.threshold == 0.7
    assert calibration.threshold_for_precision(x.where("label = 1"), 0.5).first().threshold == 0.62
    assert calibration.threshold_for_precision(x.limit(0), 0.5, default=0.58).first().threshold == 0.58


def test_rank_auc_of_one_class_is_null(spark):
    x = frame(spark, [(0.1, 1), (0.2, 1)], "score double, label int")
    assert calibration.rank_auc(x).first().auc is None
    assert calibration.rank_auc(x, one_class=0.5).first().auc == 0.5


def test_rule_grid_order_and_the_impossible_rule(spark):
    rows = [(0.995, 0.96, 40, 0.99, 1)] * 3 + [(0.95, 0.5, 5, 0.9, 1)] * 2 + [(0.91, 0.45, 4, 0.87, 0)]
    x = frame(spark, rows, "match_prob double, local double, inliers int, sim double, label int")
    r = calibration.rule_grid(x, None, 0.95, 2).first()
    assert (r.tp, r.precision, r.support) == (5, 1.0, 5) and (r.r_prob, r.r_inliers) == (0.9, 4)
    r = calibration.rule_grid(x, None, 0.95, 99).first()
    assert (r.r_prob, r.r_local, r.r_inliers, r.r_sim, r.support, r.precision) == (0.999, 0.999, 999, 0.999, 0, 0.0)
    # No rule is precise enough: precision, then positives, then support.
    y = x.withColumn("label", F.when(F.col("inliers") == 40, F.lit(0)).otherwise(F.lit(1)))
    r = calibration.rule_grid(y, None, 0.99, 4).first()
    assert (r.tp, r.support) == (3, 6)


def test_guarded_split_outcomes(spark):
    members = {"small": [1, 2], "silent": [11, 12, 13], "weak": [21, 22, 23], "whole": [31, 32, 33], "atoms": [41, 42, 43, 44], "cut": [51, 52, 53, 54], "big": list(range(61, 70))}
    x = frame(spark, [(i, c) for c, v in members.items() for i in v], "image_id long, cluster string")
    pairs = [(1, 2, 0.9), (21, 22, 0.1), (31, 32, 0.9), (32, 33, 0.9), (41, 42, 0.9), (43, 44, 0.1), (51, 52, 0.9), (53, 54, 0.9), (61, 62, 0.9), (63, 64, 0.1)]
    pairs = frame(spark, [(a, b, s, 1.0 if s > 0.5 else 0.0) for a, b, s in pairs], "a long, b long, s double, point double")
    got = {r.cluster: r.decision for r in partition.split_clusters(x, pairs, "s", 0.5).collect()}
    assert got == {"small": "small", "silent": "no_scores", "weak": "no_trusted", "whole": "connected", "atoms": "atomised", "cut": "split", "big": "split"}
    got = {r.cluster: r.decision for r in partition.split_clusters(x, pairs, "s", 0.5, least_edges=2).collect()}
    assert got["cut"] == got["big"] == "unsupported" and got["atoms"] == "atomised"
    got = {r.cluster: r.decision for r in partition.split_clusters(x, pairs, "s", 0.5, evidence=F.col("point") > 2).collect()}
    assert got["whole"] == got["cut"] == "no_trusted"


def test_shape_score_by_hand(spark):
    rep = frame(spark, [("x", 20, 9, 4, 3), ("one", 5, 1, 5, 0), ("free", 5, 2, 4, 1)], "species string, n_images long, n_clusters long, max_cluster_size long, singletons long")
    goal = frame(spark, [("x", 4, 7, 1, 2, 6, 5, 9, 1), ("one", 4, 7, 1, 2, 6, 5, 9, 1)], "species string, t_clusters int, t_max int, t_singletons int, lo_clusters int, hi_clusters int, lo_max int, hi_max int, hi_singletons int")
    got = {r.species: r for r in lineage.shape_score(rep, goal).collect()}
    want = 2.6 * log(10 / 5) + 1.4 * log(8 / 5) + 0.55 * log(4 / 2) + 3 * log(10 / 7) + 1.6 * log(6 / 5) + 1.5 * log(4 / 2)
    assert abs(got["x"].shape_score - want) < 1e-12 and got["x"].notes == ["too_many_clusters", "max_cluster_too_small", "too_many_singletons"]
    assert got["one"].shape_score == 999.0 and got["one"].notes == ["collapsed"] and got["free"].shape_score == 0.0


def test_upsert_and_duplicates(spark):
    log = frame(spark, [("a", 1), ("b", 2)], "run_id string, n int")
    assert sorted(map(tuple, tables.upsert(log, frame(spark, [("b", 3)], "run_id string, n int")).collect())) == [("a", 1), ("b", 3)]
    with pytest.raises(ValueError):
        tables.load_partition(frame(spark, [(1, "x"), (1, "y")], "image_id long, cluster string"))


def test_csv_round_trip(spark, tmp_path):
    p = frame(spark, [(1, 'a "q", b'), (2, "c")], "image_id long, cluster string")
    tables.write_csv(p, str(tmp_path / "x"), crlf=True, quote_all=True)
    assert sorted(tables.read_csv(spark, str(tmp_path / "x"), tables.PARTITION).collect()) == sorted(p.collect())


def test_zero_vectors(spark):
    r = frame(spark, [([0.0, 0.0],)], "v array<double>").select(*[V.l2_normalize(F.col("v"), g).alias(g) for g in ("add", "max", "skip")]).first()
    assert r["add"] == r["max"] == r["skip"] == [0.0, 0.0]


def test_non_finite_numbers(spark):
    r = frame(spark, [(float("nan"), float("inf"), -float("inf"))], "a double, b double, c double").select(*[S.finite(F.col(x)) for x in "abc"]).first()
    assert tuple(r) == (0.0, 1.0, 0.0)


def test_kernels():
    import numpy as np

    from partita.functions import kernels as K

    rng = np.random.default_rng(0)
    a = rng.random((12, 12))
    m = np.ones(a.shape, bool)
    assert K.template_match(a, m, a, m)[:1] + K.template_match(a, m, a, m)[1:] == (1.0, 0, 0, 0)
    assert K.template_match(a, m, a[:, ::-1], m)[1] == 1
    assert K.phase_shift(np.roll(a, (2, 3), (0, 1)), a) == (3, 2)
    assert abs(K.stack_gain(a, m, a, m) - 1 / 1.35) < 1e-9
    assert K.mutual_matches(np.eye(3), np.eye(3)[::-1]) == [(0, 2, 1.0), (1, 1, 1.0), (2, 0, 1.0)]
    assert K.mutual_matches(np.empty((0, 3)), np.eye(3)) == []


def test_agglomeration_takes_groups_of_any_size_and_equals_a_plain_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parts = {i: [i] for i in range(60)}
    mean = lambda p, q: float(np.mean([1 - x[i] @ x[j] for i in parts[p] for j in parts[q]]))
    while (best := min((round(mean(p, q), 12), p, q) for p in parts for q in parts if p < q))[0] < 0.4:
        parts[best[1]] += parts.pop(best[2])
    rows = [(i, "s", v.tolist()) for i, v in enumerate(x)]
    got = partition.agglomerate(frame(spark, rows, "image_id long, species string, v array<double>"), 0.4).collect()
    assert {r.image_id: r.root for r in got} == {i: p for p, ids in parts.items() for i in ids} and 1 < len(parts) < 60
    big = spark.range(8_200).selectExpr("id image_id", "'s' species", "array(cos(id % 41 * 0.15D), sin(id % 41 * 0.15D)) v")
    assert {(r.root, r.n) for r in partition.agglomerate(big, 0.005).groupBy("root").agg(F.count(F.lit(1)).alias("n")).collect()} == {(i, 200) for i in range(41)}
