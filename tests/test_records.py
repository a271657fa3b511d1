"""Ordered sums, pair records, sampling and digests: hand-computed cases and odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from partita.operators import calibration, candidates, components, order, records
from partita.sources import tables


def test_running_equals_a_plain_sum_with_more_values_than_drawn(spark, monkeypatch):
    monkeypatch.setattr(order, "DRAWN", 50)
    monkeypatch.setattr(order, "RANGES", 7)
    rng = random.Random(3)
    rows = [(x, rng.randint(0, 5)) for x in rng.sample(range(10_000), 900)] + [(None, 4)]
    df = spark.createDataFrame(rows, "x long, c long")
    for down in (False, True):
        got = {r.x: r.run_c for r in order.running(df, "x", ["c"], down).collect()}
        total = 0
        for x, c in sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=down):
            total += c
            assert got[x] == total


def test_running_of_texts_and_of_nothing(spark):
    df = spark.createDataFrame([("b",), ("é",), ("a",), ("",)], "x string")
    assert {r.x: r.row_idx for r in order.numbered(df, "x").collect()} == {"": 0, "a": 1, "b": 2, "é": 3}
    assert order.numbered(df.limit(0), "x").count() == 0


def test_a_record_takes_the_first_of_equal_views_and_counts_what_lacks_as_no_match(spark):
    items = spark.createDataFrame([(1, None, [1.0, 0.0], [-1.0, 0.0]), (2, "left", [1.0, 0.0], [-1.0, 0.0])], "image_id long, orientation string, orig array<double>, norm array<double>")
    pairs = spark.createDataFrame([(1, 2, 1)], "a long, b long, label int")
    none = spark.createDataFrame([], "a long, b long, view string, local_score double, matches int, inliers int, mean_conf double")
    r = records.pair_records(pairs, items, none, "views").first()
    assert (r.sim_best, r.sim_best01, r.sim_best_view, r.local_best, r.local_best_view, r.matches, r.label) == (1.0, 1.0, "orig", 0.0, "orig", 0, 1)
    one = spark.createDataFrame([(1, 2, "norm", 0.4, 9, 7, 0.5)], none.schema)
    r = records.pair_records(pairs, items, one, "views").first()
    assert (r.local_best_view, r.local_orig, r.local_norm, r.matches, r.inliers) == ("norm", 0.0, 0.4, 9, 7)


def test_features_are_finite(spark):
    row = spark.createDataFrame([(float("nan"), float("inf"), float("-inf"), None)], "sim_best01 double, local_best double, mean_conf double, lum_gap double")
    row = row.selectExpr("*", "120 matches", "11 inliers", "'mixed' relation", "'a' orientation_a", "'a' orientation_b")
    got = row.select(*records.features("flank")).first()
    assert tuple(got) == (0.0, 1.0, 1.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def test_evidence_and_brightness_of_nulls(spark):
    rows = [(0.9, 0.1, 0.9), (0.9, 0.1, 0.1), (0.9, None, None), (None, 1.0, 1.0), (0.1, 1.0, 1.0)]
    got = spark.createDataFrame(rows, "s double, p double, k double").select(records.has_evidence(F.col("s"), F.col("p"), F.col("k"), 0.5, 0.5, 0.5))
    assert [r[0] for r in got.collect()] == [True, False, False, False, False]
    m = [r[0] for r in spark.createDataFrame([([0.0, 1.0],), ([],)], "g array<double>").select(records.brightness(F.col("g"))).collect()]
    assert tuple(m[0]) == (0.5, 0.5, 0.5, 0.5) and m[1].lum_mean is None and m[1].dark_frac is None


def test_training_pairs_keep_hard_positives_and_the_limit(spark):
    rng = random.Random(1)
    rows = [(i, "s", "big" if i < 15 else f"x{i}", [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(40)]
    it = spark.createDataFrame(rows, "image_id long, species string, identity string, v array<double>")
    near = candidates.top_k(it, it, 5)
    got = candidates.training_pairs(it, near, 200).collect()
    name = {r[0]: r[2] for r in rows}
    dot = {r[0]: r[3] for r in rows}
    assert len({(r.a, r.b) for r in got}) == len(got) <= 200
    assert all((name[r.a] == name[r.b]) == bool(r.label) and r.a < r.b for r in got)
    every = sorted(((sum(x * y for x, y in zip(dot[a], dot[b], strict=True)), a, b) for a in range(15) for b in range(a + 1, 15)))
    kept = {(r.a, r.b) for r in got if r.label}
    assert {(a, b) for _, a, b in every[:20]} <= kept and len(kept) <= 50


def test_one_class_and_thresholds_in_the_validation_report(spark):
    rows = [("s", 1, 2, 0.9, 1, 5), ("s", 1, 3, 0.2, 0, 1), ("s", 2, 3, 0.5, 0, 3), ("t", 4, 5, 0.5, 1, 2)]
    got = {r.species: r for r in calibration.validation_report(spark.createDataFrame(rows, "species string, a long, b long, score double, label int, inliers int")).collect()}
    assert got["s"].auc == 1.0 and got["t"].auc == 0.5
    assert (got["s"].precision_45, got["s"].recall_45, got["s"].accepted_45, got["s"].median_inliers_negative) == (0.5, 1.0, 2, 2.0)
    assert (got["t"].median_inliers_negative, got["t"].accepted_65, got["t"].precision_65) == (0.0, 0, 0.0)


def test_digests_that_fit_differ_or_lack(spark):
    manifest = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "slug string, sha256 string")
    got = tables.verify_digests(spark.createDataFrame([("x", "1"), ("y", "9")], "slug string, sha256 string"), manifest)
    assert {r.slug: (r.found, r.verified) for r in got.collect()} == {"x": ("1", True), "y": ("9", False), "z": (None, False)}
    with pytest.raises(KeyError, match="w"):
        tables.verify_digests(spark.createDataFrame([("w", "1")], "slug string, sha256 string"), manifest)


def test_member_lists_hold_all_ids_once(spark):
    parts = spark.range(500).selectExpr("id image_id", "id % 3 component")
    got = components.members(parts, at_most=20).collect()
    assert sorted(i for r in got for i in r.ids) == list(range(500)) and max(len(r.ids) for r in got) < 60
    assert all(r.ids == sorted(r.ids) and {i % 3 for i in r.ids} == {r.component} for r in got)


def test_pairs_of_labels_are_sampled_in_cells(spark):
    rows = [(i, "big" if i % 3 else None if i % 2 else f"x{i % 5}") for i in range(300)] + [(7, "big"), (None, "big")]
    it = spark.createDataFrame(rows, "image_id long, identity string")
    plain = candidates.sampled_pairs(candidates.within_pairs(it, "identity"), 12, 7, "identity").select("identity", "a", "b")
    for cell in (16, 1024):
        drawn = candidates.first_within(it, 12, 7, "identity", cell=cell)
        got = candidates.sampled_pairs(drawn.where("a is not null"), 12, 7, "identity").select("identity", "a", "b")
        assert sorted(got.collect()) == sorted(plain.collect())
        pairs = {r.identity: r.n for r in drawn.groupBy("identity").agg(F.sum("pairs").alias("n")).collect()}
        assert pairs == {r.identity: r.n for r in candidates.within_pairs(it, "identity").groupBy("identity").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert drawn.count() < candidates.within_pairs(it, "identity").count() / 5
    assert sorted(candidates.sampled_within(it, 12, 7, "identity").select("identity", "a", "b").collect()) == sorted(plain.collect())


def test_training_pairs_take_the_hard_and_the_drawn_pairs_of_all_cells(spark, monkeypatch):
    monkeypatch.setattr(candidates.first_within, "__defaults__", (*candidates.first_within.__defaults__[:-1], 16))
    rng = random.Random(2)
    own = [[rng.gauss(0, 1), rng.gauss(0, 1)] for _ in range(40)]
    it = spark.createDataFrame([(i, "s", "big", own[i % 40]) for i in range(90)] + [(99, "s", "big", None)], "image_id long, species string, identity string, v array<double>")
    got = candidates.training_pairs(it, candidates.top_k(it.where("v is not null"), it.where("v is not null"), 3), 2000).where("label = 1").collect()
    sim = lambda a, b: float("inf") if 99 in (a, b) else round(own[a % 40][0] * own[b % 40][0] + own[a % 40][1] * own[b % 40][1], 9)
    every = [(a, b) for a in [*range(90), 99] for b in [*range(90), 99] if a < b]
    want = set(sorted(every, key=lambda p: (sim(*p), p))[:20]) | set(sorted(every, key=lambda p: hashlib.md5(f"7|{p[0]}|{p[1]}".encode()).hexdigest())[:30])
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
