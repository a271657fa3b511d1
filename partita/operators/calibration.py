"""Calibration of pair scores: pair samples, precision thresholds, rule grids, curves, ranks, probabilities."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered, running


def precision_curve(pairs: DataFrame, score: str = "score", truth: str = "label") -> DataFrame:
    """Per distinct score the pairs at or above it (n), the positives among them (tp) and the precision.

    Scores are counted before they are ordered, and running sums are taken within ranges of scores.
    """
    per = pairs.groupBy(score).agg(F.count(F.lit(1)).alias("c"), F.sum(truth).alias("p"))
    out = running(per, score, ["c", "p"], descending=True)
    return out.select(score, F.col("run_c").alias("n"), F.col("run_p").alias("tp"), (F.col("run_p") / F.col("run_c")).alias("precision"))


def threshold_for_precision(
    pairs: DataFrame, target: float, least: int = 3, scale: float = 1.0, score: str = "score", truth: str = "label", default: float = 0.62
) -> DataFrame:
    """One row: the lowest score whose prefix has the target precision and `least` pairs, times scale.

    Else the score nearest to the 55th percentile of the positives (ties: the higher). No pairs, or pairs of one class: the default.
    Equal scores are one prefix.
    """
    curve = precision_curve(pairs, score, truth)
    hit = curve.where((F.col("precision") >= target) & (F.col("n") >= least)).agg(F.min(score).alias("hit"))
    sides = pairs.agg(
        F.percentile(F.when(F.col(truth) == 1, F.col(score)), F.lit(0.55)).alias("middle"),
        (F.coalesce(F.max(truth), F.lit(0)) > F.coalesce(F.min(truth), F.lit(0))).alias("both"),
    )
    nearest = curve.crossJoin(sides).agg(F.min_by(score, F.struct(F.abs(F.col(score) - F.col("middle")), -F.col(score))).alias("nearest"), F.max("both").alias("both"))
    value = F.when(F.coalesce("both", F.lit(False)), F.coalesce("hit", "nearest") * scale).otherwise(default)
    return hit.crossJoin(nearest).select(value.alias("threshold"), (F.col("hit").isNotNull() & F.coalesce("both", F.lit(False))).alias("reached"))


#: The grid of probability, local score, inliers and similarity, and the rule that nothing passes.
GRID = ((0.90, 0.94, 0.97, 0.98, 0.99), (0.40, 0.55, 0.70, 0.82, 0.90, 0.95), (4, 6, 8, 10, 14, 18, 24, 32), (0.86, 0.90, 0.94, 0.96, 0.98))
IMPOSSIBLE = (0.999, 0.999, 999, 0.999)


def rule_grid(pairs: DataFrame, grid: DataFrame | None, target: float, min_support: int, truth: str = "label") -> DataFrame:
    """One row: the rule of the grid (prob, local, inliers, sim) that is best on labelled pairs; grid None: GRID.

    Support at least min_support; of the rules with the target precision the one with the most positives, then precision, then support; if there are none,
    the most precise, then by positives, then support. No rule with the support: the impossible rule with support 0.
    grid is a parameter table; pairs stay distributed and each rule is one conditional sum.
    """
    spark = pairs.sparkSession
    names = "r_prob double, r_local double, r_inliers int, r_sim double"
    grid = spark.createDataFrame(list(product(*GRID)), names) if grid is None else grid
    hit = (F.col("match_prob") >= F.col("r_prob")) & (F.col("local") >= F.col("r_local")) & (F.col("inliers") >= F.col("r_inliers")) & (F.col("sim") >= F.col("r_sim"))
    keys = ["r_prob", "r_local", "r_inliers", "r_sim"]
    cells = pairs.groupBy("match_prob", "local", "inliers", "sim").agg(F.count(F.lit(1)).alias("c"), F.sum(truth).alias("p"))
    got = cells.join(F.broadcast(grid), hit).groupBy(*keys).agg(F.sum("c").alias("support"), F.sum("p").alias("tp"))
    got = got.where(F.col("support") >= min_support).withColumn("precision", F.col("tp") / F.col("support"))
    none = spark.createDataFrame([(*IMPOSSIBLE, 0, 0, 0.0)], f"{names}, support long, tp long, precision double")
    ok = F.col("precision") >= target
    order = [F.desc(ok), F.desc(F.when(ok, F.col("tp")).otherwise(F.lit(0))), F.desc("precision"), F.desc("tp"), F.desc("support"), *keys]
    return got.unionByName(none).orderBy(F.desc(F.col("support") > 0), *order).limit(1)


def rank_auc(pairs: DataFrame, score: str = "score", truth: str = "label", order: Iterable[Column] = (), one_class: float | None = None) -> DataFrame:
    """One row: Mann-Whitney AUC without tie averaging (ties by the given order). One class only, or no pairs: one_class (0.5 in reports).

    Ranks are found in two steps: counts per score, then places within a score, so no task orders all pairs.
    """
    per = pairs.groupBy(score).agg(F.count(F.lit(1)).alias("c"))
    per = running(per, score, ["c"]).select(F.col(score).alias("s"), (F.col("run_c") - F.col("c")).alias("below"))
    place = F.row_number().over(Window.partitionBy(score).orderBy(*(list(order) or [F.col(score)])))
    ranked = pairs.withColumn("place", place).join(per, F.col(score) == F.col("s"))
    got = ranked.agg(
        F.sum(F.when(F.col(truth) == 1, F.col("below") + F.col("place"))).alias("ranks"),
        F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).alias("p"),
        F.sum(F.when(F.col(truth) == 0, 1).otherwise(0)).alias("q"),
    )
    auc = (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    return got.select(F.when((F.col("p") > 0) & (F.col("q") > 0), auc).otherwise(F.lit(one_class)).cast("double").alias("auc"))


def summary(df: DataFrame, value: str, group: str, share: Column) -> DataFrame:
    """Per group: n, distinct values, mean, median, and the share of rows for which a condition holds (null: does not)."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(value).alias("n_values"),
        F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.5)).alias("median"),
        F.avg(F.coalesce(share, F.lit(False)).cast("double")).alias("share"),
    )


def validation_report(pairs: DataFrame, thresholds: Iterable[float] = (0.35, 0.45, 0.55, 0.65), group: str = "species", score: str = "score", truth: str = "label") -> DataFrame:
    """Per species of scored pairs of known identity: counts, rank AUC (ties by a, b; one class: 0.5), median inliers by class, and precision, recall
    and accepted pairs at each threshold (precision_35, ...).

    pairs: species, a, b, score, label, inliers; a sample of bounded size per species, as sampled_pairs gives it, since its ranks are one window per species.
    """
    ranked = pairs.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(score, "a", "b")))
    one, zero = F.col(truth) == 1, F.col(truth) == 0
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    middle = lambda cond: F.coalesce(F.percentile(F.when(cond, F.col("inliers")), F.lit(0.5)), F.lit(0.0))
    p, q = n(one), n(zero)
    auc = (F.sum(F.when(one, F.col("_rank")).otherwise(0)) - p * (p + 1) / 2) / (p * q)
    out = [F.count(F.lit(1)).alias("n_pairs"), p.alias("n_positive"), q.alias("n_negative"), F.when((p > 0) & (q > 0), auc).otherwise(0.5).alias("auc")]
    out += [middle(one).alias("median_inliers_positive"), middle(zero).alias("median_inliers_negative")]
    for t in thresholds:
        hit, tag = F.col(score) >= t, f"{round(t * 100):02d}"
        tp = n(hit & one)
        out += [(tp / F.greatest(n(hit), F.lit(1))).alias(f"precision_{tag}"), (tp / F.greatest(p, F.lit(1))).alias(f"recall_{tag}"), n(hit).alias(f"accepted_{tag}")]
    return ranked.groupBy(group).agg(*out)


def threshold_report(pairs: DataFrame, thresholds: list[float], score: str = "score", truth: str = "label") -> DataFrame:
    """Per threshold: accepted, precision, recall; one pass over the pairs."""
    sums = pairs.agg(
        F.sum(truth).alias("pos"),
        *[F.sum(F.when(F.col(score) >= t, 1).otherwise(0)).alias(f"n{i}") for i, t in enumerate(thresholds)],
        *[F.sum(F.when(F.col(score) >= t, F.col(truth)).otherwise(0)).alias(f"p{i}") for i, t in enumerate(thresholds)],
    )
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("accepted"), F.col(f"p{i}").alias("tp")) for i, t in enumerate(thresholds)])
    x = sums.select("pos", F.explode(rows).alias("r")).select("r.*", "pos")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return x.select("threshold", "accepted", share("tp", "accepted").alias("precision"), share("tp", "pos").alias("recall"))


def adjusted_rand(items: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings, from the contingency counts. Equal trivial partitions: 1."""
    cells = items.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: F.sum(F.col(n).cast("double") * (F.col(n) - 1) / 2)
    s = cells.agg(pairs("n").alias("s"), F.sum("n").alias("n"))
    rows = cells.groupBy(truth).agg(F.sum("n").alias("m")).agg(pairs("m").alias("sa"))
    cols = cells.groupBy(pred).agg(F.sum("n").alias("m")).agg(pairs("m").alias("sb"))
    x = s.crossJoin(rows).crossJoin(cols)
    total = F.col("n").cast("double") * (F.col("n") - 1) / 2
    expected = F.col("sa") * F.col("sb") / total
    most = (F.col("sa") + F.col("sb")) / 2
    return x.select(F.when((total == 0) | (most == expected), 1.0).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"))


def date_split(items: DataFrame, share: float = 0.8, date: str = "date_dt") -> DataFrame:
    """items with validation: dates at or after the share-th quantile; null dates are not validation."""
    at = items.agg(F.expr(f"percentile(unix_micros(cast({date} as timestamp)), {share})").alias("at"))
    late = F.expr(f"unix_micros(cast({date} as timestamp))") >= F.col("at")
    return items.crossJoin(at).withColumn("validation", F.coalesce(late, F.lit(False))).drop("at")


def novel_split(items: DataFrame, share: float = 0.22, seed: int = 7, identity: str = "identity", key: str = "image_id") -> DataFrame:
    """items with role: novel (identities of the smallest hashes, `share` of them), query (one item of each other identity), gallery."""
    ids = items.select(identity).distinct().withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(identity).cast("string"))))
    n = ids.agg(F.floor(F.count(F.lit(1)) * share).alias("n_novel"))
    ids = numbered(ids, "h", "r").crossJoin(n).select(identity, (F.col("r") < F.col("n_novel")).alias("novel"))
    q = items.groupBy(identity).agg(F.min(key).alias("q"))
    role = F.when(F.col("novel"), "novel").when(F.col(key) == F.col("q"), "query").otherwise("gallery")
    return items.join(ids, identity).join(q, identity).withColumn("role", role).drop("novel", "q")


def fit_calibrator(pairs: DataFrame, features: list[str], truth: str = "label", kind: str = "boosted", rounds: int = 40, seed: int = 7):
    """An MLlib model of match probability; `logistic` (balanced by class weights) or `boosted`. Score with probability()."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    assemble = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    if kind == "boosted":
        model = GBTClassifier(labelCol=truth, maxIter=rounds, stepSize=0.1, maxDepth=4, seed=seed)
        return Pipeline(stages=[assemble, model]).fit(pairs)
    share = pairs.agg(F.avg(truth)).first()[0] or 0.5
    weighted = pairs.withColumn("w", F.when(F.col(truth) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    return Pipeline(stages=[assemble, LogisticRegression(labelCol=truth, weightCol="w")]).fit(weighted)


def probability(model, pairs: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(pairs)
    return out.select(*pairs.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("match_prob"))


def visual_words(descriptors: DataFrame, k: int, vector: str = "v", seed: int = 7, sample: int = 100_000):
    """(descriptors with word, model): k-means words, fitted on a sample of bounded size and assigned to all."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = descriptors.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=10).fit(x.orderBy(F.xxhash64(vector)).limit(sample))
    return model.transform(x).withColumnRenamed("prediction", "word").drop("features"), model


def tfidf(words: DataFrame, doc: str = "image_id", word: str = "word") -> DataFrame:
    """(doc, word, weight): count * (ln((1+N)/(1+df)) + 1), of length 1 per doc."""
    counts = words.groupBy(doc, word).agg(F.count(F.lit(1)).alias("c"))
    df = counts.groupBy(word).agg(F.count(F.lit(1)).alias("df"))
    n = counts.select(doc).distinct().agg(F.count(F.lit(1)).alias("n"))
    w = counts.join(df, word).crossJoin(F.broadcast(n)).withColumn("w", F.col("c") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = w.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, doc).select(doc, word, (F.col("w") / F.col("norm")).alias("weight"))
