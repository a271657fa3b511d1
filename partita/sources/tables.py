"""Loaders and sinks for item metadata, partitions, feature tables and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import dataset_from_path, slashes, split_from_path, truthy

METADATA = "image_id long, path string, identity string, date string, orientation string, dataset string, split string"
PARTITION = "image_id long, cluster string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, by an explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str, crlf: bool = False, quote_all: bool = False, one_file: bool = True) -> None:
    """One CSV file is one task: for reports and partitions of items, not for large tables."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("lineSep", "\r\n" if crlf else "\n").csv(path)


def write_fragments(df: DataFrame, path: str, by: str = "species") -> None:
    """One folder per species."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def prune(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that df has, in the given order."""
    return df.select(*[c for c in names if c in df.columns])


def first_items(df: DataFrame, n: int, key: str = "image_id") -> DataFrame:
    """The n rows of the smallest keys, for trial runs."""
    return df.orderBy(key).limit(n)


def duplicates(df: DataFrame, key: str = "image_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def load_partition(df: DataFrame, key: str = "image_id", label: str = "cluster", check: bool = True) -> DataFrame:
    """(image_id, cluster); an id that comes twice stops it unless check is off."""
    out = df.select(F.col(key).cast("long").alias("image_id"), F.col(label).cast("string").alias("cluster"))
    if check and duplicates(out).limit(1).count():
        raise ValueError("a partition has an id twice")
    return out


def first_by_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first by an explicit order: a min_by over a struct, so map tasks reduce before the shuffle."""
    rest = [c for c in df.columns if c != key]
    row = F.struct(*[F.col(c) for c in rest])
    got = df.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("r"))
    return got.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def prepare_metadata(df: DataFrame) -> DataFrame:
    """Fills what is missing: dataset and split from the path, orientation 'unknown', identity ''; adds the parsed date."""
    has = set(df.columns)
    col = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
    filled = lambda c: F.nullif(F.trim(col(c)), F.lit(""))
    return (
        df.withColumn("dataset", F.coalesce(filled("dataset"), dataset_from_path(F.col("path"))))
        .withColumn("split", F.coalesce(filled("split"), split_from_path(F.col("path"))))
        .withColumn("orientation", F.coalesce(filled("orientation"), F.lit("unknown")))
        .withColumn("identity", F.coalesce(col("identity"), F.lit("")))
        .withColumn("has_identity", F.col("identity") != "")
        .withColumn("date_dt", F.try_to_timestamp(col("date")))
    )


def backfill_manifest(manifest: DataFrame, metadata: DataFrame, key: str = "image_id") -> DataFrame:
    """The manifest with metadata's columns (stale ones dropped), and a row with fallbacks for each id that it lacks."""
    own = [c for c in manifest.columns if c == key or c not in metadata.columns]
    seen = manifest.select(*own).join(metadata, key, "left").withColumn("backfilled", F.lit(False))
    missing = metadata.join(manifest.select(key), key, "left_anti").withColumn("backfilled", F.lit(True))
    return seen.unionByName(missing, allowMissingColumns=True)


def attach_view(metadata: DataFrame, manifest: DataFrame, suffix: str = "_view") -> DataFrame:
    """Left join on row_idx if both have it, else on image_id; columns that both have get the suffix."""
    key = "row_idx" if "row_idx" in metadata.columns and "row_idx" in manifest.columns else "image_id"
    names = {c: c + suffix for c in manifest.columns if c != key and c in metadata.columns}
    return metadata.join(manifest.withColumnsRenamed(names), key, "left")


def choose_manifest(tagged: DataFrame, tag: str = "file", ok: str = "mask_ok") -> DataFrame:
    """Of several manifests the one with the most usable masks, then rows, then the first name: one row."""
    per = tagged.groupBy(tag).agg(F.sum(F.when(truthy(F.col(ok)), 1).otherwise(0)).alias("n_ok"), F.count(F.lit(1)).alias("n_rows"))
    return per.orderBy(F.desc("n_ok"), F.desc("n_rows"), F.asc(tag)).limit(1)


def choose_path(paths: DataFrame, col: str = "path", penalty: Column | None = None) -> DataFrame:
    """The path with the least penalty, then the shortest, then the first: one row."""
    return paths.orderBy(penalty if penalty is not None else F.lit(0), F.length(col), F.col(col)).limit(1)


def remap_path(path: Column, root: str, marker: str, exact: Column | None = None) -> Column:
    """An exact path if given, else what follows the marker below root, else the file's name below root."""
    p = slashes(path)
    tail = F.substring_index(p, f"/{marker}/", -1)
    below = F.when(F.contains(p, F.lit(f"/{marker}/")), F.concat(F.lit(f"{root}/{marker}/"), tail)).otherwise(F.concat(F.lit(f"{root}/"), F.substring_index(p, "/", -1)))
    return below if exact is None else F.coalesce(exact, below)


def upsert(log: DataFrame, rows: DataFrame, key: str = "run_id") -> DataFrame:
    """rows replace what log has of their keys."""
    return log.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files of moderate size."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verify_digests(files: DataFrame, manifest: DataFrame, slug: str = "slug", digest: str = "sha256") -> DataFrame:
    """manifest with found (the digest of the file of that slug, null without one) and verified. A slug of files that the manifest lacks stops with an error."""
    known = manifest.select(slug).distinct()
    strange = files.join(known, slug, "left_anti").select(slug).limit(1).collect()
    if strange:
        raise KeyError(strange[0][0])
    found = files.select(slug, F.col(digest).alias("found"))
    return manifest.join(found, slug, "left").withColumn("verified", F.col("found").eqNullSafe(F.col(digest)) & F.col("found").isNotNull())


def report_json(df: DataFrame, out: str = "report") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def feature_table(features: DataFrame, ids: DataFrame, key: str = "image_id") -> DataFrame:
    """A stored feature table, valid only if it covers the ids; else an error. Takes the place of array caches by position."""
    if ids.select(key).distinct().join(features.select(key), key, "left_anti").limit(1).count():
        raise ValueError("the feature table does not cover all ids")
    return features.join(ids.select(key).distinct(), key, "left_semi")
