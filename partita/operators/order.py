"""Running sums and row numbers over all rows in the order of a key, without one task that holds them all.

Keys are dealt into ranges; each range's total gives the next ones their offset, and windows run within a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import cut

#: Ranges, and keys of the smallest hashes that their bounds are drawn from. Bounds balance the work; results do not depend on them.
RANGES, DRAWN = 64, 4096


def _range_of(df: DataFrame, by: str) -> Column:
    drawn = df.select(F.col(by).alias("x")).where("x is not null").distinct().orderBy(F.xxhash64("x")).limit(DRAWN).orderBy("x").collect()
    step = max(1, -(-len(drawn) // RANGES))
    bounds = [F.lit(r.x) for r in drawn[step::step]]
    return F.size(F.filter(F.array(*bounds), lambda x: x <= F.col(by))) if bounds else F.lit(0)


def running(df: DataFrame, by: str, sums: list[str], descending: bool = False) -> DataFrame:
    """df with run_<c> for each c of sums: the sum of c over the rows up to this one in the order of `by`, nulls lowest.

    One row per value of `by` is expected; of equal values each gets some place. df is written once, as it is read three times.
    """
    df = cut(df)
    dealt = df.withColumn("_range", _range_of(df, by))
    along = (lambda c: F.desc_nulls_last(c)) if descending else (lambda c: F.asc_nulls_first(c))
    earlier = Window.orderBy(along("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    within = Window.partitionBy("_range").orderBy(along(by)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(F.broadcast(offsets), "_range").select(*df.columns, *[(F.col(f"_{c}") + F.sum(c).over(within)).alias(f"run_{c}") for c in sums])


def numbered(df: DataFrame, by: str, name: str = "row_idx") -> DataFrame:
    """df with its rows numbered from 0 in the order of a key that no two rows share. The number follows from the data, not from files."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), by, ["_one"]).withColumn(name, F.col("run__one") - 1).drop("_one", "run__one")
