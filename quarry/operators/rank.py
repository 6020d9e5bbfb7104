"""Ordered operators: carry-forward, sections, first and last per key, top-k, percentiles, queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut


def carried(value: Column, by: Sequence[str], order: Sequence[str]) -> Column:
    """The last value that is not null so far."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def sections(df: DataFrame, by: str, position: str, opens: Column) -> DataFrame:
    """A row for each opening row: it ends before the next one of its key, the last one at the key's end."""
    end = df.groupBy(by).agg(F.max(position).alias("key_end"))
    marks = df.filter(opens).select(by, F.col(position).alias("start")).withColumn("next", F.lead("start").over(Window.partitionBy(by).orderBy("start")))
    return marks.join(end, by).select(by, "start", F.coalesce(F.col("next") - 1, F.col("key_end")).alias("end"))


def first_per_key(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the first in *order* (which must be total)."""
    columns = [c for c in df.columns if c not in by]
    best = F.min_by(F.struct(*columns), F.struct(*order)).alias("b")
    return df.groupBy(*by).agg(best).select(*by, "b.*")


def last_per_key(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    columns = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("b")
    return df.groupBy(*by).agg(best).select(*by, "b.*")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first *k* rows; *order* must end in a unique column."""
    return df.orderBy(*order).limit(k)


def top_per_key(df: DataFrame, by: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first *k* rows of each key; Spark keeps *k* a key in each task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def nearest_ranks(df: DataFrame, by: str, value: str, percents: dict[str, int]) -> DataFrame:
    """*by* and, for each name, the value at rank n * percent // 100 (from 0) among the values of the key that are not null.

    Equal values are counted first, combined before the shuffle. The counts are dealt out by value range, and a running
    sum goes on from one range to the next, so no task sorts all values of a hot key.
    """
    counts = cut(df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n")))
    parts = 64
    edges = counts.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000).alias("e")).first().e or []
    part = F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>"), lambda e: e <= F.col(value)))
    counts = counts.withColumn("_p", part)
    sums = counts.groupBy(by, "_p").agg(F.sum("_n").alias("_s"))
    before = Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(by)
    sums = sums.select(by, "_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"), F.sum("_s").over(whole).alias("_total"))  # at most *parts* rows a key
    within = Window.partitionBy(by, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    d = counts.join(sums, [by, "_p"]).withColumn("_to", F.col("_b") + F.sum("_n").over(within)).withColumn("_from", F.col("_to") - F.col("_n"))
    rank = {n: F.least(F.expr(f"_total * {p} div 100"), F.col("_total") - 1) for n, p in percents.items()}
    hit = [F.max(F.when((F.col("_from") <= r) & (r < F.col("_to")), F.col(value))).alias(n) for n, r in rank.items()]
    return d.groupBy(by).agg(*hit)


def work_ahead(amount: str, by: Sequence[str], order: Sequence[str]) -> Column:
    """Sum of *amount* over the earlier rows of the key."""
    return F.coalesce(F.sum(amount).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
