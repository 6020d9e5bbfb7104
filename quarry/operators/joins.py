"""Join operators: unused definitions, range and containment matches, snapshot differences, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(definitions: DataFrame, references: DataFrame, key: str, reference: str) -> DataFrame:
    """Definitions whose key is never referenced."""
    return definitions.join(references.select(F.col(reference).alias(key)).distinct(), key, "left_anti")


def having_in_range(left: DataFrame, right: DataFrame, on: Column, point: Column, low: Column, high: Column) -> DataFrame:
    """Rows of *left* for which *right* has a row of the same key with *point* in [low, high]."""
    return left.join(right, on & point.between(low, high), "left_semi")


def containing(left: DataFrame, words: Sequence[str], column: str) -> DataFrame:
    """Each row with each of the constant *words* that it contains: an array test, no join of pairs."""
    found = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col(column), w))
    return left.withColumn("word", F.explode(found))


def difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key and change: added, deleted or changed, between two snapshots."""
    o, n = old.select(key, F.col(value).alias("o")), new.select(key, F.col(value).alias("n"))
    both = o.join(n, key, "full").filter(~F.col("o").eqNullSafe(F.col("n")))
    return both.select(key, F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").otherwise("changed").alias("change"))


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """*base* with the rows of *changes* in place of those of the same key."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)
