"""Checks that stop a run instead of letting a wrong figure through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_to_one(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Inner join on ``key`` that raises at run time where the key repeats on either side."""

    def counted(df: DataFrame, tag: str) -> DataFrame:
        rest = [c for c in df.columns if c not in key]
        n = F.count(F.lit(1))
        one = df.groupBy(*key).agg(n.alias(tag), *[F.any_value(c).alias(c) for c in rest])
        return one.where(F.when(F.col(tag) == 1, True).otherwise(F.raise_error(F.lit("the key of a one-to-one join repeats")).cast("boolean"))).drop(tag)

    return counted(a, "__na").join(counted(b, "__nb"), key)


def unusable_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows, distinct-or-not, and values that are not finite."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        bad = F.isnan(x) | x.isNull() | (F.abs(x) == float("inf"))
        low, high = F.min(F.when(~bad, x)), F.max(F.when(~bad, x))
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), low.eqNullSafe(high).cast("int").alias("is_constant"), F.sum(bad.cast("int")).alias("not_finite")))
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
