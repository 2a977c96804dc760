"""At-least-once delivery: keep exactly one row per identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], order: list[Column], payload: list[str] | None = None) -> DataFrame:
    """Exactly one row per ``keys``: the one whose ``order`` struct is smallest.

    ``order`` holds the preference (flags first), the delivery time and a
    deterministic tie-break; with a unique tie-break the result doesn't depend
    on partitioning. One ``min_by`` per key, so every map task reduces its own
    rows to one per key before the shuffle and a key that holds a third of all
    rows costs one row per map task.

    Nulls in ``keys`` form a key of their own (as in GROUP BY). Rows that tie in
    the whole ``order`` struct are interchangeable and one of them stays. An empty
    table gives an empty table. ``payload`` defaults to all other columns; it may
    have any names, also ones that clash with nothing here because it travels as
    positional struct fields.
    """
    payload = [c for c in df.columns if c not in keys] if payload is None else payload
    ordering = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    if len(payload) == 1:
        return df.groupBy(*keys).agg(F.min_by(F.col(f"`{payload[0]}`"), ordering).alias(payload[0]))
    row = F.struct(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(payload)])
    kept = df.groupBy(*keys).agg(F.min_by(row, ordering).alias("__kept"))
    return kept.select(*keys, *[F.col(f"__kept.p{i}").alias(c) for i, c in enumerate(payload)])


def latest_ok(log: DataFrame, keys: list[str], ok: str = "ok", number: str = "record_no", payload: list[str] | None = None) -> DataFrame:
    """Per ``keys`` the row with the highest ``number`` (the order of delivery) among those with ``ok`` true, else among all.

    A null ``ok`` counts as not ok; a null ``number`` loses against any other. The
    struct (not ok, -number) is packed into one decimal where only one fixed-width
    column is kept: its buffer then has a fixed width too and Spark aggregates by hash
    instead of sorting.
    """
    not_ok = ~F.coalesce(F.col(ok), F.lit(False))
    delivered = F.coalesce(-F.col(number), F.lit((1 << 63) - 1))
    if payload == [number]:
        packed = F.when(not_ok, F.expr("18446744073709551616BD")).otherwise(F.expr("0BD")).cast("decimal(38,0)") + delivered.cast("decimal(20,0)")
        return log.groupBy(*keys).agg(F.min_by(number, packed).alias(number))
    return keep_one(log, keys, [not_ok, delivered], payload)
