"""Total orders over the whole cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.durable import materialise


def numbered(df: DataFrame, order: list[str], name: str, weight: str | None = None) -> DataFrame:
    """``df`` with the place (from 1) of each row in the order of ``order``, nulls first.

    With ``weight`` it is the running sum of that column in place of the number of
    rows. Rows are sorted by range and summed inside their partition; only one sum per
    partition goes to the driver. No task holds more than its range.
    """
    at = [F.col(c).asc_nulls_first() for c in order]
    ranged = df.withColumn("__w", F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint"))
    ranged = ranged.repartitionByRange(*at).sortWithinPartitions(*at).withColumn("__part", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for pdf in batches:
            s = pdf["__w"].cumsum() + n
            yield pdf.assign(__row=s)
            n = int(s.iloc[-1]) if len(s) else n

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + ", __row bigint"
    rows = materialise(ranged.mapInPandas(run, schema), "numbered")
    sizes = rows.groupBy("__part").agg(F.sum("__w").alias("n")).orderBy("__part").collect()
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["__part"], before))
        before += r["n"]
    start = F.create_map(*[F.lit(x).cast("bigint") for kv in offsets for x in kv]) if offsets else None
    place = F.col("__row") + (F.element_at(start, F.col("__part").cast("bigint")) if start is not None else F.lit(0))
    return rows.withColumn(name, place).drop("__part", "__row", "__w")


def mid_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, t, mid): number of ties and average rank of every distinct value within ``by``.

    Values are counted, their counts summed over the cluster in sorted order, and each
    group's start taken off; no group is sorted in one task.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("t"))
    run = numbered(counts, [*by, value], "__cum", weight="t")
    if by:
        start = run.groupBy(*by).agg(F.min(F.col("__cum") - F.col("t")).alias("__start"))
        run = run.join(start, by).withColumn("__cum", F.col("__cum") - F.col("__start"))
    return run.select(*by, value, "t", (F.col("__cum") - (F.col("t") - 1) / 2).alias("mid"))
