"""Streaming jobs run over the tables; each must end with what the batch form gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.plans.registry import registry
from tallyard.streaming import jobs

QUERIES, SQL, query = registry()


@query("select record_no, cond, item_id from (select *, row_number() over (partition by cond, item_id order by coalesce(ok, false) desc, record_no desc) rn from panel_records) where rn = 1")
def str1_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = jobs.compact_latest(spark, f"{sf_dir}/panel_records.parquet", ["cond", "item_id"], ["record_no", "cond", "item_id", "ok"])
    return t.select("record_no", "cond", "item_id")


@query("select judge, sum((true_author = judge and parsed.model = judge)::int)::bigint as hits, sum((true_author <> judge and parsed.model = judge)::int)::bigint as false_alarms, count(*) as n from panel_records where cond = 'single' and ok group by judge")
def str2_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.running_counts(spark, f"{sf_dir}/panel_records.parquet", "counters_" + uuid.uuid4().hex[:8]).select("judge", "hits", "false_alarms", "n")


@query("with h as (select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as v from events group by 1, 2) select * from h where hour + interval 1 hour <= (select max(ts) - interval 2 hour from events)")
def str3_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed."""
    return jobs.hourly(spark, f"{sf_dir}/events.parquet").withColumn("v", F.round("v", 4))
