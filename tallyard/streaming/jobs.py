"""Structured Streaming forms of the audit's log jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.durable import fresh_path
from tallyard.operators.delivery import latest_ok


def source(spark: SparkSession, path: str) -> DataFrame:
    """A file-source stream over Parquet with the schema of what lies there; ``path`` is a folder or one file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run(df: DataFrame, out: str, mode: str = "append") -> None:
    """Drive a stream over all input there is, into Parquet, with a checkpoint beside it."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def compact_latest(spark: SparkSession, path: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Latest-ok table of an append log: each batch is merged into the next version of the table by one aggregation.

    Versions are named by batch number, so a batch that runs twice writes the same
    version, and the last finished version is the result.
    """
    root, state = fresh_path(spark, "latest"), {"last": None}

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        old = s.read.parquet(f"{root}/v{number - 1}") if number else None
        both = batch.select(*columns) if old is None else batch.select(*columns).unionByName(old)
        latest_ok(both, keys).select(*columns).write.mode("overwrite").parquet(f"{root}/v{number}")
        state["last"] = number

    q = source(spark, path).writeStream.foreachBatch(merge).option("checkpointLocation", root + "-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/v{state['last']}")


def running_counts(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Self-naming and false alarms per judge, in update mode: the last update of each judge is its total."""
    log = source(spark, path).where("cond = 'single' and ok")
    own, named = F.col("true_author") == F.col("judge"), F.col("parsed.model") == F.col("judge")
    agg = log.groupBy("judge").agg(F.sum((own & named).cast("int")).alias("hits"), F.sum((~own & named).cast("int")).alias("false_alarms"), F.count(F.lit(1)).alias("n"))
    q = agg.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", fresh_path(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def hourly(spark: SparkSession, path: str) -> DataFrame:
    """Windowed sums with a watermark; a closing run emits every window that the watermark has passed."""
    ev = source(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours")
    agg = ev.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    out = fresh_path(spark, "hourly")
    run(agg.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("v", 4).alias("v")), out)
    return spark.read.parquet(out)
