"""Command line: list the queries, run one into files, or re-derive the published figures.

python -m tallyard list
python -m tallyard run NAME --data DIR [--out PATH] [--format parquet|csv|json] [--limit N]
python -m tallyard verify
"""

from __future__ import annotations

import argparse
import importlib
import sys

#: Published figures that follow from counts of 38 own and 152 other texts: hits, false alarms, log odds ratio.
GOLDEN = {"GPT": (22, 16, 2.423119162022319), "Claude": (33, 14, 4.06351902279346), "Gemini": (7, 31, -0.08515780834030683)}


def known() -> dict:
    """All queries of the entry module where it can be imported, else those of the plans."""
    try:
        return importlib.import_module("__spark_entry__").queries()
    except ModuleNotFoundError:
        import tallyard.plans as plans

        return {k: f for m in plans.MODULES for k, f in importlib.import_module(f"tallyard.plans.{m}").QUERIES.items()}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tallyard", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    sub.add_parser("verify")
    run = sub.add_parser("run")
    run.add_argument("name")
    run.add_argument("--data", required=True)
    run.add_argument("--out")
    run.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    run.add_argument("--limit", type=int, default=20, help="rows shown where there is no --out")
    a = p.parse_args(args)
    if a.what == "list":
        for name, f in sorted(known().items()):
            print(f"{name:28s} {(f.__doc__ or '').strip().splitlines()[0] if f.__doc__ else ''}")
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.appName("tallyard").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.what == "verify":
        from tallyard.functions import exact

        rows = spark.createDataFrame([(k, *v) for k, v in GOLDEN.items()], "judge string, h int, f int, want double")
        lor, _ = exact.haldane(F.col("h"), F.lit(38), F.col("f"), F.lit(152))
        bad = rows.withColumn("got", lor).where(F.abs(F.col("got") - F.col("want")) > 1e-10).collect()
        print("all published figures re-derived" if not bad else f"differ: {bad}")
        return int(bool(bad))
    df = known()[a.name](spark, a.data)
    if a.out:
        df.write.mode("errorifexists").format(a.format).save(a.out)
    else:
        df.show(a.limit, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
