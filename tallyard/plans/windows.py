"""Analytic functions of the audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyard.functions import text
from tallyard.operators.delivery import keep_one
from tallyard.operators.ordering import mid_ranks
from tallyard.plans.registry import registry
from tallyard.sources.fixtures import CTE, judgments, quality, ratings, responses, yes_no
from tallyard.sources.tables import table

QUERIES, SQL, query = registry()


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).select("doc_id", "prompt_id", "author", F.coalesce(F.length("text"), F.lit(0)).alias("n"))


_LEN = CTE + ", len as (select doc_id, prompt_id, author, coalesce(length(text), 0)::int as n from resp)"


@query(_LEN + " select doc_id, rank() over (partition by prompt_id order by n) as up, rank() over (partition by prompt_id order by n desc) as down from len")
def win01_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("prompt_id")
    return _lengths(spark, sf_dir).select("doc_id", F.rank().over(w.orderBy("n")).cast("bigint").alias("up"), F.rank().over(w.orderBy(F.desc("n"))).cast("bigint").alias("down"))


@query(_LEN + " select doc_id, round((rank() over (order by n) + (count(*) over (partition by n) - 1) / 2) / count(*) over (), 6) as pct from len")
def win02_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average rank over all rows as a share."""
    df = _lengths(spark, sf_dir)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.join(mid_ranks(df, "n", []), "n").join(F.broadcast(total)).select("doc_id", F.round(F.col("mid") / F.col("total"), 6).alias("pct"))


@query(_LEN + " select prompt_id, max(n)::int as longest, count(*) filter (n = m) as ties from (select *, max(n) over (partition by prompt_id) m from len) group by prompt_id")
def win03_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties at the extreme, by aggregation of value counts."""
    g = _lengths(spark, sf_dir).groupBy("prompt_id", "n").agg(F.count(F.lit(1)).alias("t"))
    return keep_one(g, ["prompt_id"], [-F.col("n")]).select("prompt_id", F.col("n").alias("longest"), F.col("t").alias("ties"))


@query(CTE + "select judge, p_yes, (rank() over (partition by judge order by p_yes) + (count(*) over (partition by judge, p_yes) - 1) / 2)::double as mid from yesno qualify row_number() over (partition by judge, p_yes order by item) = 1")
def win04_mid_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mid_ranks(yes_no(spark, sf_dir), "p_yes", ["judge"]).select("judge", "p_yes", F.col("mid").cast("double").alias("mid"))


@query(CTE + "select item, round((quality - avg(quality) over w) / coalesce(nullif(stddev_samp(quality) over w, 0), 1), 6) as z from qual window w as (partition by block, judge)")
def win05_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("block", "judge")
    sd = F.coalesce(F.nullif(F.stddev_samp("quality").over(w), F.lit(0.0)), F.lit(1.0))
    return quality(spark, sf_dir).select("item", F.round((F.col("quality") - F.avg("quality").over(w)) / sd, 6).alias("z"))


@query(CTE + "select prompt_id, min(len(list_filter(string_split_regex(coalesce(text, ''), '[\\s\\p{Z}]+'), lambda x: x <> '')))::int as floor_ from resp group by prompt_id")
def win06_group_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses(spark, sf_dir).select("prompt_id", F.size(text.white_words(F.col("text"))).alias("n"))
    return r.groupBy("prompt_id").agg(F.min("n").alias("floor_"))


@query(CTE + "select block, judge, author from (select *, row_number() over (partition by block, judge order by lp_cond desc, author_idx) rn from rate) where rn = 1")
def win07_arg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_one(ratings(spark, sf_dir), ["block", "judge"], [-F.col("lp_cond"), F.col("author_idx")], ["author", "lp_cond"]).select("block", "judge", "author")


@query(CTE + "select k, round(confidence - avg(confidence) over (partition by cond, block, judge), 6) as demeaned from judg")
def win08_demeaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select("k", F.round(F.col("confidence") - F.avg("confidence").over(W.partitionBy("cond", "block", "judge")), 6).alias("demeaned"))


@query(CTE + ", s as (select block, judge, author, quality as s from qual) select j.k as k, round(1 + count(*) filter (o.s > g.s) + 0.5 * count(*) filter (o.s = g.s and o.author <> g.author), 6) as guess_rank from judg j join s g on g.block = j.block and g.judge = j.judge and g.author = j.guess join s o on o.block = j.block and o.judge = j.judge where j.cond = 'single' group by j.k")
def win09_guess_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the guessed author among the texts of a block that the judge rated: one more than those above, and half of those level."""
    s = quality(spark, sf_dir).groupBy("block", "judge").agg(F.map_from_entries(F.collect_list(F.struct("author", "quality"))).alias("m"))
    j = judgments(spark, sf_dir).where("cond = 'single'").select("k", "block", "judge", "guess")
    own = F.try_element_at("m", F.col("guess"))
    above = F.size(F.filter(F.map_values("m"), lambda x: x > own))
    level = F.size(F.filter(F.map_values("m"), lambda x: x == own)) - 1
    return j.join(s, ["block", "judge"]).where(own.isNotNull()).select("k", F.round(1 + above + 0.5 * level, 6).alias("guess_rank"))


def holm(p: Column, family: list[str], ties: list[str]) -> Column:
    """Holm's step-down p within ``family`` (a family is a handful of tests)."""
    w = W.partitionBy(*family).orderBy(p, *ties)
    m = F.count(p).over(W.partitionBy(*family))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * p)
    return step


def with_holm(df: DataFrame, p: str, family: list[str], ties: list[str], name: str = "holm") -> DataFrame:
    stepped = df.withColumn("__step", holm(F.col(p), family, ties))
    w = W.partitionBy(*family).orderBy(p, *ties).rowsBetween(W.unboundedPreceding, 0)
    return stepped.withColumn(name, F.max("__step").over(w)).drop("__step")


@query("with p as (select p_brand, p_partkey, (p_size % 40 + 1) / 1000.0 as p from part), s as (select *, least(1.0, (count(*) over (partition by p_brand) - row_number() over (partition by p_brand order by p, p_partkey) + 1) * p) as step from p) select p_partkey, round(max(step) over (partition by p_brand order by p, p_partkey rows unbounded preceding), 9) as holm from s")
def win10_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_brand", "p_partkey", "p_size").withColumn("p", (F.col("p_size") % 40 + 1) / 1000.0)
    return with_holm(p, "p", ["p_brand"], ["p_partkey"]).select("p_partkey", F.round("holm", 9).alias("holm"))


def folds(df: DataFrame, key: str = "prompt_no", k: int = 5) -> Column:
    return F.pmod(F.col(key), F.lit(k)).cast("int")


@query(CTE + ", f as (select (prompt_no % 5)::int as fold, author, guess, count(*) n from judg where cond = 'lineup' and is_self = 0 group by 1, 2, 3), t as (select author, guess, sum(n) n from f group by 1, 2), c as (select d.fold, t.author, t.guess, t.n - coalesce(f.n, 0) as n from (select unnest([0, 1, 2, 3, 4]) as fold) d join t on true left join f on f.fold = d.fold and f.author = t.author and f.guess = t.guess) select fold, author, guess as modal from (select *, row_number() over (partition by fold, author order by n desc, guess) rn from c) where rn = 1")
def win11_train_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modal guess for each author outside each fold: all counts less the fold's own, so no fold is read five times."""
    j = judgments(spark, sf_dir).where("cond = 'lineup' and is_self = 0")
    f = j.withColumn("fold", folds(j)).groupBy("author", "guess").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("fold") == i).cast("int")).alias(f"f{i}") for i in range(5)])
    long = f.select("author", "guess", F.inline(F.array(*[F.struct(F.lit(i).alias("fold"), (F.col("n") - F.col(f"f{i}")).alias("m")) for i in range(5)])))
    return keep_one(long, ["fold", "author"], [-F.col("m"), F.col("guess")]).select("fold", "author", F.col("guess").alias("modal"))
