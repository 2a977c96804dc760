"""Tests, intervals and verdicts of the audit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyard.durable import materialise, ship
from tallyard.functions import exact, kernels
from tallyard.operators.gee import gee
from tallyard.operators.ordering import mid_ranks
from tallyard.plans.aggregates import _BLAME, _CUED, CUES, blame, correlation, cued
from tallyard.plans.registry import registry
from tallyard.plans.windows import with_holm
from tallyard.sources.fixtures import CTE, MODELS, full, judgments, quality, ratings, yes_no
from tallyard.sources.tables import table

QUERIES, SQL, query = registry()
CHANCE = 0.2


def r9(c: Column) -> Column:
    return F.round(c, 9)


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def cells(j: DataFrame) -> DataFrame:
    """Counts per format and judge: hits and own texts, false alarms and others' texts, peers' hits on the judge's texts."""
    named = j.groupBy("cond", F.col("judge").alias("target")).agg(F.sum(F.col("is_self") * F.col("named_self")).alias("h"), F.sum("is_self").alias("hn"), F.sum((1 - F.col("is_self")) * F.col("named_self")).alias("f"), F.sum(1 - F.col("is_self")).alias("fn"))
    peers = j.groupBy("cond", F.col("author").alias("target")).agg(F.sum((1 - F.col("is_self")) * F.col("correct")).alias("p"), F.sum(1 - F.col("is_self")).alias("pn"))
    return named.join(peers, ["cond", "target"]).select("cond", F.col("target").alias("judge"), "h", "hn", "f", "fn", "p", "pn")


_CELLS = CTE + ", cells as (select cond, judge, h, hn, f, fn, p, pn from (select cond, judge, sum(is_self * named_self)::bigint h, sum(is_self)::bigint hn, sum((1 - is_self) * named_self)::bigint f, sum(1 - is_self)::bigint fn from judg group by 1, 2) join (select cond, author as judge, sum((1 - is_self) * correct)::bigint p, sum(1 - is_self)::bigint pn from judg group by 1, 2) using (cond, judge))"
_LB = "(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.2) + (n - i) * ln(0.8))"


def _sql_binom(k: str, n: str, two: bool = True) -> str:
    lb = lambda i: f"(lgamma({n} + 1) - lgamma({i} + 1) - lgamma({n} - {i} + 1) + {i} * ln(0.2) + ({n} - {i}) * ln(0.8))"
    keep = f"{lb('i')} <= {lb(k)} + ln(1 + 1e-7)" if two else f"i >= {k}"
    return f"least(1.0, list_sum(list_transform(list_filter(range(0, {n} + 1), lambda i: {keep}), lambda i: exp({lb('i')}))))"


@query(_CELLS + f" select cond, judge, h, hn, round({_sql_binom('h', 'hn')}, 9) as p_two, round({_sql_binom('h', 'hn', False)}, 9) as p_greater from cells")
def sta01_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(judgments(spark, sf_dir))
    return c.select("cond", "judge", "h", "hn", r9(exact.binomial(F.col("h"), F.col("hn"), CHANCE)).alias("p_two"), r9(exact.binomial_at_least(F.col("h"), F.col("hn"), CHANCE)).alias("p_greater"))


@query()
def sta02_clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return cells(judgments(spark, sf_dir)).select("cond", "judge", kernels.clopper_pearson("h", "hn").alias("ci")).select("cond", "judge", r6("ci.low").alias("low"), r6("ci.high").alias("high"))


@query(_CELLS + " select cond, judge, round((h / hn + 3.8416 / (2 * hn) - 1.96 * sqrt(h / hn * (1 - h / hn) / hn + 3.8416 / (4 * hn * hn))) / (1 + 3.8416 / hn), 6) as low, round((h / hn + 3.8416 / (2 * hn) + 1.96 * sqrt(h / hn * (1 - h / hn) / hn + 3.8416 / (4 * hn * hn))) / (1 + 3.8416 / hn), 6) as high from cells")
def sta03_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = exact.wilson(F.col("h"), F.col("hn"))
    return cells(judgments(spark, sf_dir)).select("cond", "judge", r6(low).alias("low"), r6(high).alias("high"))


@query(_CELLS + f" select cond, judge, round({exact.sql_fisher('h', '(hn - h)', 'p', '(pn - p)')}, 9) as p_value, round((h * (pn - p)) / nullif((hn - h) * p, 0), 6) as odds_ratio from cells")
def sta04_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own against peers' hits on the judge's texts."""
    h, hn, p, pn = (F.col(x) for x in ("h", "hn", "p", "pn"))
    return cells(judgments(spark, sf_dir)).select("cond", "judge", r9(exact.fisher(h, hn - h, p, pn - p)).alias("p_value"), r6(F.try_divide(h * (pn - p), (hn - h) * p)).alias("odds_ratio"))


@query(_BLAME + ", e as (select *, sum(k) over (partition by cond) / 5 as e from blame) select cond, round(sum((k - e) ^ 2 / e), 6) as chi2, round(exp(-sum((k - e) ^ 2 / e) / 2) * (1 + sum((k - e) ^ 2 / e) / 2), 9) as p_value from e group by cond")
def sta05_goodness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blame against equal shares, four degrees of freedom."""
    b = blame(judgments(spark, sf_dir)).withColumn("e", F.sum("k").over(W.partitionBy("cond")) / 5)
    x = F.sum((F.col("k") - F.col("e")) ** 2 / F.col("e"))
    return b.groupBy("cond").agg(x.alias("x")).select("cond", r6("x").alias("chi2"), r9(exact.chi2_even(F.col("x"), 4)).alias("p_value"))


@query(_CUED + ", c as (select judge, names_a_model as names, count(*) n from cued group by 1, 2), e as (select *, sum(n) over (partition by judge) * sum(n) over (partition by names) / sum(n) over () as e from c) select round(sum((n - e) ^ 2 / e), 6) as chi2, round(exp(-sum((n - e) ^ 2 / e) / 2) * (1 + sum((n - e) ^ 2 / e) / 2), 9) as p_value from e")
def sta06_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges by whether a reason names a model."""
    c = cued(judgments(spark, sf_dir)).groupBy("judge", "names_a_model").agg(F.count(F.lit(1)).alias("n"))
    e = c.withColumn("e", F.sum("n").over(W.partitionBy("judge")) * F.sum("n").over(W.partitionBy("names_a_model")) / F.sum("n").over(W.partitionBy(F.lit(0))))
    return e.agg(F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")).alias("x")).select(r6("x").alias("chi2"), r9(exact.chi2_even(F.col("x"), 4)).alias("p_value"))


@query(_CELLS + ", d as (select cond, h / hn - p / pn as d from cells), t as (select cond, avg(d) / (stddev_samp(d) / sqrt(5)) as t from d group by cond) select cond, round(t, 6) as t, round(2 * (0.5 - 0.375 * abs(t) / sqrt(1 + t * t / 4) * (1 - t * t / (12 * (1 + t * t / 4)))), 9) as p_value from t")
def sta07_one_sample_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean self-advantage of the five judges against zero."""
    d = cells(judgments(spark, sf_dir)).withColumn("d", F.col("h") / F.col("hn") - F.col("p") / F.col("pn"))
    t = d.groupBy("cond").agg((F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.lit(5.0)))).alias("t"))
    return t.select("cond", r6("t").alias("t"), r9(exact.t4_two_sided(F.col("t"))).alias("p_value"))


def rank_sums(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """Per ``by``: sizes, rank sum of group 1 and tie correction, from counts of distinct values."""
    v = df.groupBy(*by, value).agg(F.sum(group).alias("g1"), F.count(F.lit(1)).alias("t"))
    m = mid_ranks(df, value, by)
    return v.join(m.select(*by, value, "mid"), [*by, value]).groupBy(*by).agg(F.sum("g1").alias("n1"), F.sum("t").alias("n"), F.sum(F.col("mid") * F.col("g1")).alias("r1"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))


_RANKED = CTE + ", x as (select judge, p_yes as v, (author = judge)::int as g from yesno), rk as (select *, rank() over (partition by judge order by v) + (count(*) over (partition by judge, v) - 1) / 2 as mid, count(*) over (partition by judge, v) as t from x), rs as (select judge, sum(g)::bigint as n1, count(*) as n, sum(mid * g) as r1, sum(t * t - 1) as ties from rk group by judge)"


@query(_RANKED + " select judge, round(r1 - n1 * (n1 + 1) / 2, 6) as u, round((r1 - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))), 6) as z from rs")
def sta08_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U of own texts' p_yes, with its z corrected for ties."""
    x = yes_no(spark, sf_dir).select("judge", F.col("p_yes").alias("v"), (F.col("author") == F.col("judge")).cast("int").alias("g"))
    n1, n, r1 = F.col("n1"), F.col("n"), F.col("r1")
    u = r1 - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * (n - n1) / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return rank_sums(x, "v", "g", ["judge"]).select("judge", r6(u).alias("u"), r6((u - n1 * (n - n1) / 2) / sd).alias("z"))


@query(CTE + ", a as (select judge, p_yes, quality, rank() over (partition by judge order by p_yes) + (count(*) over (partition by judge, p_yes) - 1) / 2 as x, rank() over (partition by judge order by quality) + (count(*) over (partition by judge, quality) - 1) / 2 as y from qual where p_yes is not null) select judge, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) as rho from a group by judge")
def sta09_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation, ranks taken from counts of distinct values."""
    r = ratings(spark, sf_dir).where("p_yes is not null and quality is not null").select("judge", "p_yes", "quality")
    x = mid_ranks(r, "p_yes", ["judge"]).select("judge", "p_yes", F.col("mid").alias("x"))
    y = mid_ranks(r, "quality", ["judge"]).select("judge", "quality", F.col("mid").alias("y"))
    return r.join(x, ["judge", "p_yes"]).join(y, ["judge", "quality"]).groupBy("judge").agg(r6(correlation(F.col("x"), F.col("y"))).alias("rho"))


@query(CTE + ", x as (select author, quality as v, rank() over (order by quality) + (count(*) over (partition by quality) - 1) / 2 as mid, count(*) over (partition by quality) as t, count(*) over () as n from qual), g as (select author, count(*) k, sum(mid) r, any_value(n) n from x group by author), h as (select (12 / (any_value(n) * (any_value(n) + 1)) * sum(r * r / k) - 3 * (any_value(n) + 1)) / (1 - (select sum(t * t - 1) from x) / (any_value(n) ^ 3 - any_value(n))) as h from g) select round(h, 5) as h, round(exp(-h / 2) * (1 + h / 2), 7) as p_value from h")
def sta10_kruskal_wallis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings by author, four degrees of freedom."""
    r = quality(spark, sf_dir).select("author", F.round("quality", 6).alias("v"))
    m = mid_ranks(r, "v", []).select("v", "mid", "t")
    c = r.groupBy("author", "v").agg(F.count(F.lit(1)).alias("k")).join(m, "v")
    g = c.groupBy("author").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("mid")).alias("r"))
    ties = m.agg(F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"), F.sum("t").cast("double").alias("n"))
    n = F.first("n")
    h = g.join(F.broadcast(ties)).agg(((12 / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("k")) - 3 * (n + 1)) / (1 - F.first("ties") / (n * n * n - n))).alias("h"))
    return h.select(F.round("h", 5).alias("h"), F.round(exact.chi2_even(F.col("h"), 4), 7).alias("p_value"))


def leak(c: DataFrame) -> DataFrame:
    """Log odds of naming oneself, own against others' texts; null where both counts are zero."""
    h, hn, f, fn = (F.col(x) for x in ("h", "hn", "f", "fn"))
    lor, se = exact.haldane(h, hn, f, fn)
    degenerate = ((h == 0) & (f == 0)).cast("int")
    return c.select("cond", "judge", degenerate.alias("degenerate"), F.when(degenerate == 0, lor).alias("leak"), F.when(degenerate == 0, se).alias("se"))


_LEAK = _CELLS + ", leak as (select cond, judge, (h = 0 and f = 0)::int as degenerate, case when h > 0 or f > 0 then ln((h + 0.5) * (fn - f + 0.5) / ((hn - h + 0.5) * (f + 0.5))) end as leak, case when h > 0 or f > 0 then sqrt(1 / (h + 0.5) + 1 / (hn - h + 0.5) + 1 / (f + 0.5) + 1 / (fn - f + 0.5)) end as se from cells)"


@query(_LEAK + " select cond, judge, degenerate, round(leak, 6) as leak, round(se, 6) as se, round(leak / se, 6) as z, round(exp(leak), 6) as odds, round(leak - 1.96 * se, 6) as low, round(leak + 1.96 * se, 6) as high from leak")
def sta11_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("leak"), F.col("se")
    return leak(cells(judgments(spark, sf_dir))).select("cond", "judge", "degenerate", r6(k).alias("leak"), r6(s).alias("se"), r6(k / s).alias("z"), r6(F.exp(k)).alias("odds"), r6(k - 1.96 * s).alias("low"), r6(k + 1.96 * s).alias("high"))


@query(_LEAK + " select a.judge as judge, round(b.leak - a.leak, 6) as change, round((b.leak - a.leak) / sqrt(a.se * a.se + b.se * b.se), 6) as z from leak a join leak b on a.judge = b.judge where a.cond = 'lineup' and b.cond = 'single' and a.leak is not null and b.leak is not null")
def sta12_leak_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = leak(cells(judgments(spark, sf_dir))).where("leak is not null")
    a, b = k.where("cond = 'lineup'"), k.where("cond = 'single'").select("judge", F.col("leak").alias("b"), F.col("se").alias("sb"))
    return a.join(b, "judge").select("judge", r6(F.col("b") - F.col("leak")).alias("change"), r6((F.col("b") - F.col("leak")) / F.sqrt(F.col("se") ** 2 + F.col("sb") ** 2)).alias("z"))


@query("select round(ln((0 + 0.5) * (152 - 0 + 0.5) / ((38 - 0 + 0.5) * (0 + 0.5))), 6) as raw_leak, 1 as degenerate")
def sta13_illustration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the arithmetic gives for zero hits and zero false alarms, were it not refused."""
    lor, _ = exact.haldane(F.lit(0), F.lit(38), F.lit(0), F.lit(152))
    return spark.range(1).select(r6(lor).alias("raw_leak"), F.lit(1).alias("degenerate"))


@query(_CELLS + " select cond, judge, round(ln((h + 0.5) * (fn - f + 0.5) / ((hn - h + 0.5) * (f + 0.5))), 6) as log_odds from cells")
def sta14_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lor, _ = exact.haldane(F.col("h"), F.col("hn"), F.col("f"), F.col("fn"))
    return cells(judgments(spark, sf_dir)).select("cond", "judge", r6(lor).alias("log_odds"))


def named_long(j: DataFrame) -> DataFrame:
    """Per judge as target and block, two designs: 'own' (its own judgments) and 'peers' (all judges of its text): times named, of how many, and whether in the own cell.

    A block without its own cell says nothing about it and is left out.
    """
    own = j.groupBy("cond", F.lit("own").alias("design"), F.col("judge").alias("target"), "block").agg(F.sum("named_self").alias("t"), F.count(F.lit(1)).alias("k"), F.max(F.col("is_self") * F.col("named_self")).alias("own"), F.max("is_self").alias("there"))
    hit = (F.col("guess") == F.col("author")).cast("int")
    peers = j.groupBy("cond", F.lit("peers").alias("design"), F.col("author").alias("target"), "block").agg(F.sum(hit).alias("t"), F.count(F.lit(1)).alias("k"), F.max(F.col("is_self") * hit).alias("own"), F.max("is_self").alias("there"))
    return own.unionByName(peers).where("there = 1").drop("there")


_NAMED = CTE + ", nl as (select cond, 'own' as design, judge as target, block, sum(named_self)::bigint t, count(*) k, max(is_self * named_self) as own from jfull group by 1, 2, 3, 4 having max(is_self) = 1 union all select cond, 'peers', author, block, sum(correct)::bigint, count(*), max(is_self * correct) from jfull group by 1, 2, 3, 4 having max(is_self) = 1), hist as (select cond, design, target, sum(own)::bigint as s, list(t / k order by block) as q from nl group by 1, 2, 3)"
_PB = _NAMED + ", pb(cond, design, target, s, q, i, a) as (select cond, design, target, s, q, 1, [1.0::double] from hist union all select cond, design, target, s, q, i + 1, list_transform(range(1, len(a) + 2), lambda x: coalesce(a[x], 0) * (1 - q[i]) + case when x > 1 then coalesce(a[x - 1], 0) * q[i] else 0 end) from pb where i <= len(q)), fin as (select cond, design, target, s, list_sum(q) as mean, a from pb where i = len(q) + 1)"


def exact_p(j: DataFrame) -> DataFrame:
    """Exact randomisation p of every target and design, from the histogram of its prompts' chances (k + 1 values at most)."""
    h = named_long(j).groupBy("cond", "design", "target", (F.col("t") / F.col("k")).alias("q")).agg(F.count(F.lit(1)).alias("times"), F.sum("own").alias("own"))

    def tails(pdf: pd.DataFrame) -> pd.DataFrame:
        two, one = kernels.exact_tails(pdf["q"].to_numpy(), pdf["times"].to_numpy(), float(pdf["own"].sum()))
        first = pdf.iloc[0]
        return pd.DataFrame({"cond": [first["cond"]], "design": [first["design"]], "target": [first["target"]], "seen": [int(pdf["own"].sum())], "blocks": [int(pdf["times"].sum())], "mean": [float((pdf["q"] * pdf["times"]).sum())], "p_two": [two], "p_one": [one]})

    return h.groupBy("cond", "design", "target").applyInPandas(tails, "cond string, design string, target string, seen bigint, blocks bigint, mean double, p_two double, p_one double")


@query(_PB + " select cond, target, s as seen, round(mean, 6) as mean, round(least(1.0, list_sum(list_transform(list_filter(range(0, len(a)), lambda i: abs(i - mean) >= abs(s - mean) - 1e-9), lambda i: a[i + 1]))), 8) as p_value from fin where design = 'peers'")
def sta15_selfadv_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-advantage: is the own judge among those who named the author more often than chance allows?"""
    ship(spark)
    return exact_p(full(spark, sf_dir)).where("design = 'peers'").select("cond", "target", "seen", r6("mean").alias("mean"), F.round("p_two", 8).alias("p_value"))


@query(_PB + " select cond, design, target, s as seen, round(least(1.0, list_sum(list_transform(list_filter(range(0, len(a)), lambda i: i >= s - 1e-9), lambda i: a[i + 1]))), 8) as p_one from fin")
def sta16_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discrimination ('own') and advantage ('peers'), one-sided."""
    ship(spark)
    return exact_p(full(spark, sf_dir)).select("cond", "design", "target", "seen", F.round("p_one", 8).alias("p_one"))


@query(_RANKED + " select judge, round((r1 - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), 6) as auc from rs")
def sta19_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = yes_no(spark, sf_dir).select("judge", F.col("p_yes").alias("v"), (F.col("author") == F.col("judge")).cast("int").alias("g"))
    n1, n = F.col("n1"), F.col("n")
    return rank_sums(x, "v", "g", ["judge"]).select("judge", r6((F.col("r1") - n1 * (n1 + 1) / 2) / (n1 * (n - n1))).alias("auc"))


_CELL5 = CTE + ", c5 as (select cond, judge, author, avg(correct) as r from judg group by 1, 2, 3)"


@query(_CELL5 + " select s.cond as cond, s.judge as judge, p.judge as peer, round((s.r - p.r) - (select avg(a.r - b.r) from c5 a join c5 b on a.cond = b.cond and a.author = b.author where a.cond = s.cond and a.judge = s.judge and b.judge = p.judge and a.author <> s.judge and a.author <> p.judge), 6) as adjusted from c5 s join c5 p on s.cond = p.cond and s.author = s.judge and p.author = s.judge and p.judge <> s.judge")
def sta24_skill_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-advantage over each peer less the difference of the two on third parties' texts: from a table of 25 cells a format."""
    c = judgments(spark, sf_dir).groupBy("cond", "judge", "author").agg(F.avg("correct").alias("r"))
    m = c.groupBy("cond").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "judge", "author"), "r"))).alias("m"))
    pairs = m.select("cond", "m", F.explode(F.array(*[F.struct(F.lit(a).alias("judge"), F.lit(b).alias("peer")) for a in MODELS for b in MODELS if a != b])).alias("x")).select("cond", "m", "x.*")
    at = lambda j, a: F.element_at("m", F.concat(j, F.lit("|"), a))
    third = F.filter(F.array(*map(F.lit, MODELS)), lambda a: (a != F.col("judge")) & (a != F.col("peer")))
    skill = F.aggregate(third, F.lit(0.0), lambda s, a: s + at(F.col("judge"), a) - at(F.col("peer"), a)) / F.size(third)
    return pairs.select("cond", "judge", "peer", r6(at(F.col("judge"), F.col("judge")) - at(F.col("peer"), F.col("judge")) - skill).alias("adjusted"))


@query(_CELLS + ", b as (select cond, author, judge, avg(correct) r from judg where is_self = 0 group by 1, 2, 3), strong as (select cond, author, judge as peer from (select *, row_number() over (partition by cond, author order by r desc, judge) rn from b) where rn = 1), d as (select s.cond, s.author, sum((a.correct = 1 and p.correct = 0)::int)::bigint as b, sum((a.correct = 0 and p.correct = 1)::int)::bigint as c from strong s join judg a on a.cond = s.cond and a.author = s.author and a.judge = s.author join judg p on p.cond = s.cond and p.author = s.author and p.judge = s.peer and p.block = a.block group by 1, 2) select cond, author, b, c, round(list_sum(list_transform(range(b, b + c + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))) + 1e-12, 9) as p_value from d")
def sta28_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own judge against the strongest peer on the same texts, one-sided."""
    j = judgments(spark, sf_dir).select("cond", "author", "judge", "block", "correct", "is_self")
    rate = j.where("is_self = 0").groupBy("cond", "author", "judge").agg(F.avg("correct").alias("r"))
    strong = rate.withColumn("rn", F.row_number().over(W.partitionBy("cond", "author").orderBy(F.desc("r"), "judge"))).where("rn = 1").select("cond", "author", "judge")
    peer = j.join(F.broadcast(strong), ["cond", "author", "judge"]).select("cond", "author", "block", F.col("correct").alias("pc"))  # ten rows: formats by authors
    d = j.where("is_self = 1").join(peer, ["cond", "author", "block"]).groupBy("cond", "author").agg(F.sum(F.expr("cast(correct = 1 and pc = 0 as int)")).alias("b"), F.sum(F.expr("cast(correct = 0 and pc = 1 as int)")).alias("c"))
    return d.select("cond", "author", "b", "c", r9(exact.binomial_at_least(F.col("b"), F.col("b") + F.col("c"), 0.5) + 1e-12).alias("p_value"))  # tails of fair coins end in a five: both engines round it up


#: What clusters, of what, and what is taken off before: namings of oneself by prompt (raw, and less what authorship explains), and hits by prompt and by text.
_ICC = (("naming", "raw", "prompt_id", "named_self", "0"), ("naming", "residual", "prompt_id", "named_self", "is_self"), ("hit", "prompt", "prompt_id", "correct", "0"), ("hit", "response", "author_prompt", "correct", "0"), ("peer hit", "response", "author_prompt", "correct", "peer"))


def _sql_icc() -> str:
    parts = []
    for value, variant, cluster, y, less in _ICC:
        key = "author || '|' || prompt_id" if cluster == "author_prompt" else cluster
        unit = "author" if cluster == "author_prompt" else "judge"
        taken = f"{y} - avg({y}) over (partition by cond, {unit}, is_self)" if less == "is_self" else f"{y}::double"
        parts.append(f"select '{value}' as value, '{variant}' as variant, cond, {unit} as unit, {key} as c, {taken} as y from jfull" + (" where is_self = 0" if less == "peer" else ""))
    return CTE + ", y as (" + " union all ".join(parts) + "), g as (select value, variant, cond, unit, c, count(*)::double as n, sum(y) as s, sum(y * y) as q from y group by 1, 2, 3, 4, 5), a as (select value, variant, cond, unit, count(*)::double as a, sum(n) as n, sum(n * n) as nn, sum(s) as s, sum(s * s / n) as b, sum(q) as q from g group by 1, 2, 3, 4), m as (select *, (b - s * s / n) / nullif(a - 1, 0) as msb, (q - b) / nullif(n - a, 0) as msw, (n - nn / n) / nullif(a - 1, 0) as n0 from a), i as (select *, (msb - msw) / nullif(msb + (n0 - 1) * msw, 0) as icc from m) select value, variant, cond, unit, round(icc, 6) as icc, round(1 + (n0 - 1) * icc, 6) as design_effect, round(n / (1 + (n0 - 1) * icc), 4) as n_eff from i"


@query(_sql_icc())
def sta31_icc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ICC(1) by analysis of variance for clusters of unequal size, the design effect, and the effective number of judgments.

    One pass: sums and squares per cluster, then per case; no cluster is held in a task.
    """
    j = full(spark, sf_dir)
    by_self = j.groupBy("cond", "judge", "is_self").agg(F.avg("named_self").alias("mean"))
    j = j.join(F.broadcast(by_self), ["cond", "judge", "is_self"])  # two rows per format and judge of the panel
    text_key = F.concat_ws("|", "author", "prompt_id")
    rows = []
    for value, variant, cluster, y, less in _ICC:
        by_text = cluster == "author_prompt"
        taken = F.col(y) - F.col("mean") if less == "is_self" else F.col(y).cast("double")
        x = F.struct(F.lit(value).alias("value"), F.lit(variant).alias("variant"), F.col("author" if by_text else "judge").alias("unit"), (text_key if by_text else F.col(cluster)).alias("c"), taken.alias("y"))
        rows.append(F.when(F.col("is_self") == 0, x) if less == "peer" else x)
    long = j.select("cond", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x")).select("cond", "x.*")
    y = F.col("y")
    g = long.groupBy("value", "variant", "cond", "unit", "c").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    s, n = F.col("s"), F.col("n")
    a = g.groupBy("value", "variant", "cond", "unit").agg(F.count(F.lit(1)).cast("double").alias("a"), F.sum(s * s / n).alias("b"), F.sum(n * n).alias("nn"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    m = a.select("*", F.try_divide(F.col("b") - s * s / n, F.col("a") - 1).alias("msb"), F.try_divide(F.col("q") - F.col("b"), n - F.col("a")).alias("msw"), F.try_divide(n - F.col("nn") / n, F.col("a") - 1).alias("n0"))
    m = m.withColumn("icc", F.try_divide(F.col("msb") - F.col("msw"), F.col("msb") + (F.col("n0") - 1) * F.col("msw")))
    effect = 1 + (F.col("n0") - 1) * F.col("icc")
    return m.select("value", "variant", "cond", "unit", r6("icc").alias("icc"), r6(effect).alias("design_effect"), F.round(n / effect, 4).alias("n_eff"))


_HOLM = _CELLS + f", p as (select cond, judge, {_sql_binom('h', 'hn', False)} as p from cells)"


@query(_HOLM + ", a as (select *, least(1.0, (5 - row_number() over (partition by cond order by p, judge) + 1) * p) as s1, least(1.0, (10 - row_number() over (order by p, cond, judge) + 1) * p) as s2 from p) select cond, judge, round(max(s1) over (partition by cond order by p, judge rows unbounded preceding), 8) as within, round(max(s2) over (order by p, cond, judge rows unbounded preceding), 8) as across from a")
def sta33_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm within each format and across all ten cells."""
    p = cells(judgments(spark, sf_dir)).select("cond", "judge", exact.binomial_at_least(F.col("h"), F.col("hn"), CHANCE).alias("p"), F.lit(0).alias("all"))
    p = with_holm(with_holm(p, "p", ["cond"], ["judge"], "within"), "p", ["all"], ["cond", "judge"], "across")
    return p.select("cond", "judge", F.round("within", 8).alias("within"), F.round("across", 8).alias("across"))


@query(_LEAK + " select cond, judge, case when degenerate = 1 then 'n/a' when abs(leak) < 1.96 * se then '0' when leak > 0 then '+' else '-' end as pattern from leak")
def sta34_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("leak"), F.col("se")
    return leak(cells(judgments(spark, sf_dir))).select("cond", "judge", F.when(F.col("degenerate") == 1, "n/a").when(F.abs(k) < 1.96 * s, "0").when(k > 0, "+").otherwise("-").alias("pattern"))


@query(_HOLM + ", u as (select p.cond as cond, p.judge as judge, (p.p < 0.05)::int as usual, (l.leak / l.se > 1.96)::int as proper from p join (select cond, judge, ln((h + 0.5) * (fn - f + 0.5) / ((hn - h + 0.5) * (f + 0.5))) as leak, sqrt(1 / (h + 0.5) + 1 / (hn - h + 0.5) + 1 / (f + 0.5) + 1 / (fn - f + 0.5)) as se from cells) l using (cond, judge)) select cond, sum(usual)::bigint as usual, sum(proper)::bigint as proper, sum((usual = 1 and proper = 0)::int)::bigint as false_positive, sum((usual = 0 and proper = 1)::int)::bigint as missed from u group by cond")
def sta35_usual_or_proper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual test against chance beside the proper one against false alarms."""
    c = cells(judgments(spark, sf_dir))
    lor, se = exact.haldane(F.col("h"), F.col("hn"), F.col("f"), F.col("fn"))
    u = c.select("cond", (exact.binomial_at_least(F.col("h"), F.col("hn"), CHANCE) < 0.05).alias("u"), (lor / se > 1.96).alias("p"))
    n = lambda x: F.sum(x.cast("int"))
    return u.groupBy("cond").agg(n(F.col("u")).alias("usual"), n(F.col("p")).alias("proper"), n(F.col("u") & ~F.col("p")).alias("false_positive"), n(~F.col("u") & F.col("p")).alias("missed"))


@query(_PB + ", t as (select cond, design, target, s, list_sum(list_transform(list_filter(range(0, len(a)), lambda i: i >= s - 1e-9), lambda i: a[i + 1])) as p1 from fin), n as (select cond, target, len(q) as n, s from hist where design = 'own'), v as (select d.cond, d.target as judge, n.s as hits, n.n as n, " + _sql_binom("n.s", "n.n", False).replace("lambda i", "lambda i") + " as p_flag, d.p1 as p_disc, e.p1 as p_adv from t d join t e on d.cond = e.cond and d.target = e.target and d.design = 'own' and e.design = 'peers' join n on n.cond = d.cond and n.target = d.target), l as (select cond, judge, hits, n, unnest(['flag', 'disc', 'adv']) as test, unnest([p_flag, p_disc, p_adv]) as p from v), s as (select *, least(1.0, (5 - row_number() over (partition by cond, test order by p, judge) + 1) * p) as st from l), h as (select *, max(st) over (partition by cond, test order by p, judge rows unbounded preceding) as holm from s) select cond, judge, any_value(hits) as hits, any_value(n) as n, (max(holm) filter (test = 'flag') < 0.05)::int as flagged, (max(holm) filter (test = 'disc') < 0.05)::int as discriminates, (max(holm) filter (test = 'adv') < 0.05)::int as exceeds_peers, (max(holm) filter (test = 'disc') < 0.05 and max(holm) filter (test = 'adv') < 0.05)::int as passes from h group by cond, judge")
def sta36_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each judge and format: flagged against chance, discriminating, exceeding peers, and passing both."""
    ship(spark)
    j = full(spark, sf_dir)
    p = materialise(exact_p(j), "exact")  # a row per case and design, read thrice
    wide = p.groupBy("cond", "target").agg(F.max("seen").alias("hits"), F.max(F.when(F.col("design") == "own", F.col("p_one"))).alias("p_disc"), F.max(F.when(F.col("design") == "peers", F.col("p_one"))).alias("p_adv"))
    n = p.where("design = 'own'").select("cond", "target", F.col("blocks").alias("n"))
    v = wide.join(n, ["cond", "target"]).select("cond", F.col("target").alias("judge"), "hits", "n", exact.binomial_at_least(F.col("hits"), F.col("n"), CHANCE).alias("p_flag"), "p_disc", "p_adv")
    for t in ("flag", "disc", "adv"):
        v = with_holm(v, f"p_{t}", ["cond"], ["judge"], f"h_{t}")
    small = lambda t: (F.col(f"h_{t}") < 0.05)
    return v.select("cond", "judge", "hits", "n", small("flag").cast("int").alias("flagged"), small("disc").cast("int").alias("discriminates"), small("adv").cast("int").alias("exceeds_peers"), (small("disc") & small("adv")).cast("int").alias("passes"))


@query()
def sta37_gee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic GEE of naming oneself on authorship, prompts as clusters; null where not estimable."""
    return gee(full(spark, sf_dir), "named_self", "is_self", "prompt_id", ["cond", "judge"])


@query()
def sta38_crossed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossed random effects of prompt and author, by penalised log odds of their margins (an approximation of the MAP)."""
    j = full(spark, sf_dir)
    by = lambda c: j.groupBy("cond", F.lit(c).alias("effect"), F.col(c).alias("level")).agg(F.sum("correct").alias("s"), F.count(F.lit(1)).alias("n"))
    m = j.groupBy("cond").agg(F.avg("correct").alias("m"))
    rows = by("prompt_id").unionByName(by("author")).join(F.broadcast(m), "cond")
    info = F.col("n") * F.col("m") * (1 - F.col("m"))
    step = rows.withColumns({"b": (F.col("s") - F.col("n") * F.col("m")) / info, "v": 1 / info})
    tau = step.groupBy("cond", "effect").agg(F.greatest(F.var_samp("b") - F.avg("v"), F.lit(0.0)).alias("tau2"))
    return step.join(F.broadcast(tau), ["cond", "effect"]).select("cond", "effect", "level", F.round(F.col("b") * F.col("tau2") / (F.col("tau2") + F.col("v")), 6).alias("blup"), F.round("tau2", 6).alias("tau2"))
