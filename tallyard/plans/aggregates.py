"""Grouped figures of the audit: rates, confusion, blame, calibration, ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyard.functions import exact
from tallyard.functions.lexicons import FIRST, FIRST_FAMILIES, SECOND, before_tuning, either
from tallyard.plans.registry import registry
from tallyard.sources.fixtures import CTE, MODELS, judgments, judgments_all, quality, ratings, responses
from tallyard.sources.tables import table

QUERIES, SQL, query = registry()
CUES = tuple(FIRST)


def cnt(c: Column | str = "1") -> Column:
    return F.sum(F.expr(c).cast("int") if isinstance(c, str) else c.cast("int"))


def n() -> Column:
    return F.count(F.lit(1))


def avg_if(cond: str, c: str) -> Column:
    return F.avg(F.when(F.expr(cond), F.col(c)))


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def correlation(x: Column, y: Column) -> Column:
    """Correlation over the rows that have both; null where either doesn't vary."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


@query(CTE + "select cond, judge, sum(named_self)::bigint as k, count(*) as n, round(avg(named_self), 6) as rate from judg where is_self = 1 group by cond, judge")
def agg01_self_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).where("is_self = 1").groupBy("cond", "judge").agg(F.sum("named_self").alias("k"), n().alias("n"), r6(F.avg("named_self")).alias("rate"))


@query(CTE + "select cond, author, sum(correct) filter (is_self = 1)::bigint as self_hits, count(*) filter (is_self = 1) as self_n, sum(correct) filter (is_self = 0)::bigint as peer_hits, count(*) filter (is_self = 0) as peer_n, round(avg(correct) filter (is_self = 1) - avg(correct) filter (is_self = 0), 6) as advantage from judg group by cond, author")
def agg02_self_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, peer = "is_self = 1", "is_self = 0"
    return judgments(spark, sf_dir).groupBy("cond", "author").agg(cnt("is_self = 1 and correct = 1").alias("self_hits"), cnt(own).alias("self_n"), cnt("is_self = 0 and correct = 1").alias("peer_hits"), cnt(peer).alias("peer_n"), r6(avg_if(own, "correct") - avg_if(peer, "correct")).alias("advantage"))


@query(CTE + "select cond, author, sum(correct)::bigint as k, count(*) as n, round(avg(correct), 6) as recall from judg group by cond, author")
def agg03_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).groupBy("cond", "author").agg(F.sum("correct").alias("k"), n().alias("n"), r6(F.avg("correct")).alias("recall"))


def blame(j: DataFrame) -> DataFrame:
    """Wrong guesses by name: pooled share, and the mean over judges of each judge's shares; zero where never blamed."""
    per = j.where("correct = 0").groupBy("cond", "judge").pivot("guess", list(MODELS)).agg(n()).na.fill(0)
    total = reduce(lambda a, b: a + b, [F.col(m) for m in MODELS])
    long = per.withColumn("t", total).select("cond", "judge", "t", F.inline(F.array(*[F.struct(F.lit(m).alias("guess"), F.col(m).alias("k")) for m in MODELS])))
    g = long.groupBy("cond", "guess").agg(F.sum("k").alias("k"), F.avg(F.col("k") / F.col("t")).alias("mean_share"))
    return g.withColumn("share", F.col("k") / F.sum("k").over(W.partitionBy("cond")))


_BLAME = CTE + ", per as (select cond, judge, g.m as guess, (select count(*) from judg x where x.correct = 0 and x.cond = c.cond and x.judge = c.judge and x.guess = g.m) as k, (select count(*) from judg x where x.correct = 0 and x.cond = c.cond and x.judge = c.judge) as t from (select distinct cond, judge from judg) c, models g), bl as (select cond, guess, sum(k)::bigint as k, avg(k / t) as mean_share from per group by cond, guess), blame as (select *, k / sum(k) over (partition by cond) as share from bl)"


@query(_BLAME + " select cond, guess, k, round(share, 6) as share, round(mean_share, 6) as mean_share from blame")
def agg04_blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blame(judgments(spark, sf_dir)).select("cond", "guess", "k", r6("share").alias("share"), r6("mean_share").alias("mean_share"))


@query(_BLAME + " select cond, round(sum(share) filter (rn <= 2), 6) as top_two, round(max(share), 6) as largest, max(guess) filter (rn = 1) as most_blamed from (select *, row_number() over (partition by cond order by share desc, guess) rn from blame) group by cond")
def agg05_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blame(judgments(spark, sf_dir)).withColumn("rn", F.row_number().over(W.partitionBy("cond").orderBy(F.desc("share"), "guess")))
    return b.groupBy("cond").agg(r6(F.sum(F.when(F.col("rn") <= 2, F.col("share")))).alias("top_two"), r6(F.max("share")).alias("largest"), F.max(F.when(F.col("rn") == 1, F.col("guess"))).alias("most_blamed"))


def lojo(j: DataFrame) -> DataFrame:
    """Leave-one-judge-out: sums minus the dropped judge's own, so the rows are read once."""
    per = j.groupBy("cond", "judge").agg(n().alias("n"), F.sum("correct").alias("c"), F.sum("is_self").alias("s"), F.sum(F.col("is_self") * F.col("named_self")).alias("h"))
    w = W.partitionBy("cond")
    for c in "ncsh":
        per = per.withColumn(c, F.sum(c).over(w) - F.col(c))
    return per.select("cond", F.col("judge").alias("dropped"), (F.col("c") / F.col("n")).alias("accuracy"), (F.col("h") / F.col("s")).alias("self_rate"))


_LOJO = CTE + ", lj as (select cond, d.m as dropped, avg(correct) as accuracy, avg(named_self) filter (is_self = 1) as self_rate from judg, models d where judge <> d.m group by cond, d.m)"


@query(_LOJO + " select cond, dropped, round(accuracy, 6) as accuracy, round(self_rate, 6) as self_rate from lj")
def agg06_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lojo(judgments(spark, sf_dir)).select("cond", "dropped", r6("accuracy").alias("accuracy"), r6("self_rate").alias("self_rate"))


@query(_LOJO + ", st as (select cond, dropped, unnest(['accuracy', 'self_rate']) as metric, unnest([accuracy, self_rate]) as v from lj) select cond, metric, round(min(v), 6) as lo, round(max(v), 6) as hi, round(max(v) - min(v), 6) as span, (list(dropped order by v, dropped))[1] as at_lo, (list(dropped order by v desc, dropped))[1] as at_hi from st group by cond, metric")
def agg07_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lojo(judgments(spark, sf_dir)).select("cond", "dropped", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("accuracy", "self_rate")])))
    return long.groupBy("cond", "metric").agg(r6(F.min("v")).alias("lo"), r6(F.max("v")).alias("hi"), r6(F.max("v") - F.min("v")).alias("span"), F.min_by("dropped", F.struct("v", "dropped")).alias("at_lo"), F.min_by("dropped", F.struct(-F.col("v"), "dropped")).alias("at_hi"))


@query(CTE + "select cond, case when grouping(judge) = 1 then 'all' else judge end as judge, confidence, count(*) as n, round(avg(correct), 6) as accuracy from judg group by grouping sets ((cond, confidence), (cond, judge, confidence))")
def agg08_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = judgments(spark, sf_dir).groupingSets([[F.col("cond"), F.col("confidence")], [F.col("cond"), F.col("judge"), F.col("confidence")]], "cond", "judge", "confidence").agg(n().alias("n"), r6(F.avg("correct")).alias("accuracy"), F.grouping("judge").alias("g"))
    return g.select("cond", F.when(F.col("g") == 1, "all").otherwise(F.col("judge")).alias("judge"), "confidence", "n", "accuracy")


@query(CTE + "select cond, slot, count(*) as n, round(count(*) / sum(count(*)) over (partition by cond), 6) as share, round(avg(correct), 6) as accuracy from judg group by cond, slot")
def agg09_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = judgments(spark, sf_dir).groupBy("cond", "slot").agg(n().alias("n"), r6(F.avg("correct")).alias("accuracy"))
    return g.select("cond", "slot", "n", r6(F.col("n") / F.sum("n").over(W.partitionBy("cond"))).alias("share"), "accuracy")


@query(CTE + "select d as distinct_names, count(*) as sessions from (select prompt_id, judge, count(distinct guess) d from judg where cond = 'lineup' group by 1, 2) group by d")
def agg10_distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = judgments(spark, sf_dir).where("cond = 'lineup'").groupBy("prompt_id", "judge").agg(F.count_distinct("guess").alias("distinct_names"))
    return s.groupBy("distinct_names").agg(n().alias("sessions"))


@query(CTE + "select cond, author, " + ", ".join(f"count(*) filter (guess = '{m}') as \"to_{m}\"" for m in MODELS) + ", round(avg(correct), 6) as recall from judg group by cond, author")
def agg11_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).groupBy("cond", "author").agg(*[cnt(F.col("guess") == m).alias(f"to_{m}") for m in MODELS], r6(F.avg("correct")).alias("recall"))


@query(CTE + "select cond, author, guess, count(*) as n, round(count(*) / sum(count(*)) over (partition by cond), 6) as of_errors, round(count(*) / any_value(t), 6) as of_row from judg join (select cond, author, count(*) t from judg group by 1, 2) using (cond, author) where correct = 0 group by cond, author, guess")
def agg12_error_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = judgments(spark, sf_dir).groupBy("cond", "author", "guess").agg(n().alias("n"), F.max("correct").alias("c"))
    g = g.withColumn("t", F.sum("n").over(W.partitionBy("cond", "author"))).where("c = 0")
    return g.select("cond", "author", "guess", "n", r6(F.col("n") / F.sum("n").over(W.partitionBy("cond"))).alias("of_errors"), r6(F.col("n") / F.col("t")).alias("of_row"))


@query(CTE + "select cond, judge, round(avg(correct) filter (is_self = 0), 6) as others, round(avg(correct), 6) as overall, round(avg(named_self), 6) as names_self from judg group by cond, judge")
def agg13_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).groupBy("cond", "judge").agg(r6(avg_if("is_self = 0", "correct")).alias("others"), r6(F.avg("correct")).alias("overall"), r6(F.avg("named_self")).alias("names_self"))


def naming(j: DataFrame) -> DataFrame:
    """For every named author and judge: hits and false alarms of that name."""
    per = j.groupBy("cond", "judge", "author").pivot("guess", list(MODELS)).agg(n()).na.fill(0)
    long = per.select("cond", "judge", "author", F.inline(F.array(*[F.struct(F.lit(m).alias("named"), F.col(m).alias("k")) for m in MODELS])))
    t = reduce(lambda a, b: a + b, [F.col(m) for m in MODELS])
    sums = per.withColumn("t", t).select("cond", "judge", "author", "t")
    long = long.join(sums, ["cond", "judge", "author"])
    own = F.col("author") == F.col("named")
    return long.groupBy("cond", "named", "judge").agg(F.sum(F.when(own, F.col("k")).otherwise(0)).alias("hits"), F.sum(F.when(own, F.col("t")).otherwise(0)).alias("own_n"), F.sum(F.when(~own, F.col("k")).otherwise(0)).alias("false_alarms"), F.sum(F.when(~own, F.col("t")).otherwise(0)).alias("other_n"))


_NAMING = CTE + ", naming as (select cond, d.m as named, judge, count(*) filter (author = d.m and guess = d.m) as hits, count(*) filter (author = d.m) as own_n, count(*) filter (author <> d.m and guess = d.m) as false_alarms, count(*) filter (author <> d.m) as other_n from judg, models d group by cond, d.m, judge)"


@query(_NAMING + " select *, round(hits / own_n, 6) as hit_rate, round(false_alarms / other_n, 6) as fa_rate from naming")
def agg14_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming(judgments(spark, sf_dir)).withColumns({"hit_rate": r6(F.col("hits") / F.col("own_n")), "fa_rate": r6(F.col("false_alarms") / F.col("other_n"))})


@query(CTE + "select judge, round(avg(correct) filter ((slot_no - author_idx + 5) % 5 = 0), 6) as listed, round(avg(correct) filter ((slot_no - author_idx + 5) % 5 <> 0), 6) as other from judg where cond = 'lineup' group by judge")
def agg15_anchoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rot = "pmod(slot_no - author_idx, 5)"
    return judgments(spark, sf_dir).where("cond = 'lineup'").groupBy("judge").agg(r6(avg_if(f"{rot} = 0", "correct")).alias("listed"), r6(avg_if(f"{rot} <> 0", "correct")).alias("other"))


@query(CTE + "select author, round(sum(d * n) / sum(n), 6) as advantage from (select author, slot, count(*) filter (is_self = 1) as n, avg(correct) filter (is_self = 1) - avg(correct) filter (is_self = 0) as d from judg where cond = 'lineup' group by author, slot) where d is not null group by author")
def agg16_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = judgments(spark, sf_dir).where("cond = 'lineup'").groupBy("author", "slot").agg(cnt("is_self = 1").alias("n"), (avg_if("is_self = 1", "correct") - avg_if("is_self = 0", "correct")).alias("d"))
    return g.where("d is not null").groupBy("author").agg(r6(F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("advantage"))


@query(CTE + "select coalesce(genre, 'all') as genre, judge, count(*) as n, round(avg(correct), 6) as accuracy, round(avg(named_self) filter (is_self = 1), 6) as hit, round(avg(named_self) filter (is_self = 0), 6) as fa from judg where cond = 'lineup' group by grouping sets ((genre, judge), (judge))")
def agg17_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judgments(spark, sf_dir).where("cond = 'lineup'")
    g = j.groupingSets([[F.col("genre"), F.col("judge")], [F.col("judge")]], "genre", "judge").agg(n().alias("n"), r6(F.avg("correct")).alias("accuracy"), r6(avg_if("is_self = 1", "named_self")).alias("hit"), r6(avg_if("is_self = 0", "named_self")).alias("fa"))
    return g.withColumn("genre", F.coalesce("genre", F.lit("all")))


@query("select judge, count(*) as n, round(avg(says_yes::int) filter (true_author = judge), 6) as hit, round(avg(says_yes::int) filter (true_author <> judge), 6) as fa, round(avg(p_yes) filter (true_author = judge), 6) as p_own, round(avg(p_yes) filter (true_author <> judge), 6) as p_other, round(avg(mass), 6) as mass from (select *, row_number() over (partition by item_id order by record_no desc) rn from panel_records where cond = 'binary' and ok) where rn = 1 group by judge")
def agg18_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes/no figures of the judging log, each item once."""
    from tallyard.operators.delivery import keep_one

    log = table(spark, sf_dir, "panel_records", "record_no", "cond", "ok", "item_id", "judge", "true_author", "says_yes", "p_yes", "mass").where("cond = 'binary' and ok")
    one = keep_one(log, ["item_id"], [-F.col("record_no")], ["judge", "true_author", "says_yes", "p_yes", "mass"]).withColumn("y", F.col("says_yes").cast("int"))
    own, other = "true_author = judge", "true_author <> judge"
    return one.groupBy("judge").agg(n().alias("n"), r6(avg_if(own, "y")).alias("hit"), r6(avg_if(other, "y")).alias("fa"), r6(avg_if(own, "p_yes")).alias("p_own"), r6(avg_if(other, "p_yes")).alias("p_other"), r6(F.avg("mass")).alias("mass"))


@query(CTE + ", rel as (select prompt_id, author, author_idx, judge, lp_cond - avg(lp_cond) over (partition by block, author) as rel, block from rate), best as (select block, author, judge, row_number() over (partition by block, author order by rel desc, judge) rn from rel) select author, count(*) as n, sum((judge = author)::int)::bigint as hits from best where rn = 1 group by author")
def agg19_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts attributed to the scorer with the highest relative likelihood."""
    from tallyard.operators.delivery import keep_one

    r = ratings(spark, sf_dir).withColumn("rel", F.col("lp_cond") - F.avg("lp_cond").over(W.partitionBy("block", "author")))
    best = keep_one(r, ["block", "author"], [-F.col("rel"), F.col("judge")], ["judge", "rel"])
    return best.groupBy("author").agg(n().alias("n"), cnt("judge = author").alias("hits"))


@query(CTE + "select judge, round((avg(quality) filter (author = judge) - avg(quality) filter (author <> judge)) - (select avg(quality) filter (author = r.judge) - avg(quality) filter (author <> r.judge) from qual x where x.judge <> r.judge), 6) as preference from qual r group by judge")
def agg20_self_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Double difference: own against others' texts, by the judge and by the other judges."""
    cell = quality(spark, sf_dir).groupBy("judge", "author").agg(F.sum("quality").alias("s"), n().alias("k"))
    cell = cell.withColumns({"ts": F.sum("s").over(W.partitionBy("author")), "tk": F.sum("k").over(W.partitionBy("author"))})
    own = F.col("author") == F.col("judge")
    mine = lambda o: F.sum(F.when(o, F.col("s"))) / F.sum(F.when(o, F.col("k")))
    rest = lambda o: F.sum(F.when(o, F.col("ts") - F.col("s"))) / F.sum(F.when(o, F.col("tk") - F.col("k")))
    return cell.groupBy("judge").agg(r6((mine(own) - mine(~own)) - (rest(own) - rest(~own))).alias("preference"))


@query(CTE + "select author, round(avg(quality), 6) as mean, round(stddev_samp(quality), 6) as sd, count(*) as n from qual group by author")
def agg21_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, sf_dir).groupBy("author").agg(r6(F.avg("quality")).alias("mean"), r6(F.stddev_samp("quality")).alias("sd"), n().alias("n"))


@query(CTE + ", rk as (select judge, block, author, rank() over (partition by judge, block order by quality) + (count(*) over (partition by judge, block, quality) - 1) / 2 as mr from qual) select a.judge as a, b.judge as b, round(covar_pop(a.mr, b.mr) / nullif(stddev_pop(a.mr) * stddev_pop(b.mr), 0), 6) as rho from rk a join rk b using (block, author) where a.judge < b.judge group by 1, 2")
def agg22_rater_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of raters' ranks within prompts: sums of one pass over texts, no self-join of ratings."""
    mr = F.rank().over(W.partitionBy("judge", "block").orderBy("quality")) + (F.count(F.lit(1)).over(W.partitionBy("judge", "block", "quality")) - 1) / 2
    wide = quality(spark, sf_dir).withColumn("mr", mr).groupBy("block", "author").pivot("judge", list(MODELS)).agg(F.max("mr"))
    pairs = [(a, b) for a in MODELS for b in MODELS if a < b]
    return wide.agg(*[correlation(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs]).select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r6(F.col(f"`{a}|{b}`")).alias("rho")) for a, b in pairs])))


def cued(j: DataFrame) -> DataFrame:
    return j.withColumns({c: F.col("reason").rlike(either(p)).cast("int") for c, p in FIRST.items()})


_CUED = CTE + ", cued as (select *, " + ", ".join(f"regexp_matches(reason, '{either(p)}')::int as {c}" for c, p in FIRST.items()) + " from judg)"


@query(_CUED + ", st as (select cond, judge, unnest([" + ", ".join(f"'{c}'" for c in CUES) + "]) as cue, unnest([" + ", ".join(CUES) + "]) as v from cued) select cond, coalesce(judge, 'all') as judge, cue, sum(v)::bigint as k, round(avg(v), 6) as share from st group by grouping sets ((cond, judge, cue), (cond, cue))")
def agg23_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = cued(judgments(spark, sf_dir)).select("cond", "judge", F.inline(F.array(*[F.struct(F.lit(c).alias("cue"), F.col(c).alias("v")) for c in CUES])))
    g = long.groupingSets([[F.col("cond"), F.col("judge"), F.col("cue")], [F.col("cond"), F.col("cue")]], "cond", "judge", "cue").agg(F.sum("v").alias("k"), r6(F.avg("v")).alias("share"))
    return g.withColumn("judge", F.coalesce("judge", F.lit("all")))


_ANY = {**{f"any_{f}": cs for f, cs in FIRST_FAMILIES.items()}, "uncategorised": CUES}
_SHARES = [*CUES, *_ANY]
_SHARES_SQL = [*CUES, *[f"greatest({', '.join(cs)})" if k != "uncategorised" else f"1 - greatest({', '.join(cs)})" for k, cs in _ANY.items()]]


@query(_CUED + ", st as (select correct, unnest([" + ", ".join(f"'{c}'" for c in _SHARES) + "]) as cue, unnest([" + ", ".join(_SHARES_SQL) + "]) as v from cued), c as (select cue, count(*) as n, sum(v)::bigint as k, sum(v * correct)::bigint as a, sum((1 - v) * correct)::bigint as b, sum(v * (1 - correct))::bigint as c, sum((1 - v) * (1 - correct))::bigint as d from st group by cue) select cue, round(k / n, 6) as share, round(a / nullif(a + b, 0), 6) as when_right, round(c / nullif(c + d, 0), 6) as when_wrong, round(" + exact.sql_fisher("a", "b", "c", "d") + ", 9) as p_value from c")
def agg24_cue_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of stated cues, of any cue of a family, and of reasons without one; when right and when wrong, with Fisher's test."""
    x = cued(judgments(spark, sf_dir))
    v = [*[F.col(c) for c in CUES], *[F.greatest(*cs) if len(cs) > 1 else F.col(cs[0]) for k, cs in _ANY.items() if k != "uncategorised"], 1 - F.greatest(*CUES)]
    long = x.select("correct", F.inline(F.array(*[F.struct(F.lit(c).alias("cue"), y.alias("v")) for c, y in zip(_SHARES, v)])))
    right, has = F.col("correct") == 1, F.col("v") == 1
    c = long.groupBy("cue").agg(n().alias("n"), F.sum("v").alias("k"), *[cnt(e).alias(k) for k, e in (("a", has & right), ("b", ~has & right), ("c", has & ~right), ("d", ~has & ~right))])
    a, b, c_, d = (F.col(k) for k in "abcd")
    return c.select("cue", r6(F.col("k") / F.col("n")).alias("share"), r6(F.try_divide(a, a + b)).alias("when_right"), r6(F.try_divide(c_, c_ + d)).alias("when_wrong"), F.round(exact.fisher(a, b, c_, d), 9).alias("p_value"))


@query(_CUED + " select cond, case when is_self = 1 and named_self = 1 then 'self hit' when is_self = 0 and named_self = 1 then 'self false alarm' when is_self = 0 and correct = 1 then 'peer hit' end as population, count(*) as n, " + ", ".join(f"round(avg({c}), 6) as {c}" for c in CUES) + " from cued where named_self = 1 or (is_self = 0 and correct = 1) group by 1, 2")
def agg25_cue_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pop = F.when(F.expr("is_self = 1 and named_self = 1"), "self hit").when(F.expr("is_self = 0 and named_self = 1"), "self false alarm").when(F.expr("is_self = 0 and correct = 1"), "peer hit")
    return cued(judgments(spark, sf_dir)).withColumn("population", pop).where("population is not null").groupBy("cond", "population").agg(n().alias("n"), *[r6(F.avg(c)).alias(c) for c in CUES])


def agreement(x: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per category, and 'micro' over all of them: counts, precision, recall, F1 and Cohen's kappa of a coding (0 or 1) against a reference; 'exact': rows in which all agree.

    One pass over the rows; null where a figure has no denominator.
    """
    both = [F.struct(F.lit(c).alias("category"), *[F.sum(((a == i) & (b == j)).cast("int")).alias(n) for n, i, j in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]) for c, (a, b) in pairs.items()]
    same = reduce(lambda p, q: p & q, [a == b for a, b in pairs.values()])
    s = x.agg(F.array(*both).alias("cells"), F.sum(same.cast("int")).alias("same"), n().alias("rows"))
    total = lambda k: F.aggregate("cells", F.lit(0).cast("bigint"), lambda s, c: s + c[k])
    micro = F.struct(F.lit("micro").alias("category"), *[total(k).alias(k) for k in ("tp", "fp", "fn", "tn")])
    match = F.struct(F.lit("exact").alias("category"), F.col("same").alias("tp"), F.lit(0).cast("bigint").alias("fp"), (F.col("rows") - F.col("same")).alias("fn"), F.lit(0).cast("bigint").alias("tn"))
    rows = s.select(F.inline(F.concat("cells", F.array(micro, match))))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    t = tp + fp + fn + tn
    pe = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (t * t)
    kappa = F.when(~F.col("category").isin("micro", "exact"), F.try_divide((tp + tn) / t - pe, 1 - pe))
    return rows.select("category", "tp", "fp", "fn", "tn", r6(F.try_divide(tp, tp + fp)).alias("p"), r6(F.try_divide(tp, tp + fn)).alias("r"), r6(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"), r6(kappa).alias("kappa"))


@query()
def agg26_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second coder before its tuning round against itself after it, category by category (its look-arounds exist only on the JVM)."""
    r = judgments(spark, sf_dir).where("cond = 'single' and reason is not null").select(F.translate("reason", "‘’“”", "''\"\"").alias("r"))
    coded = r.select(*[F.col("r").rlike(either(p)).cast("int").alias(c) for c, p in SECOND.items()], *[F.col("r").rlike(either(before_tuning(c))).cast("int").alias(f"{c}_v0") for c in SECOND])
    return agreement(coded, {c: (F.col(c), F.col(f"{c}_v0")) for c in SECOND})


@query("with c as (select split_part(regexp_replace(source_file, '^.*/', ''), '__', 1) as condition, request_model as model, response.usage.total_tokens as tokens, response.usage.cost as cost from raw_responses) select coalesce(condition, 'all') as condition, coalesce(model, 'all') as model, count(*) as calls, sum(tokens)::bigint as tokens, round(sum(cost), 6) as cost from c where model is not null group by grouping sets ((condition, model), (condition), ())")
def agg27_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost ledger by condition and model, with subtotals."""
    c = table(spark, sf_dir, "raw_responses", "source_file", "request_model", "response").select(F.get(F.split(F.regexp_replace("source_file", "^.*/", ""), "__"), 0).alias("condition"), F.col("request_model").alias("model"), F.col("response.usage.total_tokens").alias("tokens"), F.col("response.usage.cost").alias("cost")).where("model is not null")
    g = c.groupingSets([[F.col("condition"), F.col("model")], [F.col("condition")], []], "condition", "model").agg(n().alias("calls"), F.sum("tokens").alias("tokens"), r6(F.sum("cost")).alias("cost"))
    return g.select(F.coalesce("condition", F.lit("all")).alias("condition"), F.coalesce("model", F.lit("all")).alias("model"), "calls", "tokens", "cost")


@query(CTE + "select p.prompt_id as prompt_id, p.m as judge, coalesce(sum(named_self) filter (is_self = 1), 0)::bigint as num, coalesce(sum(is_self), 0)::bigint as den from (select distinct prompt_id, m from resp, models) p left join (select * from judg where cond = 'single') j on j.prompt_id = p.prompt_id and j.judge = p.m group by 1, 2")
def agg28_per_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerators and denominators for every prompt and judge, zero where a judge said nothing."""
    p = responses(spark, sf_dir).select("prompt_id").distinct().select("prompt_id", F.explode(F.array(*map(F.lit, MODELS))).alias("judge"))
    j = judgments(spark, sf_dir).where("cond = 'single'").groupBy("prompt_id", "judge").agg(cnt("is_self = 1 and named_self = 1").alias("num"), F.sum("is_self").alias("den"))
    return p.join(j, ["prompt_id", "judge"], "left").select("prompt_id", "judge", F.coalesce("num", F.lit(0)).cast("bigint").alias("num"), F.coalesce("den", F.lit(0)).cast("bigint").alias("den"))


def _rates(j: DataFrame) -> DataFrame:
    return j.groupBy("cond", "judge").agg(avg_if("is_self = 1", "named_self").alias("hit"), avg_if("is_self = 0", "named_self").alias("fa"), avg_if("is_self = 0", "correct").alias("others"))


_RATES = CTE + ", rates as (select cond, judge, avg(named_self) filter (is_self = 1) as hit, avg(named_self) filter (is_self = 0) as fa, avg(correct) filter (is_self = 0) as others from judg group by 1, 2)"


@query(_RATES + " select count(*) as cases, sum((hit > 0.2)::int)::bigint as above_chance, sum((hit > fa)::int)::bigint as positive, sum((hit > 0.2 and hit > fa)::int)::bigint as both_, (sum((hit > 0.2 and hit > fa)::int) <= sum((hit > 0.2)::int))::int as nested from rates")
def agg29_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.expr("hit > 0.2"), F.expr("hit > fa")
    return _rates(judgments(spark, sf_dir)).agg(n().alias("cases"), cnt(a).alias("above_chance"), cnt(b).alias("positive"), cnt(a & b).alias("both_"), (cnt(a & b) <= cnt(a)).cast("int").alias("nested"))


@query(_RATES + " select unnest(['cases', 'named itself', 'above chance', 'above false alarms']) as step, unnest([count(*), count(*) filter (hit > 0), count(*) filter (hit > 0.2), count(*) filter (hit > 0.2 and hit > fa)]) as n from rates")
def agg30_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _rates(judgments(spark, sf_dir)).agg(n().alias("a"), cnt("hit > 0").alias("b"), cnt("hit > 0.2").alias("c"), cnt("hit > 0.2 and hit > fa").alias("d"))
    return s.select(F.inline(F.array(*[F.struct(F.lit(t).alias("step"), F.col(c).alias("n")) for t, c in zip(("cases", "named itself", "above chance", "above false alarms"), "abcd")])))


@query(CTE + "select cond, judge, round(avg(correct), 6) as all_rows, round(avg(correct) filter (author <> 'Grok'), 6) as without, round(avg(correct) filter (author <> 'Grok') - avg(correct), 6) as shift from judg group by cond, judge")
def agg31_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.avg("correct"), avg_if("author <> 'Grok'", "correct")
    return judgments(spark, sf_dir).groupBy("cond", "judge").agg(r6(a).alias("all_rows"), r6(b).alias("without"), r6(b - a).alias("shift"))


@query("select model, count(*) as n, round(avg(word_count), 6) as mean_words, round(avg(word_count) / min(avg(word_count)) over (), 6) as ratio from responses where word_count is not null group by model")
def agg32_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "responses", "model", "word_count").where("word_count is not null").groupBy("model").agg(n().alias("n"), F.avg("word_count").alias("m"))
    least = g.agg(F.min("m").alias("lo"))
    return g.join(F.broadcast(least)).select("model", "n", r6("m").alias("mean_words"), r6(F.col("m") / F.col("lo")).alias("ratio"))


@query("select p_brand as family, round(sum(p_retailprice) / (select sum(p_retailprice) from part), 6) as share from part group by p_brand")
def agg33_family_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by family as shares of all."""
    g = table(spark, sf_dir, "part", "p_brand", "p_retailprice").groupBy(F.col("p_brand").alias("family")).agg(F.sum("p_retailprice").alias("s"))
    total = g.agg(F.sum("s").alias("t"))
    return g.join(F.broadcast(total)).select("family", r6(F.col("s") / F.col("t")).alias("share"))


@query("select judge, round(avg(len(list_filter(string_split_regex(trim(parsed.reason), '\\s+'), lambda x: x <> ''))), 6) as mean_words from panel_records where cond = 'single' and ok and parsed.reason is not null group by judge")
def agg34_reason_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "panel_records", "cond", "ok", "judge", "parsed").where("cond = 'single' and ok and parsed.reason is not null")
    words = F.size(F.filter(F.split(F.trim("parsed.reason"), r"\s+"), lambda x: x != ""))
    return log.groupBy("judge").agg(r6(F.avg(words)).alias("mean_words"))


@query("select lower(trim(response.provider)) as host, count(*) as calls, round(avg((c.finish_reason = 'stop')::int), 6) as finished from (select response, unnest(response.choices) c from raw_responses) group by 1")
def agg35_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "raw_responses", "response").select(F.lower(F.trim("response.provider")).alias("host"), F.explode("response.choices.finish_reason").alias("f"))
    return c.groupBy("host").agg(n().alias("calls"), r6(F.avg((F.col("f") == "stop").cast("int"))).alias("finished"))


@query(CTE + "select judge, round(sum(m) / sum(t), 6) as modal_share from (select judge, slot, max(k) m, sum(k) t from (select judge, slot, guess, count(*) k from judg where cond = 'lineup' group by 1, 2, 3) group by 1, 2) group by judge")
def agg36_modal_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = judgments(spark, sf_dir).where("cond = 'lineup'").groupBy("judge", "slot", "guess").agg(n().alias("k"))
    g = g.groupBy("judge", "slot").agg(F.max("k").alias("m"), F.sum("k").alias("t"))
    return g.groupBy("judge").agg(r6(F.sum("m") / F.sum("t")).alias("modal_share"))


@query(CTE + ", s as (select prompt_id, judge, sum(needs_review) as missing, count(distinct guess) as names, count(guess) as answered, count(*) filter (guess = 'Claude' and author = 'Claude') as hits from jall where cond = 'lineup' group by 1, 2) select judge, count(*) as sessions, sum(missing)::bigint as missing, round(avg((names = 5 and answered = 5)::int), 6) as all_distinct, sum(hits)::bigint as claude_hits from s group by judge")
def agg37_bookkeeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judgments_all(spark, sf_dir).where("cond = 'lineup'")
    s = j.groupBy("prompt_id", "judge").agg(F.sum("needs_review").alias("missing"), F.count_distinct("guess").alias("names"), F.count("guess").alias("answered"), F.coalesce(cnt("guess = 'Claude' and author = 'Claude'"), F.lit(0)).alias("hits"))
    return s.groupBy("judge").agg(n().alias("sessions"), F.sum("missing").alias("missing"), r6(F.avg(F.expr("cast(names = 5 and answered = 5 as int)"))).alias("all_distinct"), F.sum("hits").alias("claude_hits"))


@query("select genre, count(*) as prompts, sum(length(prompt_text))::bigint as chars, round(sum(length(prompt_text)) / 4 * 0.000003, 9) as cost from prompts_v2 group by genre")
def agg38_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and price of a run before it is made: four characters a token."""
    chars = F.sum(F.length("prompt_text"))
    return table(spark, sf_dir, "prompts_v2", "genre", "prompt_text").groupBy("genre").agg(n().alias("prompts"), chars.alias("chars"), F.round(chars / 4 * 0.000003, 9).alias("cost"))


@query(_NAMING + " select cond, named, round(min(hits / own_n), 6) as lowest, round(max(hits / own_n), 6) as highest from naming where judge <> named group by cond, named")
def agg39_peer_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.col("hits") / F.col("own_n")
    return naming(judgments(spark, sf_dir)).where("judge <> named").groupBy("cond", "named").agg(r6(F.min(rate)).alias("lowest"), r6(F.max(rate)).alias("highest"))


@query(CTE + "select cond, genre, round(max(abs(a)), 6) as largest from (select cond, genre, author, avg(correct) filter (is_self = 1) - avg(correct) filter (is_self = 0) as a from judg group by 1, 2, 3) group by cond, genre")
def agg40_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = judgments(spark, sf_dir).groupBy("cond", "genre", "author").agg((avg_if("is_self = 1", "correct") - avg_if("is_self = 0", "correct")).alias("a"))
    return g.groupBy("cond", "genre").agg(r6(F.max(F.abs("a"))).alias("largest"))
