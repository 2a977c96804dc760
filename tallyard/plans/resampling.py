"""Monte-Carlo tests and bootstraps with draws taken from md5, the same on every engine and partitioning."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyard.durable import ship
from tallyard.functions import exact
from tallyard.functions.draws import chunks, draws
from tallyard.operators.ordering import mid_ranks, numbered
from tallyard.plans.registry import registry
from tallyard.plans.windows import with_holm
from tallyard.sources.fixtures import CTE, full, quality, responses, yes_no

QUERIES, SQL, query = registry()
#: Draws: within blocks, bootstraps of ratios and of the best peer, AUC, sign flips, bootstraps of rates, like for like, references.
WITHIN, RATIO_BOOT, AUC, FLIPS, BOOT, LIKE_FLIPS, REFERENCES = 4_000, 4_000, 2_000, 20_000, 10_000, 100_000, 2_000
#: Positions whose bootstrap draws are turned round together.
POSITIONS = 256
_U = "('0x' || substr(md5({}), 1, 8))::bigint"


def _d(n: int) -> str:
    return f"(select unnest(range(0, {n})) as d) draws"


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _busy(df: DataFrame, key: str) -> DataFrame:
    """Few bytes, many draws: over a stated number of tasks. By the hash of ``key``, as a repartition by a key that rows are already placed by may go, and adaptive execution then makes one task of all."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, F.xxhash64(key))


def simulated(x: DataFrame, by: list[str], seed: str, n: int, slack: float = 0.0, absolute: bool = False) -> DataFrame:
    """Per ``by``: seen, null_mean, n1 and p_value = (k + 1) / (n + 1) of ``n`` simulated sums at least as large as the seen one.

    ``x`` has a row per group and ``key``, with ``table``, from which draw d takes the place u(seed|d|key) % size, and its
    ``own`` value. A key is drawn once for all groups, and its draws are added up inside the task; tasks give a sum a draw.
    """
    ship(x.sparkSession)
    kinds = ", ".join(f"{c} string" for c in by)
    cells = _busy(x.groupBy("key").agg(F.collect_list(F.struct(*by, F.transform("table", lambda v: v.cast("double")).alias("table"), F.col("own").cast("double").alias("own"))).alias("cells")), "key")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for pdf in batches:
            for key, row in zip(pdf["key"], pdf["cells"]):
                u_ = draws(seed, key, n)
                places: dict[int, np.ndarray] = {}
                for c in row:
                    table = np.asarray(c["table"], dtype="float64")
                    if (size := len(table)) not in places:
                        places[size] = (u_ % np.uint32(size)).astype(np.intp)
                    s = sums.setdefault(tuple(c[b] for b in by), [np.zeros(n), 0.0, 0])
                    s[0] += table[places[size]]
                    s[1] += c["own"]
                    s[2] += 1
        for group, (sim, own, n1) in sums.items():
            rows = list(chunks(sim))
            yield pd.DataFrame({**{b: [v] * len(rows) for b, v in zip(by, group)}, "part": [i for i, _ in rows], "sims": [v for _, v in rows], "own": own, "n1": n1})

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        sim, seen = np.sum(np.stack(list(pdf["sims"])), axis=0), float(pdf["own"].sum())
        more = np.abs(sim) >= abs(seen) - slack if absolute else sim >= seen - slack
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] for b in by}, "seen": [seen], "n1": [int(pdf["n1"].sum())], "more": [int(more.sum())], "total": [float(sim.sum())]})

    parts = cells.mapInPandas(add, f"{kinds}, part int, sims array<double>, own double, n1 bigint")
    counted = parts.groupBy(*by, "part").applyInPandas(count, f"{kinds}, seen double, n1 bigint, more bigint, total double")
    return counted.groupBy(*by).agg(F.max("seen").alias("seen"), F.max("n1").alias("n1"), (F.sum("total") / n).alias("null_mean"), r6((F.sum("more") + 1) / (n + 1)).alias("p_value"))


def _within(j: DataFrame, target: str, other: str, hit: str, seed: str) -> DataFrame:
    """One draw picks, in every block that has the target's own place, which of its cells stands there."""
    cells = j.groupBy("cond", F.col(target).alias("target"), "block").agg(F.transform(F.array_sort(F.collect_list(F.struct(other, hit))), lambda x: x[hit]).alias("table"), F.sum(F.col("is_self") * F.col(hit)).alias("own"), F.max("is_self").alias("there"))
    x = cells.where("there = 1").select("cond", "target", F.concat_ws("|", "target", "block").alias("key"), "table", "own")
    return simulated(x, ["cond", "target"], seed, WITHIN).select("cond", "target", F.col("seen").cast("bigint").alias("seen"), "p_value")


def _sql_within(target: str, other: str, hit: str, seed: str) -> str:
    u_ = _U.format(f"'{seed}|' || d || '|' || target || '|' || block")
    return CTE + f", c as (select cond, {target} as target, block, list({hit} order by {other}) as hits, sum(is_self * {hit}) as own from jfull group by 1, 2, 3 having max(is_self) = 1), s as (select cond, target, d, sum(hits[{u_} % len(hits) + 1]) as sim, sum(own) as seen from c, {_d(WITHIN)} group by 1, 2, 3) select cond, target, max(seen)::bigint as seen, round((sum((sim >= seen)::int) + 1) / (count(*) + 1), 6) as p_value from s group by 1, 2"


@query(_sql_within("author", "judge_idx", "correct", "adv"))
def sta17_selfadv_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _within(full(spark, sf_dir), "author", "judge_idx", "correct", "adv")


@query(_sql_within("judge", "author_idx", "named_self", "disc"))
def sta18_discrimination_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _within(full(spark, sf_dir), "judge", "author_idx", "named_self", "disc")


@query(CTE + ", rk as (select *, rank() over (partition by judge order by p_yes) + (count(*) over (partition by judge, p_yes) - 1) / 2 as mid from yesno), t as (select judge, count(*) as n from yesno group by 1), c as (select judge, block, list(mid order by author_idx) as mids, max(mid) filter (author = judge) as own from rk group by 1, 2 having max((author = judge)::int) = 1), s as (select judge, d, sum(mids[" + _U.format("'auc|' || d || '|' || judge || '|' || block") + f" % len(mids) + 1]) as sim, sum(own) as seen, count(*) as n1 from c, {_d(AUC)} group by 1, 2) select judge, round(max((seen - n1 * (n1 + 1) / 2) / (n1 * (n - n1))), 6) as auc, round((sum((sim >= seen)::int) + 1) / (count(*) + 1), 6) as p_value from s join t using (judge) group by judge")
def sta20_auc_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of p_yes against within-prompt permutation; ranks are computed once and stay fixed."""
    r = yes_no(spark, sf_dir)
    sizes = r.groupBy("judge").agg(F.count(F.lit(1)).alias("n"))
    r = r.join(mid_ranks(r, "p_yes", ["judge"]).select("judge", "p_yes", "mid"), ["judge", "p_yes"])
    c = r.groupBy("judge", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("author_idx", "mid"))), lambda x: x["mid"]).alias("table"), F.max(F.when(F.col("author") == F.col("judge"), F.col("mid"))).alias("own"))
    x = c.where("own is not null").select("judge", F.concat_ws("|", "judge", "block").alias("key"), "table", "own")
    n1, n = F.col("n1"), F.col("n")
    s = simulated(x, ["judge"], "auc", AUC).join(F.broadcast(sizes), "judge")  # a row per judge of the panel
    return s.select("judge", r6((F.col("seen") - n1 * (n1 + 1) / 2) / (n1 * (n - n1))).alias("auc"), "p_value")


def weighed(x: DataFrame, spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(d, sums): the columns of ``x`` (prompt_id, v array<double>, all as long) summed over the prompts of each of ``n`` draws.

    A row of the shuffle is a prompt and the draws in which a block of positions takes it; weights are never written out by draw.
    """
    ship(spark)
    p = numbered(responses(spark, sf_dir).select("prompt_id").distinct(), ["prompt_id"], "place").select("prompt_id", (F.col("place") - 1).alias("place"))
    prompts = p.count()

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), POSITIONS):
                block = pdf["place"].iloc[at : at + POSITIONS]
                taken = np.stack([draws("boot", str(k), n) for k in block]).astype("int64") % prompts
                order = np.argsort(taken, axis=None, kind="stable")
                flat = taken.ravel()[order]
                starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
                yield pd.DataFrame({"place": flat[starts], "ds": np.split((order % n).astype("int32"), starts[1:])})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = None
        for pdf in batches:
            ds = np.concatenate(list(pdf["ds"]))
            times = pdf["ds"].map(len).to_numpy()
            v = np.stack(list(pdf["v"]))
            if sums is None:
                sums = np.zeros((n, v.shape[1]))
            for i in range(v.shape[1]):
                sums[:, i] += np.bincount(ds, weights=np.repeat(v[:, i], times), minlength=n)
        if sums is not None:
            yield pd.DataFrame({"d": np.arange(n), "v": list(sums)})

    taken = _busy(p.select("place"), "place").mapInPandas(take, "place bigint, ds array<int>")
    x = x.join(p, "prompt_id").select("place", "v").hint("shuffle_hash")
    parts = taken.join(x, "place").select("ds", "v").mapInPandas(add, "d int, v array<double>")

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for d, v in zip(pdf["d"], pdf["v"]):
                sums[d] = sums[d] + v if d in sums else v
        if sums:
            yield pd.DataFrame({"d": list(sums), "v": list(sums.values())})

    return _busy(parts, "d").mapInPandas(total, "d int, v array<double>")


def weighed_by(x: DataFrame, by: list[str], names: list[str], spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """``weighed`` for columns ``names`` of (``by``, prompt_id), back as one row per group and draw."""
    groups = sorted(tuple(r) for r in x.select(*by).distinct().collect())  # formats, authors and judges: at most some dozens
    wide = []
    for g in groups:
        here = F.lit(True)
        for b, v in zip(by, g):
            here = here & (F.col(b) == v)
        wide += [F.coalesce(F.sum(F.when(here, F.col(c))), F.lit(0)).cast("double") for c in names]
    w = weighed(x.groupBy("prompt_id").agg(F.array(*wide).alias("v")), spark, sf_dir, n)
    k = len(names)
    rows = [F.struct(*[F.lit(v).alias(b) for b, v in zip(by, g)], *[F.get(F.col("v"), F.lit(i * k + m)).alias(c) for m, c in enumerate(names)]) for i, g in enumerate(groups)]
    return w.select("d", F.inline(F.array(*rows)))


def per_prompt(j: DataFrame) -> DataFrame:
    """Per format, judge and prompt: own hits and texts, false alarms and others' texts, own texts' peers' hits, hits on others' texts."""
    s, n = F.col("is_self"), F.col("named_self")
    own = j.groupBy("cond", "judge", "prompt_id").agg(F.sum(s * n).alias("h"), F.sum(s).alias("hn"), F.sum((1 - s) * n).alias("f"), F.sum(1 - s).alias("fn"), F.sum((1 - s) * F.col("correct")).alias("o"))
    peer = j.groupBy("cond", F.col("author").alias("judge"), "prompt_id").agg(F.sum((1 - s) * F.col("correct")).alias("p"), F.sum(1 - s).alias("pn"))
    return own.join(peer, ["cond", "judge", "prompt_id"], "full").na.fill(0)


def boot(spark: SparkSession, sf_dir: str, n: int = BOOT) -> DataFrame:
    """Rates of every draw: prompts are aggregated first, then weighted; one set of draws for all statistics."""
    x = weighed_by(per_prompt(full(spark, sf_dir)), ["cond", "judge"], ["h", "hn", "f", "fn", "p", "pn", "o"], spark, sf_dir, n)
    rate = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return x.select("cond", "judge", "d", rate("h", "hn").alias("hit"), rate("f", "fn").alias("fa"), rate("p", "pn").alias("peer"), F.col("hn").alias("n"), rate("o", "fn").alias("nonself"))


def _boot(n: int = BOOT) -> str:
    return CTE + f", pn as materialized (select prompt_id, row_number() over (order by prompt_id) - 1 as place from (select distinct prompt_id from resp)), w as (select d, {_U.format("'boot|' || d || '|' || place")} % (select count(*) from pn) as place, count(*) as w from pn, {_d(n)} group by 1, 2), o as (select cond, judge, prompt_id, sum(is_self * named_self) h, sum(is_self) hn, sum((1 - is_self) * named_self) f, sum(1 - is_self) fn from jfull group by 1, 2, 3), q as (select cond, author as judge, prompt_id, sum((1 - is_self) * correct) p, sum(1 - is_self) pn from jfull group by 1, 2, 3), oq as (select cond, judge, prompt_id, coalesce(h, 0) h, coalesce(hn, 0) hn, coalesce(f, 0) f, coalesce(fn, 0) fn, coalesce(p, 0) p, coalesce(q.pn, 0) pn from o full join q using (cond, judge, prompt_id)), boot as (select cond, judge, d, sum(h * w) / nullif(sum(hn * w), 0) as hit, sum(f * w) / nullif(sum(fn * w), 0) as fa, sum(p * w) / nullif(sum(oq.pn * w), 0) as peer, sum(hn * w) as n from oq join pn using (prompt_id) join w using (place) group by 1, 2, 3)"



@query(_boot() + " select cond, judge, round(quantile_cont(hit, 0.025), 9) as hit_low, round(quantile_cont(hit, 0.975), 9) as hit_high, round(quantile_cont(hit - fa, 0.025), 9) as disc_low, round(quantile_cont(hit - fa, 0.975), 9) as disc_high from boot group by 1, 2")
def sta21_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boot(spark, sf_dir)
    q = lambda c, p: F.round(F.percentile(c, p), 9)
    disc = F.col("hit") - F.col("fa")
    return b.groupBy("cond", "judge").agg(q("hit", 0.025).alias("hit_low"), q("hit", 0.975).alias("hit_high"), q(disc, 0.025).alias("disc_low"), q(disc, 0.975).alias("disc_high"))


@query(_boot() + f" select cond, judge, round(least(1.0, 2 * (least(sum((hit - fa <= 0)::int), sum((hit - fa >= 0)::int)) + 1) / ({BOOT} + 1)), 6) as p_value from boot group by 1, 2")
def sta22_bootstrap_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("hit") - F.col("fa")
    tail = F.least(F.sum((d <= 0).cast("int")), F.sum((d >= 0).cast("int")))
    return boot(spark, sf_dir).groupBy("cond", "judge").agg(r6(F.least(F.lit(1.0), 2 * (tail + 1) / (BOOT + 1))).alias("p_value"))


@query(_boot(RATIO_BOOT) + " select cond, judge, round(quantile_cont(hit / peer, 0.025), 6) as low, round(quantile_cont(hit / peer, 0.975), 6) as high from boot where peer > 0 group by 1, 2")
def sta23_ratio_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boot(spark, sf_dir, RATIO_BOOT).where("peer > 0").withColumn("r", F.col("hit") / F.col("peer"))
    return b.groupBy("cond", "judge").agg(r6(F.percentile("r", 0.025)).alias("low"), r6(F.percentile("r", 0.975)).alias("high"))


@query(_boot() + " select cond, judge, round(var_pop(hit) / nullif(avg(hit) * (1 - avg(hit)) / avg(n), 0), 6) as design_effect from boot group by 1, 2")
def sta32_design_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.avg("hit")
    return boot(spark, sf_dir).groupBy("cond", "judge").agg(r6(F.try_divide(F.var_pop("hit"), m * (1 - m) / F.avg("n"))).alias("design_effect"))


@query()
def sta25_shuffle_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits on others' texts against all relabellings of a block's guesses (four at most), exactly.

    A block gives the distribution of its hits over all orders; blocks with the same
    distribution are counted, and the counted distributions convolved.
    """
    ship(spark)
    j = full(spark, sf_dir).where("is_self = 0")
    p = j.groupBy("cond", "judge", "block").agg(F.array_sort(F.collect_list(F.struct("author_idx", "author", "guess"))).alias("x"), F.sum("correct").alias("seen"))
    orders = F.lit(None).cast("array<array<int>>")
    for m in range(1, 5):
        orders = F.when(F.size("x") == m, F.array(*[F.array(*map(F.lit, o)) for o in permutations(range(m))])).otherwise(orders)
    hits = F.transform(orders, lambda o: F.aggregate(F.sequence(F.lit(0), F.size(o) - 1), F.lit(0), lambda a, i: a + (F.get(F.col("x"), i)["author"] == F.get(F.col("x"), F.get(o, i))["guess"]).cast("int")))
    pmf = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.size(F.filter("hits", lambda h: h == k)) / F.size("hits"))
    g = p.withColumn("hits", hits).withColumn("pmf", pmf).groupBy("cond", "judge", "pmf").agg(F.count(F.lit(1)).alias("times"), F.sum("seen").alias("seen"))

    def floor(pdf: pd.DataFrame) -> pd.DataFrame:
        n = 4 * int(pdf["times"].sum()) + 1
        size = 1 << (n - 1).bit_length()
        f = np.ones(size, dtype=complex)
        for pmf_, t in zip(pdf["pmf"], pdf["times"]):
            f *= np.power(np.fft.fft(np.asarray(pmf_, dtype="float64"), size), int(t))
        dist = np.clip(np.fft.ifft(f).real[:n], 0, None)
        seen = int(pdf["seen"].sum())
        return pd.DataFrame({"cond": [pdf["cond"].iloc[0]], "judge": [pdf["judge"].iloc[0]], "seen": [seen], "floor": [round(float((dist * np.arange(n)).sum()), 6)], "p_value": [round(float(min(1.0, dist[seen:].sum())), 8)]})

    return g.groupBy("cond", "judge").applyInPandas(floor, "cond string, judge string, seen bigint, floor double, p_value double")


def _flip(x: DataFrame, by: list[str], seed: str, n: int) -> DataFrame:
    """Sign-flip test of the sum of per-prompt differences ``delta``."""
    d = F.col("delta")
    s = simulated(x.select(*by, F.col("prompt_id").alias("key"), F.array(d, -d).alias("table"), d.alias("own")), by, seed, n, absolute=True)
    return s.select(*by, F.col("seen").cast("bigint").alias("sum"), "p_value")


def _sql_flip(x: str, by: str, seed: str, n: int) -> str:
    return f"{x}, s as (select {by}, d, sum((1 - 2 * ({_U.format(f"'{seed}|' || d || '|' || prompt_id")} % 2)) * delta) as sim, sum(delta) as sum_ from x, {_d(n)} group by {by}, d) select {by}, max(sum_)::bigint as sum, round((sum((abs(sim) >= abs(sum_))::int) + 1) / ({n} + 1), 6) as p_value from s group by {by}"


@query(_sql_flip(CTE + ", x as (select a.cond as cond, a.judge as a, b.judge as b, a.prompt_id as prompt_id, sum(a.correct - b.correct) as delta from jfull a join jfull b on a.cond = b.cond and a.block = b.block and a.author = b.author where a.judge < b.judge and a.author <> a.judge and a.author <> b.judge group by 1, 2, 3, 4)", "cond, a, b", "flip", FLIPS))
def sta26_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of judges on third parties' texts: pairs are made inside each text's row of five."""
    j = full(spark, sf_dir).groupBy("cond", "prompt_id", "block", "author").agg(F.array_sort(F.collect_list(F.struct("judge", "correct"))).alias("js"))
    a = j.select("*", F.posexplode("js").alias("i", "x")).select("*", F.explode(F.slice("js", F.col("i") + 2, F.lit(5))).alias("y"))
    a = a.where((F.col("author") != F.col("x.judge")) & (F.col("author") != F.col("y.judge")))
    x = a.groupBy("cond", F.col("x.judge").alias("a"), F.col("y.judge").alias("b"), "prompt_id").agg(F.sum(F.col("x.correct") - F.col("y.correct")).alias("delta"))
    return _flip(x, ["cond", "a", "b"], "flip", FLIPS)


@query()
def sta26_pairwise_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of judges on all texts but their own: bootstrap and Fisher's test; sign flips on common texts; Holm within the format."""
    cells = per_prompt(full(spark, sf_dir)).groupBy("cond", "judge").agg(F.sum("o").alias("k"), F.sum("fn").alias("n"))
    b = boot(spark, sf_dir).groupBy("cond", "d").agg(F.array_sort(F.collect_list(F.struct("judge", "nonself"))).alias("js"))
    b = b.select("cond", "js", F.posexplode("js").alias("i", "x")).select("cond", "x", F.explode(F.slice("js", F.col("i") + 2, F.lit(5))).alias("y"))
    diff = F.col("x.nonself") - F.col("y.nonself")
    tail = F.least(F.sum((diff <= 0).cast("int")), F.sum((diff >= 0).cast("int")))
    b = b.groupBy("cond", F.col("x.judge").alias("a"), F.col("y.judge").alias("b")).agg(F.percentile(diff, 0.025).alias("low"), F.percentile(diff, 0.975).alias("high"), F.least(F.lit(1.0), 2 * (tail + 1) / (F.count(diff) + 1)).alias("p_bootstrap"))
    one = lambda n: cells.select("cond", F.col("judge").alias(n), F.col("k").alias(f"k_{n}"), F.col("n").alias(f"n_{n}"))
    t = b.join(one("a"), ["cond", "a"]).join(one("b"), ["cond", "b"]).join(sta26_pairwise(spark, sf_dir).withColumnRenamed("p_value", "p_flip"), ["cond", "a", "b"])
    t = t.withColumn("p_fisher", exact.fisher(F.col("k_a"), F.col("n_a") - F.col("k_a"), F.col("k_b"), F.col("n_b") - F.col("k_b")))
    for p in ("p_flip", "p_bootstrap"):
        t = with_holm(t, p, ["cond"], ["a", "b"], f"{p}_holm")
    return t.select("cond", "a", "b", r6(F.col("k_a") / F.col("n_a") - F.col("k_b") / F.col("n_b")).alias("diff"), *[r6(c).alias(c) for c in ("low", "high", "p_bootstrap", "p_bootstrap_holm", "p_fisher")], "sum", *[r6(c).alias(c) for c in ("p_flip", "p_flip_holm")])


@query(CTE + "select cond, round(avg(correct) filter (judge in ('GPT', 'Claude')) - avg(correct) filter (judge not in ('GPT', 'Claude')), 6) as contrast from jfull where is_self = 0 group by cond")
def sta27_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("judge").isin("GPT", "Claude")
    return full(spark, sf_dir).where("is_self = 0").groupBy("cond").agg(r6(F.avg(F.when(g, F.col("correct"))) - F.avg(F.when(~g, F.col("correct")))).alias("contrast"))


@query(_sql_flip(CTE + ", x as (select a.cond as cond, a.judge as judge, p.judge as peer, a.prompt_id as prompt_id, sum((a.guess = a.judge)::int - (p.guess = a.judge)::int) as delta from jfull a join jfull p on a.cond = p.cond and a.block = p.block and a.author = p.author and p.judge <> a.judge where a.author = a.judge or a.author <> p.judge group by 1, 2, 3, 4)", "cond, judge, peer", "like", LIKE_FLIPS))
def sta29_like_for_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's namings of itself against each peer's namings of it, on the same texts without the peer's own."""
    j = full(spark, sf_dir).groupBy("cond", "prompt_id", "block", "author").agg(F.collect_list(F.struct("judge", "guess")).alias("js"))
    a = j.select("*", F.explode("js").alias("x")).select("*", F.explode("js").alias("y")).where((F.col("x.judge") != F.col("y.judge")) & ((F.col("author") == F.col("x.judge")) | (F.col("author") != F.col("y.judge"))))
    mine = (F.col("x.guess") == F.col("x.judge")).cast("int") - (F.col("y.guess") == F.col("x.judge")).cast("int")
    x = a.groupBy("cond", F.col("x.judge").alias("judge"), F.col("y.judge").alias("peer"), "prompt_id").agg(F.sum(mine).alias("delta"))
    return _flip(x, ["cond", "judge", "peer"], "like", LIKE_FLIPS)


@query(_boot(RATIO_BOOT) + ", c as (select cond, author, judge, d, sum(correct * w) / sum(w) as r from jfull join pn using (prompt_id) join w using (place) group by 1, 2, 3, 4), m as (select cond, author, d, max(r) filter (judge = author) - max(r) filter (judge <> author) as gap from c group by 1, 2, 3) select cond, author, round(quantile_cont(gap, 0.025), 9) as low, round(quantile_cont(gap, 0.5), 9) as median, round(quantile_cont(gap, 0.975), 9) as high from m group by 1, 2")
def sta30_best_peer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own rate less the best peer's of the same draw."""
    x = full(spark, sf_dir).groupBy("cond", "author", "judge", "prompt_id").agg(F.sum("correct").alias("k"), F.count("correct").alias("n"))
    c = weighed_by(x, ["cond", "author", "judge"], ["k", "n"], spark, sf_dir, RATIO_BOOT).withColumn("r", F.try_divide("k", "n"))
    own = F.col("author") == F.col("judge")
    m = c.groupBy("cond", "author", "d").agg((F.max(F.when(own, F.col("r"))) - F.max(F.when(~own, F.col("r")))).alias("gap"))
    return m.groupBy("cond", "author").agg(*[F.round(F.percentile("gap", q), 9).alias(n) for n, q in (("low", 0.025), ("median", 0.5), ("high", 0.975))])


@query(CTE + ", c as (select r.judge, r.prompt_id, list(r.quality order by r.author_idx) as qs, list(j.named_self order by r.author_idx) as ns from qual r join jfull j on j.item = r.item and j.cond = 'lineup' group by 1, 2), s as (select judge, d, sum(list_sum(list_transform(range(0, len(qs)), lambda i: ns[i + 1] * qs[(i + " + _U.format("'fam|' || d || '|' || judge || '|' || prompt_id") + f") % len(qs) + 1]))) as sim, sum(list_sum(list_transform(range(0, len(qs)), lambda i: ns[i + 1] * qs[i + 1]))) as seen from c, {_d(WITHIN)} group by 1, 2) select judge, round(max(seen), 4) as seen, round((sum((sim >= seen - 1e-9)::int) + 1) / (count(*) + 1), 6) as p_value from s group by judge")
def sta39_claim_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do judges claim the texts they rate highest? Ratings are rotated within prompts."""
    j = full(spark, sf_dir).where("cond = 'lineup'").select("item", "named_self")
    x = quality(spark, sf_dir).join(j, "item").groupBy("judge", "prompt_id").agg(F.array_sort(F.collect_list(F.struct("author_idx", "quality", "named_self"))).alias("x"))
    places = F.sequence(F.lit(0), F.size("x") - 1)
    score = lambda shift: F.aggregate(places, F.lit(0.0), lambda a, i: a + F.get(F.col("x"), i)["named_self"] * F.get(F.col("x"), ((i + shift) % F.size("x")).cast("int"))["quality"])
    s = x.select("judge", F.concat_ws("|", "judge", "prompt_id").alias("key"), F.transform(places, score).alias("table"), score(F.lit(0)).alias("own"))
    return simulated(s, ["judge"], "fam", WITHIN, slack=1e-9).select("judge", F.round("seen", 4).alias("seen"), "p_value")


@query(CTE + ", m as (select judge, prompt_id, list(guess order by author_idx) as gs, list(author order by author_idx) as au from jfull where cond = 'lineup' group by 1, 2), s as (select judge, d, sum(list_sum(list_transform(range(0, len(gs)), lambda i: (gs[(i + " + _U.format("'nref|' || d || '|' || judge || '|' || prompt_id") + f") % len(gs) + 1] = au[i + 1])::int))) as sim, sum(list_sum(list_transform(range(0, len(gs)), lambda i: (gs[i + 1] = au[i + 1])::int))) as seen from m, {_d(REFERENCES)} group by 1, 2) select judge, max(seen)::bigint as seen, round(avg(sim), 6) as null_mean, round((sum((sim >= seen)::int) + 1) / (count(*) + 1), 6) as p_value from s group by judge")
def sta40_reference_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits when a prompt's guesses are rotated against its references."""
    m = full(spark, sf_dir).where("cond = 'lineup'").groupBy("judge", "prompt_id").agg(F.array_sort(F.collect_list(F.struct("author_idx", "author", "guess"))).alias("x"))
    places = F.sequence(F.lit(0), F.size("x") - 1)
    hits = lambda shift: F.aggregate(places, F.lit(0), lambda a, i: a + (F.get(F.col("x"), ((i + shift) % F.size("x")).cast("int"))["guess"] == F.get(F.col("x"), i)["author"]).cast("int"))
    s = m.select("judge", F.concat_ws("|", "judge", "prompt_id").alias("key"), F.transform(places, hits).alias("table"), hits(F.lit(0)).alias("own"))
    return simulated(s, ["judge"], "nref", REFERENCES).select("judge", F.col("seen").cast("bigint").alias("seen"), r6("null_mean").alias("null_mean"), "p_value")
