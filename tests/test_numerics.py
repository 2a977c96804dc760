"""Published figures from published counts, and properties of the kernels."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyard.functions import exact, kernels
from tallyard.operators.gee import solve
from tallyard.plans.windows import with_holm

#: Counts of 38 own and 152 other texts: self hits, false alarms, peers' hits.
COUNTS = {"GPT": (22, 16, 46), "Claude": (33, 14, 82), "Gemini": (7, 31, 43), "Grok": (2, 31, 44), "DeepSeek": (8, 27, 33)}


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame([(k, *v) for k, v in COUNTS.items()], "judge string, h bigint, f bigint, p bigint")


def by_judge(df, c):
    return {r["judge"]: r[c] for r in df.collect()}


def test_binomial(counts):
    p = by_judge(counts.select("judge", exact.binomial(F.col("h"), F.lit(38), 0.2).alias("p")), "p")
    for k, v in {"GPT": 3.17e-07, "Claude": 1.47e-18, "Gemini": 1.0, "Grok": 2.33e-02, "DeepSeek": 0.840}.items():
        assert p[k] == pytest.approx(v, rel=5e-3)


def test_fisher_and_odds(counts):
    p = by_judge(counts.select("judge", exact.fisher(F.col("h"), 38 - F.col("h"), F.col("p"), 152 - F.col("p")).alias("p")), "p")
    for k, v in {"GPT": 2.27e-3, "Claude": 1.59e-4, "Gemini": 0.303, "Grok": 1.33e-3, "DeepSeek": 1.0}.items():
        assert p[k] == pytest.approx(v, rel=5e-3)


def test_leak(counts):
    k, _ = exact.haldane(F.col("h"), F.lit(38), F.col("f"), F.lit(152))
    got = by_judge(counts.select("judge", k.alias("k")), "k")
    assert got["GPT"] == pytest.approx(2.423119162022319, rel=1e-12)
    assert got["Claude"] == pytest.approx(4.06351902279346, rel=1e-12)
    assert got["Gemini"] == pytest.approx(-0.08515780834030683, rel=1e-10)


def test_intervals(counts):
    low, high = exact.wilson(F.col("h"), F.lit(38))
    r = {x["judge"]: x for x in counts.select("judge", low.alias("a"), high.alias("b")).collect()}
    assert (round(r["GPT"]["a"], 3), round(r["GPT"]["b"], 3)) == (0.422, 0.721)
    for k, want in {22: (40.8, 73.7), 33: (71.9, 95.6), 7: (7.7, 34.3), 2: (0.6, 17.7), 8: (9.6, 37.3)}.items():
        assert tuple(round(100 * x, 1) for x in kernels.clopper_pearson_interval(k, 38)) == want


def test_closed_forms(spark):
    r = spark.range(1).select(exact.chi2_even(F.lit(6.6), 4).alias("a"), exact.chi2_even(F.lit(1.3), 4).alias("b"), exact.ln_factorial(F.lit(20)).alias("c"), exact.ln_factorial(F.lit(10**6)).alias("d")).first()
    assert round(r["a"], 3) == pytest.approx(0.159, abs=2e-3) and round(r["b"], 3) == pytest.approx(0.861, abs=5e-3)
    assert r["c"] == pytest.approx(math.lgamma(21), rel=1e-13) and r["d"] == pytest.approx(math.lgamma(1e6 + 1), rel=1e-13)


def test_large_counts_stay_bounded(spark):
    r = spark.range(1).select(exact.binomial(F.lit(200_500_000), F.lit(1_000_000_000), 0.2).alias("p")).first()
    z = 500_000 / math.sqrt(1e9 * 0.16)
    assert r["p"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.2, 0.4, 0.5, 0.8, 1.0]), st.integers(1, 9)), min_size=1, max_size=6))
def test_poisson_binomial_equals_convolution(parts):
    pmf = np.array([1.0])
    for q, k in parts:
        for _ in range(k):
            pmf = np.convolve(pmf, [1 - q, q])
    got = kernels.poisson_binomial(np.array([q for q, _ in parts]), np.array([k for _, k in parts]))
    assert got.sum() == pytest.approx(1, abs=1e-9)
    assert np.allclose(got, pmf, atol=1e-12)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 30), st.integers(1, 30))
def test_beta_inverse(k, n):
    if k <= n:
        lo, hi = kernels.clopper_pearson_interval(k, n)
        assert 0 <= lo <= k / n <= hi <= 1


def test_holm(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])], "fam string, i int, p double")
    got = {r["i"]: round(r["holm"], 9) for r in with_holm(df, "p", ["fam"], ["i"]).collect()}
    assert got == {3: 0.02, 0: 0.03, 2: 0.06, 1: 0.06}


def test_gee_equals_a_dense_solver():
    rng = np.random.default_rng(3)
    clusters = []
    for _ in range(60):
        x = np.array([1, 0, 0, 0, 0])
        b = rng.normal(0, 0.7)
        clusters.append((x, (rng.random(5) < 1 / (1 + np.exp(-(-1 + x + b)))).astype(int)))
    cells = [(4, int(y[1:].sum()), 1, int(y[0]), 1) for _, y in clusters]
    got = solve(*zip(*cells))
    beta, rho = np.array([got["intercept"], got["slope"]]), got["rho"]
    score = np.zeros(2)
    for x, y in clusters:
        mu = 1 / (1 + np.exp(-(beta[0] + beta[1] * x)))
        a = np.sqrt(mu * (1 - mu))
        r = (1 - rho) * np.eye(5) + rho
        d = np.stack([np.ones(5), x]).T * (mu * (1 - mu))[:, None]
        score += d.T @ np.linalg.solve(np.outer(a, a) * r, y - mu)
    assert np.abs(score).max() < 1e-5
    assert solve([4], [0], [1], [0], [10]) is None


def test_all_orders_of_a_block_are_used(spark, sf):
    from tallyard.plans.resampling import sta25_shuffle_floor
    from tallyard.sources.fixtures import full

    j = full(spark, sf).where("is_self = 0").select("cond", "judge", "block", "author", "guess").toPandas()
    want = {}  # over all orders a guess stands at each author's place equally often
    for (cond, judge, _), b in j.groupby(["cond", "judge", "block"]):
        hits = sum(a == g for a, g in itertools.product(b["author"], b["guess"])) / len(b)
        want[cond, judge] = want.get((cond, judge), 0.0) + hits
    got = {(r["cond"], r["judge"]): r["floor"] for r in sta25_shuffle_floor(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
