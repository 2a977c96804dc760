import hashlib

import pytest

from tallyard.functions.draws import draws
from tallyard.plans import resampling


@pytest.mark.parametrize("seed, key", [("adv", "GPT|P0000012"), ("boot", "7"), ("s" * 30, "longer than a block" * 2)])
def test_draws_are_md5_of_their_text(seed, key):
    want = [int(hashlib.md5(f"{seed}|{d}|{key}".encode()).hexdigest()[:8], 16) for d in range(10_500)]
    assert draws(seed, key, 10_500).tolist() == want


def test_draws_are_as_many_as_the_references():
    """Ten Holm-adjusted tests can reach 0.05, and a 2.5 % limit rests on more than two draws."""
    assert (resampling.WITHIN, resampling.AUC, resampling.FLIPS, resampling.BOOT) == (4_000, 2_000, 20_000, 10_000)


def test_pairwise_has_bootstrap_fisher_and_holm(spark, sf):
    rows = resampling.sta26_pairwise_tests(spark, sf).collect()
    assert len(rows) == 20
    for p in ("p_flip", "p_bootstrap"):
        for cond in ("lineup", "single"):
            ps = sorted((r[p], r[f"{p}_holm"]) for r in rows if r["cond"] == cond)
            assert all(h >= x for x, h in ps)
            assert ps[0][1] == pytest.approx(min(1, 10 * ps[0][0]), abs=1e-5)
    # every p is a count of all the flips, which the log's judges give no reason to be small
    counts = [r["p_flip"] * (resampling.FLIPS + 1) for r in rows]
    assert all(abs(c - round(c)) < 0.02 and c >= 1 for c in counts)
    assert all(r["low"] <= r["diff"] <= r["high"] and 0 < r["p_fisher"] <= 1 for r in rows)
