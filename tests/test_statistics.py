import hashlib
import math
import os

import pytest
from pyspark.sql import functions as F

from corrobora.functions import stats
from corrobora.operators import bootstrap as B
from corrobora.operators import enrichment as E

SCHEMA = "id int, x_yes long, n_yes long, x_no long, n_no long"


def ratios(spark, *cells):
    df = E.with_ratios(spark.createDataFrame([(0, *cells)], SCHEMA))
    return stats.with_fisher(df, "x_yes", "n_yes", "x_no", "n_no", ["id"]).first()


def exact_p(a, m, c, n):
    s = a + c
    p = lambda k: math.comb(m, k) * math.comb(n, s - k) / math.comb(m + n, s)
    return sum(p(k) for k in range(max(0, s - n), min(m, s) + 1) if p(k) <= p(a) * (1 + 1e-7))


@pytest.mark.parametrize("cells, rr, odds", [((50, 100, 50, 100), 1.0, 1.0), ((80, 100, 40, 100), 2.0, 6.0), ((20, 100, 40, 100), 0.5, 0.375)])
def test_known_ratios(spark, cells, rr, odds):
    row = ratios(spark, *cells)
    assert row["rr"] == pytest.approx(rr) and row["or"] == pytest.approx(odds)
    assert row["rr_lower"] < rr < row["rr_upper"] and row["or_lower"] < odds < row["or_upper"]
    assert row["p_value"] == pytest.approx(exact_p(*cells), rel=1e-7)


@pytest.mark.parametrize("cells", [(0, 100, 50, 100), (0, 100, 0, 100), (1, 1, 50, 100), (100, 100, 100, 100)])
def test_zero_cells_are_corrected(spark, cells):
    row = ratios(spark, *cells)
    assert all(math.isfinite(row[c]) for c in ("rr", "rr_lower", "rr_upper", "or", "or_lower", "or_upper"))


def test_an_empty_arm_is_undefined(spark):
    row = ratios(spark, 0, 0, 50, 100)
    assert all(math.isnan(row[c]) for c in ("rr", "or", "rr_lower", "p_value")) and row["rate_yes"] == 0.0


def test_published_cell(spark):
    row = ratios(spark, 242, 742, 4322, 36635)
    assert row["rr"] == pytest.approx(2.7645, abs=1e-3) and row["or"] == pytest.approx(3.6186, abs=1e-3)


def test_large_counts(spark):
    row = ratios(spark, 18962, 19988, 1756511, 1904959)
    assert row["rr"] == pytest.approx(1.0288, abs=1e-4) and 0 < row["p_value"] < 1


@pytest.mark.parametrize("cells", [(5100, 10000, 4900, 10000), (300, 20000, 200, 20000), (9000, 10000, 100, 10000), (4000, 8000, 5, 9), (2500, 5000, 2500, 5000)])
def test_exact_test_over_many_blocks(spark, monkeypatch, cells):
    """The sum over all tables, of which most blocks are left out."""
    monkeypatch.setattr(stats, "FISHER_BLOCK", 64)
    a, m, c, n = cells
    s = a + c
    log_p = lambda k: sum(math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1) for x, y in ((m, k), (n, s - k))) - (math.lgamma(m + n + 1) - math.lgamma(s + 1) - math.lgamma(m + n - s + 1))
    want = min(1.0, math.fsum(math.exp(log_p(k)) for k in range(max(0, s - n), min(m, s) + 1) if log_p(k) <= log_p(a) + 1e-7))
    assert ratios(spark, *cells)["p_value"] == pytest.approx(want, rel=1e-6, abs=1e-300)


def rows(spark, a, m, c, n, copies=1, unique=True):
    cells = [(1, i < a, True, i) for i in range(m)] + [(1, i < c, False, m + i) for i in range(n)]
    df = spark.createDataFrame(cells, "p int, s boolean, has_genetic_evidence boolean, k int")
    df = df.select(F.when(F.col("s"), 2).otherwise(1).alias("max_phase"), "has_genetic_evidence", F.concat(F.lit("c"), "k").alias("gene"))
    return df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("n")


def test_bootstrap_of_single_rows_is_near_the_closed_form(spark):
    df = rows(spark, 200, 500, 100, 500)
    boot = B.bootstrap(df, transitions=((1, 2),), n=4000).first()
    closed = E.with_ratios(E.transition_counts(df, ((1, 2),))).first()
    for side in ("rr_lower", "rr_upper", "or_lower", "or_upper"):
        name = side.replace("_", "_boot_")
        assert boot[name] == pytest.approx(closed[side], rel=0.05)


def test_bootstrap_ignores_copies_and_order(spark):
    once = B.bootstrap(rows(spark, 40, 80, 30, 90), transitions=((1, 2),), n=1000).first()
    tenfold = B.bootstrap(rows(spark, 40, 80, 30, 90, copies=10).orderBy(F.rand(3)), transitions=((1, 2),), n=1000).first()
    assert once["rr_boot_lower"] == pytest.approx(tenfold["rr_boot_lower"]) and once["or_boot_upper"] == pytest.approx(tenfold["or_boot_upper"])


@pytest.mark.parametrize("cells", [(0, 20, 5, 20), (1, 1, 5, 20), (20, 20, 5, 20)])
def test_bootstrap_refuses(spark, cells):
    row = B.bootstrap(rows(spark, *cells), transitions=((1, 2),), n=50).first()
    assert math.isnan(row["rr_boot_lower"]) and math.isnan(row["or_boot_upper"])


def test_bootstrap_bounds_may_be_infinite(spark):
    row = B.bootstrap(rows(spark, 6, 12, 1, 12), transitions=((1, 2),), n=400).first()
    assert math.isinf(row["rr_boot_upper"]) and math.isfinite(row["rr_boot_lower"])


def test_draws_down_a_tree_have_the_moments_of_direct_draws(spark, monkeypatch):
    """The same sums by leaves of 5 cells, two or more levels deep, as by one leaf: equal means, variances and covariances."""
    import numpy as np

    rng = np.random.default_rng(2)
    cells = [(1, 2, f"c{i}", int(x), int(x) + 1 + i % 7, i % 3, 3 + i % 11) for i, x in enumerate(rng.integers(0, 40, 200))]
    df = spark.createDataFrame(cells, "phase_from int, phase_to int, cluster string, x_yes long, n_yes long, x_no long, n_no long")
    own = np.array([c[3:] for c in cells], float)
    mean, cov = own.sum(axis=0), len(own) * np.cov(own.T, bias=True)
    taken = []
    monkeypatch.setattr(B, "ratios", lambda a, m, c, n: (F.array(a, m, c, n), F.lit(1.0)))
    for leaf, parts in ((4096, 3), (5, 3), (5, 7)):
        monkeypatch.setattr(B, "LEAF", leaf)
        monkeypatch.setattr(B, "FAN", 4)
        drawn = {r["r"]: r["rr"] for r in B.replicates(df.repartition(parts), 3000).collect()}
        assert sorted(drawn) == list(range(3000))
        x = np.array([drawn[r] for r in range(3000)])
        assert np.all(np.abs(x.mean(axis=0) - mean) < 5 * np.sqrt(np.diag(cov) / 3000))
        assert (np.abs(np.cov(x.T) - cov) / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))).max() < 5 * np.sqrt(2 / 3000)
        taken.append(x)
    assert (taken[1] == taken[2]).all()  # for any partitioning
    assert (taken[0] != taken[1]).any()


def test_an_arm_of_many_clusters_is_drawn_in_parts(spark, monkeypatch):
    n = 200_000
    cells = spark.range(n).select(F.lit(1).alias("phase_from"), F.lit(2).alias("phase_to"), F.col("id").cast("string").alias("cluster"), F.col("id").alias("x_yes"), (F.col("id") + 1).alias("n_yes"), F.lit(1).cast("long").alias("x_no"), F.lit(2).cast("long").alias("n_no"))
    seen = []
    sums = B.leaf_sums
    monkeypatch.setattr(B, "leaf_sums", lambda state, leaves, *a: seen.append(leaves) or sums(state, leaves, *a))
    drawn = B.replicates(cells, 20).select("rr").collect()
    assert len(drawn) == 20 and all(r["rr"] == pytest.approx(2, rel=1e-2) for r in drawn)
    sizes = [r["s"] for leaves in seen for r in leaves.select(F.size("cells").alias("s")).collect()]
    assert sum(sizes) == n and max(sizes) < 1.2 * B.LEAF


def test_the_ratio_that_lost_more_decides(spark):
    """All odds ratios of replicates without failures are lost, none of the risk ratios."""
    sums = spark.createDataFrame([(1, 2, True)], "phase_from int, phase_to int, usable boolean")
    drawn = lambda lost: spark.createDataFrame([(1, 2, r, 1.0 + r, None if r < lost else 2.0) for r in range(100)], "phase_from int, phase_to int, r int, rr double, or_ double")
    kept, gone = B.intervals(drawn(20), sums).first(), B.intervals(drawn(30), sums).first()
    assert kept["rr_boot_lower"] == 3.0 and kept["or_boot_upper"] == 2.0
    assert math.isnan(gone["rr_boot_lower"]) and math.isnan(gone["or_boot_upper"])
    assert B.losses(drawn(30)).first()["lost"] == pytest.approx(0.3)


def test_lost_replicates_are_warned_of(spark):
    with pytest.warns(UserWarning, match="leave a ratio undefined"):
        B.bootstrap(rows(spark, 2, 3, 1, 3), transitions=((1, 2),), n=400, warn=True)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["t7_bootstrap_ci", "b4_cluster_unit_sensitivity"])
def test_queries_draw_all_replicates(spark, monkeypatch, name):
    from corrobora.plans import domain, feeds

    asked = []
    drawn = B.replicates
    monkeypatch.setattr(B, "replicates", lambda cells, n, *a, **b: asked.append(n) or drawn(cells, n, *a, **b))
    {**domain.QUERIES, **feeds.QUERIES}[name](spark, SF)
    assert asked and set(asked) == {10_000}


def test_hash_draws_against_brute_force(spark):
    cells = [("a", 1, 3, 2, 5), ("b", 2, 2, 1, 4), ("c", 3, 6, 2, 2)]
    df = spark.createDataFrame([(1, 2, *c) for c in cells], "phase_from int, phase_to int, cluster string, x_yes long, n_yes long, x_no long, n_no long")
    got = {r["r"]: r["rr"] for r in B.hashed_replicates(df, B.REPLICATES).collect()}
    assert sorted(got) == list(range(B.REPLICATES))
    for r in got:
        drawn = [cells[int(hashlib.md5(f"0:{r}:{j}".encode()).hexdigest()[:12], 16) % 3] for j in range(3)]
        a, m, c, n = (sum(x[k] for x in drawn) for k in range(1, 5))
        assert got[r] == pytest.approx(a * n / (c * m))
