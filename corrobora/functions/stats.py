"""Statistics of 2x2 tables as columns: x1 of n1 against x2 of n2."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")
#: A table at most this much likelier than the observed one counts as no likelier.
FISHER_TOLERANCE = 1e-7
#: Tables of one support that a row of work holds.
FISHER_BLOCK = 2048
#: Blocks whose tables are all so many nats less likely than the observed one are left out: fewer than 10^13 of them can't change its probability in double precision.
FISHER_TAIL = 70.0


def z_of(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)


def _zero(x1, n1, x2, n2) -> Column:
    return (x1 == 0) | (x1 == n1) | (x2 == 0) | (x2 == n2)


def _interval(ratio: Column, se: Column, alpha: float) -> list[Column]:
    z = z_of(alpha)
    return [ratio, F.exp(F.ln(ratio) - z * se), F.exp(F.ln(ratio) + z * se)]


def _defined(n1: Column, n2: Column, columns: list[Column]) -> list[Column]:
    return [F.when((n1 > 0) & (n2 > 0), c).otherwise(F.lit(NAN)) for c in columns]


def risk_ratio(x1: Column, n1: Column, x2: Column, n2: Column, alpha: float = 0.05) -> list[Column]:
    """(ratio, lower, upper) by the log method; any zero cell adds 1/2 to both successes and 1 to both totals. NaN if an arm is empty."""
    half = F.when(_zero(x1, n1, x2, n2), 0.5).otherwise(0.0)
    a, c, m, n = x1 + half, x2 + half, n1 + 2 * half, n2 + 2 * half
    return _defined(n1, n2, _interval((a / m) / (c / n), F.sqrt((1 / a - 1 / m) + (1 / c - 1 / n)), alpha))


def odds_ratio(x1: Column, n1: Column, x2: Column, n2: Column, alpha: float = 0.05) -> list[Column]:
    """(ratio, lower, upper) by the logit method; any zero cell adds 1/2 to all four. NaN if an arm is empty."""
    half = F.when(_zero(x1, n1, x2, n2), 0.5).otherwise(0.0)
    a, b, c, d = x1 + half, n1 - x1 + half, x2 + half, n2 - x2 + half
    return _defined(n1, n2, _interval((a * d) / (b * c), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d), alpha))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x from 1 to 1e38: Stirling's series at x + 8, less the ln of the product that leads there."""
    y = x + 8.0
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (y * y)) / (y * y)) / (y * y)) / y
    pairs = [(x + float(k)) * (x + float(7 - k)) for k in range(4)]
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + series - F.ln(pairs[0] * pairs[1] * pairs[2] * pairs[3])


def with_fisher(df: DataFrame, x1: str, n1: str, x2: str, n2: str, keys: list[str], name: str = "p_value") -> DataFrame:
    """Adds the two-sided exact p-value, NaN if an arm is empty. keys identify a row of df.

    The tables with the same margins are exploded, one row each; those no likelier than the observed one are summed.
    Likelihood rises to one mode and falls, so the ends of a block tell whether all its tables are likelier than the
    observed one, or all too unlikely (by FISHER_TAIL nats) to add a digit to its own probability: such blocks are left out.
    """
    a, m, c, n = (F.col(x).cast("double") for x in (x1, n1, x2, n2))
    rows = df.filter((m > 0) & (n > 0)).select(*keys, a.alias("_a"), m.alias("_m"), n.alias("_n"), (a + c).alias("_s"))
    low, high = F.greatest(F.lit(0.0), F.col("_s") - F.col("_n")).cast("long"), F.least(F.col("_m"), F.col("_s")).cast("long")
    # A table's support is dealt out in blocks, so that one large table isn't one task.
    blocks = rows.withColumn("_low", F.explode(F.sequence(low, high, F.lit(FISHER_BLOCK)))).withColumn("_high", F.least(F.col("_low") + FISHER_BLOCK - 1, high))
    kernel = lambda k: -(log_gamma(k + 1.0) + log_gamma(F.col("_m") - k + 1.0) + log_gamma(F.col("_s") - k + 1.0) + log_gamma(F.col("_n") - F.col("_s") + k + 1.0))
    margins = log_gamma(F.col("_m") + 1.0) + log_gamma(F.col("_n") + 1.0) + log_gamma(F.col("_s") + 1.0) + log_gamma(F.col("_m") + F.col("_n") - F.col("_s") + 1.0) - log_gamma(F.col("_m") + F.col("_n") + 1.0)
    blocks = blocks.withColumn("_c", margins).withColumn("_own", F.col("_c") + kernel(F.col("_a"))).repartition(df.sparkSession.sparkContext.defaultParallelism)
    mode = F.floor((F.col("_m") + 1.0) * (F.col("_s") + 1.0) / (F.col("_m") + F.col("_n") + 2.0))
    # As functions of arrays, the ends' probabilities add no code to the generated stage.
    ends = F.transform(F.array(F.col("_low").cast("double"), F.col("_high").cast("double")), lambda k: F.col("_c") + kernel(k))
    likelier = F.array_min(ends) > F.col("_own") + FISHER_TOLERANCE
    lost = ((mode < F.col("_low")) | (mode > F.col("_high"))) & (F.array_max(ends) < F.col("_own") - FISHER_TAIL)
    blocks = blocks.filter(~likelier & ~lost)
    tables = blocks.withColumn("_k", F.explode(F.sequence("_low", "_high"))).withColumn("_k", F.col("_k").cast("double")).select(*keys, "_own", (F.col("_c") + kernel(F.col("_k"))).alias("_p"))
    summed = tables.filter(F.col("_p") <= F.col("_own") + FISHER_TOLERANCE).groupBy(*keys).agg(F.least(F.lit(1.0), F.sum(F.exp("_p"))).alias(name))
    summed = summed.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(summed, same, "left").drop(*[f"_{k}" for k in keys]).withColumn(name, F.coalesce(name, F.lit(NAN)))
