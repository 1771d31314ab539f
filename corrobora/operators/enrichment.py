"""Progression of supported against unsupported pairs, for all transitions and arms in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import phase_label

TRANSITIONS = ((1, 2), (2, 3), (3, 4), (1, 4))
CONVENTIONS = ("none", "entry gate", "per transition")


def transition_counts(trials: DataFrame, transitions=TRANSITIONS, keys=(), flag: str = "has_genetic_evidence") -> DataFrame:
    """(keys, phase_from, phase_to, x_yes, n_yes, x_no, n_no) for each arm and transition, zeros where an arm has no eligible pair.

    Eligible: at or past phase_from. Censored: still running below phase_to.
    """
    ongoing = F.col("is_ongoing") if "is_ongoing" in trials.columns else F.lit(False)
    cells = trials.groupBy(*keys, "max_phase", F.col(flag).alias("yes"), ongoing.alias("ongoing")).agg(F.count("*").alias("n"))
    return step_counts(cells, transitions, keys)


def step_counts(cells: DataFrame, transitions=TRANSITIONS, keys=()) -> DataFrame:
    """transition_counts of trials counted by (keys, max_phase, yes, ongoing) as n: only these few rows are multiplied by the transitions."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("phase_from"), F.lit(b).alias("phase_to")) for a, b in transitions])).alias("step")
    rows = cells.select(*keys, "max_phase", "yes", "ongoing", "n", steps).select("*", "step.*")
    counted = (F.col("max_phase") >= F.col("phase_from")) & ~(F.col("ongoing") & (F.col("max_phase") < F.col("phase_to")))
    reached = counted & (F.col("max_phase") >= F.col("phase_to"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return rows.groupBy(*keys, "phase_from", "phase_to").agg(
        total(reached & F.col("yes")).alias("x_yes"), total(counted & F.col("yes")).alias("n_yes"),
        total(reached & ~F.col("yes")).alias("x_no"), total(counted & ~F.col("yes")).alias("n_no"),
    )


def counts_by_arm(trials: DataFrame, supported: DataFrame, keys, transitions=TRANSITIONS, arms: DataFrame | None = None, within=(), without: DataFrame | None = None, censorings: bool = False) -> DataFrame:
    """transition_counts for each arm (keys) of supported (keys, gene, efo_id; distinct), and for each value of the trials' columns `within`.

    Trials aren't multiplied by arms: what an arm doesn't support is what all trials have less what it does. arms:
    (keys) of all arms; without it, arms that support no pair at all have no row. without: (gene, efo_id) of pairs that
    leave the trials of an arm unless it supports them. censorings: counts with and without censoring, by `censored`.
    """
    keys, within = list(keys), list(within)
    by = [*within, "max_phase", "ongoing"]
    trials = trials.withColumn("ongoing", F.col("is_ongoing")).withColumn("max_phase", F.col("max_phase").cast("int"))
    rest = F.lit(True)
    if without is not None:
        trials = trials.join(without.select("gene", "efo_id").distinct().withColumn("_left", F.lit(True)), ["gene", "efo_id"], "left")
        rest = F.col("_left").isNull()
    yes = trials.join(supported, ["gene", "efo_id"]).groupBy(*keys, *by).agg(F.count("*").alias("n_yes"), F.count_if(rest).alias("n_both"))
    all_ = trials.groupBy(*by).agg(F.count_if(rest).alias("n")).collect()  # a row for each phase and state
    kind = dict(trials.dtypes)
    cell = lambda r: F.struct(*[F.lit(r[c]).cast(kind[c]).alias(c) for c in by], F.lit(r["n"]).cast("long").alias("n"))
    cells = F.array(*map(cell, all_)) if all_ else F.array().cast(f"array<struct<{', '.join(f'{c}: {kind[c]}' for c in by)}, n: bigint>>")
    arms = supported if arms is None else arms
    grid = arms.select(*keys).distinct().select(*keys, F.explode(cells).alias("cell")).select(*keys, "cell.*")
    zero = F.lit(0).cast("long")
    both = grid.join(yes, [*keys, *by], "left").withColumns({c: F.coalesce(c, zero) for c in ("n_yes", "n_both")})
    sides = F.explode(F.array(F.struct(F.lit(True).alias("yes"), F.col("n_yes").alias("n")), F.struct(F.lit(False).alias("yes"), (F.col("n") - F.col("n_both")).alias("n")))).alias("side")
    counted = both.select(*keys, *by, sides).select(*keys, *by, "side.*")
    if censorings:
        counted = counted.withColumn("censored", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("ongoing", F.col("ongoing") & F.col("censored"))
        within.append("censored")
    return step_counts(counted, transitions, [*within, *keys])


def with_ratios(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds rates (0 for an empty arm), risk and odds ratios with intervals."""
    x1, n1, x2, n2 = (F.col(c).cast("double") for c in ("x_yes", "n_yes", "x_no", "n_no"))
    rate = lambda x, n: F.when(n > 0, x / n).otherwise(0.0)
    names = ["rr", "rr_lower", "rr_upper", "or", "or_lower", "or_upper"]
    columns = [*stats.risk_ratio(x1, n1, x2, n2, alpha), *stats.odds_ratio(x1, n1, x2, n2, alpha)]
    return counts.select("*", rate(x1, n1).alias("rate_yes"), rate(x2, n2).alias("rate_no"), *[c.alias(n) for c, n in zip(columns, names)])


def enrichment(trials: DataFrame, transitions=TRANSITIONS, keys=(), alpha: float = 0.05, flag: str = "has_genetic_evidence") -> DataFrame:
    """Counts, rates, ratios, exact p-values and labels for each arm and transition."""
    return tested(transition_counts(trials, transitions, keys, flag), keys, alpha)


def tested(counts: DataFrame, keys=(), alpha: float = 0.05) -> DataFrame:
    """Counts by arm and transition with rates, ratios, exact p-values and labels."""
    counts = with_ratios(counts, alpha).withColumn("transition", phase_label(F.col("phase_from"), F.col("phase_to")))
    return stats.with_fisher(counts, "x_yes", "n_yes", "x_no", "n_no", [*keys, "phase_from", "phase_to"])


def by_convention(trials: DataFrame) -> DataFrame:
    """The trials three times, tagged by how running pairs are treated: kept, dropped below phase 2, censored per transition."""
    named = F.explode(F.array(*[F.lit(c) for c in CONVENTIONS])).alias("convention")
    rows = trials.select("*", named)
    gate = (F.col("convention") == "entry gate") & F.col("is_ongoing") & (F.col("max_phase") < 2)
    return rows.filter(~gate).withColumn("is_ongoing", F.col("is_ongoing") & (F.col("convention") == "per transition"))


def flag_sources(trials: DataFrame, supported: DataFrame, sources: list[str], key: str = "source") -> DataFrame:
    """Trials once for each source, with has_genetic_evidence: one pass for all of them. supported: (key, gene, efo_id)."""
    pairs = supported.groupBy("gene", "efo_id").agg(F.collect_set(key).alias("_by"))
    arms = trials.join(pairs, ["gene", "efo_id"], "left").withColumn(key, F.explode(F.array(*[F.lit(x) for x in sources])))
    return arms.withColumn("has_genetic_evidence", F.coalesce(F.array_contains("_by", F.col(key)), F.lit(False))).drop("_by")
