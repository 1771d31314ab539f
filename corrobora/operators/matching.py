"""Which trial pairs an evidence table supports, exactly or through a table of similar diseases."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import at_least
from ..storage import join_dealt, materialise, materialise_with, small

PAIR = ["gene", "efo_id"]


def require_columns(df: DataFrame, columns, what: str = "table") -> DataFrame:
    """df, or an error that lists what is missing, before anything is read."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


class MissingOngoingWarning(UserWarning):
    """Trials have no is_ongoing column."""


class UnmatchableDiseaseWarning(UserWarning):
    """Rows have a disease that the lookup lacks."""


BAD_FLAG = "is_ongoing holds other values than 0 and 1"


def ongoing_flag(trials: DataFrame) -> tuple[Column, Column]:
    """(is_ongoing as a boolean without nulls, whether its value is none of true, false, 0 and 1). Text is an error; without the column nothing is ongoing, with a warning."""
    if "is_ongoing" not in trials.columns:
        warnings.warn("no is_ongoing column: nothing is censored", MissingOngoingWarning, stacklevel=3)
        return F.lit(False), F.lit(False)
    kind = dict(trials.dtypes)["is_ongoing"]
    if kind == "string":
        raise ValueError("is_ongoing holds text")
    if kind == "boolean":
        return F.coalesce("is_ongoing", F.lit(False)), F.lit(False)
    number = F.col("is_ongoing").cast("double")
    absent = number.isNull() | F.isnan(number)
    return F.coalesce(number == 1.0, F.lit(False)), ~absent & ~F.coalesce(number.isin(0.0, 1.0), F.lit(False))


def clean_trials(trials: DataFrame) -> DataFrame:
    """Trials without null keys, is_ongoing as a boolean without nulls. Repeated pairs and other values of is_ongoing are errors; a missing is_ongoing censors nothing, with a warning."""
    require_columns(trials, [*PAIR, "max_phase"], "clinical trials")
    trials = trials.dropna(subset=[*PAIR, "max_phase"])
    again = trials.groupBy(*PAIR).count().filter("count > 1")
    if found := again.orderBy(*PAIR).limit(3).collect():
        raise ValueError(f"{again.count()} pairs are repeated, such as {[(r['gene'], r['efo_id']) for r in found]}")
    flag, bad = ongoing_flag(trials)
    return trials.withColumn("is_ongoing", F.when(~bad, flag).otherwise(F.raise_error(F.lit(BAD_FLAG)).cast("boolean")))


def checked_trials(trials: DataFrame, similarity: DataFrame | None = None) -> DataFrame:
    """clean_trials and drop_unmatchable in the one pass that writes the trials: what is wrong is counted on the way.

    Errors: repeated pairs, other values of is_ongoing, a lookup that knows no trial's disease. Warnings: no is_ongoing,
    pairs whose disease the lookup lacks, which are left out.
    """
    require_columns(trials, [*PAIR, "max_phase"], "clinical trials")
    flag, bad = ongoing_flag(trials)
    columns = [*trials.columns, *(["is_ongoing"] if "is_ongoing" not in trials.columns else [])]
    rows = trials.withColumns({"_bad": bad, "is_ongoing": flag}).dropna(subset=[*PAIR, "max_phase"])
    others = F.struct(*[F.col(f"`{c}`") for c in columns if c not in PAIR], "_bad")
    pairs = rows.groupBy(*PAIR).agg(F.count("*").alias("_n"), F.first(others).alias("_row"), F.bool_or("_bad").alias("_odd"))
    known = F.lit(True)
    if similarity is not None:
        ids = small(similarity.select(F.col("efo_id_2").alias("_id")).dropna().distinct())
        pairs, known = pairs.join(ids, F.col("efo_id") == F.col("_id"), "left"), F.col("_id").isNotNull()
    pairs = pairs.select(*PAIR, *[F.col(f"_row.`{c}`").alias(c) for c in columns if c not in PAIR], "_n", "_odd", known.alias("_known"))
    pair = F.struct(*PAIR)
    first = lambda condition: F.min(F.when(condition, pair))
    counts = {"pairs": F.count("*"), "repeated": F.count_if(F.col("_n") > 1), "odd": F.count_if("_odd"), "lost": F.count_if(~F.col("_known")), "again": first(F.col("_n") > 1), "unknown": first(~F.col("_known"))}
    written, seen = materialise_with(pairs, **counts)
    if seen["repeated"]:
        raise ValueError(f"{seen['repeated']} pairs are repeated, such as {tuple(seen['again'])}")
    if seen["odd"]:
        raise ValueError(f"{BAD_FLAG}, in {seen['odd']} pairs")
    if similarity is not None and seen["lost"] == seen["pairs"]:
        raise ValueError("no trial pair has a disease that the lookup knows" + (f", such as {seen['unknown']['efo_id']}" if seen["lost"] else ""))
    if seen["lost"]:
        warnings.warn(f"{seen['lost']} of {seen['pairs']} trial pairs have a disease that the lookup lacks, such as {seen['unknown']['efo_id']}, and are left out", UnmatchableDiseaseWarning, stacklevel=3)
    return written.filter("_known").select(*[f"`{c}`" for c in columns])


def checked_evidence(evidence: DataFrame, similarity: DataFrame | None, key: str = "source") -> tuple[DataFrame, DataFrame | None]:
    """((key, gene, efo_id, n) of the evidence's distinct rows, written out; unmatchable_report of it), in one pass. Rows whose disease the lookup lacks are warned of, by value of the key."""
    require_columns(evidence, [key, *PAIR], "evidence")
    rows = evidence.groupBy(key, *PAIR).agg(F.count("*").alias("n"))
    if similarity is None:
        return materialise(rows), None
    ids = small(similarity.select(F.col("efo_id_1").alias("_id")).dropna().distinct())
    lost = F.col("efo_id").isNotNull() & F.col("_id").isNull()
    written, seen = materialise_with(rows.join(ids, F.col("efo_id") == F.col("_id"), "left").select(key, *PAIR, "n", lost.alias("lost")), lost=F.count_if("lost"))
    examples = F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.col("lost"), F.col("efo_id")))), 1, 3), ",")
    n, gone = F.sum("n"), F.sum(F.when(F.col("lost"), F.col("n")).otherwise(0))
    report = written.filter("efo_id IS NOT NULL").groupBy(key).agg(n.alias("n_rows"), gone.alias("n_unmatched"), (gone / n).alias("share"), examples.alias("examples"))
    for r in report.filter("n_unmatched > 0").orderBy(key).collect() if seen["lost"] else ():
        warnings.warn(f"{r[key]}: {r['n_unmatched']} of {r['n_rows']} rows ({100 * r['share']:.1f} %) have a disease that the lookup lacks, such as {r['examples']}, and can't match", UnmatchableDiseaseWarning, stacklevel=3)
    return written.select(key, *PAIR, "n"), report


def narrow_lookup(similarity: DataFrame, threshold: float) -> DataFrame:
    """The rows of the lookup at or above the threshold; null and NaN are below."""
    return similarity.filter(at_least(F.col("similarity"), threshold))


def expand_disease_set(ids: DataFrame, similarity: DataFrame, threshold: float) -> DataFrame:
    """The ids and those similar to them; at a threshold of 1 or more, the ids alone."""
    ids = ids.select("efo_id").distinct()
    if threshold >= 1.0:
        return ids
    near = narrow_lookup(similarity, threshold).join(ids, F.col("efo_id_1") == F.col("efo_id"), "left_semi")
    return ids.union(near.select("efo_id_2")).distinct()


def in_universe(df: DataFrame, genes: DataFrame | None) -> DataFrame:
    """Rows of genes in the universe; no universe, or an empty one, filters nothing."""
    if genes is None or genes.isEmpty():
        return df
    return df.join(small(genes.select("gene").distinct()), "gene", "left_semi")


def supporting_pairs(evidence: DataFrame, similarity: DataFrame | None, threshold: float, keys=()) -> DataFrame:
    """Evidence pairs as (keys, gene, efo_id) of the trials that they would support."""
    pairs = evidence.select(*keys, *PAIR).dropna(subset=PAIR).distinct()
    if similarity is None:
        return pairs
    near = narrow_lookup(similarity, threshold).select(F.col("efo_id_1").alias("efo_id"), "efo_id_2")
    return join_dealt(pairs, near, "efo_id").select(*keys, "gene", F.col("efo_id_2").alias("efo_id")).distinct()


def matched_pairs(evidence: DataFrame, trials: DataFrame, similarity: DataFrame | None = None, threshold: float = 0.8, genes: DataFrame | None = None) -> DataFrame:
    """The distinct trial pairs that the evidence supports."""
    wanted = in_universe(trials.select(*PAIR).dropna(), genes)
    return wanted.join(supporting_pairs(evidence, similarity, threshold), PAIR, "left_semi").distinct()


def matched_pairs_audit(evidence: DataFrame, trials: DataFrame, similarity: DataFrame | None = None, threshold: float = 0.8, genes: DataFrame | None = None) -> DataFrame:
    """(gene, ct_efo_id, ge_efo_id, similarity, match_type) of each distinct match."""
    wanted = in_universe(trials.select("gene", F.col("efo_id").alias("ct_efo_id")).dropna().distinct(), genes)
    pairs = evidence.select("gene", F.col("efo_id").alias("ge_efo_id")).dropna().distinct()
    if similarity is None:
        found = wanted.join(pairs.withColumn("ct_efo_id", F.col("ge_efo_id")), ["gene", "ct_efo_id"]).withColumn("similarity", F.lit(1.0))
    else:
        near = narrow_lookup(similarity, threshold).select(F.col("efo_id_1").alias("ge_efo_id"), F.col("efo_id_2").alias("ct_efo_id"), F.col("similarity").cast("double").alias("similarity"))
        found = wanted.join(pairs.join(small(near), "ge_efo_id"), ["gene", "ct_efo_id"])
    kind = F.when(F.col("ct_efo_id") == F.col("ge_efo_id"), "exact").otherwise("similar")
    return found.select("gene", "ct_efo_id", "ge_efo_id", "similarity", kind.alias("match_type")).distinct()


def lookup_violations(similarity: DataFrame, require_diagonal: bool = True) -> DataFrame:
    """(kind, efo_id_1, efo_id_2): pairs without their mirror, terms without themselves, themselves below 1."""
    pairs = similarity.select("efo_id_1", "efo_id_2").distinct()
    mirror = pairs.select(F.col("efo_id_2").alias("efo_id_1"), F.col("efo_id_1").alias("efo_id_2"))
    out = pairs.join(mirror, ["efo_id_1", "efo_id_2"], "left_anti").select(F.lit("mirror").alias("kind"), "efo_id_1", "efo_id_2")
    if not require_diagonal:
        return out
    terms = pairs.select(F.col("efo_id_1").alias("t")).union(pairs.select("efo_id_2")).distinct()
    own = similarity.filter("efo_id_1 = efo_id_2")
    missing = terms.join(own, F.col("t") == F.col("efo_id_1"), "left_anti").select(F.lit("diagonal"), "t", "t")
    weak = own.filter(~at_least(F.col("similarity"), 1.0)).select(F.lit("weak diagonal"), "efo_id_1", "efo_id_2")
    return out.union(missing).union(weak)


def check_similarity_lookup(similarity: DataFrame, require_diagonal: bool = True) -> None:
    """An error that shows some violations, if there are any."""
    if found := lookup_violations(similarity, require_diagonal).orderBy("kind", "efo_id_1", "efo_id_2").limit(5).collect():
        raise ValueError(f"the similarity lookup isn't symmetric with a full diagonal: {[tuple(r) for r in found]}")


def drop_unmatchable(trials: DataFrame, similarity: DataFrame) -> DataFrame:
    """Trials whose disease is in the lookup at any similarity."""
    return trials.join(small(similarity.select(F.col("efo_id_2").alias("efo_id")).distinct()), "efo_id", "left_semi")


def unmatchable_report(evidence: DataFrame, similarity: DataFrame, name: str = "source") -> DataFrame:
    """Per input: rows, rows whose disease the lookup lacks, their share, three examples. Null ids aren't counted."""
    known = small(similarity.select(F.col("efo_id_1").alias("known")).distinct())
    rows = evidence.filter(F.col("efo_id").isNotNull()).join(known, F.col("efo_id") == F.col("known"), "left")
    lost = F.col("known").isNull()
    return rows.groupBy(name).agg(
        F.count("*").alias("n_rows"), F.count_if(lost).alias("n_unmatched"), (F.count_if(lost) / F.count("*")).alias("share"),
        F.array_join(F.slice(F.array_sort(F.collect_set(F.when(lost, F.col("efo_id")))), 1, 3), ",").alias("examples"),
    )


def membership_flags(trials: DataFrame, flags: dict[str, DataFrame]) -> DataFrame:
    """Adds a boolean for each table of pairs: whether it has the trial's pair."""
    for name, pairs in flags.items():
        trials = trials.join(pairs.select(*PAIR).distinct().withColumn(name, F.lit(True)), PAIR, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return trials


def annotate_evidence(trials: DataFrame, target: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Adds has_genetic_evidence; with a baseline, drops the trials that only the baseline supports."""
    if baseline is None:
        return membership_flags(trials, {"has_genetic_evidence": target})
    flagged = membership_flags(trials, {"has_genetic_evidence": target, "has_baseline": baseline})
    return flagged.filter(F.col("has_genetic_evidence") | ~F.col("has_baseline")).drop("has_baseline")


def best_similarity(evidence: DataFrame, trials: DataFrame, similarity: DataFrame, keys=()) -> DataFrame:
    """(keys, gene, efo_id, max_similarity): for each trial pair the best match, once for all thresholds."""
    near = small(similarity.select("efo_id_1", "efo_id_2", F.col("similarity").cast("double").alias("similarity")))
    pairs = evidence.select(*keys, "gene", F.col("efo_id").alias("efo_id_1")).dropna().distinct().join(near, "efo_id_1")
    return pairs.join(trials.select("gene", F.col("efo_id").alias("efo_id_2")).distinct(), ["gene", "efo_id_2"]).groupBy(*keys, "gene", F.col("efo_id_2").alias("efo_id")).agg(F.max("similarity").alias("max_similarity"))
