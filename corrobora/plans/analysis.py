"""Sweeps, strata and composition tables. Arms are values of a key column, so each is one pass over its tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import relative_movement
from ..operators import aggregate as A
from ..operators import enrichment as E
from ..operators import matching as M
from ..sources.evidence import GERMLINE, SOMATIC
from ..storage import bucketed, materialise


def named_union(tables: dict[str, DataFrame], key: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn(key, F.lit(name)) for name, df in tables.items()])


def arm_grid(trials: DataFrame, evidence: DataFrame, similarity: DataFrame | None = None, threshold: float = 0.8) -> DataFrame:
    """Enrichment by trial table (column `trial_table`), evidence source and censoring."""
    return grid_of(Stored(materialise(trials), M.supporting_pairs(evidence, similarity, threshold, ["source"]), evidence.select("source")))


@dataclass
class Stored:
    """Trials, the pairs (keys, gene, efo_id) that arms of evidence support, and the keys of all arms. As store() gives them, trials and pairs lie in buckets of (gene, efo_id), so each analysis of them joins without moving rows."""

    trials: DataFrame
    supported: DataFrame
    arms: DataFrame


def store(trials: DataFrame, evidence: DataFrame, keys: list[str], similarity: DataFrame | None = None, threshold: float = 0.8, buckets: int | None = None) -> Stored:
    """Writes what sweeps and arms start from, once for all of them."""
    return Stored(bucketed(trials, M.PAIR, buckets), bucketed(M.supporting_pairs(evidence, similarity, threshold, keys), M.PAIR, buckets), materialise(evidence.select(*keys).distinct()))


def grid_of(stored: Stored) -> DataFrame:
    """arm_grid of stored tables with the key `source`."""
    return E.with_ratios(E.counts_by_arm(stored.trials, stored.supported, ["source"], arms=stored.arms, within=["trial_table"], censorings=True))


def arms_of(stored: Stored) -> DataFrame:
    """Counts and ratios of each arm of stored tables."""
    return E.with_ratios(E.counts_by_arm(stored.trials, stored.supported, stored.arms.columns, arms=stored.arms))


def published_gap(own: DataFrame, published: DataFrame, on: str = "transition") -> DataFrame:
    """Adds published_rr and the relative gap of rr to it."""
    return own.join(published.select(on, F.col("rr").alias("published_rr")), on).withColumn("gap", relative_movement(F.col("published_rr"), F.col("rr")))


def pivot_metric(df: DataFrame, rows: list[str], arm: str, arms: list[str], metric: str) -> DataFrame:
    """A column of the metric for each arm, and the movement from the first to the last."""
    wide = df.groupBy(*rows).pivot(arm, arms).agg(F.first(metric))
    return wide.withColumn("movement", relative_movement(F.col(f"`{arms[0]}`"), F.col(f"`{arms[-1]}`")))


def interval_widening(boot: DataFrame, closed: DataFrame, keys: list[str]) -> DataFrame:
    """log width of the bootstrap's interval over that of the closed form."""
    width = lambda a, b: F.ln(F.col(b)) - F.ln(F.col(a))
    return boot.join(closed, keys).withColumn("widening", F.try_divide(width("rr_boot_lower", "rr_boot_upper"), width("rr_lower", "rr_upper")))


def evidence_scope(associations: DataFrame) -> DataFrame:
    """Evidence under each scope: germline, and germline with somatic. associations: (gene, efo_id, datasource)."""
    scope = F.when(F.col("datasource").isin(*GERMLINE), F.array(F.lit("germline"), F.lit("with somatic"))).when(F.col("datasource").isin(*SOMATIC), F.array(F.lit("with somatic")))
    return associations.withColumn("source", F.explode(scope)).select("source", "gene", "efo_id").distinct()


def rebuild(gene_drug: dict[str, DataFrame], drug_indication: dict[str, DataFrame], names: list[str], synonyms: DataFrame | None = None, wanted=A.TABLES) -> dict[str, DataFrame]:
    """The aggregate of some sources alone: filtering a combined table would keep the others' phases. Synonyms count only with their own source."""
    if missing := [n for n in names if n not in gene_drug and n not in drug_indication]:
        raise ValueError(f"no leg of {missing}")
    pick = lambda legs: {n: df for n, df in legs.items() if n in names}
    return A.aggregate_trials(pick(gene_drug), pick(drug_indication), synonyms if "dgidb" in names and "dgidb" in gene_drug else None, wanted=wanted)


def coverage(pairs: DataFrame, genes: DataFrame, key: str = "source") -> DataFrame:
    """Distinct pairs, genes and diseases by source, in all and within the gene universe."""
    inside = genes.select("gene").distinct().withColumn("_in", F.lit(True))
    rows = pairs.join(inside, "gene", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    own = lambda *c: F.count_distinct(*c)
    within = lambda c: F.when(F.col("_in"), c)
    pair = F.struct("gene", "efo_id")
    return rows.groupBy(key).agg(own(pair).alias("pairs"), own("gene").alias("genes"), own("efo_id").alias("diseases"), own(within(pair)).alias("pairs_in"), own(within(F.col("gene"))).alias("genes_in"), own(within(F.col("efo_id"))).alias("diseases_in"))


def gene_drug_profile(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source").agg(F.count("*").alias("edges"), F.count_distinct("gene").alias("genes"), F.count_distinct("our_drug_id").alias("drugs"), F.count_distinct(F.when(F.col("action_type").isNotNull(), F.col("our_drug_id"))).alias("drugs_with_action"))


def drug_indication_profile(records: DataFrame) -> DataFrame:
    open_ = (F.col("phase") < 4) & (F.coalesce("phase_concluded", F.lit(0)) < F.col("phase"))
    return records.groupBy("source").agg(F.count("*").alias("records"), F.count_distinct("our_drug_id").alias("drugs"), F.count_distinct("efo_id").alias("diseases"), F.count_if(open_).alias("undetermined"), *[F.count_if(F.col("phase") == p).alias(f"phase_{p}") for p in range(1, 5)])


def pair_phase_profile(trials: DataFrame, arm: str) -> DataFrame:
    return trials.groupBy(arm).agg(F.count("*").alias("pairs"), *[F.count_if(F.col("max_phase") == p).alias(f"phase_{p}") for p in range(1, 5)], F.count_if("is_ongoing").alias("ongoing"))


def pair_coverage_by_source(trials: DataFrame, column: str = "drug_indication_sources") -> DataFrame:
    """Pairs, genes and diseases that each source contributed to, by its name in the joined set."""
    rows = trials.withColumn("source", F.explode(F.split(column, "&")))
    return rows.groupBy("source").agg(F.count_distinct("gene", "efo_id").alias("pairs"), F.count_distinct("gene").alias("genes"), F.count_distinct("efo_id").alias("diseases"))


def source_intersections(df: DataFrame, column: str = "source", top: int = 10) -> DataFrame:
    """(kind, name, n): the top combinations of sources, the size of each source over all combinations, and the rows of combinations that aren't shown."""
    combos = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    shown = combos.orderBy(F.desc("count"), column).limit(top)
    members = combos.withColumn("name", F.explode(F.split(column, "&"))).groupBy("name").agg(F.sum("count").alias("n"))
    hidden = combos.join(shown.select(column), column, "left_anti").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    return shown.select(F.lit("combination").alias("kind"), F.col(column).alias("name"), F.col("count").alias("n")).union(members.select(F.lit("member"), "name", "n")).union(hidden.select(F.lit("not shown"), F.lit(None).cast("string"), "n"))


def with_thresholds(df: DataFrame, score: str, thresholds) -> DataFrame:
    """df once for each threshold that its score reaches."""
    reached = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.coalesce(F.col(score).cast("double") >= t, F.lit(False)))
    return df.withColumn("threshold", F.explode(reached))


def datasource_sweep(associations: DataFrame, thresholds=(0.0, 0.25, 0.5, 0.75)) -> DataFrame:
    """(datasource, threshold, gene, efo_id): evidence by datasource and threshold, and pooled as `overall`."""
    rows = with_thresholds(associations.filter(F.col("score").isNotNull()), "score", thresholds)
    names = F.explode(F.array(F.col("datasource"), F.lit("overall")))
    return rows.select(names.alias("datasource"), "threshold", "gene", "efo_id").distinct()


def pooled_sweep(associations: DataFrame, thresholds=(0.0, 0.25, 0.5, 0.75)) -> DataFrame:
    """(threshold, gene, efo_id) by each pair's best score."""
    best = associations.groupBy("gene", "efo_id").agg(F.max("score").alias("score"))
    return with_thresholds(best, "score", thresholds).select("threshold", "gene", "efo_id")


def enrich_arms(trials: DataFrame, evidence: DataFrame, keys: list[str], similarity: DataFrame | None = None, threshold: float = 0.8) -> DataFrame:
    """Counts and ratios of each arm of the evidence (keys: scope, datasource and threshold, ...), in one pass over the trials; an arm that supports no trial has its row too."""
    trials, evidence = materialise(trials), materialise(evidence.select(*keys, *M.PAIR).distinct())  # each is read more than once
    return E.with_ratios(E.counts_by_arm(trials, M.supporting_pairs(evidence, similarity, threshold, keys), keys, arms=evidence.select(*keys)))


def similarity_sweep(trials: DataFrame, evidence: DataFrame, similarity: DataFrame, thresholds=(0.5, 0.6, 0.7, 0.8, 0.9, 1.0)) -> DataFrame:
    """Counts and ratios by similarity threshold: the best match of each pair is found once, then held against all."""
    best = M.best_similarity(evidence, trials, similarity)
    rows = trials.join(best, ["gene", "efo_id"], "left").withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    rows = rows.withColumn("has_genetic_evidence", F.coalesce(F.col("max_similarity") >= F.col("threshold"), F.lit(False)))
    return E.with_ratios(E.transition_counts(rows, keys=["threshold"]))


def stratified(flagged: DataFrame, branch: DataFrame, name: str = "stratum") -> DataFrame:
    """Counts and ratios with and without the diseases of a branch (id)."""
    inside = branch.select(F.col("id").alias("efo_id")).distinct().withColumn("_in", F.lit(True))
    rows = flagged.join(inside, "efo_id", "left").withColumn(name, F.when(F.col("_in"), F.lit("with")).otherwise(F.lit("without")))
    return E.with_ratios(E.transition_counts(rows, keys=[name]))


def crosswalked_branch(branch: DataFrame, crosswalk: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(id) of a branch and of the diseases that the crosswalk (mesh_id, efo_id) has for descriptors (id)."""
    targets = crosswalk.join(descriptors.select(F.col("id").alias("mesh_id")), "mesh_id", "left_semi").select(F.col("efo_id").alias("id"))
    return branch.select("id").union(targets).dropna().distinct()


def overlapping_strata(flagged: DataFrame, branch: DataFrame, name: str = "stratum", descriptors: DataFrame | None = None) -> DataFrame:
    """Counts and ratios of all rows ("with") and of those outside a branch (id) of diseases ("without"). With descriptors (id), rows whose mesh_id is among them are inside too."""
    inside = branch.select(F.col("id").alias("efo_id")).distinct().withColumn("_in", F.lit(True))
    rows = flagged.join(inside, "efo_id", "left")
    if descriptors is not None:
        rows = rows.join(descriptors.select(F.col("id").alias("mesh_id")).distinct().withColumn("_by", F.lit(True)), "mesh_id", "left").withColumn("_in", F.coalesce("_in", "_by"))
    strata = F.when(F.col("_in"), F.array(F.lit("with"))).otherwise(F.array(F.lit("with"), F.lit("without")))
    rows = rows.withColumn(name, F.explode(strata))
    return E.with_ratios(E.transition_counts(rows, keys=[name]))


#: The prior art's published cell, from I to approval: x_yes, n_yes, x_no, n_no; and its pairs by phase. Fixed values.
PUBLISHED_COUNTS = (242, 742, 4322, 36635)
PUBLISHED_PHASES = {1: 6163, 2: 14410, 3: 12240, 4: 4564}


def prior_art_trials(trials: DataFrame, branch: DataFrame) -> DataFrame:
    """Trials as the prior art has them: uncensored, without the diseases of a branch (id)."""
    return trials.join(branch.select(F.col("id").alias("efo_id")).distinct(), "efo_id", "left_anti").withColumn("is_ongoing", F.lit(False))


def prior_art(trials: DataFrame, evidence: DataFrame, branch: DataFrame, key: str | None = None) -> DataFrame:
    """Exact matching on the prior art's trials: counts and ratios, of each arm of the evidence if it has a column `key`."""
    rest = prior_art_trials(trials, branch)
    if key:
        return enrich_arms(rest, evidence, [key])
    return E.with_ratios(E.transition_counts(M.annotate_evidence(rest, M.matched_pairs(evidence, rest))))


def prior_art_evidence(credible: DataFrame, direct: DataFrame, combined: DataFrame, least: float = 0.5) -> DataFrame:
    """(targets, gene, efo_id) of the three arms: propagated credible sets and direct germline associations (gene, efo_id, score) from a score on, and the combined evidence (gene, efo_id)."""
    from ..functions.text import at_least

    strong = lambda df: df.filter(at_least(F.col("score"), least))
    arms = {"credible sets": strong(credible), "direct": strong(direct), "combined": combined}
    return named_union({n: df.select("gene", "efo_id").dropna().distinct() for n, df in arms.items()}, "targets").select("targets", "gene", "efo_id")


def with_published(counts: DataFrame, published: tuple[int, int, int, int] = PUBLISHED_COUNTS, label: str = "published", key: str = "targets") -> DataFrame:
    """Counts by arm (key) from I to approval with ratios, and the published counts as one more arm, through the same estimators."""
    names = ["x_yes", "n_yes", "x_no", "n_no"]
    own = counts.filter("phase_from = 1 AND phase_to = 4").select(F.col(key).cast("string").alias(key), "phase_from", "phase_to", *[F.col(c).cast("long").alias(c) for c in names])
    row = counts.sparkSession.createDataFrame([(label, 1, 4, *published)], own.schema)
    return E.with_ratios(own.unionByName(row))


def composition_ratio(trials: DataFrame, published: DataFrame) -> DataFrame:
    """(max_phase, n, published_n, ratio) of shares by phase."""
    own = trials.groupBy("max_phase").agg(F.count("*").alias("n"))
    totals = own.agg(F.sum("n")).first()[0] or 0, published.agg(F.sum("published_n")).first()[0] or 0
    share = lambda c, t: F.col(c) / F.lit(float(t)) if t else F.lit(None).cast("double")
    return own.join(published, "max_phase").withColumn("ratio", F.try_divide(share("n", totals[0]), share("published_n", totals[1])))
