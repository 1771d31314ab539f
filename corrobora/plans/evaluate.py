"""From trials, evidence and a similarity lookup to enrichment, for many sources in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import enrichment as E
from ..operators import matching as M
from ..sources.scans import scan
from ..storage import materialise


@dataclass
class Evaluation:
    """enrichment: by source and transition. trials and pairs: the annotated trials and the audit of matches, each with the source. report: evidence that the lookup can't match."""

    enrichment: DataFrame
    trials: DataFrame
    pairs: DataFrame
    report: DataFrame | None


def evaluate(
    trials: DataFrame | str,
    evidence: DataFrame | str,
    similarity: DataFrame | str | None = None,
    baseline: DataFrame | str | None = None,
    genes: DataFrame | str | None = None,
    threshold: float = 0.8,
    transitions=E.TRANSITIONS,
    cluster: str | None = None,
    replicates: int = B.REPLICATES,
    seed: int = 0,
    check_similarity: bool = False,
    key: str = "source",
    hashed: bool = False,
) -> Evaluation:
    """Enrichment of each source of the evidence (column `key`), also of one that supports no trial. With a baseline, trials that it alone supports are left out. Inputs are frames or Parquet paths. hashed: bootstrap draws that other engines repeat."""
    spark = SparkSession.active()
    trials, evidence, similarity, baseline, genes = (None if x is None else scan(spark, x) for x in (trials, evidence, similarity, baseline, genes))
    M.require_columns(evidence, [key, *M.PAIR], "evidence")
    M.require_columns(trials, [*M.PAIR, "max_phase"], "clinical trials")
    if cluster and cluster not in trials.columns:
        raise ValueError(f"no column {cluster} to resample by")
    if similarity is not None:
        M.require_columns(similarity, ["efo_id_1", "efo_id_2", "similarity"], "similarity lookup")
        if check_similarity:
            M.check_similarity_lookup(similarity)
        similarity = materialise(similarity)
    base = M.checked_trials(trials, similarity)  # checks, and every arm, start from what is written out
    evidence, report = M.checked_evidence(evidence, similarity, key)
    if genes is not None:
        base = base.join(genes.select("gene").distinct(), "gene", "left_semi").select(*base.columns)
    sources = sorted(r[0] for r in evidence.select(key).distinct().collect())  # names of arms
    supported = M.supporting_pairs(evidence, similarity, threshold, [key])
    flagged = E.flag_sources(base, supported, sources, key)
    own = None
    if baseline is not None:
        own = M.supporting_pairs(baseline, similarity, threshold)
        flagged = M.membership_flags(flagged, {"_base": own}).filter(F.col("has_genetic_evidence") | ~F.col("_base")).drop("_base")
    counts = materialise(E.counts_by_arm(base, supported, [key], transitions, evidence.select(key), without=own))  # a few rows, which tests read twice
    result = E.tested(counts, [key])
    if cluster:
        result = result.join(B.bootstrap(flagged, cluster, replicates, seed, transitions=transitions, keys=[key], hashed=hashed, warn=True), [key, "phase_from", "phase_to"])
    return Evaluation(result, flagged, audit(evidence, base, similarity, threshold, key), report)


def audit(evidence: DataFrame, trials: DataFrame, similarity: DataFrame | None, threshold: float, key: str = "source") -> DataFrame:
    """(key, gene, ct_efo_id, ge_efo_id, similarity, match_type) of all matches."""
    pairs = evidence.select(key, *M.PAIR).distinct()
    found = M.matched_pairs_audit(pairs, trials, similarity, threshold)
    return pairs.join(found.withColumnRenamed("ge_efo_id", "efo_id"), M.PAIR).select(key, "gene", "ct_efo_id", F.col("efo_id").alias("ge_efo_id"), "similarity", "match_type")
