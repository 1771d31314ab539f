"""Genetic evidence feeds into (gene, efo_id, ...) tables. `release` gives (replacements, obsolete) for obsolete disease ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.ontology import remap
from ..storage import materialise, small

# Datasources by kind: fixed values of the feed.
GERMLINE = ("gwas_credible_sets", "eva", "gene_burden", "genomics_england", "gene2phenotype", "clingen", "uniprot_variants", "uniprot_literature", "orphanet")
SOMATIC = ("eva_somatic", "intogen")
# Terms that a variant must have: fixed values of the feed.
PATHOGENIC = ("Pathogenic", "Likely_pathogenic", "Pathogenic/Likely_pathogenic")
REVIEWED = ("criteria_provided,_multiple_submitters,_no_conflicts", "reviewed_by_expert_panel", "practice_guideline")
NOT_CAUSAL = r"(?i)somatic|susceptibility|response|\?"


def current(df: DataFrame, release, **more) -> DataFrame:
    return df if release is None else remap(df, *release, **more)


def normalize_gwas(raw: DataFrame, max_p: float = 5e-8, release=None) -> DataFrame:
    """(gene, efo_id, trait, p_value, source) of hits with one trait, one row per gene and disease, of the least p-value."""
    rows = raw.select(F.col("`P-VALUE`").cast("double").alias("p_value"), F.col("MAPPED_GENE").alias("genes"), F.col("MAPPED_TRAIT").alias("trait"), F.col("MAPPED_TRAIT_URI").alias("uri"))
    rows = rows.filter(X.strict(F.col("p_value"), max_p)).dropna(subset=["genes", "trait", "uri"]).filter(F.size(F.split("uri", ",")) == 1)
    segment = X.last_path_segment(F.trim("uri"))
    pairs = rows.select(F.explode(X.split_genes(F.col("genes"))).alias("gene"), X.first_underscore_to_colon(segment).alias("efo_id"), "trait", "p_value")
    pairs = current(pairs, release).dropna(subset=["efo_id"])
    return pairs.groupBy("gene", "efo_id").agg(X.first_nonnull(F.col("trait"), F.col("p_value")).alias("trait"), F.min("p_value").alias("p_value")).withColumn("source", F.lit("GWAS Catalog"))


def read_associations(raw: DataFrame) -> DataFrame:
    """(datasource, target, disease, score) of either layout."""
    old = ("datasourceId", "targetId", "diseaseId", "score")
    new = ("aggregationValue", "targetId", "diseaseId", "associationScore")
    return raw.select(*(new if "aggregationValue" in raw.columns else old)).toDF("datasource", "target", "disease", "score")


def normalize_associations(raw: DataFrame, targets: DataFrame, min_score: float = 0.5, somatic: bool = False, release=None) -> DataFrame:
    """(gene, efo_id, ot_score, source): the best score over the kept datasources, all of which are named, whatever their own scores."""
    rows = read_associations(raw).filter(F.col("datasource").isin(*GERMLINE, *(SOMATIC if somatic else ())))
    best = rows.groupBy("target", "disease").agg(F.max(F.when(~F.isnan("score"), F.col("score"))).alias("ot_score"), X.string_set(F.col("datasource")).alias("source"))
    symbols = small(targets.select(F.col("id").alias("target"), F.col("approvedSymbol").alias("gene")).dropna())
    pairs = best.filter(X.at_least(F.col("ot_score"), min_score)).join(symbols, "target").select("gene", X.all_underscores_to_colon(F.col("disease")).alias("efo_id"), "ot_score", "source")
    return dedup_keep_best(current(pairs, release), ["gene", "efo_id"], F.desc("ot_score"))


def dedup_keep_best(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key, first in the order; ties go by all other columns."""
    rest = [F.col(c) for c in df.columns if c not in keys]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))).filter("_n = 1").drop("_n")


def normalize_burden(raw: DataFrame, manifest: DataFrame, max_p: float = 1e-7, release=None) -> DataFrame:
    """(gene, efo_id, trait, p_value, source): hits joined to the manifest by phenocode and coding, null equal to null."""
    hits = raw.filter(X.strict(F.col("Pvalue"), max_p)).select(F.col("gene_symbol").alias("gene"), "phenocode", "coding_description", F.col("description").alias("own"), F.col("Pvalue").alias("p_value"))
    traits = manifest.select(F.col("phenocode").alias("code"), F.col("coding_description").alias("coding"), F.explode(X.split_trim(F.col("trait_efos"), ",")).alias("efo"), F.col("description").alias("named"))
    same = (F.col("phenocode") == F.col("code")) & F.col("coding_description").eqNullSafe(F.col("coding"))
    pairs = hits.join(traits, same).select("gene", X.first_underscore_to_colon(F.col("efo")).alias("efo_id"), F.coalesce("named", "own").alias("trait"), "p_value")
    pairs = current(pairs, release).filter(F.trim("gene") != "").dropna(subset=["efo_id"])
    return pairs.groupBy("gene", "efo_id").agg(X.first_nonnull(F.col("trait"), F.col("p_value")).alias("trait"), F.min("p_value").alias("p_value")).withColumn("source", F.lit("Genebass"))


def gene_universe(targets: DataFrame) -> DataFrame:
    """(gene): symbols of protein-coding targets."""
    return targets.filter("biotype = 'protein_coding'").select(F.col("approvedSymbol").alias("gene")).dropna().distinct()


def variant_conditions(variants: DataFrame) -> DataFrame:
    """(gene, gene_id, condition, xrefs) of pathogenic, well-reviewed variants, one row for each gene, condition and variant; all conditions of a variant share its cross-references."""
    terms = lambda c, sep: F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")
    has = lambda c, wanted: F.coalesce(F.arrays_overlap(c, F.array(*[F.lit(x) for x in wanted])), F.lit(False))
    kept = variants.filter(has(terms(F.col("clnsig"), r"[|,]"), PATHOGENIC) & has(terms(F.col("clnrevstat"), r"\|"), REVIEWED))
    genes = kept.select(F.explode(X.gene_info_pairs(F.col("geneinfo"))).alias("g"), "clndn", "clndisdb")
    rows = genes.select(F.trim("g.symbol").alias("gene"), F.trim("g.id").alias("gene_id"), F.explode(X.split_trim(F.col("clndn"), r"\|")).alias("condition"), F.col("clndisdb").alias("xrefs")).filter("gene <> ''")
    return rows.filter(F.coalesce(~F.col("condition").rlike(NOT_CAUSAL), F.lit(True)))


def map_conditions(rows: DataFrame, live: DataFrame, mesh_map: DataFrame, crosswalk: DataFrame, cached: DataFrame) -> DataFrame:
    """(condition, efo_id, ontology), by tier: cross-references of the rows, a crosswalk of names, a cached search; a condition goes on only if no earlier tier has it.

    live: (id). mesh_map: (mesh_id, efo_id). crosswalk: (condition, ontology, efo_id). cached: (condition, efo_id).
    """
    rank = {"MONDO:": ("MONDO", 1), "Orphanet:": ("ORDO", 2), "MeSH:": ("MESH", 3), "HP:": ("HP", 4)}
    distinct = rows.select("condition", "xrefs").distinct()

    def of(prefix: str):
        name, place = rank[prefix]
        return F.transform(X.xrefs(F.coalesce("xrefs", F.lit("")), prefix), lambda x: F.struct(F.lit(place).alias("rank"), F.lit(name).alias("ontology"), x.alias("ref")))

    refs = F.concat(*[of(p) for p in X.XREF_PREFIXES])
    each = distinct.select("condition", "xrefs", F.explode(refs).alias("r")).select("condition", "xrefs", "r.*")
    direct = each.filter("ontology <> 'MESH'").join(small(live.select(F.col("id").alias("ref"))), "ref", "left_semi").withColumn("efo_id", F.col("ref"))
    by_mesh = each.filter("ontology = 'MESH'").join(small(mesh_map.select(F.concat(F.lit("MeSH:"), "mesh_id").alias("ref"), "efo_id")), "ref")
    hits = direct.select("condition", "xrefs", "rank", "ontology", "efo_id").union(by_mesh.select("condition", "xrefs", "rank", "ontology", "efo_id"))
    first = hits.groupBy("condition", "xrefs").agg(F.min("rank").alias("best"))
    tier1 = materialise(hits.join(first, ["condition", "xrefs"]).filter("rank = best").groupBy("condition", "efo_id").agg(F.min_by("ontology", "rank").alias("ontology")))
    left = distinct.select("condition").distinct().join(tier1, "condition", "left_anti")
    order = X.map_case(F.col("ontology"), {"MONDO": 1, "ORDO": 2, "MESH": 3, "HP": 4}, F.lit(9))
    cross = left.join(crosswalk.withColumn("rank", order), "condition")
    best = cross.groupBy("condition").agg(F.min("rank").alias("best"))
    tier2 = cross.join(best, "condition").filter("rank = best").select("condition", "efo_id", "ontology").distinct()
    tier3 = left.join(tier2, "condition", "left_anti").join(cached, "condition").select("condition", "efo_id", F.lit("search").alias("ontology")).distinct()
    return tier1.unionByName(tier2).unionByName(tier3)


def normalize_clinvar(variants: DataFrame, live: DataFrame, mesh_map: DataFrame, crosswalk: DataFrame, cached: DataFrame, release=None, max_diseases: int = 10) -> DataFrame:
    """(gene, efo_id, gene_id, n_variants, trait, ontology, source); conditions with more than max_diseases diseases are left out."""
    rows = materialise(variant_conditions(variants))
    mapped = current(map_conditions(rows, live, mesh_map, crosswalk, cached), release)
    many = mapped.groupBy("condition").agg(F.count_distinct("efo_id").alias("n")).filter(F.col("n") > max_diseases)
    mapped = mapped.join(many, "condition", "left_anti")
    counts = rows.groupBy("gene", "condition").agg(F.min("gene_id").alias("gene_id"), F.count("*").alias("n"))
    pairs = counts.join(mapped, "condition")
    return pairs.groupBy("gene", "efo_id").agg(F.min("gene_id").alias("gene_id"), F.sum("n").alias("n_variants"), F.min("condition").alias("trait"), F.min("ontology").alias("ontology")).withColumn("source", F.lit("ClinVar"))


def normalize_published(raw: DataFrame, crosswalk: DataFrame, release=None, min_share: float = 0.5, somatic: str = "intOGen") -> DataFrame:
    """(gene, efo_id, source): pairs with the set of their sources; without the somatic one, and with a share that is null or high enough. crosswalk: (mesh_id, efo_id)."""
    kept = raw.dropna(subset=["gene", "mesh_id"]).filter(F.coalesce(F.col("source") != somatic, F.lit(True)) & (F.col("l2g_share").isNull() | X.at_least(F.col("l2g_share"), min_share)))
    pairs = current(kept.join(small(crosswalk), "mesh_id").select("gene", "efo_id", "source"), release)
    return pairs.groupBy("gene", "efo_id").agg(X.string_set(F.col("source")).alias("source"))
