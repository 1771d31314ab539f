"""Many sources into one row per pair: gene-drug edges, drug-indication records, gene-indication pairs, evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_nonnull, normalize_name, not_blank, split_set, string_set
from ..sources import scans
from ..storage import materialise
from . import entities

#: By source: the identifier that joins it to drugs, and its display name. Fixed by the domain.
JOIN_KEYS = {"chembl": "chembl_id", "trialpanorama": "drug_name_normalized", "stitch": "stitch_id", "dgidb": "drug_name_normalized", "opentargets": "chembl_id"}
DISPLAY_NAMES = {"chembl": "ChEMBL", "trialpanorama": "TrialPanorama", "stitch": "STITCH", "dgidb": "DGIdb", "opentargets": "OpenTargets"}
#: Indications of these carry no trial status; the drugs still take part in clustering.
EXCLUDED_INDICATIONS = ("chembl",)
UNKNOWN_STATUSES = ("UNKNOWN", "Unknown status")
SCORES = ("pchembl", "stitch_score", "dgidb_interaction_score", "dgidb_drug_specificity_score", "dgidb_gene_specificity_score", "dgidb_evidence_score")


def with_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df cut to the named columns, those that it lacks null."""
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in names.items()])


def join_key(df: DataFrame, kind: str) -> Column:
    """A source's identifier of one kind; null if blank."""
    if kind == "drug_name_normalized":
        return normalize_name(F.col("drug_name"))
    return F.when(F.trim(kind) != "", F.col(kind))


def by_identifier(df: DataFrame, kind: str, members: DataFrame) -> DataFrame:
    """Rows with our_drug_id, by one kind of identifier; rows without it are dropped."""
    own = members.filter(F.col("id_type") == kind).select("id_value", "our_drug_id")
    return df.withColumn("id_value", join_key(df, kind)).filter(F.col("id_value").isNotNull()).join(own, "id_value").drop("id_value")


def gene_drug_records(legs: dict[str, DataFrame], members: DataFrame) -> DataFrame:
    """All sources' edges under one schema, with genes and drugs known."""
    names = {"gene": "string", "subsource": "string", "action_type": "string", "drug_name": "string", "chembl_id": "string", "drugbank_id": "string", "stitch_id": "string", "molecule_type": "string"} | dict.fromkeys(SCORES, "double")
    parts = [by_identifier(with_columns(df, names), JOIN_KEYS[s], members).filter(not_blank(F.col("gene"))).withColumn("source", F.lit(DISPLAY_NAMES[s])) for s, df in legs.items()]
    return reduce(DataFrame.unionByName, parts)


def gene_drug_mapping(records: DataFrame) -> DataFrame:
    """One row per (gene, drug); all of several action types are kept."""
    sets = [string_set(F.col(c)).alias(c) for c in ("source", "subsource", "action_type")]
    least = [F.min(c).alias(c) for c in ("drug_name", "chembl_id", "drugbank_id", "stitch_id", "molecule_type")]
    return records.groupBy("gene", "our_drug_id").agg(*sets, *least, *[F.max(c).alias(c) for c in SCORES])


def gene_drug_by_source(records: DataFrame) -> DataFrame:
    return records.groupBy("gene", "our_drug_id", "source").agg(string_set(F.col("subsource")).alias("subsource"), string_set(F.col("action_type")).alias("action_type"))


def drug_indication_records(legs: dict[str, DataFrame], members: DataFrame, unknown_ongoing: bool = False) -> DataFrame:
    """All sources' indications with a disease. unknown_ongoing: an unknown status counts as not concluded."""
    names = {"drug_name": "string", "chembl_id": "string", "stitch_id": "string", "mesh_id": "string", "mesh_heading": "string", "efo_id": "string", "efo_term": "string", "phase": "int", "subsource": "string", "study_ids": "string", "is_concluded": "boolean", "status": "string", "references": "string"}
    parts = [by_identifier(with_columns(df, names), JOIN_KEYS[s], members).withColumn("source", F.lit(DISPLAY_NAMES[s])) for s, df in legs.items()]
    out = reduce(DataFrame.unionByName, parts).filter(F.col("efo_id").isNotNull())
    return out.withColumn("is_concluded", unknown_as_ongoing(F.col("status"), F.col("is_concluded"))) if unknown_ongoing else out


def unknown_as_ongoing(status: Column, concluded: Column) -> Column:
    return F.when(status.isin(*UNKNOWN_STATUSES), F.lit(False)).otherwise(concluded)


def concluded_phase() -> Column:
    """Aggregate: the highest phase of records that are concluded or don't say."""
    return F.max(F.when(F.coalesce("is_concluded", F.lit(True)), F.col("phase")))


def drug_indication_mapping(records: DataFrame) -> DataFrame:
    """One row per (drug, disease); mesh id and heading come from one record."""
    paired = F.min(F.when(F.col("mesh_id").isNotNull(), F.struct("mesh_id", "mesh_heading")))
    out = records.groupBy("our_drug_id", "efo_id").agg(
        paired.alias("_m"), F.min("efo_term").alias("efo_term"), F.max("phase").alias("phase"), concluded_phase().alias("phase_concluded"),
        string_set(F.col("source")).alias("source"), string_set(F.col("subsource")).alias("subsource"), F.min("references").alias("references"), string_set(F.col("study_ids"), "|").alias("study_ids"),
    )
    return out.select("our_drug_id", "efo_id", "_m.mesh_id", "_m.mesh_heading", *[c for c in out.columns if c not in ("our_drug_id", "efo_id", "_m")])


def drug_indication_by_source(records: DataFrame) -> DataFrame:
    return records.groupBy("our_drug_id", "efo_id", "source").agg(F.max("phase").alias("phase"), concluded_phase().alias("phase_concluded"), string_set(F.col("subsource")).alias("subsource"))


def is_ongoing(phase: str = "phase", concluded: str = "phase_concluded") -> Column:
    """Aggregate: nothing is concluded at the highest phase, and that isn't approval."""
    return F.coalesce(F.max(phase) < 4, F.lit(True)) & F.coalesce(F.max(concluded) < F.max(phase), F.lit(True))


def gene_indication_max_phase(gene_drug: DataFrame, drug_indication: DataFrame) -> DataFrame:
    """One row per (gene, disease) over all drugs that link them; the sets of sources are united in the same pass."""
    scores = [c for c in ("pchembl", "stitch_score") if c in gene_drug.columns]
    texts = [c for c in ("mesh_id", "mesh_heading", "efo_term") if c in drug_indication.columns]
    edges = gene_drug.select("gene", "our_drug_id", F.col("source").alias("source_gd"), *scores)
    records = drug_indication.select("our_drug_id", "efo_id", "phase", "phase_concluded", F.col("source").alias("source_di"), *texts)
    return edges.join(records, "our_drug_id").groupBy("gene", "efo_id").agg(
        *[F.min(c).alias(c) for c in texts], F.max("phase").alias("max_phase"), F.max("phase_concluded").alias("max_phase_concluded"), is_ongoing().alias("is_ongoing"),
        split_set(F.col("source_gd")).alias("gene_drug_sources"), split_set(F.col("source_di")).alias("drug_indication_sources"), *[F.max(c).alias(c) for c in scores],
    )


def drug_records(gene_drug: dict[str, DataFrame], drug_indication: dict[str, DataFrame]) -> DataFrame:
    """All records of all legs that name a drug, with normalised names: the input of clustering."""
    names = dict.fromkeys(("drug_name", "chembl_id", "drugbank_id", "stitch_id", *entities.METADATA_COLUMNS), "string")
    parts = [with_columns(df, names).withColumn("source", F.lit(DISPLAY_NAMES[s])) for legs in (gene_drug, drug_indication) for s, df in legs.items()]
    out = reduce(DataFrame.unionByName, parts).distinct().withColumn("drug_name_normalized", normalize_name(F.col("drug_name")))
    return out.withColumn("record_id", F.xxhash64(*out.columns))


#: The tables of aggregate_trials.
TABLES = ("drug_id_mapping", "gene_drug_mapping", "gene_drug_mapping_by_source", "drug_indication_mapping", "drug_indication_mapping_by_source", "gene_indication_max_phase")


def aggregate_trials(gene_drug: dict[str, DataFrame], drug_indication: dict[str, DataFrame], synonyms: DataFrame | None = None, unknown_ongoing: bool = False, wanted=TABLES) -> dict[str, DataFrame]:
    """The wanted ones of the six tables. What none of them needs isn't computed, and only what several need is written first. A source whose indications are excluded still takes part in clustering. An unknown source is an error."""
    if unknown := (gene_drug.keys() | drug_indication.keys()) - JOIN_KEYS.keys():
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    if unknown := set(wanted) - set(TABLES):
        raise ValueError(f"unknown tables: {sorted(unknown)}")

    def shared(df: DataFrame, *users: bool) -> DataFrame:
        return materialise(df) if sum(users) > 1 else df

    ids, mapped, edged, indicated, recorded, paired = (name in wanted for name in TABLES)
    edges_needed, records_needed = mapped or edged or paired, indicated or recorded or paired
    # Read for the identifiers' edges, for the identifiers, and for the records: distinct once.
    drugs = materialise(drug_records(gene_drug, drug_indication))
    out = {"drug_id_mapping": entities.representatives(entities.connected_entities(drugs, synonyms=synonyms))} if ids else {}
    if edges_needed or records_needed:
        members = materialise(entities.membership(drugs, synonyms=synonyms))
    if edges_needed:
        edges = shared(gene_drug_records(gene_drug, members), mapped or paired, edged)
        gene_drugs = shared(gene_drug_mapping(edges), mapped, paired)
        out |= {"gene_drug_mapping": gene_drugs, "gene_drug_mapping_by_source": gene_drug_by_source(edges)}
    if records_needed:
        records = shared(drug_indication_records({s: d for s, d in drug_indication.items() if s not in EXCLUDED_INDICATIONS}, members, unknown_ongoing), indicated or paired, recorded)
        indications = shared(drug_indication_mapping(records), indicated, paired)
        out |= {"drug_indication_mapping": indications, "drug_indication_mapping_by_source": drug_indication_by_source(records)}
    if paired:
        out["gene_indication_max_phase"] = gene_indication_max_phase(gene_drugs, indications)
    return {name: out[name] for name in TABLES if name in wanted}


def aggregate_folder(spark: SparkSession, source_dir: str, output_dir: str, synonyms: DataFrame | None = None, unknown_ongoing: bool = False) -> str:
    """Finds the sources' tables in a folder, aggregates them and writes the six tables as one set (scans.scan_set reads it). Returns the version. No gene-drug table at all is an error."""
    gene_drug, drug_indication = scans.discover_folder(spark, source_dir, list(JOIN_KEYS))
    if not gene_drug:
        raise FileNotFoundError(f"{source_dir} holds no gene-drug table of a known source")
    return scans.sink_set(aggregate_trials(gene_drug, drug_indication, synonyms, unknown_ongoing), output_dir)


def aggregate_evidence(sources: dict[str, DataFrame]) -> DataFrame:
    """One row per (gene, disease) of evidence tables with trait, source, p_value or ot_score: set of sources, least p-value, largest score, first trait in order of source."""
    names = {"gene": "string", "efo_id": "string", "trait": "string", "source": "string", "p_value": "double", "ot_score": "double"}
    rows = reduce(DataFrame.unionByName, [with_columns(df, names).withColumn("_n", F.lit(i)) for i, df in enumerate(sources.values())]).dropna(subset=["gene", "efo_id"])
    return rows.groupBy("gene", "efo_id").agg(first_nonnull(F.col("trait"), F.col("_n")).alias("trait"), string_set(F.col("source")).alias("source"), F.min("p_value").alias("gwas_pvalue"), F.max("ot_score").alias("ot_score"))
