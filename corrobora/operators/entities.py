"""Drug identity across sources: records that share an identifier are one drug."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name, string_set
from .graph import smaller

#: Identifier columns in order of preference, and descriptive ones.
ID_COLUMNS = ("chembl_id", "drugbank_id", "drug_name_normalized", "stitch_id")
METADATA_COLUMNS = ("molecule_type", "target_class", "trade_names", "synonyms")
#: Whose name names a drug: fixed order of the domain.
NAME_PRIORITY = ("ChEMBL", "OpenTargets", "DrugBank", "DGIdb", "TrialPanorama", "STITCH")


def identifiers(columns=ID_COLUMNS) -> list[Column]:
    """Of each identifier column "type:value", null where it is blank."""
    return [F.when(F.trim(c) != "", F.concat(F.lit(f"{c}:"), F.col(c))) for c in columns]


def synonym_edges(drugs: DataFrame) -> DataFrame:
    """(a, b): name and canonical name of claims of kind "Primary Drug Name" that differ; of several canonical names the last in order counts."""
    name, canonical = normalize_name(F.col("claim_name")), normalize_name(F.col("drug_name"))
    rows = drugs.filter("nomenclature = 'Primary Drug Name'").select(name.alias("a"), canonical.alias("b")).dropna().filter("a <> b")
    return rows.groupBy("a").agg(F.max("b").alias("b"))


def identifier_labels(records: DataFrame, columns=ID_COLUMNS, synonyms: DataFrame | None = None) -> DataFrame:
    """(node, label) of the identifiers "type:value" that hang together with a smaller one; label: the smallest. synonyms: (a, b) of normalised names."""
    first, *others = identifiers(columns)
    star = records.select(F.coalesce(first, *others).alias("a"), F.explode(F.array(*others)).alias("b")).filter("a <> b")
    if synonyms is not None:
        name = lambda c: F.concat(F.lit("drug_name_normalized:"), F.col(c))
        star = star.union(synonyms.select(name("a"), name("b")))
    return smaller(star)


def connected_entities(records: DataFrame, record: str = "record_id", columns=ID_COLUMNS, synonyms: DataFrame | None = None) -> DataFrame:
    """Adds drug_cluster: the smallest "type:value" among all identifiers that hang together, or "record:<id>" for a record without any.

    Blank identifiers are no identifiers. synonyms: (a, b) of normalised names.
    """
    labels = identifier_labels(records, columns, synonyms).select(F.col("node").alias("_key"), F.col("label").alias("_label"))
    out = records.withColumn("_key", F.coalesce(*identifiers(columns))).join(labels, "_key", "left")
    return out.withColumn("drug_cluster", F.coalesce("_label", "_key", F.concat(F.lit("record:"), F.col(record).cast("string")))).drop("_key", "_label")


def membership(records: DataFrame, columns=ID_COLUMNS, synonyms: DataFrame | None = None) -> DataFrame:
    """(id_type, id_value, our_drug_id), distinct, of the identifiers of records; our_drug_id is the drug_cluster of connected_entities. The records themselves aren't joined, only their distinct identifiers."""
    labels = identifier_labels(records, columns, synonyms).select("node", F.col("label").alias("our_drug_id"))
    each = records.select(F.explode(F.array(*[F.struct(F.lit(c).alias("id_type"), F.col(c).alias("id_value")) for c in columns])).alias("x")).select("x.*").filter("trim(id_value) <> ''").distinct()
    named = each.withColumn("node", F.concat("id_type", F.lit(":"), "id_value")).join(labels, "node", "left")
    return named.select("id_type", "id_value", F.coalesce("our_drug_id", "node").alias("our_drug_id"))


def ambiguous_identifiers(members: DataFrame) -> DataFrame:
    """Values that are used under two types, with the number of types."""
    return members.groupBy("id_value").agg(F.count_distinct("id_type").alias("n_types")).filter("n_types > 1")


def representatives(clustered: DataFrame) -> DataFrame:
    """One row per cluster: its name by source priority, then name; the smallest ids; the set of sources."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in NAME_PRIORITY]), F.col("source")), F.lit(0))
    rows = clustered.withColumn("_rank", F.when(rank == 0, len(NAME_PRIORITY) + 1).otherwise(rank))
    named = F.min(F.when(F.col("drug_name").isNotNull(), F.struct("_rank", "drug_name", "drug_name_normalized")))
    least = [F.min(c).alias(c) for c in ("chembl_id", "drugbank_id", "stitch_id", *METADATA_COLUMNS) if c in clustered.columns]
    out = rows.groupBy(F.col("drug_cluster").alias("our_drug_id")).agg(named.alias("_n"), *least, string_set(F.col("source")).alias("source"))
    return out.select("our_drug_id", "_n.drug_name", "_n.drug_name_normalized", *[c for c in out.columns if c not in ("our_drug_id", "_n")])
