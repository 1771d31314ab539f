"""Trial status: which records are dropped, and which are concluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vocabularies of the registries: fixed values. True: the outcome at this phase is determined.
LABELS = {
    "Completed": True, "Terminated": True, "Unknown status": True, None: True,
    "Recruiting": False, "Active, not recruiting": False, "Not yet recruiting": False, "Enrolling by invitation": False, "Suspended": False,
}
LABELS_DROPPED = ("Withdrawn",)
CODES = {
    "COMPLETED": True, "TERMINATED": True, "UNKNOWN": True,
    "RECRUITING": False, "ACTIVE_NOT_RECRUITING": False, "NOT_YET_RECRUITING": False, "ENROLLING_BY_INVITATION": False, "SUSPENDED": False,
}
CODES_DROPPED = ("WITHDRAWN",)
#: Reports without a status are concluded at these stages only.
CONCLUDED_STAGES = ("APPROVAL", "WITHDRAWAL")


def unknown_values(df: DataFrame, column: str, known) -> DataFrame:
    """(column): values outside the known ones; null is a value."""
    known = list(known)
    inside = F.col(column).isin(*[k for k in known if k is not None]) if any(k is not None for k in known) else F.lit(False)
    fits = F.when(F.col(column).isNull(), F.lit(None in known)).otherwise(inside)
    return df.filter(~fits).select(column).distinct()


def assert_known(df: DataFrame, column: str, known) -> DataFrame:
    """df, or an error that shows unknown values."""
    if found := unknown_values(df, column, known).limit(5).collect():
        raise ValueError(f"unknown values of {column}: {[r[0] for r in found]}")
    return df


def is_concluded(status: Column, vocabulary: dict) -> Column:
    yes = [k for k, v in vocabulary.items() if v and k is not None]
    no = [k for k, v in vocabulary.items() if not v and k is not None]
    null = F.lit(vocabulary[None]) if None in vocabulary else F.raise_error(F.lit("a null status")).cast("boolean")
    return F.when(status.isNull(), null).when(status.isin(*yes), F.lit(True)).when(status.isin(*no), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), status)).cast("boolean"))


def resolve_status(df: DataFrame, vocabulary: dict, dropped, column: str = "status") -> DataFrame:
    """Without dropped statuses, with is_concluded; an unknown status is an error when the rows are computed."""
    kept = df.filter(F.coalesce(~F.col(column).isin(*dropped), F.lit(True)))
    return kept.withColumn("is_concluded", is_concluded(F.col(column), vocabulary))


def concluded_without_status(stage: Column, source_phase: Column) -> Column:
    return F.coalesce(stage.isin(*CONCLUDED_STAGES) | source_phase.ilike("%discontinued%"), F.lit(False))
