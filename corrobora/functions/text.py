"""Scalar functions on identifiers, names and delimited text, and aggregates that give one defined value per group."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of cross-references in order of preference.
XREF_PREFIXES = ("MONDO:", "Orphanet:", "MeSH:", "HP:")


def to_curie(c: Column) -> Column:
    """IRIs and underscore forms as PREFIX:local; anything else unchanged."""
    return F.regexp_replace(c, r"^(?:.*/|efo:)([A-Z][A-Za-z]*)_([A-Za-z0-9]+)$", "$1:$2")


def first_underscore_to_colon(c: Column) -> Column:
    return F.regexp_replace(c, "^([^_]*)_", "$1:")


def all_underscores_to_colon(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(":"))


def last_path_segment(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def normalize_name(c: Column) -> Column:
    """Lower-case and trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.lower(c)), F.lit(""))


def strip_prefix(c: Column, prefix: str) -> Column:
    """Without the prefix, trimmed; null if nothing is left."""
    return blank_to_null(F.trim(F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)))


def split_trim(c: Column, pattern: str) -> Column:
    """The trimmed, non-blank parts between separators."""
    return F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != "")


def split_genes(c: Column) -> Column:
    """Upper-case genes of a field that separates them by commas, " - " or " x "."""
    return F.transform(split_trim(F.regexp_replace(c, " (-|x) ", ","), ","), lambda x: F.upper(x))


def gene_info_pairs(c: Column) -> Column:
    """(symbol, id) of each "symbol:id" between bars; parts without a colon are left out."""
    parts = F.filter(F.split(c, r"\|"), lambda x: F.contains(x, F.lit(":")))
    return F.transform(parts, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("symbol"), F.split_part(x, F.lit(":"), F.lit(2)).alias("id")))


def xrefs(c: Column, prefix: str, prefixes: Iterable[str] = XREF_PREFIXES) -> Column:
    """The references of one vocabulary in a comma list; a part belongs to the first prefix, in order of preference, that it contains."""
    earlier = []
    for p in prefixes:
        if p == prefix:
            break
        earlier.append(p)

    def own(x: Column) -> Column:
        hit = F.contains(x, F.lit(prefix))
        for p in earlier:
            hit = hit & ~F.contains(x, F.lit(p))
        return hit

    return F.transform(F.filter(F.split(c, ","), own), lambda x: F.concat(F.lit(prefix), F.substring_index(x, prefix, -1)))


def map_case(c: Column, mapping: Mapping, default: Column | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(next(iter(mapping.values()))))
    for k, v in mapping.items():
        out = out.when(c == k, F.lit(v))
    return out if default is None else out.otherwise(default)


def joined_list(c: Column, separator: str = "|") -> Column:
    """An array joined, without null and blank elements; null if none is left."""
    return F.nullif(F.array_join(F.filter(c, lambda x: F.trim(x) != ""), separator), F.lit(""))


def set_of_field(c: Column, name: str) -> Column:
    """The sorted distinct values of a field of an array of structs."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: x[name]), lambda x: x.isNotNull())))


def phase_name(c: Column) -> Column:
    return map_case(c, {0: "Pre", 1: "I", 2: "II", 3: "III", 4: "Approved"}, c.cast("string"))


def phase_label(start: Column, end: Column) -> Column:
    return F.concat(phase_name(start), F.lit("→"), phase_name(end))


def relative_movement(a: Column, b: Column) -> Column:
    """b / a - 1; null where a is 0."""
    return F.try_divide(b, a) - 1


def strict(c: Column, below: float) -> Column:
    """c < below; false for null and NaN."""
    return F.coalesce((c < below) & ~F.isnan(c), F.lit(False))


def at_least(c: Column, limit: float) -> Column:
    """c >= limit, c widened to double first; false for null and NaN."""
    wide = c.cast("double")
    return F.coalesce((wide >= limit) & ~F.isnan(wide), F.lit(False))


def not_blank(c: Column, unknown: str = "UNKNOWN") -> Column:
    return F.coalesce(~F.trim(c).isin("", unknown), F.lit(False))


def string_set(c: Column, separator: str = "&") -> Column:
    """Aggregate: the sorted distinct non-null values, joined; null if there are none."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(c)), separator), F.lit(""))


def split_set(c: Column, separator: str = "&") -> Column:
    """Aggregate: like string_set, of values that are joined sets themselves."""
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(c, separator))))), separator), F.lit(""))


def first_nonnull(value: Column, *order: Column) -> Column:
    """Aggregate: the non-null value that comes first in the order."""
    return F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.struct(*order, value)))
