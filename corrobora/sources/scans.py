"""Reading and writing tables, delimited text, line lists and record text."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import small


def scan(spark: SparkSession, source: DataFrame | str, columns: Sequence[str] | None = None, where=None) -> DataFrame:
    """A frame or a Parquet path (file or folder), cut to columns and filtered; both reach the scan."""
    df = source if isinstance(source, DataFrame) else spark.read.parquet(str(source))
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def scan_export(rows: DataFrame, *links: tuple[str, DataFrame, str]) -> DataFrame:
    """The rows of a relational export with the columns of the tables that they point to. links: (column, table, its key), followed in turn; rows without a counterpart are dropped. Tables of few rows are broadcast."""
    for column, other, key in links:
        rows = rows.join(small(other), F.col(column) == F.col(key))
    return rows


def scan_tsv(spark: SparkSession, path: str, schema: str | None = None, comment: str | None = None, columns: Sequence[str] | None = None, header: bool = True) -> DataFrame:
    """Tab-separated text, gzipped or not; without a schema all columns are text. columns renames by place."""
    reader = spark.read.option("sep", "\t").option("header", header).option("quote", "")
    if comment:
        reader = reader.option("comment", comment)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*columns) if columns else df


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the distinct non-blank trimmed lines."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''").distinct()


def scan_records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(value): one row per record of text."""
    return spark.read.text(path, lineSep=separator)


#: Fields of a variant's INFO text.
VARIANT_FIELDS = ("CLNSIG", "CLNREVSTAT", "CLNDN", "GENEINFO", "CLNDISDB")


def variant_fields(lines: DataFrame, column: str = "info") -> DataFrame:
    """The named fields of a text of key=value pairs between semicolons; null where absent."""
    field = lambda k: F.nullif(F.regexp_extract(F.col(column), f"(?:^|;){k}=([^;]*)", 1), F.lit(""))
    return lines.select(*[c for c in lines.columns if c != column], *[field(k).alias(k.lower()) for k in VARIANT_FIELDS])


def scan_variants(spark: SparkSession, path: str) -> DataFrame:
    """Variant lines: tab-separated, # comments, INFO in the eighth column; lines end with LF or CRLF, quotes are characters like others."""
    lines = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema("chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string").csv(path)
    return variant_fields(lines.select("chrom", "pos", "id", "info"))


def filter_entries(entries: DataFrame, columns: Sequence[str], limit: float = 1e-7, p: str = "Pvalue") -> DataFrame:
    """Entries of a long gene-by-phenotype table below a p-value, cut to columns."""
    from ..functions.text import strict

    return entries.where(strict(F.col(p), limit)).select(*columns)


def discover_sources(legs: dict[str, tuple[DataFrame | None, DataFrame | None]]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """By source, the gene-drug and the drug-indication legs that are there."""
    return tuple({s: pair[k] for s, pair in legs.items() if pair[k] is not None} for k in (0, 1))


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path): any scheme that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Endings of the names of a source's two tables.
LEGS = ("gene_drug", "drug_indication")


def discover_folder(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """By source, the tables <source>_gene_drug.parquet and <source>_drug_indication.parquet (files or folders) of a folder; either may be absent. names: the sources to look for, all by default. A folder that isn't there has none."""
    fs, at = file_system(spark, folder)
    found: tuple[dict, dict] = {}, {}
    for status in fs.listStatus(at) if fs.exists(at) else ():
        name = status.getPath().getName()
        for k, leg in enumerate(LEGS):
            source = name.removesuffix(f"_{leg}.parquet")
            if source != name and (names is None or source in names):
                found[k][source] = spark.read.parquet(status.getPath().toString())
    return tuple(dict(sorted(legs.items())) for legs in found)


#: Names of the folder of a version, and of the file that tells which version holds.
VERSION, POINTER = "version=", "_CURRENT"


def sink_set(tables: dict[str, DataFrame], folder: str) -> str:
    """Writes tables together: as <name>.parquet in a new version's folder, which readers see once all of them are there. Returns the version.

    The pointer is replaced by a rename; a writer that is lost before leaves the version before as it was, and the
    files of its own, which no reader looks at.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"{time.time_ns():020}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{VERSION}{version}/{name}.parquet")
    jvm = spark.sparkContext._jvm
    fs, fresh = file_system(spark, f"{folder}/.{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTER}"), overwrite)
    return version


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The version that the pointer names; None where no set has been written."""
    fs, at = file_system(spark, f"{folder}/{POINTER}")
    if not fs.exists(at):
        return None
    return read_small(spark, fs, at)


def read_small(spark: SparkSession, fs, at) -> str:
    """The text of a small file, also of one whose name Spark's scans skip."""
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def scan_set(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the current version by name."""
    version = current_version(spark, folder)
    if version is None:
        raise FileNotFoundError(f"{folder} holds no written set")
    fs, at = file_system(spark, f"{folder}/{VERSION}{version}")
    names = sorted(x.getPath().getName() for x in fs.listStatus(at))
    return {n.removesuffix(".parquet"): spark.read.parquet(f"{folder}/{VERSION}{version}/{n}") for n in names if n.endswith(".parquet")}


def concat_parts(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sink_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes a folder of Parquet, tsv or csv files."""
    writer = df.write.mode("overwrite")
    if form == "parquet":
        writer.parquet(path)
    else:
        writer.option("header", True).option("sep", {"tsv": "\t", "csv": ","}[form]).csv(path)


def sink_lines(df: DataFrame, path: str, column: str = "gene") -> None:
    """Sorted distinct values, one a line."""
    df.select(F.col(column).cast("string").alias("value")).dropna().distinct().orderBy("value").write.mode("overwrite").text(path)
