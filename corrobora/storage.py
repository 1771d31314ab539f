"""Reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many rows, a few short columns each, may be broadcast.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder, which stays set; a cluster gets an error, as its executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corrobora-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Paths of the scopes that are open, the innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is materialised in it is deleted at its end, so results have to be written or collected before. Without a scope, tables stay until the shared folder is cleared."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/corrobora/{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, so later stages start from these files: a lost executor costs a retry of its own tasks and no more."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_with(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """materialise, and the values of aggregates over the rows, which Spark gathers as it writes them (or, where it finds that there are none and leaves the plan out, from what is written)."""
    seen, wanted = Observation(), [c.alias(name) for name, c in metrics.items()]
    written = materialise(df.observe(seen, *wanted))
    return written, seen.get or written.agg(*wanted).first().asDict()


def bucketed(df: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Writes df in the shared folder as a table of buckets by hash of the keys, sorted in them, and reads it back: joins and groupings by these keys of tables with as many buckets move no rows. buckets: spark.sql.shuffle.partitions by default."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"corrobora_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", new_path(spark)).saveAsTable(name)
    return spark.table(name)


#: Rows that one task of `dealt` takes, about.
TASK_ROWS = 500_000


def tasks(df: DataFrame) -> int:
    """How many tasks df's rows ask for, at least spark.sql.shuffle.partitions. Counts df, which is cheap for a table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df by hash of the keys over n partitions, so that what a task of a join or grouping by them sorts or holds doesn't grow with the table; df itself where Spark's own number is as large."""
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


#: Rows of one key that a join's task takes.
HOT_ROWS = 100_000


def join_dealt(left: DataFrame, right: DataFrame, on: str, hot_rows: int | None = None) -> DataFrame:
    """The inner join by one column of a large left side, whose keys may be hot, with a right side too large to broadcast.

    Keys with more than HOT_ROWS rows on the left are counted; their rows are dealt out to blocks of that many by a
    hash of the row, and the right side's rows of these keys, and only these, are repeated for each block. Each pair of
    rows meets once. The counted keys are at most the left side's rows over HOT_ROWS.
    """
    most = hot_rows or HOT_ROWS
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on)
    hot = materialise(left.groupBy(on).agg(F.ceil(F.count("*") / most).cast("int").alias("_blocks")).filter("_blocks > 1"))
    n = F.coalesce("_blocks", F.lit(1))
    row = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    dealt = left.join(small(hot), on, "left").withColumn("_block", F.pmod(row, n).cast("int")).drop("_blocks")
    spread = right.join(small(hot), on, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), n - 1))).drop("_blocks")
    return dealt.join(spread, [on, "_block"]).drop("_block")


#: Of the right side of fan_out: rows that a list is made from, and rows whose lists may be broadcast. Rows of the left side that a task takes.
LIST_ROWS, LISTED_ROWS, FAN_ROWS = 10_000, 1_000_000, 10_000
#: Values of a broadcast list and rows of a part at most. Many such cycles fit a page of a file (20,000 rows), and by a multiple of 8 each begins at a whole byte; Spark holds the rows that it reads out of one row.
CYCLE_ROWS, PART_ROWS = 256, 32


def fan_out(left: DataFrame, right: DataFrame, on: str, value: str) -> DataFrame:
    """The left join by one column with a right side (on, value), where each row of many meets many.

    The rows of result are the keys' products, so they are made last, in tasks of some FAN_ROWS rows of the left side.
    Lists of the right side's values of a key are broadcast up to LISTED_ROWS values. Rows of the left side, dealt by
    ranges of the key and their place, meet them in parts of one key, and a task reads each list out for all its rows of
    the key: what is written holds runs of a row and short cycles of values, a bit or so a row, not all values again and
    again. Beyond LISTED_ROWS the left side's rows are dealt to cuts of HOT_ROWS, for each of which the lists, of at most
    LIST_ROWS values, are repeated, and rows of one key and cut are one task's.
    """
    rows = left.count()
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // FAN_ROWS))
    values = F.transform(F.collect_list(F.struct(F.col(value))), lambda x: x[value])  # in a struct nulls stay
    if right.limit(LISTED_ROWS + 1).count() <= LISTED_ROWS:
        in_cuts = lambda c, size: F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / size)), lambda i: F.slice(c, i.cast("int") * size + 1, size))
        lists = right.groupBy(on).agg(values.alias("_all")).select(on, F.posexplode(in_cuts("_all", min(LIST_ROWS, CYCLE_ROWS))).alias("_block", "_list"))
        place = F.floor(F.monotonically_increasing_id() / FAN_ROWS).alias("_place")
        rows_of = left.select("*", place).repartitionByRange(n, on, "_place").groupBy(on, "_place").agg(F.collect_list(F.struct(*left.columns)).alias("_all"))
        parts = rows_of.select(on, F.explode(in_cuts("_all", PART_ROWS)).alias("_part"))
        met = parts.join(F.broadcast(lists), on, "left").sortWithinPartitions(on, "_block")
        met = met.select(F.explode("_part").alias("_row"), "_list").select("_row.*", "_list")
    else:
        cuts = max(1, -(-rows // HOT_ROWS))
        cut = left.withColumn("_cut", F.pmod(F.monotonically_increasing_id(), F.lit(cuts)).cast("int"))
        block = F.floor(F.monotonically_increasing_id() / LIST_ROWS).alias("_block")
        lists = right.select(on, value, block).groupBy(on, "_block").agg(values.alias("_list")).drop("_block")
        repeated = lists.withColumn("_cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
        met = cut.repartition(n, on, "_cut").join(repeated.repartition(n, on, "_cut"), [on, "_cut"], "left")
    return met.select(*left.columns, F.explode_outer("_list").alias(value))


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
