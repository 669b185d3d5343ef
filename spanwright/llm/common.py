"""Helpers shared by the operators: tables, words, durable cuts, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship_package

#: White space between words: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: Keys that are taken for hot at most, and the rows that a hot key has at least.
HOT_KEYS, LEAST_HOT = 10_000, 1_000


def hot_key(weight: Column, rows: int) -> Column:
    """Whether a key of `weight` rows out of `rows` is hot; at most HOT_KEYS keys are."""
    return (weight >= LEAST_HOT) & (weight * HOT_KEYS >= rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's checkpoint folder, or, in local mode only, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanwright-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/spanwright-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and drop its lineage; lost executors do not lose it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def cut_dealt(df: DataFrame) -> DataFrame:
    """cut() of a join or grouping by keys of few rows each, which keeps how its rows are dealt: later joins on the keys leave them where they are.

    Spark forgets that where it plans adaptively, so this one plan is fixed beforehand; its skewed keys would not be split.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df)
    finally:
        conf.set(name, before)


def cut_packed(df: DataFrame, rows_per_task: int = 50_000, least: int = 8) -> DataFrame:
    """cut(), read again in as many tasks as its rows need, so that few rows do not become many small shuffle files."""
    return cut_counted(df, rows_per_task, least)[0]


def cut_counted(df: DataFrame, rows_per_task: int = 50_000, least: int = 8) -> tuple[DataFrame, int]:
    """cut_packed() and the number of rows."""
    held = cut(df)
    n = held.count()
    return held.coalesce(max(least, -(-n // rows_per_task))), n


def small_side(df: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """df for use as the small side of a join: broadcast if its counted rows are within most_rows, else left to a shuffle.

    df should be cut() already: it is counted here.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def heavy_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, n_left: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key, `weight` (how many rows of left have the key) and other names but for `on`.

    Keys with a HOT_KEYS-th of left's n_left rows are at most HOT_KEYS, whatever the data: they are broadcast, and
    left's rows of them stay where they are. No other key is hot. Both sides should be cut() already.
    """
    hot, kept = hot_key(F.col(weight), n_left), [c for c in right.columns if c not in (*on, weight)]
    few = right.where(hot).select(*on, *kept)
    cold = left.join(F.broadcast(few.select(*on)), on, "left_anti").join(right.where(~hot).select(*on, *kept), on, how)
    return left.join(F.broadcast(few), on).select(*left.columns, *kept).unionByName(cold.select(*left.columns, *kept))


def running(df: DataFrame, order: list[Column], weight: Column, name: str) -> DataFrame:
    """df with the sum of `weight` over the rows before each in the given order (`name`), and their number (`name`_n).

    Rows are ranged over tasks; only one sum a task is brought together. `order` should tell rows apart.
    """
    spread = cut(df.repartitionByRange(*order).withColumns({"_p": F.spark_partition_id(), "_w": weight}))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    sums = spread.groupBy(F.col("_p").alias("_q")).agg(F.sum("_w").alias("_s"), F.count(F.lit(1)).alias("_c"))
    sums = sums.select("_q", F.sum("_s").over(ahead).alias("_s"), F.sum("_c").over(ahead).alias("_c"))  # one row a task
    placed = spread.withColumns({"_own": F.sum("_w").over(inside), "_at": F.count(F.lit(1)).over(inside)}).join(F.broadcast(sums), F.col("_p") == F.col("_q"))
    return placed.select(*df.columns, (F.coalesce("_s", F.lit(0)) + F.coalesce("_own", F.lit(0))).alias(name), (F.coalesce("_c", F.lit(0)) + F.col("_at")).alias(f"{name}_n"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once; a plain reference inside a lambda would be evaluated per element."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of words of a text that is not null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))


def n_words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_CLASS)).cast("long")


def gapless(df: DataFrame, group: list[str], order: list[str], slot: str, weight: str | None = None, rows_per_block: int = 2_048) -> DataFrame:
    """Number rows of each group 0, 1, 2, ... (or give the running weight before the row), a group over many tasks.

    Rows fall into hash blocks of the order columns; blocks of a group follow each other, rows
    inside a block follow `order`. Block totals are summed first, so no group meets in one task.
    `order` must tell the rows of a group apart for a result that reruns alike; equal rows are
    interchangeable.
    """
    total = df.count()
    blocks = max(1, -(-total // rows_per_block))
    keyed = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    step = F.col(weight) if weight else F.lit(1).cast("long")
    inside = Window.partitionBy(*group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy(*group, "_block").agg(F.sum(step).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    on = [keyed[c].eqNullSafe(F.col(f"_b_{c}")) for c in [*group, "_block"]]
    base = base.select(*[F.col(c).alias(f"_b_{c}") for c in [*group, "_block"]], "_base")
    placed = keyed.withColumn("_at", F.coalesce(F.sum(step).over(inside), F.lit(0)))
    out = placed.join(base, on=[*on], how="left")
    return out.withColumn(slot, (F.col("_base") + F.col("_at")).cast("long")).drop("_block", "_base", "_at", *[f"_b_{c}" for c in [*group, "_block"]])


def partition_number() -> int:
    return TaskContext.get().partitionId()


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with batches bounded by bytes, so that long texts do not gather in one batch."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def bound_batches(spark: SparkSession) -> None:
    """Before Python runs on the executors: bounded batches, and this package where they can import it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    ship_package(spark)

