"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import math
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; with long texts, Spark's default of 10,000 rows would fill a worker's memory. One number for all
#: operators, since Spark reads the setting when a plan runs and not when it is built.
ARROW_ROWS = 256
#: Rows of a few longs that may be broadcast (16 to 32 MB).
BROADCAST_ROWS = 1_000_000
#: Broadcasts of so many rows each that one join may hold.
SLICES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark reads it, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this subpackage's Python stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once and bound to a lambda's variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where it is unset, a new one if all of Spark runs in this process; executors elsewhere would not see that."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="notegraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def sized(df: DataFrame) -> DataFrame:
    """df, to be broadcast if a count shows that it is small enough; the join shuffles it otherwise. For narrow rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def met_with(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with few narrow rows of a stored() table, which is broadcast, in SLICES of BROADCAST_ROWS at most: no row of rows moves. With still more of them both sides are shuffled."""
    n = math.ceil(few.count() / BROADCAST_ROWS)
    if n > SLICES:
        return rows.join(few, on)
    if n <= 1:
        return rows.join(F.broadcast(few), on)
    own = F.pmod(F.xxhash64(*on), F.lit(n))
    return reduce(DataFrame.unionByName, [rows.filter(own == i).join(F.broadcast(few.filter(own == i)), on) for i in range(n)])


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written once to the shared folder and read again: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/notegraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a stored() table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffles of plans that are done. It does when the driver's references to them are collected, by default only every 30 minutes or so; till then their files fill the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
