"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a few narrow columns that may be broadcast.
BROADCAST_ROWS = 1_000_000
COMMIT = "batch long, relation string, bucket int, writer string, epoch long"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new folder if all of Spark runs in this process; executors elsewhere would not see that."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="notegraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read again, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/notegraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df written once in buckets of key, a file each and as many as shuffles have partitions, and read again: a join by key leaves its rows where they lie. The catalog's entry is dropped, the files stay."""
    spark = df.sparkSession
    table, n = f"{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/notegraph/{table}").saveAsTable(table)
    made = spark.table(table)
    made.isEmpty()  # the relation's files are listed
    spark.sql(f"DROP TABLE {table}")
    return made


def forget(*tables: DataFrame) -> None:
    """Deletes the files of stored() tables that no later plan reads."""
    for df in tables:
        session = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = session._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame) -> DataFrame:
    """df, to be broadcast if a count shows that it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def bucket_of(keys: Iterable[str], buckets: int) -> Column:
    """The bucket that a keyed relation's row lives in. Its number must not change once a relation is written."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def next_batch(spark: SparkSession, root: str) -> int:
    return (_commits(spark, root).agg(F.max("batch")).first()[0] or 0) + 1


def is_done(spark: SparkSession, root: str, batch: int | None = None, writer: str | None = None, epoch: int | None = None) -> bool:
    """Whether a batch, or a writer's epoch, is committed."""
    done = _commits(spark, root)
    return not done.filter(F.col("batch") == batch if writer is None else (F.col("writer") == writer) & (F.col("epoch") == epoch)).isEmpty()


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], batch: int, *, keyed: dict[str, DataFrame] | None = None, spread: dict[str, list[str]] | None = None, writer: str | None = None, epoch: int | None = None) -> bool:
    """Appends the tables' rows to the relations under root as one batch: all are staged in the batch's own folders, and the batch counts once its commit is written, last.

    keyed: relations whose rows carry a column bucket; a batch writes the buckets that it touches, whole, and they stand for these buckets from
    then on (see latest()), or add to what they hold (see in_buckets()). spread: further columns by which a relation's buckets are cut among tasks. writer and epoch: a stream's name and its own number of the batch, which make a repeated one known under any batch number.
    One writer at a time. False, and nothing is done, for a batch that is there already; what a failed try staged is overwritten.
    """
    if is_done(spark, root, batch) or (writer is not None and is_done(spark, root, writer=writer, epoch=epoch)):
        return False
    rows = [(batch, name, None, writer, epoch) for name in [*tables, *(keyed or {})]]
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
    for name, df in (keyed or {}).items():
        path = f"{root}/{name}/batch={batch}"
        df.repartition("bucket", *(spread or {}).get(name, [])).write.mode("overwrite").partitionBy("bucket").parquet(path)
        rows += [(batch, name, r["bucket"], writer, epoch) for r in spark.read.schema(df.schema).parquet(path).select("bucket").distinct().collect()]
    spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("overwrite").json(f"{root}/commits/{batch}")
    return True


def latest(spark: SparkSession, root: str, name: str, schema: T.StructType, buckets: Iterable[int] | None = None) -> DataFrame:
    """A keyed relation: every bucket, or those asked for, as the last batch that touched it left it. Only their folders are read; a commit row for each bucket reaches the driver."""
    return _in_folders(spark, root, name, schema, _bucketed(spark, root, name, buckets).groupBy("bucket").agg(F.max("batch").alias("batch")))


def in_buckets(spark: SparkSession, root: str, name: str, schema: T.StructType, buckets: Iterable[int]) -> DataFrame:
    """A bucketed relation to which each batch adds: the rows of all batches in the buckets asked for, whose folders alone are read. A commit row for each bucket asked for and batch reaches the driver."""
    return _in_folders(spark, root, name, schema, _bucketed(spark, root, name, buckets).select("batch", "bucket").distinct())


def _bucketed(spark: SparkSession, root: str, name: str, buckets: Iterable[int] | None) -> DataFrame:
    done = _commits(spark, root).filter((F.col("relation") == name) & F.col("bucket").isNotNull())
    return done if buckets is None else done.filter(F.col("bucket").isin(*buckets))


def _in_folders(spark: SparkSession, root: str, name: str, schema: T.StructType, found: DataFrame) -> DataFrame:
    paths = [f"{root}/{name}/batch={r['batch']}/bucket={r['bucket']}" for r in found.collect()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def committed(spark: SparkSession, root: str, name: str, schema: T.StructType, *, last: bool = False, batch: int | None = None, until: int | None = None) -> DataFrame:
    """A relation's rows of all committed batches, of one of them, of those until one, or of the last one, for a relation that each batch holds whole."""
    done = _commits(spark, root).filter(F.col("relation") == name)
    done = done if batch is None else done.filter(F.col("batch") == batch)
    done = done if until is None else done.filter(F.col("batch") <= until)
    done = done.agg(F.max("batch").alias("batch")) if last else done.select("batch").distinct()
    try:
        rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{root}/{name}")
    except AnalysisException as e:
        _only_missing(e)
        return spark.createDataFrame([], schema)
    return rows.join(F.broadcast(done), "batch", "left_semi").drop("batch")  # done: one row a batch


def _commits(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(COMMIT).option("recursiveFileLookup", "true").json(f"{root}/commits")
    except AnalysisException as e:
        _only_missing(e)
        return spark.createDataFrame([], COMMIT)


def _only_missing(e: AnalysisException) -> None:
    if e.getCondition() != "PATH_NOT_FOUND":
        raise e
