"""What the training-data operators share: scratch tables, row identity, prefix sums."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes for each core below which a table's files may leave cores idle.
SMALL = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder of its own and any
    other master a folder in the warehouse, which a cluster shares as well.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quire_scratch"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    schema = df.schema
    del df
    free_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_scratch(df: DataFrame) -> None:
    """Deletes the files behind a table of :func:`stored`."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = shared_dir(spark) + "/quire-"
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.split("://")[-1].lstrip("/") in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_fp(text: Column) -> Column:
    """Tells apart rows that share a doc_id; null and empty texts differ."""
    return F.coalesce(F.xxhash64(text, F.length(text)), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of a few megabytes is spread over all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return rows.repartition(cores) if size < cores * SMALL else rows
