"""Sharding by a two-pass external shuffle; DataFrame functions only.

Pass 1 scatters records over buckets by a seeded hash of their content, so that
every bucket is about ``bucket_bytes`` large whatever the sources or keys are.
Pass 2 runs Fisher-Yates over each bucket (Spark's ``shuffle``) and writes it.
Bucket after bucket, the shuffled records form one random order of the corpus;
shards are equal runs of that order, so their row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import drop_scratch, scratch_path, stored, table

#: Buckets per group in the two-level prefix sum of bucket sizes.
GROUP = 1024
#: Rows alike in id and text beyond which they are dealt by a number of their own.
ALIKE = 1000


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def salted(docs: DataFrame, names: list[str], alike: int) -> DataFrame:
    """(rec, salt): all rows, with a number of its own for each row that is one of more than
    ``alike`` of equal id and text, and 0 for others. The numbers are written down, so a task
    that runs again deals its rows as before."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*names).alias("rec"), F.xxhash64("doc_id", "text").alias("own"))
    crowds = rows.groupBy("own").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > alike).select("own")
    crowds = stored(crowds, "crowds")
    if crowds.isEmpty():
        drop_scratch(crowds)
        return rows.select("rec", F.lit(0).cast("long").alias("salt"))
    # Spark broadcasts the crowds only if their file is small.
    numbered = stored(rows.join(crowds, "own", "left_semi").select("rec", F.monotonically_increasing_id().alias("salt")), "numbered")
    return rows.join(crowds, "own", "left_anti").select("rec", F.lit(0).cast("long").alias("salt")).unionByName(numbered)


def bucket_of(seed: int, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "rec.doc_id", "rec.text", "salt"), F.lit(n_buckets)).cast("int")


def bucket_offsets(counts: DataFrame) -> DataFrame:
    """(bucket, n) -> (bucket, first): rows in all buckets before, in two levels so
    that no task sees more than ``GROUP`` buckets or one row per group of them."""
    grouped = counts.withColumn("g", F.expr(f"bucket div {GROUP}"))
    inner = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    groups = grouped.groupBy("g").agg(F.sum("n").alias("gn")).select("g", F.coalesce(F.sum("gn").over(outer), zero).alias("gfirst"))
    within = grouped.select("bucket", "g", F.coalesce(F.sum("n").over(inner), zero).alias("wfirst"))
    return within.join(groups, "g").select("bucket", (F.col("gfirst") + F.col("wfirst")).alias("first"))


def shuffle_into_shards(docs: DataFrame, n_shards: int, seed: int = 7, bucket_bytes: int = 16 << 20, path: str | None = None, alike: int = ALIKE) -> DataFrame:
    """Writes ``docs`` as ``n_shards`` shards of Parquet files and returns the files' rows.

    The result has all columns of ``docs`` plus ``shard`` int and ``slot`` long (gapless
    from 0 within a shard). Needs ``doc_id`` and ``text``; other columns are carried along;
    input columns named shard or slot are replaced.

    Null ids and null or empty texts are records like any other; a very long text is one record.
    Rows that agree in both id and text come in any order between them; more than ``alike``
    such rows are spread over all buckets. No rows: no files, an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    names = docs.columns
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(record_size(F.col("text"))), F.lit(0)).alias("b")).first()
    n_rows, n_buckets = total["n"], max(1, -(-total["b"] // bucket_bytes))
    out = docs.withColumn("shard", F.lit(None).cast("int")).withColumn("slot", F.lit(None).cast("long"))
    if not n_rows:
        return out.limit(0)
    bucketed = salted(docs, names, alike).select("rec", "salt", bucket_of(seed, n_buckets).alias("bucket"))
    # Stored: Spark sees that one row a bucket is small and leaves the buckets where they are.
    offsets = stored(bucket_offsets(bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))), "offsets")
    # One array per bucket of bounded size. sort_array and the order of the buckets make a
    # task that runs again after a lost executor shuffle just as before.
    order = F.struct(F.col("rec.doc_id").alias("k0"), F.xxhash64("rec.text").alias("k1"), F.col("salt"), F.col("rec"))
    whole = (
        bucketed.repartitionById(n_buckets, F.col("bucket"))  # each bucket a partition
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list(order)).alias("recs"))
        .select("bucket", F.shuffle("recs", seed).alias("recs"))
    )
    placed = whole.join(offsets, "bucket").select("first", F.posexplode("recs").alias("pos", "r"))
    at = F.col("first") + F.col("pos")
    size, extra = divmod(n_rows, n_shards)
    split = extra * (size + 1)
    shard = F.expr(f"CASE WHEN at < {split} THEN at div {size + 1} ELSE {extra} + (at - {split}) div {max(size, 1)} END").cast("int")
    slot = F.expr(f"CASE WHEN at < {split} THEN at % {size + 1} ELSE (at - {split}) % {max(size, 1)} END")
    rows = placed.select("r.rec", at.alias("at")).select("rec", slot.alias("slot"), shard.alias("shard")).select("rec.*", "slot", "shard")
    path = path or scratch_path(spark, "shards")
    rows.write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.select(*names, "slot", "shard").schema).parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return rows.select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
