"""Incremental intake of PDF files by Structured Streaming.

New files of a folder become rows once; files with bytes that were seen before are dropped
within the watermark; each micro-batch is drawn and appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources import pdf_tables


def incoming(spark: SparkSession, path: str, glob: str = "*.pdf", files_per_trigger: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)


def new_documents(files: DataFrame, delay: str = "7 days") -> DataFrame:
    """(doc_id, content, arrived): doc_id is the content's hash; state is kept for ``delay``."""
    keyed = files.select(F.sha2("content", 256).alias("doc_id"), "content", F.col("modificationTime").alias("arrived"))
    return keyed.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["doc_id"])


def render_stream(files: DataFrame, table_path: str, checkpoint: str, dpi: float = 150.0) -> StreamingQuery:
    """Draws what is there and stops; run again for what came since. A batch that is run
    again after a failure replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        pdf_tables.render(batch, dpi).write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    return new_documents(files).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
