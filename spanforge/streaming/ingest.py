"""Incremental corpus ingestion: chunk new documents as they arrive and append them to a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from spanforge.plans.session import numbered


def new_documents(stream: DataFrame, delay: str = "1 day", id_col: str = "id", text_col: str = "text", time_col: str = "loaded_at") -> DataFrame:
    """(id, text, loaded_at) of a stream of documents; the same id and text again within ``delay`` is dropped.

    Rows with a null id or time go; state is kept only as long as the watermark allows.
    """
    rows = stream.where(F.col(id_col).isNotNull() & F.col(time_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.col(time_col).alias("loaded_at"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("version")
    )
    return rows.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["id", "version"]).drop("version")


def last_position(spark: SparkSession, out: str, batch: int) -> int:
    """The greatest doc_pos of the batches before ``batch``; -1 if there is none."""
    try:
        written = spark.read.parquet(out)
    except AnalysisException:
        return -1
    last = written.where(F.col("batch") < batch).agg(F.max("chunk_pos")).first()[0]
    return -1 if last is None else last >> 24


def ingest_chunks(stream: DataFrame, chunk: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends the chunks of all available documents to Parquet under ``out``, one folder a batch.

    doc_pos numbers documents without gaps in a batch by time, id and text, after those of the batches before,
    so no two documents share one, whatever their times. A batch that is run again overwrites its
    own folder with the same rows.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = last_position(spark, out, number)
        docs = numbered(batch, "__no", "loaded_at", "id", "text").withColumn("doc_pos", F.col("__no") + first).drop("__no")
        chunk(docs).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return new_documents(stream).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
