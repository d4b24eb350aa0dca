"""Restartable incremental work as a stream of new documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators import pagination, segmentation


def new_documents(spark: SparkSession, path: str, schema) -> DataFrame:
    """Documents of Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def paginate_stream(documents: DataFrame, out_path: str, checkpoint: str, target: int = pagination.TARGET) -> StreamingQuery:
    """Write the pages of every arriving document (doc_id, text) once; a restart goes on from the checkpoint.

    A document's pages depend on nothing but the document, so batches keep no state. Each batch goes
    to a folder of its own number, so one that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        blocks = batch.select(F.col("doc_id").alias("book_id"), F.lit(0).alias("chapter"), F.posexplode(F.split("text", "\n")).alias("block_no", "text"), F.lit(False).alias("is_heading"))
        pages = pagination.page_texts(pagination.greedy_pages(segmentation.sentences(blocks), target))
        pages.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
