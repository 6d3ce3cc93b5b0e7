"""Incremental ingest: new files only, resumed from a checkpoint, written idempotently."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.text import strip
from lectern.operators.chunking import token_windows
from lectern.sources.collections import upsert_chunks, with_defaults


def chunk_documents(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """(collection, source, chunk_id, prev/next ids, text) windows of (doc_id, collection, source, text).

    Ids hold the source, document and place, and a document's window count is known in its row, so
    neighbour ids need neither a window function nor a join.
    """
    cut = token_windows(docs, ["doc_id", "collection", "source"], size, overlap)

    def place(shift: int):
        return F.sha2(F.concat_ws("|", "source", F.col("doc_id").cast("string"), (F.col("chunk_index") + shift).cast("string")), 256)

    return cut.select(
        "collection", "source", "doc_id", "chunk_index",
        place(0).alias("chunk_id"),
        F.when(F.col("chunk_index") > 0, place(-1)).alias("prev_chunk_id"),
        F.when(F.col("chunk_index") + 1 < F.col("n_windows"), place(1)).alias("next_chunk_id"),
        "text",
    )


def incremental_ingest(
    stream: DataFrame, root: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = chunk_documents
) -> StreamingQuery:
    """Process all new input of ``stream`` (doc_id, collection, source, text) once and stop.

    Each micro-batch becomes one store write named by the stream's id and its number: run again after a failure it
    changes nothing. Documents without text go to ``<root>-rejected``.
    """

    def write(batch: DataFrame, number: int) -> None:
        # the id that Spark gave the stream when it made the checkpoint: a new checkpoint is a new stream
        stream_id = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        name = f"{stream_id}-{number}"
        empty = F.coalesce(strip(F.col("text")), F.lit("")) == ""
        batch.where(empty).select("doc_id", "source", F.lit("no text").alias("reason")).write.mode("overwrite").parquet(
            f"{root}-rejected/write={name}"
        )
        upsert_chunks(with_defaults(shape(batch.where(~empty))), root, name)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
