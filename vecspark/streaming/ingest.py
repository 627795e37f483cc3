"""Streams into and through collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from vecspark.engine import Engine
from vecspark.operators.search import batch_search


def upsert_stream(engine: Engine, name: str, stream: DataFrame, checkpoint: str, point_id: str = "id", vector: str = "vector", payload: str | None = "payload") -> DataStreamWriter:
    """Each micro-batch of stream is one upsert, which the collection keeps by the checkpoint's path and the batch's number: one
    that comes again after a failure changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            engine.upsert_dataframe(name, batch, point_id, vector, payload, (checkpoint, epoch))

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def search_queries(engine: Engine, name: str, queries: DataFrame, k: int, out: str, checkpoint: str) -> DataStreamWriter:
    """queries: a stream of qid and vector. The k best points of each go to Parquet under out, with the batch's number."""
    metric = engine.collection_config(name)["metric"]

    def answer(batch: DataFrame, epoch: int) -> None:
        found = batch_search(engine.points(name), batch, k, metric)
        found.withColumn("batch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return queries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(answer)
