"""An extension: questions as a stream, answered batch by batch against a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators import retrieval


def answer_stream(questions: DataFrame, collection: DataFrame, k: int, out: str, checkpoint: str) -> StreamingQuery:
    """questions: a stream of (query_id, q). Each micro-batch's top k go to out/batch=N; a batch that is run again replaces its own folder, so results stay exactly once."""

    def run(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            retrieval.dense_topk(batch.select("query_id", "q"), collection, k).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
