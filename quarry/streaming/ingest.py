"""An extension: documents that arrive as a stream are tokenized and appended to the term table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.retrieval import term_frequencies, tokenized


def follow(stream: DataFrame, terms: str, checkpoint: str, id_col: str = "chunk_id", text_col: str = "text") -> StreamingQuery:
    """Term frequencies of each batch go to ``terms``/batch=N; a batch that is run again overwrites its own folder, so none counts twice."""

    def add(batch: DataFrame, n: int) -> None:
        term_frequencies(tokenized(batch.select(id_col, text_col), text_col), id_col).write.mode("overwrite").parquet(f"{terms}/batch={n}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
