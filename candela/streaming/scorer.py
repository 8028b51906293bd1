"""New queries against a prepared gallery, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_k
from ..operators.scoring import view_scores


def rank_stream(queries: DataFrame, gallery: DataFrame, path: str, checkpoint: str, k: int = 10, **trigger):
    """Starts a query that appends the k best gallery cases of each arriving query row
    (case_id, person_id, view, h, f) to a Parquet table at path. A batch is written under
    its number, so one that is tried again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            top = top_k(view_scores(batch, gallery), k)
            top.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
