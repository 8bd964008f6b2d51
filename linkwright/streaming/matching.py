"""Source-1 records as a stream against reference records at rest.

Every micro-batch is a batch run of candidate generation over the new records
alone, since candidates of one source-1 record do not depend on others. The
reference side is prepared once, written, and read by all micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking


def prepare_reference(source2: DataFrame, source3: DataFrame, path: str, max_bucket: int | None = blocking.MAX_BUCKET) -> DataFrame:
    """The reference records, normalised, keyed and with oversized buckets blanked, as a table."""
    ready = blocking.within_cap(blocking.prepared(blocking.tagged(source2, source3)), max_bucket)
    ready.write.mode("overwrite").parquet(path)
    return source2.sparkSession.read.parquet(path)


def start(stream: DataFrame, reference: DataFrame, out: str, checkpoint: str, top_k: int = blocking.TOP_K, floor: float = blocking.SCORE_FLOOR, **trigger) -> StreamingQuery:
    """Append every micro-batch's candidates to the table at out, one folder per batch, so that a repeated batch replaces its own."""

    def run(batch: DataFrame, number: int) -> None:
        pairs = blocking.bucket_pairs(blocking.prepared(batch), reference)
        found = blocking.best_candidates(blocking.scored_pairs(pairs, floor), top_k)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
