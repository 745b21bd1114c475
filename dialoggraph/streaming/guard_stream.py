"""The guard on a stream of replies: the batch projection plus its log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.guard import GuardConfig, log_rows, outward, sanitise


def guard_stream(replies: DataFrame, cfg: GuardConfig, user_message: str | None = None) -> DataFrame:
    """Stateless, so it is the batch operator applied to a streaming DataFrame."""
    return outward(sanitise(replies, cfg, user_message=user_message), cfg)


def start_guard(replies: DataFrame, cfg: GuardConfig, out_path: str, log_path: str, checkpoint: str,
                user_message: str | None = None, **trigger) -> StreamingQuery:
    """Write guarded replies and the log of removals; ``trigger`` as for ``writeStream``.

    A micro-batch that is replayed after a failure overwrites its own folder, so neither
    output holds a batch twice.
    """
    spark = replies.sparkSession
    # A file may be one row group, which one task reads; the work on it is dealt to all.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    guarded = guard_stream(replies.repartition(parts), cfg, user_message)

    def sink(batch: DataFrame, batch_id: int) -> None:
        folder = f"{out_path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(folder)
        # The log is taken from what was written; the batch is neither held nor worked out again.
        stored = batch.sparkSession.read.schema(batch.schema).parquet(folder)
        log_rows(stored).write.mode("overwrite").json(f"{log_path}/batch={batch_id}")

    return (guarded.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
