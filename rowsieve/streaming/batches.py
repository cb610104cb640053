"""Each micro-batch of a stream is one table: validated, reported and split by itself."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rowsieve.plans.runs import run
from rowsieve.rules import DEFAULT_THRESHOLD, Rule


def validate_stream(
    stream: DataFrame,
    rules: Iterable[Rule] | None,
    root: str,
    checkpoint: str | None = None,
    order_by: Sequence[str] | None = None,
    default_threshold: float = DEFAULT_THRESHOLD,
    run_prefix: str = "batch",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the stream. Run ids follow the batch number, so a batch that is tried again
    after a failure replaces its own output. Uniqueness holds within a batch. Progress is
    kept in ``checkpoint``, by default a folder below ``spark.checkpoint.dir`` that later
    applications find again by ``run_prefix``."""
    chosen = None if rules is None else list(rules)
    if checkpoint is None:
        base = stream.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            raise ValueError("pass checkpoint, or set spark.checkpoint.dir")
        checkpoint = f"{base.rstrip('/')}/rowsieve-streams/{run_prefix}"

    def handle(batch: DataFrame, number: int) -> None:
        run(
            batch,
            chosen,
            root=root,
            run_id=f"{run_prefix}-{number:012d}",
            order_by=order_by,
            default_threshold=default_threshold,
            source=f"{run_prefix} {number}",
        )

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
