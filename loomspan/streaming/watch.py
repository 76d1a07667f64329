"""Watching a tree: every trigger lists it and looks whether names, times or sizes have changed.

Spark's file source tells of new files only, so the trigger is a clock, and the listing tells of changed and removed ones and of new folders.
A change is indexed once the tree has been quiet for one interval, so that a burst is one pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import index
from ..sources import files
from ..sources.modules import Resolver


def watch(spark: SparkSession, root: str, store: str, by: Resolver | None, checkpoint: str, *, interval_ms: int = 200, once: bool = False, tell: Callable[[index.Result], None] | None = None, tsconfig: str | None = None) -> StreamingQuery:
    """Starts the stream; once: only what is there now. tell gets the result of every pass that saved something. Without by, the
    configuration is read anew from the tree for each pass."""
    seen: dict[str, tuple[int, int] | None] = {"indexed": None, "last": None}

    def on_batch(_: DataFrame, __: int) -> None:
        now = files.signature(spark, root)
        quiet, seen["last"] = now == seen["last"], now
        if now == seen["indexed"] or not (once or quiet):
            return
        result = index.index_pass(spark, files.scan(spark, root), store, by or index.resolver(spark, root, tsconfig), known=index.known(spark, root))
        seen["indexed"] = now
        if result.saved and tell:
            tell(result)

    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = clock.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{interval_ms} milliseconds")).start()
