"""Running a compiled pipeline as a stream: checkpointed, to a sink and copies of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from streamstage.plans.engine import compile_pipeline
from streamstage.spec import PipelineSpec
from streamstage.streaming.stateful import PROVIDER


def run_stream(spec: PipelineSpec, events: DataFrame, out: str, checkpoint: str, mode: str = "contract", keep: tuple[str, ...] = ("seq",), once: bool = True):
    """Start the pipeline over streaming typed ``events``; all that is there now is worked off, then it ends, or with
    ``once`` false it goes on until it is stopped. Parquet files in ``out``; with the checkpoint, each event is written once."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    done = compile_pipeline(spec, events, mode, keep)
    writer = done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def collect_and_tee(finished: DataFrame, log: str, tees: list[Callable[[DataFrame], None]], checkpoint: str):
    """Append finished events to the event log ``log`` and hand each batch to ``tees``. A batch is written to a folder of
    its own number, so that one that is run again replaces itself; a tee that fails doesn't stop the log."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
            for tee in tees:
                try:
                    tee(batch)
                except Exception as e:  # noqa: BLE001  copies are best effort
                    print(f"tee failed on batch {number}: {e}")
        finally:
            batch.unpersist()

    return finished.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
