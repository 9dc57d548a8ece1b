"""File-arrival ingest and status, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from folioloom.operators.index import STAGES
from folioloom.session import ship
from folioloom.sources.records import key_parts, schema, with_defaults

#: An object key that starts indexing.
TRIGGER = r"^processed/([^/]+)/v(\d+)/documents\.jsonl$"


def trigger_parts(key) -> tuple:
    """(doc_id, version) of an object key that starts indexing; empty and null for others."""
    version = F.regexp_extract(key, TRIGGER, 2)
    return F.regexp_extract(key, TRIGGER, 1), F.when(version != "", version.cast("int"))


def arrivals(spark: SparkSession, root: str, record: str = "text_blocks", files_per_batch: int = 100) -> DataFrame:
    """New files of a record type under ``processed/<doc>/v<N>/`` as a stream, with their version."""
    df = spark.readStream.schema(schema(record)).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.jsonl").json(f"{root}/processed/*/v*/{{{record},{record}.jsonl}}")
    _, version = key_parts(F.col("_metadata.file_path"), uri=True)
    return with_defaults(df.withColumn("version", version), record)


def ingest(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Runs ``handle(batch, batch_id)`` on each micro-batch; handlers overwrite by document, so a repeat changes nothing."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer).start()


def without_repeats(events: DataFrame, key: str = "key", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events with each key once within the watermark; delivery may repeat them."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def status_stream(events: DataFrame) -> DataFrame:
    """The latest stage per file of a stream (filename, stage, updated_at), by time of the event."""
    k = F.struct("updated_at", "stage")
    return events.groupBy("filename").agg(F.max_by("stage", k).alias("stage"), F.max("updated_at").alias("updated_at"))


#: Hours without news after which a file that isn't done counts as stuck.
STUCK_HOURS = 6


class Stages(StatefulProcessor):
    """A file's furthest stage, and a timer that says when it is stuck.

    The stage never goes back, whatever the order of arrival; events of one stage keep the latest time. A row is put
    out whenever the stage moves on. A file that is neither ``done`` nor ``error`` gets a timer ``hours`` after its last event; when
    the watermark passes it, a row with ``stuck`` is put out. Later events start it anew. What was known before the stream began comes as initial state.
    """

    def __init__(self, hours: float = STUCK_HOURS):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "stage int, at long")

    def _known(self) -> tuple[int, int]:
        return tuple(self.best.get()) if self.best.exists() else (-1, 0)

    def _row(self, key: tuple, stage: int, at: int, stuck: bool) -> pd.DataFrame:
        return pd.DataFrame({"filename": [key[0]], "stage": [STAGES[stage] if stage >= 0 else None], "updated_at": [pd.Timestamp(at, unit="us")], "stuck": [stuck]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        before = stage, at = self._known()
        last = at
        for p in rows:
            for name, t in zip(p["stage"], p["updated_at"], strict=True):
                rank, t = (STAGES.index(name) if name in STAGES else -1), int(pd.Timestamp(t).value // 1000)
                last = max(last, t)
                if rank > stage or (rank == stage and t > at):
                    stage, at = rank, t
        self.best.update((stage, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if STAGES[stage] not in ("done", "error") or stage < 0:
            self.handle.registerTimer(int(last // 1000 + self.hours * 3_600_000))
        if (stage, at) != before:
            yield self._row(key, stage, at, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._row(key, *self._known(), True)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for name, t in zip(initialState["stage"], initialState["updated_at"], strict=True):
            self.best.update((STAGES.index(name) if name in STAGES else -1, int(pd.Timestamp(t).value // 1000)))

    def close(self) -> None:
        pass


def ordered_status(events: DataFrame, late: str = "1 hour", hours: float = STUCK_HOURS, stored: DataFrame | None = None) -> DataFrame:
    """Rows (filename, stage, updated_at, stuck) of a stream (filename, stage, updated_at), as stages move on and files get stuck.

    ``stored``: the stages known before (filename, stage, updated_at), a row a file. The session's state store must be RocksDB's (``state_store``).
    """
    ship(events.sparkSession)
    known = None if stored is None else stored.select("filename", "stage", "updated_at").groupBy("filename")
    rows = events.select("filename", "stage", "updated_at").withWatermark("updated_at", late).groupBy("filename")
    return rows.transformWithStateInPandas(Stages(hours), "filename string, stage string, updated_at timestamp, stuck boolean", "Update", "EventTime", known)


def state_store(spark: SparkSession) -> None:
    """State with timers needs the session's state store to be RocksDB's."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def once_each(name: str, change: Callable[[DataFrame, str], object]) -> Callable[[DataFrame, int], None]:
    """A handler for ``ingest`` that gives ``change`` each batch with a name of its own, under which a store commits it: a batch that is delivered again changes nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        change(batch, f"{name}:{batch_id}")

    return handle


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and window, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
