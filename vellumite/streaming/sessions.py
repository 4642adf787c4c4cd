"""Sessions in a stream: choices that wait for a newer one, offers that depend on a phase, files taken once.

Each keeps a few values a key in Spark's state store (``transformWithState``), so
a restarted query goes on where its checkpoint is: a timer that was set still
fires, a choice that was let through is not let through again, a file that was
seen is not taken again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .ingest import OPEN_PHASES

#: Fixed value: milliseconds that a choice waits for a newer one.
WAIT_MS = 280
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Start queries with state in here; the session's own store is set again afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def time_mode(keep_ms: int | None) -> str:
    """State with an end needs a clock; with one, a query goes on after its last input until it is stopped."""
    return "None" if keep_ms is None else "ProcessingTime"


class Debounce(StatefulProcessor):
    """Of a session's choices, (generation, level, at, ended), those with no newer one within ``wait`` milliseconds.

    ``at`` is milliseconds of event time, or null for the time of arrival. A choice
    of an older generation than the newest is dropped, whenever it comes. A row
    with ``ended`` removes all that is held of the session.
    """

    SCHEMA = "session long, generation long, level int"

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "generation long, level int, at long, passed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        new = pd.concat(list(rows)).sort_values(["generation"], kind="stable")
        held, out, ended = (self.held.get() if self.held.exists() else None), [], False
        for generation, level, at, end in zip(new["generation"], new["level"], new["at"], new["ended"], strict=True):
            at = now if pd.isna(at) else int(at)
            if end:
                held, ended = None, True
                continue
            if held is not None and generation <= held[0]:
                continue
            if held is not None and not held[3] and at - held[2] >= self.wait:
                out.append((key[0], held[0], held[1]))
            held, ended = (int(generation), int(level), at, False), False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None or ended:
            self.held.clear()
        else:
            self.held.update(held)
            if not held[3]:
                self.handle.registerTimer(held[2] + self.wait)
        yield pd.DataFrame(out, columns=["session", "generation", "level"]).astype({"session": "int64", "generation": "int64", "level": "int32"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            generation, level, at, passed = self.held.get()
            if not passed:
                self.held.update((generation, level, at, True))
                yield pd.DataFrame([(key[0], generation, level)], columns=["session", "generation", "level"]).astype({"session": "int64", "generation": "int64", "level": "int32"})

    def close(self) -> None:
        pass


def debounced(choices: DataFrame, wait: int = WAIT_MS, event_time: str | None = None) -> DataFrame:
    """(session, generation, level) of the choices that stay the newest for ``wait`` milliseconds.

    ``choices``, a stream, has session, generation, level, and ended where sessions
    end. With ``event_time``, a timestamp column with a watermark, that counts
    instead of the time of arrival; generations then follow it.
    """
    at = F.unix_millis(F.col(event_time)) if event_time else F.lit(None).cast("long")
    ended = F.coalesce("ended", F.lit(False)) if "ended" in choices.columns else F.lit(False)
    rows = choices.select("session", "generation", F.col("level").cast("int").alias("level"), at.alias("at"), ended.alias("ended"), *([F.col(event_time).alias("_event")] if event_time else []))
    return rows.groupBy("session").transformWithStateInPandas(Debounce(wait), Debounce.SCHEMA, "Append", "EventTime" if event_time else "ProcessingTime")


class Phases(StatefulProcessor):
    """Of a session's rows in their order, (place, phase, url), the urls that come while its phase takes files."""

    SCHEMA = "session long, place long, url string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.phase = handle.getValueState("phase", "phase string", ttlDurationMs=self.keep)

    def __init__(self, keep: int | None):
        self.keep = keep

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        phase = self.phase.get()[0] if self.phase.exists() else OPEN_PHASES[0]
        out = []
        for place, changed, url in pd.concat(list(rows)).sort_values("place", kind="stable")[["place", "phase", "url"]].itertuples(index=False):
            if isinstance(changed, str):
                phase = changed
            elif isinstance(url, str) and phase in OPEN_PHASES:
                out.append((key[0], place, url))
        self.phase.update((phase,))
        yield pd.DataFrame(out, columns=["session", "place", "url"]).astype({"session": "int64", "place": "int64", "url": "object"})

    def close(self) -> None:
        pass


def taken_offers(rows: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(session, place, url) of the local files offered while the session's phase takes files.

    ``rows``, a stream, has session, place (their order), and phase (the session's
    new one) or url (an offer). A session of which nothing is heard for ``keep_ms``, where given, begins anew.
    """
    local = F.when(F.lower("url").startswith("file:"), F.col("url"))
    wanted = rows.where(F.col("phase").isNotNull() | local.isNotNull()).select("session", "place", "phase", local.alias("url"))
    return wanted.groupBy("session").transformWithStateInPandas(Phases(keep_ms), Phases.SCHEMA, "Append", time_mode(keep_ms))


class Once(StatefulProcessor):
    """Of the files of a path, (length, modified), each kind once: a file that is offered again unchanged is dropped."""

    SCHEMA = "path string, length long, modified long"

    def __init__(self, keep: int | None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "length long, modified long", "met boolean", ttlDurationMs=self.keep)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for length, modified in pd.concat(list(rows))[["length", "modified"]].drop_duplicates().itertuples(index=False):
            kind = int(length), int(modified)
            if not self.seen.containsKey(kind):
                self.seen.updateValue(kind, (True,))
                out.append((key[0], *kind))
        yield pd.DataFrame(out, columns=["path", "length", "modified"]).astype({"path": "object", "length": "int64", "modified": "int64"})

    def close(self) -> None:
        pass


def new_files(listed: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(path, length, modified) of a stream of listed files, each once, however often it is offered; without an end unless ``keep_ms`` is given."""
    return listed.select("path", "length", "modified").groupBy("path").transformWithStateInPandas(Once(keep_ms), Once.SCHEMA, "Append", time_mode(keep_ms))


def listed(spark: SparkSession, folder: str, most: int = 1000) -> DataFrame:
    """PDF files of ``folder`` as a stream of names, lengths and times; no content is read. At most ``most`` new ones a batch."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", str(most)).load(folder)
    return files.select("path", "length", F.unix_millis("modificationTime").alias("modified"))


def each_new(found: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``handle(files, batch)`` over the new files of ``found``, (path, length, modified), as they stand now. ``batch`` counts them, and is the same when a batch is run again."""
    with state_store(found.sparkSession):
        return new_files(found).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All that ``stream`` gives of what is there now, written under ``folder`` with its checkpoint."""
    spark = stream.sparkSession
    with state_store(spark):
        query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
