"""Interactive sessions as a stream: each has a state, its current input."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "line string, query_number int, searched boolean, current_input string"


class _Session(StatefulProcessor):
    """A line with ``#`` in it ends the query; any other becomes the current input."""

    def __init__(self, session: str, order: str, text: str, names: list[str], idle_ms: int | None):
        self.session, self.order, self.text, self.names, self.idle_ms = session, order, text, names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "query_number int, current_input string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        number, current = self.state.get() if self.state.exists() else (0, "")
        for row in sorted(rows, key=lambda r: r[self.order]):  # one session's lines of one batch
            reset = "#" in row[self.text]
            number, current = (number + 1, "") if reset else (number, row[self.text])
            yield Row(*self.names)(key[0], row[self.order], row[self.text], number, not reset, current)
        self.state.update((number, current))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def session_stream(lines: DataFrame, session: str, order: str, text: str = "line", idle_ms: int | None = None) -> DataFrame:
    """``operators.complete.sessions`` for a streaming table of lines: (session, order, line,
    query_number, searched, current_input), whatever batches the lines come in.

    State is one number and one line for each session. With ``idle_ms`` it goes when a
    session has been idle for so long, by a timer; timers of the clock keep a stream
    running, so one that is to end by itself has none. A session's lines must come in order from batch to batch;
    within one they are sorted. Rows without a session or a line are left out. The state
    store is RocksDB, which Spark asks for here; the setting is made for the session.
    """
    spark = lines.sparkSession
    spark.conf.set(PROVIDER, ROCKSDB)
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    names = [session, order, *(f.split()[0] for f in OUTPUT.split(", "))]
    rows = lines.where(F.col(session).isNotNull() & F.col(text).isNotNull()).select(session, order, text)
    return rows.groupBy(session).transformWithState(
        statefulProcessor=_Session(session, order, text, names, idle_ms),
        outputStructType=f"`{session}` {kinds[session]}, `{order}` {kinds[order]}, {OUTPUT}",
        outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )
