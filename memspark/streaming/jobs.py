"""Ingest, reflection triggers and session memory as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memspark.config import DEFAULTS
from memspark.operators.ingest import ingest


def stream_ingest(observations: DataFrame, as_of: Column, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Valid memories of a stream of observations, appended to a Parquet table. Without state: a row's memory depends on it alone."""
    valid, _ = ingest(observations, as_of)
    writer = valid.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def reflection_triggers(memories: DataFrame, every: int = DEFAULTS.reflect_every) -> DataFrame:
    """user_id, namespace, n: a row each time the running count of active memories reaches a multiple of ``every``; the state is one counter."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        now = before + sum(len(f) for f in frames)
        state.update((now,))
        reached = range((before // every + 1) * every, now + 1, every)
        yield pd.DataFrame({"user_id": [key[0]] * len(reached), "namespace": [key[1]] * len(reached), "n": list(reached)})

    active = memories.filter("status = 'active'").select("user_id", "namespace")
    return active.groupBy("user_id", "namespace").applyInPandasWithState(count, "user_id string, namespace string, n long", "n long", "append", GroupStateTimeout.NoTimeout)


def session_memory(events: DataFrame, tool_outputs: int = DEFAULTS.tool_outputs, idle: str | None = "1 hour") -> DataFrame:
    """session_id, n_events, turns (role, content) and tool_outputs (tool, output): the session after each micro-batch that touches it.

    Turns are all kept, in order of seq within a micro-batch; of tool outputs the last ones. The state goes after ``idle``, so it
    is bounded by what a session says before it falls silent. The row with the most events is a session's latest. A job that
    drains its source and ends (availableNow) takes None: waiting for idle sessions it would not end.
    """
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, roles, said, tools, outputs = (state.get[0], *map(list, state.get[1:])) if state.exists else (0, [], [], [], [])
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        turns, own = rows[rows["kind"] == "turn"], rows[rows["kind"] == "tool"]
        n += len(rows)
        roles, said = roles + turns["role_or_tool"].tolist(), said + turns["content"].tolist()
        tools, outputs = (tools + own["role_or_tool"].tolist())[-tool_outputs:], (outputs + own["content"].tolist())[-tool_outputs:]
        state.update((n, roles, said, tools, outputs))
        if milliseconds:
            state.setTimeoutDuration(milliseconds)
        pairs = lambda a, b, x, y: [{a: i, b: j} for i, j in zip(x, y)]
        yield pd.DataFrame({"session_id": [key[0]], "n_events": [n], "turns": [pairs("role", "content", roles, said)], "tool_outputs": [pairs("tool", "output", tools, outputs)]})

    found = "session_id string, n_events long, turns array<struct<role:string,content:string>>, tool_outputs array<struct<tool:string,output:string>>"
    kept = "n long, roles array<string>, said array<string>, tools array<string>, outputs array<string>"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if milliseconds else GroupStateTimeout.NoTimeout
    return events.groupBy("session_id").applyInPandasWithState(fold, found, kept, "update", timeout)


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """What session_updates() needs of the session in which its query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _SessionUpdates(StatefulProcessor):
    """State of a session: how many events it had, and its last tool outputs; both expire when it is idle."""

    def __init__(self, tool_outputs: int, idle_ms: int | None):
        self.tool_outputs, self.idle_ms = tool_outputs, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getValueState("events", "n long", self.idle_ms)
        self.outputs = handle.getListState("outputs", "tool string, output string", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        n = (self.events.get()[0] if self.events.exists() else 0) + len(new)
        turns, tools = new[new["kind"] == "turn"], new[new["kind"] == "tool"]
        held = [tuple(x) for x in self.outputs.get()] if self.outputs.exists() else []
        held = [*held, *zip(tools["role_or_tool"], tools["content"])][-self.tool_outputs :]
        self.events.update((n,))
        if held:
            self.outputs.put(held)
        pairs = lambda a, b, rows: [{a: x, b: y} for x, y in rows]
        yield pd.DataFrame({"session_id": [key[0]], "n_events": [n], "turns": [pairs("role", "content", zip(turns["role_or_tool"], turns["content"]))], "tool_outputs": [pairs("tool", "output", held)]})

    def close(self) -> None:
        pass


def session_updates(events: DataFrame, tool_outputs: int = DEFAULTS.tool_outputs, idle: str | None = "1 hour") -> DataFrame:
    """session_id, n_events, turns (role, content) and tool_outputs (tool, output): what a micro-batch adds to each session that it touches.

    ``turns`` are those of the micro-batch, in order of seq, so all output together is as long as the events; whole_sessions() joins
    them. The state is one number and the last tool outputs, which expire after ``idle`` (None: never).
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    found = "session_id string, n_events long, turns array<struct<role:string,content:string>>, tool_outputs array<struct<tool:string,output:string>>"
    return events.groupBy("session_id").transformWithStateInPandas(_SessionUpdates(tool_outputs, idle_ms), found, "Update", "ProcessingTime" if idle_ms else "None")


def whole_sessions(updates: DataFrame) -> DataFrame:
    """session_id, n_events, turns and tool_outputs of each session from all its updates; a session that begins anew after it was idle counts as one."""
    rows = F.array_sort(F.collect_list(F.struct("n_events", "turns")))
    return updates.groupBy("session_id").agg(F.max("n_events").alias("n_events"), F.flatten(F.transform(rows, lambda x: x["turns"])).alias("turns"), F.max_by("tool_outputs", "n_events").alias("tool_outputs"))
