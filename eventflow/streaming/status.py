"""Entities kept up to date from a stream of status events, in keyed streaming state.

The state is the entity's JSON document. It starts from the stored entities, survives restarts with the
stream's checkpoint, and each event merges into it what ``state.status_documents`` merges in batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "position bigint, entity string, action string, data string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StatusProcessor(StatefulProcessor):
    """One entity's document. The events of a micro-batch are put in order here, so that the trigger's
    limit on files bounds what is held for one entity."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("document", "data string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.stored.update((initialState["data"].iloc[-1],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.stored.get() if self.stored.exists() else None
        known = None if held is None else as_object(held[0])
        out = []
        events = [r for part in rows for r in part[["position", "entity_id", "status", "message", "at"]].itertuples(index=False, name=None)]
        for position, entity_id, status, message, at in sorted(events, key=lambda e: e[0]):
            action = "create" if known is None else "update"
            known = {"id": entity_id, "created_at": at} if known is None else known
            known |= {"status": status, "last_update": at, "message": message}
            out.append((position, key[0], action, json.dumps(known, ensure_ascii=False, separators=(",", ":"))))
        self.stored.update((out[-1][-1],))
        yield pd.DataFrame(out, columns=["position", "entity", "action", "data"])

    def close(self) -> None:
        pass


def as_object(text: str) -> dict:
    """A JSON object; anything else counts as an empty one."""
    try:
        value = json.loads(text)
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def keep_status(updates: DataFrame, position: str, stored: DataFrame, folder: str) -> str:
    """Merge everything available of a stream of ``entity_id, status, message, ts`` into entities, on top
    of the ``stored`` ones (``entity, data``); returns the path of the resulting documents, one row for
    each event. The stored entities are read when the stream first starts; later its own state counts.
    """
    events = updates.where(F.col("entity_id").isNotNull()).select(
        F.concat(F.lit("entity-"), "entity_id").alias("entity"),
        F.col(position).cast("bigint").alias("position"),
        "entity_id",
        "status",
        "message",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
    )
    merged = events.groupBy("entity").transformWithStateInPandas(
        StatusProcessor(), OUTPUT, "Append", "None", initialState=stored.select("entity", "data").groupBy("entity")
    )
    conf, sink = updates.sparkSession.conf, f"{folder}/documents"
    earlier = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKSDB)  # the only provider with this kind of state
    try:
        writer = merged.writeStream.format("parquet").outputMode("append").option("path", sink)
        writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(_PROVIDER, earlier)
    return sink
