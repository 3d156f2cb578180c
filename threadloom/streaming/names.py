"""Names of tool results as they arrive, from calls kept in keyed state.

Calls and results of a (session, tool id) meet in one bucket, and a bucket's state holds the last name of
each of its ids, with a time to live. A batch reads and writes only the ids it brings, so its cost does not
depend on what came before. Buckets are dealt by the hash of session and id, so the calls of one busy session spread over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadloom.operators.messages import build_messages, explode_blocks
from threadloom.operators.records import KEYS, decode

NAMED = "project_key string, session_id string, line_no bigint, block_no bigint, tool_id string, tool_name string"
ID = ["project_key", "session_id", "tool_id"]
UNKNOWN = "result"
DAY_MS = 86_400_000

#: Settings of a query that keeps such state: the store that can hold it, and no batches without data.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class LastNames(StatefulProcessor):
    """Gives each result of a bucket the name of the last call of its id, of this batch or an earlier one."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getMapState("names", "project_key string, session_id string, tool_id string", "tool_name string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        is_call = batch["block_type"] == "tool_use"
        known = batch["tool_id"].notna() & (batch["tool_id"] != "")
        calls = batch[is_call & known].sort_values(["line_no", "block_no"]).drop_duplicates(ID, keep="last")
        fresh = {}
        for *id, name in calls[[*ID, "tool_name"]].itertuples(index=False, name=None):
            fresh[tuple(id)] = name = name if isinstance(name, str) else None
            self.names.updateValue(tuple(id), (name,))
        results = batch[~is_call]
        if len(results):
            looked = {id: fresh[id] if id in fresh else self._kept(id) for id in set(results[known[results.index]][ID].itertuples(index=False, name=None))}
            names = [looked.get(id) or UNKNOWN for id in results[ID].itertuples(index=False, name=None)]
            yield results[[*KEYS, "line_no", "block_no", "tool_id"]].assign(tool_name=names)

    def _kept(self, id: tuple) -> str | None:
        found = self.names.getValue(id)
        return found[0] if found is not None else None

    def close(self) -> None:
        pass


def named_results(lines: DataFrame, keep_ms: int = 7 * DAY_MS, buckets: int = 256) -> DataFrame:
    """Stream of tool results with the name of the tool that gave them, ``result`` where no call is known.

    A result comes out in the batch it arrives in. A call is known for ``keep_ms`` after it arrived; calls without an id name nothing.
    """
    blocks = explode_blocks(build_messages(decode(lines))).where("block_type in ('tool_use', 'tool_result')")
    narrow = blocks.select(*KEYS, "line_no", "block_no", "block_type", "tool_id", "tool_name")
    id = F.coalesce(F.when(F.col("tool_id") != "", F.col("tool_id")), F.col("line_no").cast("string"))
    return (
        narrow.withColumn("bucket", F.pmod(F.xxhash64(*KEYS, id), F.lit(buckets))).groupBy("bucket")
        .transformWithStateInPandas(LastNames(keep_ms), NAMED, "append", "ProcessingTime")
    )
