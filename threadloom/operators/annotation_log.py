"""The log of star and tag events as a folder that grows by parts.

An append writes one new part, split by kind (``events`` or the quarantine ``rejected``) and by block of event numbers, and
then a small manifest that names the parts in force. Readers follow the newest manifest, so an append that is cut short
leaves the state before it. Which events are there already is looked up in the blocks the new ones fall in, so an
append does not read the history. ``compact_log`` folds all parts into one.

One writer at a time; any number of readers.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.annotations import STAR_ACTIONS, STAR_KEY, TAG_ACTIONS, is_valid
from threadloom.session import delete, scratch, stage
from threadloom.sources.stores import open_store, read_json, write_json

#: Event numbers that stand side by side in a block, and the number of blocks they are dealt to in turn.
BLOCK, BLOCKS = 1 << 16, 256
KINDS = ("events", "rejected")


def _block(seq: Column) -> Column:
    return F.coalesce(F.pmod(F.floor(seq / F.lit(BLOCK)), F.lit(BLOCKS)), F.lit(0)).cast("int")


def _manifests(log: str) -> tuple[fs.FileSystem, str, list[int]]:
    store, base = open_store(log)
    found = store.get_file_info(fs.FileSelector(f"{base}/manifests", allow_not_found=True))
    return store, base, sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))


def _newest(log: str) -> dict:
    store, base, numbers = _manifests(log)
    return read_json(store, f"{base}/manifests/{numbers[-1]:012d}.json") if numbers else {"schema": None, "parts": []}


def _publish(log: str, schema: T.StructType, parts: list[str]) -> None:
    store, base, numbers = _manifests(log)
    number = numbers[-1] + 1 if numbers else 0
    write_json(store, f"{base}/manifests/{number:012d}.json", {"schema": schema.json(), "parts": parts})


def _schema(state: dict) -> T.StructType | None:
    return T.StructType.fromJson(json.loads(state["schema"])) if state["schema"] else None


def _rows(spark: SparkSession, log: str, state: dict) -> DataFrame:
    """All rows of the parts in force, with ``kind`` and ``block``, which are folders."""
    schema = _schema(state)
    folders = T.StructType([T.StructField("kind", T.StringType()), T.StructField("block", T.IntegerType())])
    whole = T.StructType(schema.fields + folders.fields)
    if not state["parts"]:
        return spark.createDataFrame([], whole)
    reader = spark.read.schema(whole).option("basePath", f"{log}/parts")
    return reader.parquet(*[f"{log}/parts/part={part}" for part in state["parts"]]).drop("part")


def _write_part(rows: DataFrame, log: str) -> str:
    """A new part; a block that holds much is split over tasks, small ones share a task."""
    part = uuid.uuid4().hex
    laid = rows.hint("rebalance", "kind", "block").sortWithinPartitions("kind", "block", "seq")
    laid.write.partitionBy("kind", "block").parquet(f"{log}/parts/part={part}")
    return part


def append_events(events: DataFrame, log: str) -> None:
    """Append star and tag events to the log folder; those with a missing or unknown action go to its quarantine.

    An event is known by its ``seq``: one that is there already, or comes twice, is written once; of unlike events of
    one number that come together the least stays, column by column. Events without a number count as one of number
    NULL. Columns the log does not have yet are added to it, NULL in older events.
    """
    spark, state = events.sparkSession, _newest(log)
    known_schema = _schema(state)
    known_fields = known_schema.fields if known_schema else []
    names = {f.name for f in known_fields}
    schema = T.StructType(known_fields + [T.StructField(f.name, f.dataType) for f in events.schema.fields if f.name not in names])
    whole = F.struct(*events.columns)
    with scratch(spark):
        new = events.groupBy("seq").agg(F.min(whole).alias("e")).select(*(F.col(f"e.{c}").alias(c) for c in events.columns))
        kind = F.when(is_valid(), KINDS[0]).otherwise(KINDS[1])
        new = stage(new.withColumns({"kind": kind, "block": _block(F.col("seq"))}))
        if state["parts"]:
            # At most one row per block, of which there are 256.
            touched = [r.block for r in new.select("block").distinct().collect()]
            known = _rows(spark, log, state).where(F.col("block").isin(touched)).select(
                F.col("kind").alias("known_kind"), F.col("seq").alias("known_seq")
            )
            same = F.col("seq").eqNullSafe(F.col("known_seq")) & (F.col("kind") == F.col("known_kind"))
            new = new.join(known, same, "left_anti")
        part = _write_part(new, log)
    _publish(log, schema, [*state["parts"], part])


def read_log(spark: SparkSession, log: str, name: str = "events") -> DataFrame | None:
    """The log, or with ``rejected`` its quarantine; None before the first append."""
    state = _newest(log)
    if state["schema"] is None:
        return None
    return _rows(spark, log, state).where(F.col("kind") == name).drop("kind", "block")


def deciding_events(log: DataFrame) -> DataFrame:
    """The events that current stars, tags of items and the tags ever given hang on; the same answers follow from them.

    The last action per star and per tag of an item, and the first mention of every tag. Numbers alone are
    aggregated, so that counting is by hash and a much-starred item costs one row per map task.
    """
    star, tag = F.col("action").isin(*STAR_ACTIONS), F.col("action").isin(*TAG_ACTIONS)
    kept = (
        log.where(star).groupBy(*STAR_KEY).agg(F.max("seq").alias("seq")).select("seq")
        .unionAll(log.where(tag).groupBy(*STAR_KEY, "tag").agg(F.max("seq").alias("seq")).select("seq"))
        .unionAll(log.where(F.col("action") == TAG_ACTIONS[0]).groupBy("tag").agg(F.min("seq").alias("seq")).select("seq"))
        .where("seq is not null")
    )
    return log.where("seq is not null").join(kept, "seq", "left_semi").unionByName(log.where("seq is null"))


def compact_log(spark: SparkSession, log: str, *, history: bool = True) -> None:
    """Fold the parts into one, by default with every event.

    Without ``history`` events that decide nothing any more are left out. What is derived from the log stays the same,
    also when such an event is delivered again: a later action of its item outlives it. The quarantine is kept whole.
    """
    state = _newest(log)
    if state["schema"] is None:
        return
    rows = _rows(spark, log, state)
    if not history:
        rejected = F.col("kind") == KINDS[1]
        rows = deciding_events(rows.where(~rejected)).unionByName(rows.where(rejected))
    _publish(log, _schema(state), [_write_part(rows, log)])


def sweep_log(spark: SparkSession, log: str) -> None:
    """Delete parts that the newest manifest does not name, and older manifests. No reader or writer may be at work on them."""
    state = _newest(log)
    store, base, numbers = _manifests(log)
    for number in numbers[:-1]:
        store.delete_file(f"{base}/manifests/{number:012d}.json")
    for found in store.get_file_info(fs.FileSelector(f"{base}/parts", allow_not_found=True)):
        if found.base_name.removeprefix("part=") not in state["parts"]:
            delete(spark, f"{log}/parts/{found.base_name}")
