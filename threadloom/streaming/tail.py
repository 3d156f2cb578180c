"""Tailing logs with Structured Streaming.

Spark's file source sees new files, not bytes added to old ones. So a live
tail either has producers land closed chunks (``read_chunks``), or reads
growing files through the ``growing_jsonl`` source of
``threadloom.streaming.growing``. Both give numbered lines; from there the batch
operators are used as they are, micro-batch by micro-batch.

What must be known from earlier batches is kept in the stream's state: names of calls (``streaming.names``), and
counters of the sessions seen lately. Counters leave the state with the watermark; what was landed of them is folded
into one table now and then.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.variants import array_of
from threadloom.operators.messages import classify, is_conversational, item_type, tool_call_count
from threadloom.operators.records import KEYS, TOKEN_FIELDS, decode
from threadloom.session import FILE_LOG_SETTINGS, delete, new_folder, scratch
from threadloom.streaming import chunks
from threadloom.streaming.growing import register_source
from threadloom.streaming.names import DAY_MS, STATE_SETTINGS, named_results

POLL = "500 milliseconds"

#: Counters are a short row per session seen lately: few partitions hold them, and every tick opens and commits each.
COUNTER_SETTINGS = {"spark.sql.shuffle.partitions": "12"}

FILE_MANAGER = "spark.sql.streaming.checkpointFileManagerClass"
LOCAL_SETTINGS = {FILE_MANAGER: "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"}


def read_chunks(spark: SparkSession, root: str, max_files: int = 1000, index: str | None = None) -> DataFrame:
    """Stream of closed chunks ``<root>/<project>/<session>/<name>-<first>.jsonl``, at most ``max_files`` a tick.

    A chunk is complete when it appears, and is named after the number of its first
    line, so its lines have the numbers of the whole log. A chunk is one row until it is cut into lines.

    ``index`` names a folder for this query's offsets, kept with its checkpoint; the driver then holds no list of chunks (``streaming.chunks``).
    Such a stream runs tick by tick: ``availableNow`` takes a single tick of it. Without it Spark's file source keeps the names in the checkpoint and on the driver's heap.
    """
    if index:
        chunks.register_source(spark)
        files = spark.readStream.format("closed_chunks").options(index=index, maxFilesPerTrigger=max_files).load(root)
        files = files.select("path", F.col("value").cast("string").alias("value"))
    else:
        source = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files)
        files = source.load(f"{root}/*/*/*.jsonl").select(F.col("_metadata.file_path").alias("path"), "value")
    path = F.col("path")
    keys = r"([^/]+)/([^/]+)/[^/]*?(\d+)\.jsonl$"
    return (
        files
        .select(
            F.regexp_extract(path, keys, 1).alias("project_key"), F.regexp_extract(path, keys, 2).alias("session_id"),
            F.regexp_extract(path, keys, 3).cast("bigint").alias("first"), F.posexplode(F.split("value", "\n", -1)).alias("at", "value"),
        )
        .select(*KEYS, (F.col("first") + F.col("at")).alias("line_no"), "value")
    )


def read_growing(spark: SparkSession, root: str, index: str | None = None, **options) -> DataFrame:
    """Stream of the lines of files that grow.

    ``index`` names a folder for this query's offsets and line numbers; a query that is to go on after a restart needs the
    same one again. Without it the folder goes with what the job staged.
    """
    register_source(spark)
    return spark.readStream.format("growing_jsonl").options(index=index or new_folder(spark), **options).load(root)


def _first_is_result() -> Column:
    return F.coalesce(item_type(F.get(array_of(F.col("content")), F.lit(0))) == "tool_result", F.lit(False))


def tail_messages(lines: DataFrame) -> DataFrame:
    """What a tail shows: conversational records, no meta, no compact summaries, classified."""
    kind = F.when(F.col("type") == "assistant", "assistant").when(_first_is_result(), "result").otherwise("user")
    return (
        decode(lines)
        .where(is_conversational() & ~F.col("is_meta") & ~F.col("is_compacted"))
        .withColumn("tail_kind", kind)
        .withColumn("is_agent", (F.col("type") == "assistant") & F.col("is_sidechain"))
    )


def _classified(lines: DataFrame) -> DataFrame:
    return classify(decode(lines).withColumn("talk", is_conversational()))


def _counters() -> list[Column]:
    talk = F.col("talk")
    prompt = talk & (F.col("kind") == "user_prompt")
    return [
        F.count_if(prompt | (talk & (F.col("kind") == "assistant"))).alias("message_count"),
        F.count_if(prompt).alias("user_prompts"),
        F.coalesce(F.sum(F.when(talk, tool_call_count(F.col("items")))), F.lit(0).cast("bigint")).alias("tool_calls"),
        F.count_if(talk & F.col("is_compacted")).alias("continuations"),
        F.count_if(talk & F.col("is_sidechain")).alias("agent_sidechains"),
        *[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in TOKEN_FIELDS],
    ]


def running_stats(lines: DataFrame) -> DataFrame:
    """Session counters of some lines (sums and counts only)."""
    return _classified(lines).groupBy(*KEYS).agg(*_counters())


def counted_sessions(stream: DataFrame, span: str = "1 hour") -> DataFrame:
    """Stream of the counters of each session in the span of time its lines arrived in, as they change.

    For update mode. Lines are dated by the start of their batch, so none is late, and a span's counters leave the
    state once the watermark has passed it: the state holds the sessions of the last two spans, however many there were before.
    """
    seen = _classified(stream).withColumn("seen", F.current_timestamp()).withWatermark("seen", span)
    counted = seen.groupBy(*KEYS, F.window("seen", span)).agg(*_counters())
    return counted.withColumn("span", F.unix_micros("window.start")).drop("window")


def current_stats(landed: DataFrame) -> DataFrame:
    """Counters per session over all landed batches: the last of every span, added up."""
    counters = [c for c in landed.columns if c not in (*KEYS, "span", "batch")]
    return last_counters(landed).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in counters])


def last_counters(landed: DataFrame) -> DataFrame:
    """The last row of every session and span; the rest is outdated."""
    counters = [c for c in landed.columns if c not in (*KEYS, "span", "batch")]
    last = landed.groupBy(*KEYS, "span").agg(F.max_by(F.struct(*counters), "batch").alias("c"), F.max("batch").alias("batch"))
    return last.select(*KEYS, "span", *(f"c.{c}" for c in counters), "batch")


def _local_settings(spark: SparkSession, checkpoint: str) -> dict[str, str]:
    """For a checkpoint on a local disk, where the usual file manager starts a process for several steps of every file of a tick.

    The one over ``FileSystem`` renames a finished file just as well there. Other stores, and a manager the session names, keep theirs.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    local = path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    return LOCAL_SETTINGS if local and spark.conf.get(FILE_MANAGER, None) is None else {}


def land(stream: DataFrame, apply: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, trigger: dict | None = None, mode: str = "append"):
    """Start writing ``apply`` of every micro-batch as a folder of its own; a repeated batch overwrites its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        apply(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with settings(stream.sparkSession, _local_settings(stream.sparkSession, checkpoint)):
        return (
            stream.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": POLL}))
            .outputMode(mode)
            .foreachBatch(write)
            .start()
        )


def land_result_names(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, keep_ms: int = 7 * DAY_MS, buckets: int = 256):
    """Start landing tool results with the name of the tool that gave them, ``result`` where it is unknown."""
    with settings(stream.sparkSession, STATE_SETTINGS):
        return land(named_results(stream, keep_ms, buckets), lambda named: named, out, checkpoint, trigger)


def land_running_stats(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, span: str = "1 hour"):
    """Start landing the counters of the sessions a batch changes; ``current_stats`` reads them."""
    with settings(stream.sparkSession, COUNTER_SETTINGS):
        return land(counted_sessions(stream, span), lambda changed: changed, out, checkpoint, trigger, "update")


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings for the queries started inside; a query keeps those it was started with."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def fold_landed(spark: SparkSession, out: str, schema: str, merge: Callable[[DataFrame], DataFrame] = lambda landed: landed) -> None:
    """Write what was landed so far as one table, less what ``merge`` drops, and delete the folders it replaces.

    A fold is named after the last batch in it and counts once its success mark is there, so one that was cut short changes
    nothing. Readers that had listed the old folders must list again. For finished batches: run it between queries, or from the thread that runs them.
    """
    names = _folders(spark, out)
    if not names:
        return
    last = max(number for _, number in names)
    merge(read_landed(spark, out, schema)).write.mode("overwrite").parquet(f"{out}/folded-{last}")
    for name, number in names:
        if number <= last and name != f"folded-{last}":
            delete(spark, f"{out}/{name}")


def _folders(spark: SparkSession, out: str) -> list[tuple[str, int]]:
    """Names of the finished folders below, and the batch they are numbered after."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    names = [f.getPath().getName() for f in store.listStatus(path)]
    numbered = [(n, re.fullmatch(r"(?:batch=|folded-)(\d+)", n)) for n in names]
    done = [(n, int(m.group(1))) for n, m in numbered if m and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{n}/_SUCCESS"))]
    return sorted(done)


def read_landed(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """What was landed so far, the newest fold and the batches after it; nothing landed gives no rows."""
    folders = _folders(spark, out)
    fold = max((n for name, n in folders if name.startswith("folded-")), default=None)
    whole = spark.createDataFrame([], f"{schema}, batch bigint")
    if fold is not None:
        whole = spark.read.schema(whole.schema).parquet(f"{out}/folded-{fold}")
    later = [f"{out}/{name}" for name, n in folders if name.startswith("batch=") and (fold is None or n > fold)]
    if later:
        landed = spark.read.schema(whole.schema).option("basePath", out).parquet(*later)
        whole = whole.unionAll(landed) if fold is not None else landed
    return whole


def replay(stream: DataFrame, start: Callable[..., object], out_schema: str, ticks: bool = False) -> DataFrame:
    """Run a stream until all there is has been read, and return what it landed.

    ``start`` is called as ``start(stream, out=..., checkpoint=..., trigger=...)``. With ``ticks`` the stream runs tick by tick,
    as a source that gives out a bounded part at a time asks for. The stream's own files are deleted at once, what it landed with the scope.
    """
    spark = stream.sparkSession
    out = new_folder(spark)
    # The file source reads its setting when the query's own thread makes it, so it holds until the end.
    with scratch(spark), settings(spark, FILE_LOG_SETTINGS):
        query = start(stream, out=out, checkpoint=new_folder(spark), trigger={"processingTime": "0 seconds"} if ticks else {"availableNow": True})
        if ticks:
            query.processAllAvailable()
            query.stop()
        query.awaitTermination()
    return read_landed(spark, out, out_schema)
