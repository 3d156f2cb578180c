"""Log files as lines: scan, keys from paths, line numbers, persisted lake tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators.records import KEYS
from threadloom.operators.scans import running
from threadloom.session import new_folder, stage

#: Files that one read lists, side files included; more only where a single project has them.
FILES_AT_ONCE = 20_000
LISTERS = 16

_EMPTY = "project_key string, session_id string, file_path string, line_no bigint, value string"


def path_keys(path: Column) -> tuple[Column, Column]:
    """Project (parent folder) and session (file name without ending) of a log path."""
    # No pattern: one that may begin anywhere in the path costs many times what all else does to a short line.
    name = F.substring_index(path, "/", -1)
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    is_log = F.contains(path, F.lit("/")) & (folder != "") & name.endswith(".jsonl") & (F.length(name) > len(".jsonl"))
    return F.when(is_log, folder).otherwise(""), F.when(is_log, F.left(name, F.length(name) - len(".jsonl"))).otherwise("")


def _depth(path: str) -> int:
    return len(re.sub(r"^[a-z0-9]+:/*", "", path).strip("/").split("/"))


def _existing_each(spark: SparkSession, folders: Sequence[str]) -> list[str | None]:
    """The folders as paths in which no character is a pattern, None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    found = [path(f).getFileSystem(conf).exists(path(f)) for f in folders]
    return [re.sub(r"([{}\[\]*?\\])", r"\\\1", f) if there else None for f, there in zip(folders, found)]


def _existing(spark: SparkSession, folders: Sequence[str]) -> list[str]:
    return [f for f in _existing_each(spark, folders) if f is not None]


def _side_file(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return name.startswith("agent-") & name.endswith(".jsonl")


def _at_depth(path: Column, root: str) -> Column:
    return F.size(F.split(F.regexp_replace(path, "^[a-z0-9]+:/*", ""), "/")) == _depth(root) + 2


def _hidden(name: str) -> bool:
    """Names Spark leaves out when it lists a folder."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _groups(spark: SparkSession, root: str, projects: Sequence[str] | None, only: Sequence[str] | None) -> list[list[str]]:
    """What is to be read, some ``FILES_AT_ONCE`` files at a time: folders of projects, or the files themselves.

    A read keeps every file it lists on the driver, at some kilobytes each, so all projects are never listed in one. A folder is the least that can be.
    """
    if only is not None:
        found = _existing(spark, only)
        return [found[at : at + FILES_AT_ONCE] for at in range(0, len(found), FILES_AT_ONCE)]
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    if projects is None:
        store = path(root).getFileSystem(conf)
        inside = store.listStatus(path(root)) if store.exists(path(root)) else []
        projects = sorted(s.getPath().getName() for s in inside if s.isDirectory())
        projects = [p for p in projects if not _hidden(p)]
    folders = [f"{root}/{p}" for p in projects]
    exist = dict(zip(folders, _existing_each(spark, folders)))

    def n_files(folder: str) -> int:
        return len(path(folder).getFileSystem(conf).listStatus(path(folder)))

    groups, held = [], 0
    wanted = [f for f in dict.fromkeys(folders) if exist[f] is not None]
    with ThreadPoolExecutor(LISTERS) as pool:
        for folder, n in zip(wanted, pool.map(n_files, wanted)):
            if not groups or held + n > FILES_AT_ONCE:
                groups.append([])
                held = 0
            groups[-1].append(exist[folder])
            held += n
    return groups


def _staged_by(spark: SparkSession, groups: list[list[str]], read: Callable[[list[str]], DataFrame]) -> DataFrame:
    """``read`` of all groups as one staged table."""
    out = new_folder(spark)
    for group in groups:
        found = read(group)
        found.write.mode("append").parquet(out)
    return spark.read.schema(found.schema).parquet(out)


def list_logs(spark: SparkSession, root: str) -> DataFrame:
    """``project_key``, ``session_id``, ``path``, ``size`` and ``modified`` of every log, staged; none is opened."""
    groups = _groups(spark, root.rstrip("/"), None, None)
    if not groups:
        return spark.createDataFrame([], "project_key string, session_id string, path string, size bigint, modified timestamp")
    path = F.col("path")
    project, session = path_keys(path)

    def read(folders: list[str]) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(folders)
        return files.where(_at_depth(path, root.rstrip("/")) & ~_side_file(path)).select(
            project.alias("project_key"), session.alias("session_id"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")
        )

    return _staged_by(spark, groups, read)


def scan_transcripts(
    spark: SparkSession, root: str, *, projects: Sequence[str] | None = None, with_side_files: bool = False,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Every ``<root>/<project>/<session>.jsonl`` as numbered lines from 0.

    ``projects`` names the project folders to read; others are not even listed. A missing root or project, or one
    without logs, gives no rows. ``only`` names the files to read instead, as ``list_logs`` gives them. Folders that look like a log
    file are left out. The logs are read once, into a staged table from which all that follows is taken.
    """
    root = root.rstrip("/")
    groups = _groups(spark, root, projects, only)
    if not groups:
        return spark.createDataFrame([], _EMPTY)
    path = F.col("_metadata.file_path")
    # Folders are listed, in parallel, not files one by one. These filters only
    # look at the path, so files that fail them are never opened.
    at_depth, side_file = _at_depth(path, root), _side_file(path)

    def read(folders: list[str]) -> DataFrame:
        files = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(folders)
        return files.where(at_depth if with_side_files else at_depth & ~side_file).select(
            path.alias("raw_path"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("scan_pos"),
            "value",
        )

    return number_lines(_staged_by(spark, groups, read)).select(*KEYS, "file_path", "line_no", "value")


def number_lines(raw: DataFrame) -> DataFrame:
    """Line numbers over input splits without moving the lines.

    ``raw`` is a written table, so splits and positions are those of one scan, whatever the settings
    are when it is read. Within a split the scan position counts the lines. One row per split says
    how many lines came before it and where it starts; this table is written too,
    so that its size is known and a small one is broadcast to the lines.
    """
    key = ["raw_path", "split"]
    splits = raw.groupBy(*key).agg(F.min("scan_pos").alias("first_pos"), F.count("*").alias("n"))
    before = Window.partitionBy("raw_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_pos")
    readable = F.url_decode(F.replace("raw_path", F.lit("+"), F.lit("%2B")))
    project, session = path_keys(F.col("file_path"))
    starts = stage(
        splits.select(*key, shift.alias("shift"), readable.alias("file_path")).select(
            *key, "shift", "file_path", project.alias("project_key"), session.alias("session_id")
        )
    )
    return raw.join(starts, key).withColumn("line_no", F.col("scan_pos") + F.col("shift"))


def line_ordinals(lines: DataFrame) -> DataFrame:
    """Add ``ordinal``: dense position of a line in its session, from 0."""
    return running(lines, KEYS, "line_no", {"ordinal": ("sum", F.lit(1).cast("bigint"), "before")}).withColumn(
        "ordinal", F.coalesce("ordinal", F.lit(0).cast("bigint"))
    )
