"""The persisted tables of an organisation's logs, built once and read by every query.

``records`` holds every line once, parsed, with its content; all other tables
are narrow or small:

==================  ==========================================================
``records``         lines as records of both profiles, and the rejected ones
``tree``            tree index of all messages
``tool_calls``      calls paired with their last result
``sessions``        detail profile
``listed_sessions`` listing profile, what a listing shows
``projects``        projects of the listed sessions
``_logs``           the logs the tables were made from, with size and time
==================  ==========================================================
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.messages import build_messages, explode_blocks
from threadloom.operators.records import KEYS, ingest, records_for, rejected
from threadloom.operators.sessions import listable, project_table, session_table
from threadloom.operators.tool_calls import pair_calls
from threadloom.operators.tree import build_tree
from threadloom.sources.sinks import write_table
from threadloom.session import delete, scratch, stage
from threadloom.sources.transcripts import list_logs, scan_transcripts


def build_lake(
    spark: SparkSession, root: str, out: str, *, projects: Sequence[str] | None = None, strict: bool = False,
    cap: int | None = None, policy: str = "skip_line",
) -> None:
    """Scan ``root`` and write every table below ``out``.

    The logs are read and parsed once; each later step reads the columns it
    needs of what was written. ``project_key`` is the partition column, so a
    query for one project prunes the rest. ``projects`` limits the scan. What is staged on the way is deleted as soon as
    the tables it went into are written.
    """
    with scratch(spark):
        # Listed first: what changes while the logs are read is taken for changed by the next update.
        logs = list_logs(spark, root)
        if projects is not None:
            logs = logs.where(F.col("project_key").isin(list(projects)))
        _save(spark, out, "records", ingest(scan_transcripts(spark, root, projects=projects).drop("file_path"), strict=strict, cap=cap))
        _save_derived(spark, out, policy)
        logs.write.mode("overwrite").parquet(f"{out}/_logs")


def update_lake(
    spark: SparkSession, root: str, out: str, *, strict: bool = False, cap: int | None = None, policy: str = "skip_line"
) -> int:
    """Bring a lake up to date with its logs; gives the number of logs opened.

    Logs of another size or time than at the last update, and new ones, are read and parsed; the other sessions of their projects
    keep the records they have. The tables of these projects are made anew from the records, all other projects are left as they
    are. The list of logs is written last, so an update that was cut short is done again by the next. One writer at a time.
    """
    with scratch(spark):
        now = list_logs(spark, root)
        known = spark.read.schema(now.schema).parquet(f"{out}/_logs")
        same = now.join(known, ["path", "size", "modified"], "left_semi").select("path")
        changed = stage(now.join(same, "path", "left_anti"))
        gone = known.join(now, "path", "left_anti")
        touched = stage(changed.select(*KEYS).unionAll(gone.select(*KEYS)).distinct())
        projects = [r.project_key for r in touched.select("project_key").distinct().collect()]
        if not projects:
            return 0
        paths = [r.path for r in changed.select("path").collect()]  # the logs to open
        fresh = ingest(scan_transcripts(spark, root, only=paths).drop("file_path"), strict=strict, cap=cap)
        here = F.col("project_key").isin(projects)
        kept = read_table(spark, out, "records").where(here).join(touched, KEYS, "left_anti")
        _save(spark, out, "records", stage(kept.unionByName(fresh)), projects)
        _save_derived(spark, out, policy, projects)
        now.write.mode("overwrite").parquet(f"{out}/_logs")
        return len(paths)


def _save(spark: SparkSession, out: str, name: str, df: DataFrame, projects: Sequence[str] | None = None) -> DataFrame:
    """Write a table, or these projects of it."""
    if projects is None:
        write_table(df, f"{out}/{name}")
        # The schema is kept beside the tables: a table may be empty, and project
        # keys are text also where they look like numbers.
        spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/_schemas/{name}")
    else:
        df = stage(df)
        write_table(df, f"{out}/{name}", "dynamic")
        left = {r.project_key for r in df.select("project_key").distinct().collect()}
        escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for project in set(projects) - left:
            delete(spark, f"{out}/{name}/project_key={escaped(project)}")
    return read_table(spark, out, name)


def _save_derived(spark: SparkSession, out: str, policy: str, projects: Sequence[str] | None = None) -> None:
    """The tables that come from the records, of all projects or these."""
    def records(profile: str) -> DataFrame:
        found = read_records(spark, out, profile, policy)
        return found if projects is None else found.where(F.col("project_key").isin(list(projects)))

    with scratch(spark):
        detail = records("detail")
        _save(spark, out, "tree", build_tree(detail), projects)
        _save(spark, out, "tool_calls", pair_calls(explode_blocks(build_messages(detail))), projects)
        _save(spark, out, "sessions", session_table(detail, "detail"), projects)
        listed = _save(spark, out, "listed_sessions", listable(session_table(records("listing"), "listing")), projects)
        listed = listed if projects is None else listed.where(F.col("project_key").isin(list(projects)))
        _save(spark, out, "projects", project_table(listed), projects)


def read_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{out}/_schemas/{name}").first()[0]))
    return spark.read.schema(schema).parquet(f"{out}/{name}").select(*schema.names)


def read_records(spark: SparkSession, out: str, profile: str = "detail", policy: str = "skip_line") -> DataFrame:
    return records_for(read_table(spark, out, "records"), profile, policy)


def read_messages(spark: SparkSession, out: str) -> DataFrame:
    """Messages with their content; classified on reading, which costs no shuffle."""
    return build_messages(read_records(spark, out))


def read_rejected(spark: SparkSession, out: str) -> DataFrame:
    return rejected(read_table(spark, out, "records"))
