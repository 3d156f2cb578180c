"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every headline query runs its whole path, from the tables through the log lines to the
result, and writes all result columns to the no-op sink; ``value`` is their sum. Beside them,
``lake`` has the seconds to build the lake of the same logs once and to answer the views from it, as a user would,
and ``rates`` the messages per second of the readers on a larger input: every session of the given table ``COPIES`` times
under new ids. ``input`` says how large the inputs are.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import records, search, sessions, tree, views
from threadloom.plans import catalog, lake
from threadloom.plans.catalog import QUERIES
from threadloom.session import build_session, new_folder, scratch, stage
from threadloom.sources import bridges

HEADLINE = [
    "session_stats_detail", "session_stats_listing", "token_usage", "project_listing", "recent_sessions", "dfs_order",
    "subtree_prune_compact", "threads", "nav_groups", "tool_call_results", "tool_preview", "compact_reparent",
    "content_first_hit", "search_global", "faceted_search", "relevance_score", "snippets", "stars_current", "item_tags",
    "export_markdown", "export_json",
]
COPIES = 100


def timed(make: Callable[[], DataFrame]) -> float:
    started = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def lake_rows(spark, folder: str) -> dict[str, float]:
    logs, out = new_folder(spark), new_folder(spark)
    bridges.write_logs(catalog.chat_lines(spark, folder), logs)
    started = time.perf_counter()
    lake.build_lake(spark, logs, out)
    seconds = {"build": round(time.perf_counter() - started, 3)}
    read = lambda name: lake.read_table(spark, out, name)
    talk = lambda: lake.read_messages(spark, out)
    asks = {
        "project_listing": lambda: sessions.list_projects(read("projects")),
        "recent_sessions": lambda: sessions.recent_sessions(read("listed_sessions"), read("projects"), 25),
        "dfs_order": lambda: read("tree").select("session_id", "line_no", "dfs_pos"),
        "subtree_prune": lambda: tree.visible(read("tree")),
        "threads": lambda: views.threads(read("tree")),
        "nav_groups": lambda: views.nav_groups(read("tree")),
        "content_first_hit": lambda: search.content_hits(read("tree"), talk(), [catalog.WORD]),
        "search_global": lambda: search.search_global(
            read("listed_sessions"), read("projects"), read("tree"), talk(), [catalog.WORD, "proj4"], limit=40
        ),
        "faceted_search": lambda: search.faceted_search(read("tree"), talk(), catalog.WORD),
    }
    return seconds | {name: timed(ask) for name, ask in asks.items()}


def rates(spark, folder: str) -> tuple[dict[str, int], int]:
    """Messages per second of the two readers and of the tree, from log lines."""
    lines = catalog.chat_lines(spark, folder).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    lines = stage(lines.withColumn("session_id", F.concat("session_id", F.lit("-"), "copy")).drop("copy"))
    n = lines.count()
    asks = {
        "listing": lambda: sessions.listing_sessions(records.decode(lines, "listing")),
        "detail": lambda: sessions.detail_sessions(records.decode(lines)),
        "tree": lambda: tree.build_tree(records.decode(lines)),
    }
    return {name: round(n / timed(ask)) for name, ask in asks.items()}, n


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()  # start the engine
    seconds = {}
    for name in HEADLINE:
        with scratch(spark):
            seconds[name] = timed(lambda: QUERIES[name](spark, folder))
    with scratch(spark):
        from_lake = lake_rows(spark, folder)
    with scratch(spark):
        per_second, n_lines = rates(spark, folder)
    count = lambda name: spark.read.parquet(f"{folder}/{name}.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf"), "lake": from_lake, "rates": per_second,
                "input": {"conversations": count("conversations"), "events": count("events"), "rate_lines": n_lines},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
