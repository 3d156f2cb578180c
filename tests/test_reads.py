"""How often a query builds and parses a line: once, however many branches read it."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import records, tree
from threadloom.plans import catalog
from threadloom.sources import bridges

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
TURNS = "conv_id bigint, turn bigint, role string, text string"


def tables(spark, folder):
    events = spark.range(40).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1704067200).alias("ts"), (F.col("id") % 3).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("view", "click", "purchase", "error", "signup"))), (F.col("id") % 5 + 1).cast("int")).alias("event_type"),
        (F.col("id") / 4).alias("value"), F.format_string('{"k": %d}', "id").alias("props"),
    )
    events.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_built_once(spark, tmp_path):
    sf = tables(spark, tmp_path)
    events = spark.createDataFrame([(7, None, 1, "view", 0.5, '{"k": 3}')], EVENTS)
    assert plan_of(bridges.event_lines(bridges.table(spark, sf, "events"))).count("compact_boundary") == 1
    assert plan_of(bridges.toolbox_lines(events)).count("mystery") == 1
    assert plan_of(records.parse_lines(bridges.long_lines(bridges.table(spark, sf, "events")))).count("isCompactSummary") == 1
    assert plan_of(bridges.chat_lines(spark.createDataFrame([(1, 0, "user", "x")], TURNS))).count("isCompactSummary") == 1


@pytest.mark.parametrize("name", ["export_markdown_kind_calls", "export_html_calls", "export_text_calls"])
def test_an_export_parses_its_lines_once(spark, tmp_path, name):
    """What is left to run reads a written table; before, it built and parsed the lines anew."""
    made = catalog.QUERIES[name](spark, tables(spark, tmp_path))
    assert "parse_json" not in plan_of(made)
    assert made.count() == 3


@pytest.mark.parametrize("name", ["nav_labels", "tool_content_hit", "faceted_tool_search"])
def test_labels_and_hits_parse_their_lines_once(spark, tmp_path, name):
    assert "parse_json" not in plan_of(catalog.QUERIES[name](spark, tables(spark, tmp_path)))


def test_the_skeleton_takes_a_field_once(spark, tmp_path):
    """The filter on messages and boundaries looks at fields already taken, and what kind a message is needs its first item alone."""
    sf = tables(spark, tmp_path)
    plan = plan_of(tree.skeleton(records.decode(bridges.event_lines(bridges.table(spark, sf, "events")))))
    assert plan.count("$.logicalParentUuid") == 1 and plan.count("$.subtype") == 1
