"""Writing results: lake tables, JSON listings, export documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import stage


def write_table(df: DataFrame, folder: str, replace: str = "static") -> None:
    """Parquet by project. Rows are gathered by project before the write, so a project
    fills a few files; an outsized project is split over many tasks and a small one
    shares its task with others. With ``replace`` as ``dynamic`` only the projects of ``df`` are replaced."""
    df.hint("rebalance", "project_key").write.mode("overwrite").option("partitionOverwriteMode", replace).partitionBy("project_key").parquet(folder)


def number_in_order(df: DataFrame, *order: Column) -> DataFrame:
    """Rows with ``position``, 1, 2, ... in the given order, sorted by ranges and numbered in place.

    Only one row per sorted range is ever looked at together.
    """
    label = F.monotonically_increasing_id()
    ranged = stage(df.orderBy(*order).withColumn("range_row", label))
    split = F.shiftrightunsigned("range_row", 33)
    sizes = ranged.groupBy(split.alias("range_no")).agg(F.count("*").alias("n"))
    # One row per range, as many as there are sort partitions.
    before = sizes.select("range_no", (F.sum("n").over(Window.orderBy("range_no")) - F.col("n")).alias("before"))
    inside = F.col("range_row").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.withColumn("range_no", split).join(F.broadcast(before), "range_no")
    return placed.withColumn("position", F.col("before") + inside + 1).drop("range_no", "range_row", "before")


def write_json(listing: DataFrame, folder: str, *order: Column) -> None:
    """A listing or search result as JSON lines; ``position`` keeps its order for every reader."""
    number_in_order(listing, *order).orderBy("position").write.mode("overwrite").json(folder)


def write_documents(documents: DataFrame, folder: str) -> None:
    """Export documents with their file names, by project."""
    write_table(documents, folder)
