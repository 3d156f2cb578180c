"""Distributed connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import stage, unstage


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Every neighbour of a node moves to the least of them: the larger neighbours, or the node with its smaller ones."""
    if large:
        edges = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("_least")).select("a", F.least("a", "_least").alias("_least"))
    moved = edges.join(least, "a")
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("_least").alias("b")).unionAll(least.select("a", F.col("_least").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) of every node in the edges ``(a, b)``.

    Each round is a pair of joins whose result is written to the shared folder, which
    cuts the lineage; a round's table is deleted once the next stands. The number of rounds grows with the
    logarithm of the longest path. A node with very many edges meets them in a
    join, which Spark splits. An empty table gives an empty result; loops and repeats are ignored.
    """
    current = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _print_of(current)
    while seen[0]:
        after = stage(_stars(_stars(current, True), False))
        unstage(current)
        current, before, seen = after, seen, _print_of(after)
        if seen == before:
            break
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
