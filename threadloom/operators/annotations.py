"""Stars and tags as an append-only log with derived current state.

``annotation_log`` keeps the log; what is here reads it.

The current state is the last action per key, found by max_by, which combines
before the shuffle: a much-starred item costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAR_ACTIONS = ("add", "remove")
TAG_ACTIONS = ("tag", "untag")
STAR_KEY = ["item_type", "item_id"]


def is_valid() -> Column:
    return F.coalesce(F.col("action").isin(*STAR_ACTIONS, *TAG_ACTIONS), F.lit(False))


def valid_events(log: DataFrame) -> DataFrame:
    return log.where(is_valid())


def rejected_events(log: DataFrame) -> DataFrame:
    """Events with a missing or unknown action."""
    return log.where(~is_valid())


def _last(log: DataFrame, actions: tuple[str, ...], keys: list[str], keep: list[str]) -> DataFrame:
    return (
        log.where(F.col("action").isin(*actions))
        .groupBy(*keys)
        .agg(F.max_by(F.struct("action", *keep), "seq").alias("last"))
        .where(F.col("last.action") == actions[0])
        .select(*keys, *[f"last.{c}" for c in keep])
    )


def current_stars(log: DataFrame) -> DataFrame:
    """Starred items. Starring again replaces the star, its id, note and time."""
    return _last(log, STAR_ACTIONS, STAR_KEY, ["seq", "event_ts", "project_id", "note"]).select(
        F.col("seq").alias("star_id"), *STAR_KEY, "project_id", "note", F.col("event_ts").alias("created_at")
    )


def list_stars(stars: DataFrame, item_type: str = "") -> DataFrame:
    """Newest first, of one type or all."""
    chosen = stars.where(F.col("item_type") == item_type) if item_type else stars
    return chosen.orderBy(F.col("created_at").desc(), F.col("star_id").desc())


def starred(items: DataFrame, stars: DataFrame) -> DataFrame:
    """Items (type and id) that carry a star."""
    return items.join(stars.select(*STAR_KEY), STAR_KEY, "left_semi")


def tag_id(name: Column) -> Column:
    return F.xxhash64(name)


def all_tags(log: DataFrame) -> DataFrame:
    """Every tag ever given, once, by name. Untagging an item keeps the tag."""
    return (
        log.where("action = 'tag'").select(F.col("tag").alias("name")).dropDuplicates(["name"])
        .select(tag_id(F.col("name")).alias("tag_id"), "name").orderBy("name")
    )


def item_tags(log: DataFrame) -> DataFrame:
    """Tags each item carries now."""
    return _last(log, TAG_ACTIONS, [*STAR_KEY, "tag"], ["seq"]).select(*STAR_KEY, tag_id(F.col("tag")).alias("tag_id"), F.col("tag").alias("name"))


def tags_of(tags: DataFrame, links: DataFrame, item_type: str, item_id: str) -> DataFrame:
    """Tags of one item, by the join of the tag table with the item links."""
    wanted = links.where((F.col("item_type") == item_type) & (F.col("item_id") == item_id)).select("tag_id")
    return tags.join(wanted, "tag_id").select("tag_id", "name")
