"""Records to messages: content items, kinds, commands, per-message text.

``items`` is the normalised content: an array of JSON objects whatever shape
the log used. Everything here is local to a row, so nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.functions.variants import array_of, child, flag_at, is_object, text_at
from threadloom.operators.records import KEYS, once

CONVERSATIONAL = ("user", "assistant")
MESSAGE_COLUMNS = [
    *KEYS, "line_no", "uuid", "parent_uuid_raw", "type", "kind", "ts", "ts_raw", "is_compacted", "is_sidechain",
    "is_meta", "is_command", "command_name", "command_args", "agent_id", "model", "subtype", "items",
]


def content_items(content: Column) -> Column:
    """A string is one text item, an array keeps its objects, anything else is empty."""
    spoken = F.try_variant_get(content, "$", "string")
    one = F.array(F.to_variant_object(F.struct(F.lit("text").alias("type"), spoken.alias("text"))))
    return F.coalesce(
        F.filter(array_of(content), is_object),
        F.when(F.schema_of_variant(content) == "STRING", one),
        F.array().cast("array<variant>"),
    )


def item_type(item: Column) -> Column:
    """Type of an item, to compare with the known types; these are no text form of other JSON."""
    return F.coalesce(F.try_variant_get(item, "$.type", "string"), F.lit(""))


def kind_of(type_: Column, compacted: Column, meta: Column, items: Column) -> Column:
    """The eight message kinds. The order of the tests matters."""
    first = F.get(items, F.lit(0))
    first_type = item_type(first)
    as_command = (first_type == "text") & text_at(first, "$.text").startswith("<command-")
    return (
        F.when(type_ == "assistant", "assistant")
        .when(type_ == "system", "system")
        .when(F.coalesce(type_, F.lit("")) != "user", "unknown")
        .when(compacted, "compact_summary")
        .when(meta, "meta")
        .when(first_type == "tool_result", "tool_result")
        .when(as_command, "command")
        .otherwise("user_prompt")
    )


def between_tags(c: Column, tag: str) -> Column:
    """Trimmed text of the first ``<tag>`` element, empty when missing or unclosed."""
    return text.trim_all(F.regexp_extract(c, f"(?s)<{tag}>(.*?)</{tag}>", 1))


def is_conversational() -> Column:
    return F.coalesce(F.col("type").isin(*CONVERSATIONAL), F.lit(False))


def classify(records: DataFrame) -> DataFrame:
    """Add ``items`` and ``kind`` to all records; records that have them stay as they are."""
    if "items" in records.columns:
        return records
    return once(records, "items", content_items(F.col("content"))).withColumn(
        "kind", kind_of(F.col("type"), F.col("is_compacted"), F.col("is_meta"), F.col("items"))
    )


def build_messages(records: DataFrame) -> DataFrame:
    """Conversational records as classified messages, still without a tree."""
    spoken = text_at(F.get(F.col("items"), F.lit(0)), "$.text")
    is_command = F.col("kind") == "command"
    return (
        once(classify(records.where(is_conversational())).withColumn("is_command", is_command), "spoken", F.when(is_command, spoken))
        .withColumns({f"command_{c}": F.coalesce(between_tags(F.col("spoken"), f"command-{c}"), F.lit("")) for c in ("name", "args")})
        .select(*MESSAGE_COLUMNS)
    )


def texts_of(items: Column) -> Column:
    """Texts of the text items, in order; items without a text are left out."""
    found = F.transform(
        F.filter(items, lambda i: item_type(i) == "text"), lambda i: text_at(i, "$.text")
    )
    return F.filter(found, lambda t: t.isNotNull())


def joined_text(items: Column) -> Column:
    return text.trim_all(F.array_join(texts_of(items), " "))


def first_text(items: Column) -> Column:
    """First non-empty text item, or an empty text."""
    return F.coalesce(F.get(F.filter(texts_of(items), lambda t: t != ""), F.lit(0)), F.lit(""))


def tool_call_count(items: Column) -> Column:
    return F.size(F.filter(items, lambda i: item_type(i) == "tool_use")).cast("bigint")


def explode_blocks(messages: DataFrame, *carry: str) -> DataFrame:
    """One row per content block, keyed ``(keys, line_no, block_no)``."""
    b = F.col("item")
    kind = F.col("block_type")
    return (
        messages.select(*KEYS, "line_no", *carry, F.posexplode("items").alias("block_no", "item"))
        .withColumn("block_type", F.coalesce(text_at(b, "$.type"), F.lit("")))
        .select(
            *KEYS,
            "line_no",
            *carry,
            F.col("block_no").cast("bigint").alias("block_no"),
            "block_type",
            F.when(kind == "text", F.coalesce(text_at(b, "$.text"), F.lit("")))
            .when(kind == "thinking", F.coalesce(text_at(b, "$.thinking"), F.lit("")))
            .alias("text"),
            F.when(kind == "tool_use", F.coalesce(text_at(b, "$.name"), F.lit(""))).alias("tool_name"),
            F.when(kind == "tool_use", text_at(b, "$.id"))
            .when(kind == "tool_result", text_at(b, "$.tool_use_id"))
            .alias("tool_id"),
            F.when(kind == "tool_use", child(b, "$.input")).alias("tool_input"),
            F.when(kind == "tool_result", child(b, "$.content")).alias("tool_result"),
            F.when(kind == "tool_result", flag_at(b, "$.is_error")).alias("is_error"),
            F.when(kind == "image", text_at(b, "$.source.media_type")).alias("media_type"),
            F.when(kind == "image", text_at(b, "$.source.data")).alias("image_data"),
        )
    )
