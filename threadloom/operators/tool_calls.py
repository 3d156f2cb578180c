"""Tool calls and their results, and one typed argument table per tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.functions.tools import argument_lines, guess_language, is_active, tool_preview
from threadloom.functions.variants import array_of, child, is_object, text_at
from threadloom.operators.records import KEYS


def tool_uses(blocks: DataFrame) -> DataFrame:
    return blocks.where("block_type = 'tool_use'").select(*KEYS, "line_no", "block_no", "tool_id", "tool_name", "tool_input")


def tool_results(blocks: DataFrame) -> DataFrame:
    return blocks.where("block_type = 'tool_result'").select(*KEYS, "line_no", "block_no", "tool_id", "tool_result", "is_error")


def last_results(results: DataFrame) -> DataFrame:
    """The last result per tool id of a session, in file order; results without an id are left out.

    The first of a falling order, which Spark cuts per task before the shuffle.
    """
    newest = Window.partitionBy(*KEYS, "tool_id").orderBy(F.desc("line_no"), F.desc("block_no"))
    return (
        results.where("tool_id != ''")
        .withColumn("nth", F.row_number().over(newest)).where("nth = 1")
        .select(*KEYS, "tool_id", F.col("line_no").alias("result_line"), F.col("block_no").alias("result_block"), "tool_result", "is_error")
    )


def pair_calls(blocks: DataFrame) -> DataFrame:
    """Every tool call with its last result, if any.

    Calls and results pass one exchange together, by session and tool id; there each call looks at the results beside it.
    """
    call = F.col("block_type") == "tool_use"
    both = blocks.where(call | ((F.col("block_type") == "tool_result") & (F.col("tool_id") != ""))).select(
        *KEYS, "line_no", "block_no", "tool_id", "tool_name", "tool_input", call.alias("is_call"),
        # Calls without an id get a key of their own and so spread over the tasks.
        F.coalesce(text.none_if_empty(F.col("tool_id")), F.concat_ws("\u0000", F.lit(""), "line_no", "block_no")).alias("pair_id"),
        F.when(~call, F.struct(F.col("line_no").alias("result_line"), F.col("block_no").alias("result_block"), "tool_result", "is_error")).alias("result"),
    )
    beside = Window.partitionBy(*KEYS, "pair_id")
    at = F.when(~F.col("is_call"), F.struct("line_no", "block_no"))
    paired = both.withColumn("result", F.max_by("result", at).over(beside)).where("is_call")
    name, args = F.col("tool_name"), F.col("tool_input")
    return (
        paired.select(*KEYS, "line_no", "block_no", "tool_id", "tool_name", "tool_input", "result.*")
        .withColumn("preview", tool_preview(name, args))
        .withColumn("is_active", is_active(name))
    )


def described_calls(blocks: DataFrame) -> DataFrame:
    """Calls with their argument text and the language it is written in."""
    shown = argument_lines(F.col("tool_input"))
    return (
        tool_uses(blocks)
        .withColumn("argument_text", shown)
        .withColumn("language", guess_language(F.col("tool_name"), F.coalesce("argument_text", F.lit(""))))
    )


def _number_at(args: Column, path: str) -> Column:
    """A JSON number cut to a whole number, 0 where there is none."""
    found = child(args, path)
    numeric = F.schema_of_variant(found).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.coalesce(F.when(numeric, F.try_variant_get(found, "$", "double").cast("bigint")), F.lit(0).cast("bigint"))


# Tools whose arguments are plain texts: output column -> JSON key.
_TEXT_ARGUMENTS = {
    "Edit": ("file_path", "old_string", "new_string"),
    "Write": ("file_path", "content"),
    "Task": ("subagent_type", "model", "prompt", "description"),
    "Skill": ("skill", "args"),
    "WebSearch": ("query",),
    "WebFetch": ("url", "prompt"),
    "LSP": ("operation", "filePath"),
    "TaskOutput": ("task_id",),
    "KillShell": ("shell_id",),
}
LIST_TOOLS = ("TodoWrite", "AskUserQuestion")


def tool_arguments(blocks: DataFrame, tool: str) -> DataFrame:
    """Typed arguments of one tool; a tool without a layout gives its input as JSON."""
    args = F.col("tool_input")
    calls = tool_uses(blocks).where(F.col("tool_name") == tool)
    if tool in LIST_TOOLS:
        return todo_items(calls) if tool == "TodoWrite" else asked_options(calls)
    base = [*KEYS, "line_no", "block_no", "tool_id"]
    if tool not in _TEXT_ARGUMENTS:
        return calls.select(*base, "tool_name", F.to_json(args).alias("arguments"))
    calls = calls.where(is_object(args))
    columns = {key: text_at(args, f"$.{key}") for key in _TEXT_ARGUMENTS[tool]}
    if tool == "Write":
        columns["n_chars"] = F.length(columns["content"]).cast("bigint")
    elif tool == "WebFetch":
        columns["is_safe_url"] = text.is_web_url(columns["url"])
    elif tool == "LSP":
        columns |= {"line": _number_at(args, "$.line"), "character": _number_at(args, "$.character")}
    elif tool == "TaskOutput":
        block = child(args, "$.block")
        waits = F.when(F.schema_of_variant(block) == "BOOLEAN", F.try_variant_get(block, "$", "boolean"))
        columns["mode"] = F.when(waits, "blocking").when(~waits, "async")
    # The columns ``line`` of LSP and ``line_no`` of the log are different things.
    return calls.select(*base, *[c.alias(n) for n, c in columns.items()])


def todo_items(calls: DataFrame) -> DataFrame:
    """One row per todo of a TodoWrite call."""
    todo = F.col("todo")
    status = F.coalesce(text_at(todo, "$.status"), F.lit(""))
    return (
        calls.select(*KEYS, "line_no", "block_no", F.posexplode(array_of(child(F.col("tool_input"), "$.todos"))).alias("todo_no", "todo"))
        .where(is_object(todo))
        .select(
            *KEYS, "line_no", "block_no", F.col("todo_no").cast("bigint").alias("todo_no"),
            F.coalesce(text_at(todo, "$.content"), F.lit("")).alias("content"),
            status.alias("status"),
            F.when(status.isin("completed", "in_progress"), status).otherwise("pending").alias("status_class"),
        )
    )


def asked_options(calls: DataFrame) -> DataFrame:
    """One row per option of each question of an AskUserQuestion call; a question without options keeps one row."""
    q, o = F.col("question"), F.col("option")

    def word(v: Column, path: str) -> Column:
        return F.coalesce(text_at(v, path), F.lit(""))

    asked = calls.select(
        *KEYS, "line_no", "block_no", F.posexplode(array_of(child(F.col("tool_input"), "$.questions"))).alias("question_no", "question")
    ).where(is_object(q))
    options = F.filter(array_of(child(q, "$.options")), is_object)
    return asked.select(
        *KEYS, "line_no", "block_no", F.col("question_no").cast("bigint").alias("question_no"),
        word(q, "$.header").alias("header"), word(q, "$.question").alias("question_text"),
        F.posexplode_outer(options).alias("option_no", "option"),
    ).select(
        *KEYS, "line_no", "block_no", "question_no", "header", "question_text",
        F.col("option_no").cast("bigint").alias("option_no"),
        F.when(o.isNotNull(), word(o, "$.label")).alias("label"),
        F.when(o.isNotNull(), word(o, "$.description")).alias("description"),
    )
