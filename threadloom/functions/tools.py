"""Tool calls: previews, flags, argument text, language guesses, result text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.functions.variants import entries_of, is_object, is_present, show_value, text_at

# Tools that change state.
ACTIVE_TOOLS = (
    "Write", "Edit", "Bash", "Task", "TodoWrite", "Skill", "NotebookEdit", "KillShell", "AskUserQuestion",
)


def is_active(name: Column) -> Column:
    return name.isin(*ACTIVE_TOOLS)


def tool_preview(name: Column, args: Column) -> Column:
    """One short line for a call; an empty text where the input is not an object.

    A tool without its own argument falls through to the first key in order.
    """
    def arg(key: str) -> Column:
        return text_at(args, f"$.{key}")

    # The argument shown per tool.
    plain = {
        "file_path": ("Read", "Write", "Edit"),
        "pattern": ("Glob",),
        "url": ("WebFetch",),
        "task_id": ("TaskOutput",),
        "shell_id": ("KillShell",),
    }
    own = F.lit(None).cast("string")
    for key, tools in plain.items():
        own = F.when(name.isin(*tools), arg(key)).otherwise(own)
    agent = F.concat(F.lit("["), text.none_if_empty(arg("subagent_type")), F.lit("]"))
    task = F.array_compact(F.array(agent, arg("description")))
    file_name = F.substring_index(arg("filePath"), "/", -1)
    special = (
        F.when(name == "Grep", F.concat(F.lit("/"), arg("pattern"), F.lit("/")))
        .when(name == "Bash", F.concat(F.lit("$ "), text.cut_with_dots(arg("command"), 50)))
        .when(name == "Task", F.when(F.size(task) > 0, F.array_join(task, " ")))
        .when(name == "Skill", F.concat(F.lit("/"), arg("skill")))
        .when(name == "WebSearch", text.cut_with_dots(arg("query"), 50))
        .when(name == "AskUserQuestion", text_at(args, "$.questions[0].header"))
        .when(name == "LSP", F.when(arg("filePath").isNotNull(), F.concat(arg("operation"), F.lit(" "), file_name)).otherwise(arg("operation")))
        .otherwise(own)
    )
    first = F.slice(entries_of(args), 1, 1)
    fallback = F.get(F.transform(first, lambda e: F.concat(e["key"], F.lit("="), show_value(e["value"]))), F.lit(0))
    return F.when(is_object(args), F.coalesce(special, fallback, F.lit(""))).otherwise(F.lit(""))


def argument_preview(args: Column) -> Column:
    """The ``pattern``, else the ``command``, else the ``file_path``, else nothing."""
    return F.coalesce(text_at(args, "$.pattern"), text_at(args, "$.command"), text_at(args, "$.file_path"), F.lit(""))


def argument_lines(args: Column) -> Column:
    """``key: value`` lines in key order; other inputs as text. NULL where absent."""
    lines = F.transform(entries_of(args), lambda e: F.concat(e["key"], F.lit(": "), show_value(e["value"])))
    return F.when(is_present(args), F.when(is_object(args), F.array_join(lines, "\n")).otherwise(show_value(args)))


def guess_language(name: Column, shown: Column) -> Column:
    """Source language of a call, from the tool and its argument text."""
    # File endings and their language, first hit wins.
    by_file = (
        F.when(F.contains(shown, F.lit(".go")), "go")
        .when(F.contains(shown, F.lit(".py")), "python")
        .when(F.contains(shown, F.lit(".js")) | F.contains(shown, F.lit(".ts")), "javascript")
        .when(F.contains(shown, F.lit(".rs")), "rust")
        .otherwise("")
    )
    on_file = name.isin("Read", "Write", "Edit") & F.contains(shown, F.lit("file_path"))
    return F.when(name == "Bash", "bash").when(on_file, by_file).otherwise("")


def cap_result(c: Column, size: int = 5000) -> Column:
    """A result shortened for display."""
    return text.ellipsize(c, size)


def result_text(result: Column) -> Column:
    """Result for a rendering, whole: strings as they are, other JSON as JSON. NULL where absent."""
    return F.when(is_present(result), show_value(result))
