"""Code blocks and tables inside message texts. Row-local: nothing shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators.records import once

# Multi-line mode with \n as the only line end.
_FENCE = r"(?dm)^```"
_TABLE_RUN = r"(?dm)(?:^[^\S\n]*\|[^\n]*(?:\n|\z))+"


def code_blocks(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """Fenced code blocks: number, language (``text`` where none is named), body.

    Splitting at line-start fences leaves every second piece inside a fence.
    The last piece is kept when its fence is never closed.
    """
    inside = F.col("piece")
    newline = F.instr(inside, "\n")
    body = F.when(newline > 0, inside.substr(newline + 1, F.length(inside))).otherwise("")
    closed = F.col("piece_no") < F.col("n_pieces") - 1
    lang = F.substring_index(inside, "\n", 1)
    return (
        once(texts.where(F.col(column).rlike(_FENCE)), "pieces", F.split(F.col(column), _FENCE))
        .select(*keys, F.size("pieces").alias("n_pieces"), F.posexplode("pieces").alias("piece_no", "piece"))
        .where("piece_no % 2 = 1")
        .select(
            *keys,
            F.floor(F.col("piece_no") / 2).alias("code_no"),
            F.when(lang == "", "text").otherwise(lang).alias("language"),
            F.when(closed, F.regexp_replace(body, r"\n\z", "")).otherwise(body).alias("body"),
        )
    )


def table_cells(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """Cells of pipe tables outside code: table, row (0 is the header), cell, trimmed text.

    A table is a run of lines starting with a pipe; lines with ``---`` are
    separators and dropped. A run of separators only is no table.
    """
    pieces = F.split(F.col(column), _FENCE)
    # After a closing fence the rest of the fence line is not text.
    outside = F.filter(
        F.transform(
            pieces,
            lambda p, i: F.when(
                i % 2 == 0,
                F.when(i == 0, p).otherwise(F.regexp_replace(p, r"^[^\n]*", "")),
            ),
        ),
        lambda p: p.isNotNull(),
    )
    runs = F.flatten(F.transform(outside, lambda p: F.regexp_extract_all(p, F.lit(_TABLE_RUN), 0)))
    rows = F.transform(
        runs,
        lambda run: F.filter(F.split(run, "\n"), lambda line: text.has_ink(line) & ~F.contains(line, F.lit("---"))),
    )
    stripped = F.regexp_replace(text.trim_all(F.col("row")), r"^\|+|\|+$", "")
    return (
        once(texts.where(F.col(column).contains("|")), "tables", F.filter(rows, lambda r: F.size(r) > 0))
        .select(*keys, F.posexplode("tables").alias("table_no", "rows"))
        .select(*keys, "table_no", F.posexplode("rows").alias("row_no", "row"))
        .select(*keys, "table_no", "row_no", F.split(stripped, r"\|").alias("cells"))
        .select(*keys, "table_no", "row_no", F.posexplode("cells").alias("cell_no", "cell"))
        .select(
            *keys, *[F.col(c).cast("bigint").alias(c) for c in ("table_no", "row_no", "cell_no")],
            text.trim_all(F.col("cell")).alias("cell"),
        )
    )
