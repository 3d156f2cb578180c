"""Raw lines to typed records: parsing, quarantine, size policy, envelope.

A *line* is ``(project_key, session_id, line_no, value)``; a *record* is the
same row with the parsed document and the envelope fields as typed columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text, times
from threadloom.functions.variants import child, is_present
from threadloom.session import stage

KEYS = ["project_key", "session_id"]
POLICIES = ("skip_line", "truncate_session", "fail_session")

# Envelope text fields: column -> JSON path.
TEXT_FIELDS = {
    "type": "$.type",
    "subtype": "$.subtype",
    "ts_raw": "$.timestamp",
    "uuid": "$.uuid",
    "parent_uuid_raw": "$.parentUuid",
    "logical_parent_uuid": "$.logicalParentUuid",
    "agent_id": "$.agentId",
    "role": "$.message.role",
    "model": "$.message.model",
    "summary_text": "$.summary",
    "slug": "$.slug",
    "version": "$.version",
    "git_branch": "$.gitBranch",
    "cwd": "$.cwd",
}
FLAG_FIELDS = {"is_compacted": "$.isCompactSummary", "is_sidechain": "$.isSidechain", "is_meta": "$.isMeta"}
TOKEN_FIELDS = {
    "input_tokens": "$.input_tokens",
    "output_tokens": "$.output_tokens",
    "cache_read_tokens": "$.cache_read_input_tokens",
    "cache_create_tokens": "$.cache_creation_input_tokens",
}

# Declared JSON types a line must respect under strict decoding. The listing
# reader looks at fewer fields than the detail reader.
_LISTING_STRICT = {
    **dict.fromkeys(
        ["$.type", "$.timestamp", "$.summary", "$.slug", "$.version", "$.gitBranch", "$.cwd"], "STRING"
    ),
    **dict.fromkeys(FLAG_FIELDS.values(), "BOOLEAN"),
    **dict.fromkeys(
        [f"{base}.{leaf[2:]}" for base in ("$.usage", "$.message.usage") for leaf in TOKEN_FIELDS.values()], "BIGINT"
    ),
    **dict.fromkeys(["$.usage", "$.message", "$.message.usage"], "OBJECT"),
}
STRICT_FIELDS = {
    "listing": _LISTING_STRICT,
    "detail": {
        **_LISTING_STRICT,
        **dict.fromkeys(
            [
                "$.subtype", "$.uuid", "$.parentUuid", "$.logicalParentUuid", "$.sessionId", "$.agentId",
                "$.content", "$.leafUuid", "$.message.role", "$.message.model",
            ],
            "STRING",
        ),
    },
}


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is computed once per row.

    Filters on columns derived from it would otherwise be pushed below it,
    each with a copy of the whole computation. Filters on the other columns
    still reach the scan.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def explode_once(df: DataFrame, name: str, values: Column) -> DataFrame:
    """A row per array element, the array being computed once per row."""
    return once(df, "__values", values).withColumn(name, F.explode("__values")).drop("__values")


def parse_lines(lines: DataFrame, cap: int | None = None) -> DataFrame:
    """Drop blank lines; add ``rec``, ``oversize`` and ``parse_ok``.

    With a ``cap`` lines of more bytes are not parsed. A line that is not a JSON
    object has ``parse_ok = false``.
    """
    oversize = F.lit(False) if cap is None else F.octet_length("value") > cap
    flagged = lines.where(text.has_ink(F.col("value"))).withColumns(
        {"oversize": oversize, "__braced": F.col("value").rlike(r"\A[ \t\r\n]*\{")}
    )
    parsed = once(flagged, "rec", F.when(~F.col("oversize"), F.try_parse_json("value")))
    # A document that parses and opens with a brace is an object.
    return parsed.withColumn("parse_ok", F.col("rec").isNotNull() & F.col("__braced")).drop("__braced")


def type_clash(rec: Column, profile: str) -> Column:
    """True where a declared field is present with another JSON type."""
    clash = F.lit(False)
    for path, wanted in STRICT_FIELDS[profile].items():
        found = F.schema_of_variant(child(rec, path))
        ok = found.startswith("OBJECT") if wanted == "OBJECT" else found == wanted
        clash = clash | F.coalesce((found != "VOID") & ~ok, F.lit(False))
    return clash


def _apply_policy(kept: DataFrame, oversize: DataFrame, policy: str) -> DataFrame:
    """Treat sessions holding an oversize line.

    ``skip_line`` drops the line, ``truncate_session`` also everything after
    it, ``fail_session`` the whole session. Only sessions with such a line
    take part in the join, so its side is as small as the problem.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown size policy: {policy}")
    if policy == "skip_line":
        return kept
    # Written first, so that its true size is known and the records need no shuffle.
    first_bad = stage(oversize.groupBy(*KEYS).agg(F.min("line_no").alias("cut_line")))
    if first_bad.isEmpty():
        return kept
    if policy == "fail_session":
        return kept.join(first_bad, KEYS, "left_anti")
    return (
        kept.join(first_bad, KEYS, "left")
        .where(F.col("cut_line").isNull() | (F.col("line_no") < F.col("cut_line")))
        .drop("cut_line")
    )


def usage_of(rec: Column) -> Column:
    """Usage object: the top-level one wins, else the one inside the message."""
    top = child(rec, "$.usage")
    return F.when(is_present(top), top).otherwise(child(rec, "$.message.usage"))


def _envelope(parsed: DataFrame, *keep: str) -> DataFrame:
    """Typed columns of the records. Absent and empty text become NULL."""
    rec = F.col("rec")
    return (
        parsed.select(
            *KEYS,
            "line_no",
            *keep,
            *[F.try_variant_get(rec, p, "string").alias(c) for c, p in TEXT_FIELDS.items()],
            *[F.coalesce(F.try_variant_get(rec, p, "boolean"), F.lit(False)).alias(c) for c, p in FLAG_FIELDS.items()],
            usage_of(rec).alias("usage"),
            child(rec, "$.message.content").alias("content"),
        )
        .withColumns(
            {
                **{c: text.none_if_empty(F.col(c)) for c in TEXT_FIELDS},
                **{c: F.try_variant_get(F.col("usage"), p, "bigint") for c, p in TOKEN_FIELDS.items()},
                "ts": times.parse_time(F.col("ts_raw")),
            }
        )
        .drop("usage")
    )


def decode(
    lines: DataFrame, profile: str = "detail", *, strict: bool = False, cap: int | None = None, policy: str = "skip_line"
) -> DataFrame:
    """Lines to records in one pass. ``policy`` says what a line above the ``cap`` does, if there is one."""
    parsed = parse_lines(lines, cap)
    kept = parsed.where("parse_ok")
    if strict:
        kept = kept.where(~type_clash(F.col("rec"), profile))
    return _envelope(_apply_policy(kept, parsed.where("oversize"), policy))


def _reason() -> Column:
    """Why a line is no record. What is JSON and yet gives no VARIANT is too large for one, or repeats a key where that is not allowed."""
    return (
        F.when(F.col("oversize"), "oversize")
        .when(F.col("rec").isNull() & F.get_json_object("value", "$").isNotNull(), "not_held")
        .when(F.col("rec").isNull(), "not_json")
        .when(~F.col("parse_ok"), "not_an_object")
    )


def quarantine(
    lines: DataFrame, profile: str = "detail", *, strict: bool = False, cap: int | None = None
) -> DataFrame:
    """Lines that give no record, with the reason."""
    parsed = parse_lines(lines, cap)
    reason = _reason()
    if strict:
        reason = F.coalesce(reason, F.when(type_clash(F.col("rec"), profile), "type_clash"))
    return parsed.select(*KEYS, "line_no", "value", reason.alias("reason")).where("reason is not null")


def ingest(lines: DataFrame, *, strict: bool = False, cap: int | None = None) -> DataFrame:
    """All lines in one table for both profiles, parsed once.

    ``reason`` says why a line is no record and ``bad_value`` keeps its text;
    both are NULL on records. ``clash_<profile>`` marks type clashes.
    """
    parsed = parse_lines(lines, cap)
    marked = parsed.withColumns(
        {
            "reason": _reason(),
            **{f"clash_{p}": type_clash(F.col("rec"), p) if strict else F.lit(False) for p in STRICT_FIELDS},
        }
    ).withColumn("bad_value", F.when(F.col("reason").isNotNull() | F.col("clash_detail"), F.col("value")))
    return _envelope(marked, "reason", "bad_value", *[f"clash_{p}" for p in STRICT_FIELDS])


def records_for(ingested: DataFrame, profile: str, policy: str = "skip_line") -> DataFrame:
    """The records one reader sees of an ingested table; ``policy`` counts where a cap was set."""
    kept = ingested.where(f"reason is null and not clash_{profile}").drop("reason", "bad_value", "clash_detail", "clash_listing")
    return _apply_policy(kept, ingested.where("reason = 'oversize'"), policy)


def rejected(ingested: DataFrame) -> DataFrame:
    """Lines of an ingested table the detail reader does not see, with the reason."""
    reason = F.coalesce("reason", F.when(F.col("clash_detail"), "type_clash"))
    return ingested.select(*KEYS, "line_no", F.col("bad_value").alias("value"), reason.alias("reason")).where("reason is not null")


def odd_keys(rec: Column) -> Column:
    """Top-level keys that differ from a declared one only in case; they are not decoded."""
    declared = sorted({p[2:] for p in [*TEXT_FIELDS.values(), *FLAG_FIELDS.values()] if "." not in p[2:]} | {"usage", "message"})
    folded = [k.lower() for k in declared]
    keys = F.map_keys(F.try_variant_get(rec, "$", "map<string,variant>"))
    return F.filter(keys, lambda k: F.lower(k).isin(*folded) & ~k.isin(*declared))
