"""Driver tables rewritten as raw log lines, so queries run the true ingest path.

``chat_lines`` turns ``conversations`` into sessions of prompts and answers,
``event_lines`` turns ``events`` into sessions of tool calls with results and
compaction boundaries, and ``toolbox_lines`` gives every tool a call with its
own arguments. ``long_lines`` makes one long session per project, and ``write_logs`` puts
lines into files as the log writers do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.records import KEYS, explode_once, once
from threadloom.operators.scans import running
from threadloom.sources.stores import open_store

LINE_COLUMNS = [*KEYS, "line_no", "value"]
PROJECT_PREFIX = "-home-user-src-proj"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else _s(p) for p in parts])


def _quoted(c: Column) -> Column:
    """JSON string of a plain word: ids, numbers, names. Free text goes through ``to_json``."""
    return F.concat(F.lit('"'), _s(c), F.lit('"'))


def _object(**fields: Column) -> Column:
    """JSON object text; a NULL field is left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]), F.lit("}"))


def _array(*items: Column) -> Column:
    """JSON array text; NULL items are left out."""
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def _true_if(c: Column) -> Column:
    return F.when(c, F.lit("true"))


def _stamp(seconds: Column) -> Column:
    """RFC 3339 text of 2024-01-01 plus seconds, free of the session time zone."""
    days = F.floor(seconds / 86400)
    rest = seconds - days * 86400

    def two(c: Column) -> Column:
        return F.lpad(_s(F.floor(c)), 2, "0")

    day = F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int"))
    return _text(day, "T", two(rest / 3600), ":", two(rest % 3600 / 60), ":", two(rest % 60), "Z")


def _lines(df: DataFrame, project: Column, session: Column, **columns: Column) -> DataFrame:
    return df.select(_text(PROJECT_PREFIX, project).alias("project_key"), session.alias("session_id"), *[c.alias(n) for n, c in columns.items()])


def chat_text() -> Column:
    """Text of a turn after the command wrapper or the code fence."""
    conv, turn, said = F.col("conv_id"), F.col("turn"), F.col("text")
    return (
        F.when((conv % 11 == 0) & (turn == 0), _text("<command-name>/run</command-name><command-args>", said, "</command-args>"))
        .when(conv % 13 == 0, _text("intro\n```sql\n", said, "\n```\noutro"))
        .otherwise(said)
    )


def chat_lines(conversations: DataFrame) -> DataFrame:
    """``conversations`` as log lines: a session per conversation, seven projects.

    The line number is twice the turn; odd lines hold summary records.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    answer = F.col("role") == "assistant"
    asked = F.col("role") == "user"
    up = F.when((conv % 3 == 0) & (turn >= 2), turn - 2).when(turn >= 1, turn - 1)

    block = _object
    said = F.col("said_json").substr(F.lit(2), F.length("said_json") - 2)
    blocks = _array(
        F.when(answer & (turn % 4 == 1), block(type=F.lit('"thinking"'), thinking=_quoted(_text("think ", turn)))),
        block(type=F.lit('"text"'), text=said),
        F.when(conv % 4 == 3, block(type=F.lit('"text"'), text=_quoted(_text("tail ", turn)))),
    )
    content = F.when((conv % 23 == 9) & asked, F.lit("[]")).when(conv % 2 == 1, blocks).otherwise(said)
    n = F.length("text")
    usage = F.when(
        answer,
        _object(input_tokens=_s(n), output_tokens=_s(F.floor(n / 4)), cache_read_input_tokens=_s(turn)),
    )
    decoy = F.when(answer, F.lit('{"input_tokens":999,"output_tokens":999,"cache_read_input_tokens":999}'))
    on_top = conv % 2 == 1
    record = _object(
        type=_quoted(F.col("role")),
        timestamp=_quoted(_stamp((conv % 50000) * 3600 + turn * 5)),
        uuid=_quoted(_text("c", conv, "-t", turn)),
        parentUuid=F.when(up.isNotNull(), _quoted(_text("c", conv, "-t", up))),
        isSidechain=_true_if(turn % 5 == 3),
        isMeta=_true_if((conv % 17 == 5) & (turn == 0)),
        isCompactSummary=_true_if(asked & (conv % 10 == 4) & (turn == 2)),
        version=_quoted(_text("1.0.", conv % 5)),
        slug=F.when(turn == 1, _quoted(_text("slug-", conv))),
        gitBranch=F.when(turn >= 2, _quoted(_text("branch-", turn))),
        cwd=F.when(turn == 0, _quoted(_text("/home/user/src/proj", conv % 7))),
        usage=F.when(on_top, usage),
        message=_object(
            role=_quoted(F.col("role")),
            content=content,
            model=F.when(answer, _quoted(_text("model-", conv % 3))),
            usage=F.when(~on_top, usage).when(conv % 6 == 1, decoy),
        ),
    )
    note = F.when((conv % 5 == 2) & (turn == 0), F.when(conv % 25 == 7, F.lit("Warmup")).otherwise(_text("Summary of ", conv))).when(
        (conv % 10 == 2) & (turn == 1), _text("Later summary of ", conv)
    )
    summary = F.when(note.isNotNull(), _object(type=F.lit('"summary"'), summary=_quoted(note), leafUuid=_quoted(_text("c", conv, "-t", turn))))
    both = F.array_compact(
        F.array(
            F.struct((turn * 2).cast("bigint").alias("line_no"), record.alias("value")),
            F.when(summary.isNotNull(), F.struct((turn * 2 + 1).cast("bigint").alias("line_no"), summary.alias("value"))),
        )
    )
    spoken = conversations.withColumn("said_json", F.to_json(F.array(chat_text())))
    return (
        explode_once(spoken, "l", both)
        .select(_text(PROJECT_PREFIX, conv % 7).alias("project_key"), _text("conv-", conv).alias("session_id"), "l.line_no", "l.value")
    )


def _event_stamp() -> Column:
    return F.concat(F.replace(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def event_knob() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _call_input(kind: Column, k: Column) -> Column:
    return (
        F.when(k % 10 == 0, F.col("props"))
        .when(kind == "view", _object(file_path=_quoted(_text("src/f", k, ".py"))))
        .when(kind == "click", _object(command=_quoted(_text("run ", k)), timeout=_s(k)))
        .when(kind == "purchase", _object(subagent_type=_quoted(_text("agent-", k % 4)), description=_quoted(_text("buy ", k)), prompt=_quoted(_text("please ", k))))
        .otherwise(_object(pattern=_quoted(_text("err", k)), path=F.lit('"src"')))
    )


def _call_name(kind: Column, k: Column) -> Column:
    return (
        F.when(k % 10 == 0, F.lit("Probe"))
        .when(kind == "view", F.lit("Read"))
        .when(kind == "click", F.lit("Bash"))
        .when(kind == "purchase", F.lit("Task"))
        .otherwise(F.lit("Grep"))
    )


def event_lines(events: DataFrame, malformed_every: int = 0) -> DataFrame:
    """``events`` as log lines: a session per user, ten projects, line order by event id.

    Every event is a tool call followed by its result, save signups, which are
    a compaction boundary followed by a compact summary. The next event hangs
    below the result, or below the boundary. With ``malformed_every`` each
    event id divisible by it gives one broken line in place of its first.
    """
    linked = running(
        events, ["user_id"], "event_id",
        {
            "prev_id": ("max", F.col("event_id"), "before"),
            "prev_call": ("max", F.when(F.col("event_type") != "signup", F.col("event_id")), "before"),
        },
    )
    eid, kind = F.col("event_id"), F.col("event_type")
    k, stamp, prev = F.col("knob"), F.col("stamp"), F.col("prev")
    signup = kind == "signup"
    before = F.when(
        F.col("prev_id").isNotNull(),
        _text("e", F.col("prev_id"), F.when(F.coalesce(F.col("prev_call") == F.col("prev_id"), F.lit(False)), "-r").otherwise("-b")),
    )
    own = F.when(signup, _text("e", eid, "-b")).otherwise(_text("e", eid, "-u"))
    tool_id = _quoted(_text("tool-", eid))
    boundary = _object(
        type=F.lit('"system"'), subtype=F.lit('"compact_boundary"'), timestamp=stamp, uuid=_quoted(own),
        logicalParentUuid=prev, content=F.lit('"compacted"'),
    )
    call = _object(
        type=F.lit('"assistant"'), timestamp=stamp, uuid=_quoted(own), parentUuid=prev,
        isSidechain=_true_if(eid % 13 == 5),
        message=_object(
            role=F.lit('"assistant"'),
            content=_array(
                F.when(eid % 3 == 0, _object(type=F.lit('"text"'), text=_quoted(_text("step ", eid)))),
                _object(
                    type=F.lit('"tool_use"'), id=tool_id, name=_quoted(_call_name(kind, k)), input=F.col("call_input")
                ),
            ),
        ),
    )
    cents = _text("cents ", F.round(F.col("value") * 100).cast("bigint"))
    answer = F.when(eid % 4 == 0, _array(_object(type=F.lit('"text"'), text=_quoted(cents)))).otherwise(_quoted(cents))
    result = _object(
        type=F.lit('"user"'), timestamp=stamp, uuid=_quoted(_text("e", eid, "-r")), parentUuid=_quoted(_text("e", eid, "-u")),
        message=_object(
            role=F.lit('"user"'),
            content=_array(
                _object(type=F.lit('"tool_result"'), tool_use_id=tool_id, content=answer, is_error=_true_if(kind == "error")),
                F.when(
                    eid % 50 == 0,
                    _object(type=F.lit('"tool_result"'), tool_use_id=tool_id, content=_quoted(_text("again ", eid))),
                ),
            ),
        ),
    )
    compact = _object(
        type=F.lit('"user"'), timestamp=stamp, uuid=_quoted(_text("e", eid, "-c")), parentUuid=_quoted(own),
        isCompactSummary=F.lit("true"),
        message=_object(role=F.lit('"user"'), content=_quoted(_text("Compacted at ", eid))),
    )
    first = F.when(signup, boundary).otherwise(call)
    if malformed_every:
        first = F.when(eid % malformed_every == 0, _text("{broken ", eid)).otherwise(first)
    # Step by step, what several lines share first: as one expression the generated method is too long for the JVM to
    # compile, and an exploded array column would be built twice, once for the filter Spark derives on its size.
    named = linked.withColumns({"knob": event_knob(), "stamp": _quoted(_event_stamp()), "prev": _quoted(before)})
    named = once(once(named, "call_input", _call_input(kind, k)), "first_line", first)
    named = once(named, "second_line", F.when(signup, compact).otherwise(result))
    pair = F.array("first_line", "second_line")
    return _lines(
        named, F.col("user_id") % 10, _text("user-", F.col("user_id")), event_id=eid, first_line=F.col("first_line"), second_line=F.col("second_line")
    ).select(*KEYS, "event_id", F.posexplode(pair).alias("half", "value")).select(
        *KEYS, (F.col("event_id") * 2 + F.col("half")).alias("line_no"), "value"
    )


def long_lines(events: DataFrame) -> DataFrame:
    """``events`` as one long session per project: the n-th event hangs below the one before, every seventh below event n / 2.

    Every fourth message is a prompt, one in fifty a compact summary, one in 97 a sidechain.
    """
    counted = running(
        events.withColumn("project", F.col("user_id") % 10), ["project"], "event_id", {"nth": ("sum", F.lit(1).cast("bigint"), "before")}
    ).withColumn("n", F.coalesce("nth", F.lit(0)))
    n = F.col("n")
    up = F.when(n == 0, None).when(n % 7 == 0, F.floor(n / 2)).otherwise(n - 1)
    compact = n % 50 == 49
    role = F.when(compact | (n % 4 == 0), F.lit("user")).otherwise(F.lit("assistant"))
    record = _object(
        type=_quoted(role), timestamp=_quoted(_event_stamp()), uuid=_quoted(_text("n", n)),
        parentUuid=F.when(up.isNotNull(), _quoted(_text("n", up))), isSidechain=_true_if(n % 97 == 41), isCompactSummary=_true_if(compact),
        message=_object(role=_quoted(role), content=_quoted(_text("say ", n))),
    )
    built = once(counted, "record", record)
    return _lines(built, F.col("project"), _text("long-", F.col("project")), line_no=n.cast("bigint"), value=F.col("record"))


def write_logs(lines: DataFrame, root: str, *, padded: bool = False, chunk: int = 0) -> None:
    """Write lines as ``<root>/<project>/<session>.jsonl``, a side file in every project folder beside them.

    With ``padded`` a line stands at its own line number, blank lines fill the gaps; else lines follow each other.
    With ``chunk`` a session is a folder of closed chunks of so many lines, named after their first line.
    """
    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        session, values = None, []

        def put(path: str, rows: list[str]) -> None:
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path) as f:
                f.write("".join(r + "\n" for r in rows).encode())

        def close() -> None:
            if session is None:
                return
            folder = f"{base}/{session[0]}"
            if not chunk:
                put(f"{folder}/{session[1]}.jsonl", values)
                put(f"{folder}/agent-{session[1]}.jsonl", ['{"type":"user"}'])
            for at in range(0, len(values), chunk or len(values) + 1):
                if chunk:
                    put(f"{folder}/{session[1]}/part-{at:08d}.jsonl", values[at : at + chunk])

        for batch in batches:
            for project, name, number, value in zip(*(batch.column(c).to_pylist() for c in LINE_COLUMNS)):
                if (project, name) != session:
                    close()
                    session, values = (project, name), []
                if padded:
                    values += [""] * (number - len(values))
                values.append(value)
        close()
        yield pa.RecordBatch.from_pydict({"done": [1]})

    by_session = lines.select(*LINE_COLUMNS).repartition(*KEYS).sortWithinPartitions(*KEYS, "line_no")
    by_session.mapInArrow(save, "done long").agg(F.sum("done")).collect()


# The tools of the toolbox bridge, by event id.
TOOLBOX = ("Edit", "Write", "TodoWrite", "Task", "Skill", "WebSearch", "WebFetch", "AskUserQuestion", "LSP",
           "TaskOutput", "KillShell", "Glob", "Other")


def toolbox_lines(events: DataFrame) -> DataFrame:
    """``events`` as one assistant line each, the tool going round by event id.

    Every line also has a thinking block, an image, a block of a type nobody
    knows, and an item that is not an object.
    """
    eid, kind = F.col("event_id"), F.col("event_type")
    name = F.get(F.array(*[F.lit(t) for t in TOOLBOX]), (eid % len(TOOLBOX)).cast("int"))
    q = _quoted
    label = _text("v", eid)
    todo = lambda n, status: _object(content=q(_text("item ", n, " of ", eid)), status=q(status))
    option = lambda n: _object(label=q(_text("opt", n)), description=q(_text("about ", eid)))
    inputs = {
        "Edit": _object(file_path=q(_text("a/", label, ".go")), old_string=q(_text("old ", kind)), new_string=q(_text("new ", kind))),
        "Write": _object(file_path=q(_text("b/", label, ".md")), content=q(_text(kind, "\\n", label))),
        "TodoWrite": _object(todos=_array(todo(F.lit(0), F.lit("completed")), todo(F.lit(1), F.lit("in_progress")), todo(F.lit(2), kind))),
        "Task": _object(subagent_type=q(kind), model=F.when(eid % 2 == 0, q(F.lit("small"))), prompt=q(_text("do ", label)), description=q(label)),
        "Skill": _object(skill=q(kind), args=q(label)),
        "WebSearch": _object(query=q(_text("find ", label))),
        "WebFetch": _object(url=q(_text(F.when(eid % 2 == 0, "HTTPS").otherwise("ftp"), "://example.org/", eid)), prompt=q(label)),
        "AskUserQuestion": _object(
            questions=_array(
                _object(header=q(kind), question=q(_text("which ", eid)), options=_array(option(F.lit(0)), option(F.lit(1)))),
                _object(header=q(F.lit("last")), question=q(_text("why ", eid))),
            )
        ),
        "LSP": _object(operation=q(kind), filePath=q(_text("/x/y/", label, ".rs")), line=_text(eid, ".75"), character=_s(eid % 80)),
        "TaskOutput": _object(task_id=q(label), block=F.when(eid % 4 == 1, F.lit("true")).when(eid % 4 == 3, F.lit("false"))),
        "KillShell": _object(shell_id=q(label)),
        "Glob": _object(pattern=q(_text("**/", label))),
    }
    body = F.lit(None).cast("string")
    for tool, args in inputs.items():
        body = F.when(name == tool, args).otherwise(body)
    body = F.coalesce(body, _object(b=_s(eid), a=_array(_s(eid % 3), q(kind))))
    record = _object(
        type=F.lit('"assistant"'), timestamp=q(_event_stamp()), uuid=q(_text("b", eid)),
        message=_object(
            role=F.lit('"assistant"'),
            content=_array(
                F.lit("7"),
                _object(type=F.lit('"thinking"'), thinking=q(_text("plan ", kind))),
                _object(type=F.lit('"tool_use"'), id=q(label), name=q(name), input=body),
                _object(
                    type=F.lit('"image"'),
                    source=_object(media_type=F.lit('"image/png"'), data=q(F.base64(label.cast("binary")))),
                ),
                F.lit('{"type":"mystery","text":"ignored"}'),
            ),
        ),
    )
    return _lines(once(events, "record", record), F.col("user_id") % 10, _text("box-", F.col("user_id")), line_no=eid, value=F.col("record"))


def annotation_events(events: DataFrame) -> DataFrame:
    """``events`` as a log of star and tag actions, in event-id order."""
    eid, kind = F.col("event_id"), F.col("event_type")
    action = (
        F.when(eid % 97 == 0, F.lit("bogus"))
        .when(eid % 4 == 0, F.lit("add"))
        .when(eid % 4 == 1, F.lit("remove"))
        .when(eid % 4 == 2, F.lit("tag"))
        .otherwise(F.lit("untag"))
    )
    return events.select(
        eid.alias("seq"),
        F.col("ts").alias("event_ts"),
        action.alias("action"),
        F.when(kind == "view", "session").when(kind == "click", "message").otherwise("project").alias("item_type"),
        _text("item-", F.col("user_id") % 40).alias("item_id"),
        _text("p", F.col("user_id") % 10).alias("project_id"),
        F.when(eid % 3 == 0, F.lit("")).otherwise(F.col("props")).alias("note"),
        _text("tag-", event_knob() % 12).alias("tag"),
    )
