import json

import pytest
from conftest import answer, call, result, user
from pyspark.sql import functions as F

from threadloom.operators import messages, records
from threadloom.operators.sessions import detail_sessions, listing_sessions


def kinds(df):
    return [r.kind for r in messages.build_messages(records.decode(df)).orderBy("session_id", "line_no").collect()]


def test_kinds_in_order(lines_of):
    rows = [
        answer(), user(isCompactSummary=True), user(isMeta=True), user([result("x")]), user("<command-name>/help</command-name>"),
        user([{"type": "text", "text": "<command-args>x"}]), user("Hello"), user([]), user(None),
        user("<command-x", isMeta=True, isCompactSummary=True), user([3, result("x")]), user([{"type": "text"}, result("x")]),
    ]
    assert kinds(lines_of({"s": rows})) == [
        "assistant", "compact_summary", "meta", "tool_result", "command", "command", "user_prompt", "user_prompt", "user_prompt",
        "compact_summary", "tool_result", "user_prompt",
    ]


def test_kind_of_other_types(spark):
    df = spark.sql("select * from values ('system'), ('summary'), (cast(null as string)) t(type)")
    none = F.array().cast("array<variant>")
    got = [r[0] for r in df.select(messages.kind_of(F.col("type"), F.lit(False), F.lit(False), none)).collect()]
    assert got == ["system", "unknown", "unknown"]


@pytest.mark.parametrize(
    "text, name, args",
    [
        ("<command-name>/help</command-name>", "/help", ""),
        ("<command-name> /go </command-name><command-args>-m fix\nbug </command-args>", "/go", "-m fix\nbug"),
        ("none here", "", ""), ("<command-name>", "", ""), ("", "", ""),
        ("<command-name>a</command-name><command-name>b</command-name>", "a", ""),
    ],
)
def test_command_parts(spark, text, name, args):
    c = F.lit(text)
    row = spark.range(1).select(messages.between_tags(c, "command-name"), messages.between_tags(c, "command-args")).first()
    assert tuple(row) == (name, args)


def test_blocks_of_every_type(lines_of):
    content = [
        7, {"type": "text", "text": "a"}, {"type": "thinking", "thinking": "b"}, call("Read", {"x": 1}), result("r", is_error=True),
        {"type": "image", "source": {"media_type": "image/png", "data": "QQ=="}}, {"type": "odd", "text": "c"}, {"text": "d"}, None,
        {"type": "tool_result", "tool_use_id": 5, "is_error": "yes"},
    ]
    blocks = messages.explode_blocks(messages.build_messages(records.decode(lines_of({"s": [answer(content)]})))).orderBy("block_no").collect()
    assert [b.block_type for b in blocks] == ["text", "thinking", "tool_use", "tool_result", "image", "odd", "", "tool_result"]
    assert [b.block_no for b in blocks] == list(range(8))
    assert [b.text for b in blocks] == ["a", "b", None, None, None, None, None, None]
    assert (blocks[2].tool_name, blocks[2].tool_id, blocks[3].is_error) == ("Read", "t1", True)
    assert (blocks[4].media_type, blocks[4].image_data) == ("image/png", "QQ==")
    assert (blocks[7].tool_id, blocks[7].is_error) == (None, False)


@pytest.mark.parametrize(
    "content, text, calls",
    [
        ("  hello ", "hello", 0), ([], "", 0), (5, "", 0), ({"type": "text", "text": "x"}, "", 0),
        ([{"type": "text", "text": "hello"}, {"type": "tool_use"}, {"type": "text", "text": "world"}, {"type": "text"}], "hello world", 1),
        ([{"type": "tool_use"}, {"type": "tool_use"}, {"type": "thinking"}], "", 2),
    ],
)
def test_joined_text_and_calls(lines_of, content, text, calls):
    m = messages.build_messages(records.decode(lines_of({"s": [answer(content)]})))
    row = m.select(messages.joined_text(F.col("items")), messages.tool_call_count(F.col("items"))).first()
    assert tuple(row) == (text, calls)


def test_usage_and_envelope(lines_of):
    rows = [
        {**answer(usage={"input_tokens": 1}), "message": {"content": "x", "usage": {"input_tokens": 9}}},
        {"type": "assistant", "usage": None, "message": {"usage": {"input_tokens": 4, "output_tokens": 2}}},
        {"type": "summary", "usage": {"cache_creation_input_tokens": 8}},
        {"type": "user", "UUID": "X", "uuid": "", "isMeta": None},
    ]
    got = records.decode(lines_of({"s": rows})).orderBy("line_no").collect()
    assert [r.input_tokens for r in got] == [1, 4, None, None]
    assert got[2].cache_create_tokens == 8
    assert (got[3].uuid, got[3].is_meta) == (None, False)
    odd = records.parse_lines(lines_of({"s": rows})).select("line_no", records.odd_keys(F.col("rec")).alias("odd_keys")).collect()
    assert {r.line_no: r.odd_keys for r in odd if r.odd_keys} == {3: ["UUID"]}


@pytest.mark.parametrize(
    "raw, micros",
    [
        ("2025-12-24T10:00:00.000Z", 1766570400000000), ("2025-12-24T12:00:00+02:00", 1766570400000000),
        ("2025-12-24T10:00:00.123456789Z", 1766570400123456), ("2025-12-24", None), ("2025-12-24T10:00:00", None),
        ("2025-13-24T10:00:00Z", None), ("2025-12-24 10:00:00Z", None), ("", None),
    ],
)
def test_times(lines_of, raw, micros):
    row = records.decode(lines_of({"s": [user(timestamp=raw)]})).select(F.unix_micros("ts")).first()
    assert row[0] == micros


def test_bad_lines(lines_of):
    lines = lines_of({"s": [user("a"), "", " \t ", "{no", "[1]", "7", json.dumps(user("x" * 300)), '{"type":"user","type":"assistant"}']})
    assert [(r.line_no, r.type) for r in records.decode(lines, cap=200).orderBy("line_no").collect()] == [(0, "user"), (7, "assistant")]
    bad = {r.line_no: r.reason for r in records.quarantine(lines, cap=200).collect()}
    assert bad == {3: "not_json", 4: "not_an_object", 5: "not_an_object", 6: "oversize"}


def test_size_policies(lines_of):
    big = json.dumps(user("x" * 300))
    lines = lines_of({"a": [user("1"), big, user("2")], "b": [user("3")]})
    left = lambda policy: [(r.session_id, r.line_no) for r in records.decode(lines, cap=200, policy=policy).orderBy("session_id", "line_no").collect()]
    assert left("skip_line") == [("a", 0), ("a", 2), ("b", 0)]
    assert left("truncate_session") == [("a", 0), ("b", 0)]
    assert left("fail_session") == [("b", 0)]
    with pytest.raises(ValueError):
        left("other")


def test_no_line_is_too_long_by_default(lines_of):
    """A line of 11 MiB is a record like any other, in all profiles, and so are its neighbours."""
    lines = lines_of({"a": [user("1"), json.dumps(user("x" * (11 << 20))), user("2")]})
    assert records.decode(lines).count() == 3
    table = records.ingest(lines)
    assert [records.records_for(table, p).count() for p in ("detail", "listing")] == [3, 3]
    assert records.rejected(table).count() == 0


def test_json_that_gives_no_record_has_a_reason_of_its_own(spark, lines_of):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    try:
        bad = records.quarantine(lines_of({"s": ['{"type":"user","type":"assistant"}', "{no"]})).collect()
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    assert {r.line_no: r.reason for r in bad} == {0: "not_held", 1: "not_json"}


def test_strict_types(lines_of):
    rows = [
        user(usage={"input_tokens": 1.5}), user(uuid=5), user(content="ok"), user(isMeta="true"), {"type": "user", "message": "text"},
        user(usage=None, uuid=None), {"type": "system", "content": ["x"]},
    ]
    lines = lines_of({"s": rows})
    kept = lambda profile: [r.line_no for r in records.decode(lines, profile, strict=True).orderBy("line_no").collect()]
    assert kept("detail") == [2, 5]
    assert kept("listing") == [1, 2, 5, 6]
    assert {r.line_no for r in records.quarantine(lines, "detail", strict=True).collect()} == {0, 1, 3, 4, 6}


def test_one_table_for_both_readers(lines_of):
    big = json.dumps(user("x" * 300))
    lines = lines_of({"a": [user("1"), big, user("2")], "b": [user("3"), user(uuid=5), "{", user(isMeta="x")]})
    table = records.ingest(lines, strict=True, cap=200)
    seen = lambda profile, policy: [(r.session_id, r.line_no) for r in records.records_for(table, profile, policy).orderBy("session_id", "line_no").collect()]
    assert seen("detail", "fail_session") == [("b", 0)]
    assert seen("listing", "truncate_session") == [("a", 0), ("b", 0), ("b", 1)]
    assert seen("detail", "skip_line") == [("a", 0), ("a", 2), ("b", 0)]
    assert records.records_for(table, "detail").columns == records.decode(lines).columns
    bad = {(r.session_id, r.line_no): r.reason for r in records.rejected(table).collect()}
    assert bad == {("a", 1): "oversize", ("b", 1): "type_clash", ("b", 2): "not_json", ("b", 3): "type_clash"}


def one(df):
    return df.first().asDict()


def test_profiles_differ(lines_of):
    rows = [
        {"type": "summary", "summary": "  First  "}, user("<command-name>/a</command-name>", timestamp="2025-01-01T00:00:05Z"),
        answer([call("Read", {}), {"type": "text", "text": "x"}], timestamp="2025-01-01T00:00:03Z", isSidechain=True),
        {"type": "system", "timestamp": "2025-01-01T00:01:00Z", "isSidechain": True}, {"type": "summary", "summary": "Last "},
    ]
    recs = records.decode(lines_of({"s": rows}))
    detail, listing = one(detail_sessions(recs)), one(listing_sessions(recs))
    assert (detail["summary"], listing["summary"]) == ("First", "Last ")
    assert (detail["user_prompts"], listing["user_prompts"]) == (0, 1)
    assert (detail["message_count"], listing["message_count"]) == (1, 2)
    assert (detail["agent_sidechains"], listing["agent_sidechains"]) == (1, 2)
    assert (detail["duration_seconds"], listing["duration_seconds"]) == (-2.0, 0.0)
    assert (detail["end_time"].second, listing["end_time"].minute) == (3, 1)
    assert detail["tool_calls"] == listing["tool_calls"] == 1


@pytest.mark.parametrize(
    "rows, detail, listing",
    [
        ([answer("x")], "(no summary)", "(no summary)"),
        ([user("First line\nSecond")], "First line", "First line"),
        ([answer("no"), user([result("r"), {"type": "text", "text": "t"}]), user("Question")], "Question", "t"),
        ([user("meta text", isMeta=True), user("<x> y"), user("plain")], "<x> y", "meta text"),
        ([user("compact", isCompactSummary=True)], "(no summary)", "(no summary)"),
        ([user([{"type": "text", "text": ""}, {"type": "text", "text": " b\nc"}, {"type": "text", "text": "d"}])], "b", "b"),
        ([user("  "), user("later")], "", "later"),
    ],
)
def test_summaries(lines_of, rows, detail, listing):
    recs = records.decode(lines_of({"s": rows}))
    assert (one(detail_sessions(recs))["summary"], one(listing_sessions(recs))["summary"]) == (detail, listing)


def test_stats_of_eight(lines_of):
    rows = [
        user("p"), answer([{"type": "tool_use"}, {"type": "tool_use"}]), user("q"), answer(), user([result("r")]),
        user("c", isCompactSummary=True), user("m", isMeta=True), answer(isSidechain=True),
    ]
    got = one(detail_sessions(records.decode(lines_of({"s": rows}))))
    assert [got[c] for c in ("user_prompts", "message_count", "tool_calls", "continuations", "agent_sidechains")] == [2, 5, 2, 1, 1]


def test_sample_session(lines_of):
    """The four-line example: a prompt, a tool call, its result, a closing answer."""
    at = "2025-03-01T09:0{}Z".format
    rows = [
        user("Make a parser", uuid="p1", timestamp=at("0:00")),
        answer([{"type": "text", "text": "Sure."}, call("Write", {"file_path": "p.go"})], uuid="a1", parentUuid="p1", timestamp=at("0:05")),
        user([result("done")], uuid="p2", timestamp=at("1:00")), answer("Made.", uuid="a2", timestamp=at("1:05")),
    ]
    got = one(detail_sessions(records.decode(lines_of({"s": rows}))))
    assert (got["message_count"], got["tool_calls"], got["duration_seconds"], got["summary"]) == (3, 1, 65.0, "Make a parser")


def test_metadata_first_each(lines_of):
    rows = [user(version=""), user(version="2", cwd="/a"), user(version="3", slug="s", gitBranch="b", cwd="/b")]
    got = one(detail_sessions(records.decode(lines_of({"s": rows}))))
    assert [got[c] for c in ("slug", "version", "git_branch", "cwd")] == ["s", "2", "b", "/a"]
