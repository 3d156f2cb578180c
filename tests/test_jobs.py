"""Listing, search, export, annotations."""

import json
import random

import pytest
from conftest import answer, call, result, user
from pyspark.sql import functions as F

from threadloom.operators import annotation_log, annotations, export, search, sessions
from threadloom.operators.messages import build_messages
from threadloom.operators.records import decode
from threadloom.operators.tree import build_tree
from threadloom.sources import sinks


@pytest.fixture(scope="module")
def corpus(lines_of):
    at = "2025-01-{:02d}T00:00:00Z".format
    a = lines_of(
        {
            "abc-1": [user("Fix the parser", uuid="u1", timestamp=at(1)), answer([call("Bash", {"command": "grep needle"})], uuid="a1", parentUuid="u1", timestamp=at(2))],
            "abc-2": [user("Warmup", timestamp=at(20))],
            "zed": [user("Needle in title", timestamp=at(3)), answer("x")],
        },
        "-home-u-src-alpha",
    )
    b = lines_of(
        {"abc-9": [user("Other", uuid="m", timestamp=at(9)), user([result([{"type": "text", "text": "a needle"}])], uuid="r", parentUuid="m", timestamp=at(9))]},
        "-home-u-src-beta",
    )
    c = lines_of({"empty": [answer("nothing asked")]}, "-home-u-src-gamma")
    return decode(a.unionByName(b).unionByName(c))


@pytest.fixture(scope="module")
def listing(corpus):
    listed = sessions.listable(sessions.listing_sessions(corpus)).cache()
    return listed, sessions.project_table(listed).cache()


def test_listing(listing):
    listed, projects = listing
    assert [r.project_key[-4:] for r in sessions.list_projects(projects).collect()] == ["beta", "lpha"]
    assert [r.n_sessions for r in sessions.list_projects(projects, "sessions").collect()] == [2, 1]
    assert [r.display_name for r in sessions.list_projects(projects, "name", 1).collect()] == ["alpha"]
    assert [r.session_id for r in sessions.recent_sessions(listed, projects, 0).collect()] == ["abc-9", "zed", "abc-1"]
    assert [r.session_id for r in sessions.list_sessions(listed, "messages").collect()] == ["abc-1", "zed", "abc-9"]
    assert sessions.global_counts(listed).first().asDict() == {"projects": 2, "sessions": 3}
    assert [(r.position, r.session_id) for r in sessions.recent_index(listed, projects, 2).collect()] == [(1, "abc-9"), (2, "zed")]
    with pytest.raises(ValueError):
        sessions.list_projects(projects, "size")


def test_an_index_needs_a_size(listing):
    with pytest.raises(ValueError):
        sessions.recent_index(*listing, 0)


def test_orders_hold(listing, corpus):
    """Collected rows come in the order the listing promises, also after the join with their projects."""
    listed, projects = listing
    joined = sessions.list_sessions(sessions.with_project(listed, projects)).select("session_id", "display_name").collect()
    assert [r.session_id for r in joined] == ["abc-9", "zed", "abc-1"]
    hits = search.search_sessions(listed, projects, ["a", "needle"]).collect()
    assert [(r.query, r.priority, r.project) for r in hits] == [("a", 0, "beta"), ("a", 0, "alpha"), ("a", 1, "beta"), ("a", 1, "alpha"), ("needle", 2, "alpha")]
    first = search.search_sessions(listed, projects, ["a", "needle"], limit=1).collect()
    assert [(r.query, r.session_id) for r in first] == [("a", "abc-9"), ("needle", "zed")]


def test_numbered_rows_and_json(spark, tmp_path):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("v")).repartition(7)
    sinks.write_json(rows, str(tmp_path / "out"), F.col("v").desc())
    back = spark.read.schema("v bigint, position bigint").json(str(tmp_path / "out")).orderBy("position").collect()
    assert [r.position for r in back] == list(range(1, 1001)) and [r.v for r in back] == sorted((r.v for r in back), reverse=True)


def test_lookup(listing):
    listed, projects = listing
    names = {r.request: r.display_name for r in sessions.find_projects(projects, ["a", "ALPHA", "-home-u-src-beta", "none"]).collect()}
    assert names == {"a": "beta", "ALPHA": "alpha", "-home-u-src-beta": "beta"}
    found = {r.request: r.session_id for r in sessions.find_sessions(listed, projects, ["abc", "alpha:abc", "alpha:", "x:abc", "zed"]).collect()}
    assert found == {"abc": "abc-9", "alpha:abc": "abc-1", "alpha:": "zed", "zed": "zed"}
    assert sessions.split_request("p:s:t") == ("p", "s:t")


def test_metadata_search(listing):
    got = [(r.query, r.priority, r.type, r.session_id) for r in search.search_sessions(*listing, ["ABC", "needle", "alpha"]).collect()]
    assert sorted(got) == sorted([
        ("abc", 0, "session", "abc-9"), ("abc", 0, "session", "abc-1"), ("needle", 2, "session", "zed"), ("alpha", 1, "project", None)
    ])
    assert search.search_sessions(*listing, ["a"], only="project").count() == 2
    assert search.search_sessions(*listing, ["a"], limit=1).count() == 1


def test_content_search(listing, corpus):
    got = search.search_global(*listing, build_tree(corpus), build_messages(corpus), ["needle"]).collect()
    assert [(r.priority, r.type, r.session_id, r.message_id, r.snippet) for r in got] == [
        (2, "session", "zed", None, None), (3, "message", "abc-9", "r", '[{"text":"a needle","type":"text"}]'),
        (3, "message", "abc-1", "a1", '[Bash] {"command":"grep needle"}'),
    ]


def test_project_answers_by_key_and_path(spark, lines_of):
    recs = decode(lines_of({"s": [user("x", timestamp="2025-01-01T00:00:00Z")]}, "ABC"))
    listed = sessions.listable(sessions.listing_sessions(recs))
    found = search.search_global(listed, sessions.project_table(listed), build_tree(recs), build_messages(recs), ["abc"]).collect()
    assert [(r.priority, r.type, r.snippet) for r in found] == [(0, "project", None), (1, "project", "/ABC")]
    assert search.search_global(listed, sessions.project_table(listed), build_tree(recs), build_messages(recs), [""]).count() == 0


def test_facets(lines_of):
    rows = [
        user("find me", uuid="1"), answer([{"type": "thinking", "thinking": "find it"}, {"type": "text", "text": "no match"}, call("Task", {"subagent_type": "finder", "description": "d"})]),
        answer("we find"), user([result("find")]), user("self", uuid="x", parentUuid="x"),
    ]
    recs = decode(lines_of({"s": rows}))
    index, talk = build_tree(recs), build_messages(recs)
    got = [(r.type, r.line_no, r.block_no, r.score) for r in search.faceted_search(index, talk, "find").collect()]
    assert got == [("user", 0, -1, 84.0), ("thinking", 1, 0, 34.0), ("response", 2, -1, pytest.approx(33.7)), ("agent", 1, 2, 25.0), ("tool", 1, 2, 20.0)]
    assert search.faceted_search(index, talk, "f").count() == 0
    assert {r.type for r in search.faceted_search(index, talk, "find", ["tool"]).collect()} == {"tool"}
    with pytest.raises(ValueError):
        search.faceted_search(index, talk, "find", ["x"])


STORY = [
    user("Ask <b>\n\nmore", uuid="1", timestamp="2025-05-05T01:02:03+05:00"),
    answer(
        [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "Sure"}, call("Read", {"file_path": "a.go", "deep": {"x": [1, "y"], "e": {}}}),
         {"type": "image", "source": {"media_type": "image/png", "data": "QUJD"}}],
        uuid="2", parentUuid="1", timestamp="2025-05-05T01:02:04+05:00",
    ),
    user([result("r&r", is_error=True), result(None), result([1, "z"])], uuid="3", parentUuid="2"),
    answer("agent", uuid="4", parentUuid="1", isSidechain=True), answer("below agent", uuid="5", parentUuid="4"),
    user("Summary so far", uuid="6", parentUuid="1", isCompactSummary=True), answer("below compact", uuid="7", parentUuid="6"),
    user("<command-name>/go</command-name><command-args>now</command-args>", uuid="8"), user("rules", uuid="9", isMeta=True),
]


@pytest.fixture(scope="module")
def story(lines_of):
    recs = decode(lines_of({"0123456789": STORY}))
    return build_tree(recs), build_messages(recs), sessions.detail_sessions(recs)


def document(story, fmt, **options):
    row = export.export_transcripts(*story, fmt, **options).first()
    return row.file_name, row.document


def test_markdown(story):
    name, doc = document(story, "markdown", with_thinking=True)
    assert name == "session-01234567.md"
    assert doc == (
        "# Session: 01234567\n\n**Started:** 2025-05-05 01:02\n**Messages:** 5 | **Tools:** 1\n\n---\n\n"
        "## User (01:02:03)\n\nAsk <b>\n\nmore\n\n---\n\n"
        "## Assistant (01:02:04)\n\n<details>\n<summary>Thinking</summary>\n\nhm\n\n</details>\n\nSure\n\n"
        '### Tool: Read\n\n```\ndeep: {"e":{},"x":[1,"y"]}\nfile_path: a.go\n```\n\n![Image](image/png)\n\n---\n\n'
        '## User (00:00:00)\n\n### Error\n\n```\nr&r\n```\n\n### Result\n\n### Result\n\n```\n[1,"z"]\n```\n\n---\n\n'
        "## ═══ Context Compacted ═══\n\n*Summary so far*\n\n---\n\n"
        "## User (00:00:00)\n\n<command-name>/go</command-name><command-args>now</command-args>\n\n---\n\n"
        "## User (00:00:00)\n\nrules\n\n---\n\n"
    )


def test_org(story):
    _, doc = document(story, "org", with_agents=True)
    assert doc == (
        "#+TITLE: Session 01234567\n#+DATE: 2025-05-05\n#+OPTIONS: toc:2 num:nil\n\n"
        "* Session Metadata\n- Started: 2025-05-05 01:02\n- Messages: 5\n- Tool Calls: 1\n- Continuations: 1\n\n* Conversation\n\n"
        "** USER [2025-05-05 Mon 01:02]\nAsk <b>\n\nmore\n\n\n"
        "*** ASSISTANT [2025-05-05 Mon 01:02]\nSure\n\n**** TOOL: Read\n#+BEGIN_SRC go\n"
        'deep: {"e":{},"x":[1,"y"]}\nfile_path: a.go\n#+END_SRC\n\n[[data:image/png;base64,QUJD]]\n\n\n'
        "**** USER [0001-01-01 Mon 00:00]\n***** ERROR\n#+BEGIN_EXAMPLE\nr&r\n#+END_EXAMPLE\n\n***** RESULT\n***** RESULT\n"
        '#+BEGIN_EXAMPLE\n[1,"z"]\n#+END_EXAMPLE\n\n\n'
        "*** ASSISTANT [0001-01-01 Mon 00:00]\nagent\n\n\n**** ASSISTANT [0001-01-01 Mon 00:00]\nbelow agent\n\n\n"
        "*** ═══ COMPACTED ═══\nSummary so far\n\n"
        "** USER [0001-01-01 Mon 00:00]\n<command-name>/go</command-name><command-args>now</command-args>\n\n\n"
        "** USER [0001-01-01 Mon 00:00]\nrules\n\n\n"
    )


def test_markdown_by_kind(story):
    _, doc = document(story, "md", by_kind=True)
    assert doc == (
        "# Session 0123456789\n\n**Started:** 2025-05-05 01:02:03\n\n**Messages:** 5 | **Tools:** 1\n\n---\n\n"
        "## ▶ USER (01:02:03)\n\nAsk <b>\n\nmore\n\n### ● ASSISTANT (01:02:04)\n\n> *∴ Thinking...*\n\nSure\n\n#### ● Read\n\n```json\n"
        '{\n  "deep": {\n    "e": {},\n    "x": [\n      1,\n      "y"\n    ]\n  },\n  "file_path": "a.go"\n}\n```\n\n'
        '```\nr&r\n```\n\n```\n<nil>\n```\n\n```\n[1,"z"]\n```\n\n### ● ASSISTANT (00:00:00)\n\nagent\n\n'
        "### ● ASSISTANT (00:00:00)\n\nbelow agent\n\n---\n## ◇ CONTEXT COMPACTED\n\nSummary so far\n\n"
        "### ● ASSISTANT (00:00:00)\n\nbelow compact\n\n## ⌘ /go (00:00:00)\n\nnow\n\n> *System Instructions* (00:00:00)\n\nrules\n\n"
    )


def test_org_and_text_by_kind(story):
    org = document(story, "org", by_kind=True)[1]
    assert org.startswith("#+TITLE: Session 0123456789\n#+DATE: 2025-05-05\n\n* ▶ USER [01:02:03]\nAsk <b>\n\nmore\n** ● ASSISTANT [01:02:04]\n/∴ Thinking.../\nSure\n*** ● Read\n#+BEGIN_SRC json\n{")
    assert "* ⌘ /go [00:00:00]\nnow\n** System Instructions [00:00:00]\nrules\n" in org
    name, txt = document(story, "txt")
    assert name == "2025-05-05-ask-b.txt"
    assert txt == (
        "\n\n> Ask <b>\n\nmore\n\n● Sure\n\n● Read(a.go)\n● agent\n\n● below agent\n\n"
        "══════════════════ Conversation compacted ═════════════════\n\n● below compact\n\n> /go now\n\n"
    )


def test_long_results_are_whole(lines_of):
    recs = decode(lines_of({"s": [user([result("r" * 9000)], uuid="1")]}))
    for fmt in ("md", "org", "html"):
        doc = export.export_transcripts(build_tree(recs), build_messages(recs), sessions.detail_sessions(recs), fmt).first().document
        assert "r" * 9000 in doc


def test_html(story):
    _, doc = document(story, "html", with_agents=True)
    for part in (
        "<p>Ask &lt;b&gt;</p>\n<p>more</p>\n", '<div class="message assistant sidechain">', "<pre>r&amp;r</pre>", '<div class="tool-result error">',
        '<img src="data:image/png;base64,QUJD" class="inline-image">', '<p class="dim">Summary so far</p>', "[USER] 01:02:03</div>",
    ):
        assert part in doc
    assert "below compact" not in doc and "hm" not in doc and doc.endswith("</html>")


def test_json(story):
    whole = json.loads(document(story, "json")[1])
    assert whole["session"]["summary"] == "Ask <b>"
    assert [(m["line"], m.get("parent_line"), m["depth"]) for m in whole["messages"]] == [
        (0, None, 0), (1, 0, 1), (2, 1, 2), (3, 0, 1), (4, 3, 2), (5, 0, 1), (6, 5, 2), (7, None, 0), (8, None, 0)
    ]
    assert whole["messages"][1]["content"][2]["input"]["file_path"] == "a.go"


def test_parts_make_the_whole(story):
    whole = document(story, "md")[1]
    parts = export.export_transcripts(*story, "md", part_chars=100).orderBy("part_no").collect()
    assert len(parts) > 2 and "".join(p.document for p in parts) == whole
    names = [p.file_name for p in parts]
    assert names[0] == "session-01234567.md" and len(set(names)) == len(names) and names[1] == f"session-01234567-part-{parts[1].part_no + 1:04d}.md"
    page = export.export_transcripts(*story, "html", part_chars=100).orderBy("part_no").collect()
    assert "".join(p.document for p in page) == document(story, "html")[1]
    with pytest.raises(ValueError):
        export.export_transcripts(*story, "pdf")


@pytest.mark.parametrize(
    "summary, name",
    [("Fix: the BUG, in Parser now please ok", "d-fix-the-bug-in-parser-now.txt"), ("¿!?", "d-session.txt"), ("a" * 60, "d-" + "a" * 50 + ".txt")],
)
def test_text_file_name(spark, summary, name):
    assert spark.range(1).select(export.text_file_name(F.lit(summary), F.lit("d"))).first()[0] == name


def test_annotations(spark):
    log = spark.createDataFrame(
        [
            (1, "add", "session", "a", "p", "n1", ""), (2, "add", "session", "b", "p", "", ""), (3, "add", "session", "a", "p", "n2", ""),
            (4, "remove", "session", "b", "", "", ""), (5, "add", "project", "c", "", "", ""), (6, "drop", "session", "a", "", "", ""),
            (7, "tag", "session", "a", "", "", "x"), (8, "tag", "session", "a", "", "", "x"), (9, "tag", "session", "a", "", "", "y"),
            (10, "untag", "session", "a", "", "", "y"), (11, None, "session", "a", "", "", "y"),
        ],
        "seq bigint, action string, item_type string, item_id string, project_id string, note string, tag string",
    ).withColumn("event_ts", F.timestamp_seconds("seq"))
    stars = annotations.current_stars(log)
    assert [(r.star_id, r.item_id, r.note) for r in annotations.list_stars(stars).collect()] == [(5, "c", ""), (3, "a", "n2")]
    assert [r.star_id for r in annotations.list_stars(stars, "session").collect()] == [3]
    items = spark.createDataFrame([("session", "a"), ("session", "b")], "item_type string, item_id string")
    assert [r.item_id for r in annotations.starred(items, stars).collect()] == ["a"]
    assert [r.name for r in annotations.all_tags(log).collect()] == ["x", "y"]
    assert [r.name for r in annotations.tags_of(annotations.all_tags(log), annotations.item_tags(log), "session", "a").collect()] == ["x"]
    assert [r.seq for r in annotations.rejected_events(log).orderBy("seq").collect()] == [6, 11]
    assert annotations.valid_events(log).count() == 9


def test_annotation_log_is_written_once(spark, tmp_path):
    schema = "seq bigint, action string, item_type string, item_id string, project_id string, note string, tag string"
    rows = [(1, "add", "session", "a", "p", "n", ""), (2, "drop", "session", "a", "", "", ""), (2, "drop", "session", "a", "", "", ""), (3, None, "x", "a", "", "", "")]
    log = str(tmp_path / "log")
    assert annotation_log.read_log(spark, log) is None
    for part in (rows[:1], rows, rows + [(4, "remove", "session", "a", "p", "", "")]):
        annotation_log.append_events(spark.createDataFrame(part, schema), log)
    assert sorted(r.seq for r in annotation_log.read_log(spark, log).collect()) == [1, 4]
    assert sorted(r.seq for r in annotation_log.read_log(spark, log, "rejected").collect()) == [2, 3]


NOTE = "seq bigint, action string, item_type string, item_id string, project_id string, note string, tag string"


def state_of(log):
    stars = annotations.current_stars(log.withColumn("event_ts", F.timestamp_seconds("seq"))).collect()
    tags = annotations.item_tags(log).collect()
    return sorted(map(str, stars)), sorted(map(str, tags)), [r.name for r in annotations.all_tags(log).collect()]


def random_notes(n, first=0):
    rng = random.Random(n)
    actions = ["add", "remove", "tag", "untag", "bogus", None]
    return [(first + i, rng.choice(actions), "session", f"i{rng.randrange(5)}", "p", f"n{i}", f"t{rng.randrange(4)}") for i in range(n)]


@pytest.mark.parametrize("history", [True, False])
def test_compacted_log_gives_the_same_state(spark, tmp_path, history):
    rows = random_notes(120)
    log, whole = str(tmp_path / "log"), spark.createDataFrame(rows, NOTE)
    annotation_log.compact_log(spark, log, history=history)
    assert annotation_log.read_log(spark, log) is None
    for part in (rows[:50], rows[30:80]):
        annotation_log.append_events(spark.createDataFrame(part, NOTE), log)
    annotation_log.compact_log(spark, log, history=history)
    # What was left out comes again, with the rest.
    annotation_log.append_events(whole, log)
    valid = annotations.valid_events(whole)
    assert state_of(annotation_log.read_log(spark, log)) == state_of(valid)
    annotation_log.compact_log(spark, log, history=history)
    annotation_log.sweep_log(spark, log)
    kept = annotation_log.read_log(spark, log)
    assert state_of(kept) == state_of(valid)
    assert kept.count() == valid.count() if history else kept.count() <= 5 + 20 + 4
    assert annotation_log.read_log(spark, log, "rejected").count() == len(rows) - valid.count()
    assert len(list((tmp_path / "log" / "parts").iterdir())) == 1


def test_an_append_that_is_cut_changes_nothing(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    annotation_log.append_events(spark.createDataFrame(random_notes(20), NOTE), log)
    before = sorted(map(str, annotation_log.read_log(spark, log).collect()))
    with monkeypatch.context() as m:
        m.setattr(annotation_log, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            annotation_log.append_events(spark.createDataFrame(random_notes(20, 20), NOTE), log)
    assert len(list((tmp_path / "log" / "parts").iterdir())) == 2
    assert sorted(map(str, annotation_log.read_log(spark, log).collect())) == before
    annotation_log.sweep_log(spark, log)
    assert len(list((tmp_path / "log" / "parts").iterdir())) == 1
    annotation_log.append_events(spark.createDataFrame(random_notes(20, 20), NOTE), log)
    both = random_notes(20) + random_notes(20, 20)
    assert annotation_log.read_log(spark, log).count() == annotations.valid_events(spark.createDataFrame(both, NOTE)).count()


def test_an_append_reads_the_blocks_it_touches(spark, tmp_path):
    """Files of other blocks are spoilt, and the append does not notice."""
    log, far = str(tmp_path / "log"), 5 * annotation_log.BLOCK
    annotation_log.append_events(spark.createDataFrame([(1, "add", "s", "a", "p", "", ""), (far, "add", "s", "b", "p", "", "")], NOTE), log)
    old = list((tmp_path / "log" / "parts").glob("part=*/kind=events/block=0/*.parquet"))
    assert len(old) == 1
    old[0].write_bytes(b"spoilt")
    annotation_log.append_events(spark.createDataFrame([(far, "add", "s", "z", "p", "", ""), (far + 1, "add", "s", "c", "p", "", "")], NOTE), log)
    state = annotation_log._newest(log)
    rows = annotation_log._rows(spark, log, state).where("block = 5")
    assert sorted((r.seq, r.item_id) for r in rows.collect()) == [(far, "b"), (far + 1, "c")]


def test_events_of_odd_numbers_and_new_columns(spark, tmp_path):
    log = str(tmp_path / "log")
    odd = [(None, "add", "s", "a", "p", "", ""), (-3, "add", "s", "b", None, None, None), (-3, "add", "s", "a", None, None, None)]
    for _ in range(2):
        annotation_log.append_events(spark.createDataFrame(odd, NOTE), log)
    annotation_log.append_events(spark.createDataFrame(odd, NOTE).where("false"), log)
    annotation_log.append_events(spark.createDataFrame([(9, "add", "s", "c", "p", "", "", "blue")], NOTE + ", colour string"), log)
    got = {(r.seq, r.item_id, r.colour) for r in annotation_log.read_log(spark, log).collect()}
    assert got == {(None, "a", None), (-3, "a", None), (9, "c", "blue")}
