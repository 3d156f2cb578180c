import json
import random

import pytest
from conftest import answer, call, result, user
from pyspark.sql import functions as F

from threadloom.functions import paths, text, times, tools
from threadloom.operators import export, markup, messages, records, tool_calls


def value(spark, c):
    return spark.range(1).select(c).first()[0]


@pytest.mark.parametrize(
    "key, name",
    [
        ("-Users-kim-projects-shop", "shop"), ("-Users-kim-code-repos-app", "app"), ("-home-user-github-com-org-repo", "org-repo"),
        ("-Users-kim-wrk-src-github-com-a-b-c-d-e", "b-c-d-e"), ("-mnt-x", "x"), ("src-dev", "dev"), ("---", "---"), ("", ""),
        ("-gitlab-net-x", "gitlab-net-x"), ("home", "home"), ("-opt-GitHub-IO-z", "opt-GitHub-IO-z"), ("GitHub-IO-z", "z"),
    ],
)
def test_display_name(spark, key, name):
    assert value(spark, paths.display_name(F.lit(key))) == name


@pytest.mark.parametrize("key, path", [("-Users-kim-app", "/Users/kim/app"), ("home-x", "/home/x"), ("", "")])
def test_decode_path(spark, key, path):
    assert value(spark, paths.decode_path(F.lit(key))) == path


@pytest.mark.parametrize("path, key", [("/Users/kim/app", "Users-kim-app"), ("a/b", "a-b"), ("//x", "-x"), ("", "")])
def test_encode_path(spark, path, key):
    assert value(spark, paths.encode_path(F.lit(path))) == key


@pytest.mark.parametrize("path, inside", [("/a/b", True), ("/a/b/c", True), ("/a/bc", False), ("/a", False)])
def test_under_root(spark, path, inside):
    assert value(spark, paths.under_root(F.lit(path), "/a/b/")) is inside


@pytest.mark.parametrize("raw, done", [(" \t a\n", "a"), (" x  ", "x"), ("a  b", "a  b"), ("\u0085", ""), ("", ""), ("\n\n", "")])
def test_trim(spark, raw, done):
    assert value(spark, text.trim_all(F.lit(raw))) == done


@pytest.mark.parametrize(
    "body, query, size, shown",
    [
        ("short hit here", "hit", 60, "short hit here"), ("x" * 30 + "HIT" + "y" * 60, "hit", 60, "..." + "x" * 20 + "HIT" + "y" * 40 + "..."),
        ("a\nhit\nb", "hit", 60, "a hit b"), ("none", "hit", 60, None), ("ÄÖ" * 20 + "hit", "hit", 40, "..." + "ÄÖ" * 10 + "hit"),
    ],
)
def test_snippet(spark, body, query, size, shown):
    assert value(spark, text.snippet(F.lit(body), F.lit(query), size)) == shown


@pytest.mark.parametrize(
    "body, query, score",
    [
        ("fox", "fox", 10 + 3 + 10 + 10), ("a fox", "fox", 13 + 9.8 + 10), ("afox", "fox", 13 + 9.9), ("x" * 200 + " fox", "FOX", 13 + 10),
        ("the quick fox", "quick fox", (10 + 96 / 20 + 5) + (10 + 90 / 20 + 5)), ("the fox", "quick fox", 0), ("x", "  ", 0), ("_fox", "fox", 13 + 9.9),
    ],
)
def test_relevance(spark, body, query, score):
    assert value(spark, text.relevance(F.lit(body), query)) == pytest.approx(score)


@pytest.mark.parametrize(
    "age, shown",
    [(0, "just now"), (59, "just now"), (60, "1m ago"), (3599, "59m ago"), (3600, "1h ago"), (86399, "23h ago"), (86400, "1d ago"), (7 * 86400, "2024-01-01"), (None, "N/A")],
)
def test_recency(spark, age, shown):
    now = 1704672000 * 10**6  # 2024-01-08
    ts = F.lit(None if age is None else now - age * 10**6).cast("bigint")
    assert value(spark, times.recency(ts, F.lit(now))) == shown


@pytest.mark.parametrize(
    "name, args, preview",
    [
        ("Read", {"file_path": "a.py"}, "a.py"), ("Grep", {"pattern": "x"}, "/x/"), ("Glob", {"pattern": "*"}, "*"), ("Bash", {"command": "ls"}, "$ ls"),
        ("Bash", {"command": "c" * 51}, "$ " + "c" * 50 + "..."), ("Task", {"subagent_type": "a", "description": "d"}, "[a] d"),
        ("Task", {"subagent_type": "", "prompt": "p"}, "prompt=p"), ("Task", {"description": "d"}, "d"), ("Skill", {"skill": "s"}, "/s"),
        ("WebSearch", {"query": "q" * 60}, "q" * 50 + "..."), ("WebFetch", {"url": "u"}, "u"), ("AskUserQuestion", {"questions": [{"header": "H"}]}, "H"),
        ("LSP", {"operation": "def", "filePath": "/a/b.go"}, "def b.go"), ("LSP", {"operation": "def"}, "def"), ("TaskOutput", {"task_id": "7"}, "7"),
        ("KillShell", {"shell_id": "9"}, "9"), ("Other", {"z": 1, "a": [1, "b"]}, 'a=[1,"b"]'), ("Read", {"file_path": 5}, "file_path=5"),
        ("Other", {"n": None}, "n=<nil>"), ("Other", {}, ""), ("Read", "text", ""), ("Other", {"b": True}, "b=true"),
    ],
)
def test_preview(lines_of, name, args, preview):
    blocks = messages.explode_blocks(messages.build_messages(records.decode(lines_of({"s": [answer([call(name, args)])]}))))
    assert tool_calls.pair_calls(blocks).first().preview == preview


def calls_table(lines_of, name, args):
    blocks = messages.explode_blocks(messages.build_messages(records.decode(lines_of({"s": [answer([call(name, args)])]}))))
    return [r.asDict() for r in tool_calls.tool_arguments(blocks, name).collect()]


def test_argument_tables(lines_of):
    todos = {"todos": [{"content": "a", "status": "completed"}, "skip", {"status": "in_progress"}, {"content": "c", "status": "later"}]}
    assert [(r["todo_no"], r["content"], r["status_class"]) for r in calls_table(lines_of, "TodoWrite", todos)] == [
        (0, "a", "completed"), (2, "", "in_progress"), (3, "c", "pending")
    ]
    asked = calls_table(lines_of, "AskUserQuestion", {"questions": [{"header": "h", "options": [{"label": "l"}, 4]}, {"question": "q"}]})
    assert [(r["question_no"], r["header"], r["question_text"], r["option_no"], r["label"], r["description"]) for r in asked] == [
        (0, "h", "", 0, "l", ""), (1, "", "q", None, None, None)
    ]
    lsp = calls_table(lines_of, "LSP", {"operation": "o", "line": 3.9, "character": "x"})[0]
    assert (lsp["line"], lsp["character"], lsp["filePath"]) == (3, 0, None)
    assert calls_table(lines_of, "Nope", [1, {"b": 1, "a": 2}])[0]["arguments"] == '[1,{"a":2,"b":1}]'
    assert calls_table(lines_of, "Write", {"content": "äb"})[0]["n_chars"] == 2


def test_last_result_wins(lines_of):
    rows = [
        answer([call("Bash", {"command": "a"}, id="x"), call("Read", {}, id="y"), call("Read", {}, id="")]), user([result("one", "x")]),
        user([result("two", "x"), result("three", "x", is_error=True), result("lost", "")]),
    ]
    blocks = messages.explode_blocks(messages.build_messages(records.decode(lines_of({"s": rows}))))
    got = [(r.tool_id, r.result_line, r.result_block, r.is_error, r.is_active) for r in tool_calls.pair_calls(blocks).orderBy("block_no").collect()]
    assert got == [("x", 2, 1, True, True), ("y", None, None, None, False), ("", None, None, None, False)]


@pytest.mark.parametrize(
    "name, shown, lang",
    [("Bash", "x", "bash"), ("Read", "file_path: a.go", "go"), ("Edit", "file_path: a.ts", "javascript"), ("Write", "file_path: a.rs", "rust"),
     ("Read", "path: a.go", ""), ("Read", "file_path: a.c", ""), ("Grep", "file_path: a.py", "")],
)
def test_language(spark, name, shown, lang):
    assert value(spark, tools.guess_language(F.lit(name), F.lit(shown))) == lang


def test_code_blocks(spark):
    texts = [
        (0, "a\n```py\nx = 1\n\ny\n```\nb\n```\nplain\n```tail\nc"), (1, "```\nopen\nend\n"), (2, " ```no\n"), (3, "```\n```"), (4, "```go"),
    ]
    df = spark.createDataFrame(texts, "id int, text string")
    got = [(r.id, r.code_no, r.language, r.body) for r in markup.code_blocks(df, ["id"]).orderBy("id", "code_no").collect()]
    assert got == [(0, 0, "py", "x = 1\n\ny"), (0, 1, "text", "plain"), (1, 0, "text", "open\nend\n"), (3, 0, "text", ""), (4, 0, "go", "")]


def test_tables(spark):
    body = "| a | b |\n|---|---|\n| 1 |  |\ntext\n  |x|\n```\n|no|\n``` | rest\n|y|z"
    got = markup.table_cells(spark.createDataFrame([(0, body), (1, "|---|"), (2, "a | b")], "id int, text string"), ["id"])
    assert [(r.table_no, r.row_no, r.cell_no, r.cell) for r in got.orderBy("table_no", "row_no", "cell_no").collect()] == [
        (0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "1"), (0, 1, 1, ""), (1, 0, 0, "x"), (2, 0, 0, "y"), (2, 0, 1, "z")
    ]


def test_json_is_laid_out_at_any_depth(spark):
    rng = random.Random(3)

    def value(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice([None, True, 12, -3, "", 'a "quoted" \\ text', "{[,:]}", "é漢\n\t", "x\\", {}, []])
        if rng.random() < 0.5:
            return [value(depth - 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice(["k", 'q"', "b{", "a:", "z\\"]) + str(n): value(depth - 1) for n in range(rng.randint(0, 4))}

    deep = {"end": []}
    for n in range(12):
        deep = {f"level {n}": [deep, n]}
    cases = [deep, {"long": '\\"' * 60_000 + "x" * 200_000}, list(range(3000)), *(value(6) for _ in range(60))]
    frame = spark.createDataFrame([(n, json.dumps(c, ensure_ascii=False)) for n, c in enumerate(cases)], "n int, j string")
    got = {r.n: r.t for r in frame.select("n", export.laid_out(F.parse_json("j")).alias("t")).collect()}
    assert got == {n: json.dumps(c, indent=2, ensure_ascii=False, sort_keys=True) for n, c in enumerate(cases)}
