import json

import pytest

from threadloom.session import build_session

LINE_SCHEMA = "project_key string, session_id string, line_no bigint, value string"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines_of(spark):
    """Sessions as lists of records (dicts, or raw text) to a frame of lines."""
    def make(sessions: dict, project: str = "-p"):
        rows = [
            (project, sid, n, r if isinstance(r, str) else json.dumps(r, ensure_ascii=False))
            for sid, records in sessions.items()
            for n, r in enumerate(records)
        ]
        return spark.createDataFrame(rows, LINE_SCHEMA)

    return make


def user(content="hi", **extra):
    return {"type": "user", "message": {"role": "user", "content": content}, **extra}


def answer(content="ok", **extra):
    return {"type": "assistant", "message": {"role": "assistant", "content": content}, **extra}


def call(name, args, id="t1", **extra):
    return {"type": "tool_use", "id": id, "name": name, "input": args, **extra}


def result(content, id="t1", **extra):
    return {"type": "tool_result", "tool_use_id": id, "content": content, **extra}
