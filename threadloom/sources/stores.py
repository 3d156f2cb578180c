"""Files of a shared folder, opened where a task or the driver needs bytes and not rows."""

from __future__ import annotations

import json
import re

from pyarrow import fs


def open_store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it; plain paths and ``file:`` are local."""
    local = re.match(r"file:/*(/.*)", root)
    if local or "://" not in root:
        return fs.LocalFileSystem(), local.group(1) if local else root
    return fs.FileSystem.from_uri(root)


def read_json(store: fs.FileSystem, path: str):
    with store.open_input_stream(path) as file:
        return json.loads(file.read())


def write_json(store: fs.FileSystem, path: str, value) -> None:
    """A small file that is there whole or not at all."""
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(f"{path}.part") as file:
        file.write(json.dumps(value).encode())
    store.move(f"{path}.part", path)
