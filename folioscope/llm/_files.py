"""Binary files in the shared folder, through Arrow's file systems.

A task writes under a name of its own and renames at the end, so a task that runs
again after an executor is lost replaces its file by an equal one.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        if not uri.startswith("file:"):
            return fs.LocalFileSystem(), uri
        return fs.LocalFileSystem(), uri[5:]
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def create(uri: str) -> Iterator:
    """An output stream that appears under its name once it is whole."""
    store, path = locate(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        yield out
    store.move(part, path)


def open_at(uri: str):
    store, path = locate(uri)
    return store.open_input_file(path)
