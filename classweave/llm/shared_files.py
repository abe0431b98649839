"""Files that tasks write to and read from the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and the folder's path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = open_folder(uri)
    system.create_dir(path, recursive=True)


def new_name(prefix: str, suffix: str) -> str:
    """A name of its own for every attempt, so that retries never share a file."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"
