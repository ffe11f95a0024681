"""Whole files in shared storage, by any address that Arrow's file systems know (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write(uri: str, parts: Iterable[bytes]) -> int:
    """Write a file whole or not at all: under another name first, then moved. Returns its size."""
    system, path = place(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    hidden, size = f"{path}.{uuid.uuid4().hex}.part", 0
    with system.open_output_stream(hidden) as out:
        for x in parts:
            out.write(x)
            size += len(x)
    system.move(hidden, path)
    return size


class Reader:
    """Range reads of a file."""

    def __init__(self, uri: str):
        system, path = place(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def at(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset) if length else b""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()
