"""Shard files in the shared folder, written and read by executors through pyarrow's file systems.

A shard's name holds a random part, so a repeated or speculative task never writes into another's file; readers know
shards only from the manifest rows of the task that succeeded. Persist the manifest (``common.written``) before reading.
"""

from __future__ import annotations

import uuid

import pyarrow.fs


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Appends byte strings to shards of about ``limit`` bytes in ``folder``; ``add`` gives (shard, offset, length)."""

    def __init__(self, folder: str, suffix: str, limit: int = 32 << 20, head=None, tail: bytes = b""):
        self.folder, self.suffix, self.limit, self.head, self.tail = folder, suffix, limit, head, tail
        self.fs, self.root = opened(folder)
        self.stream, self.name, self.at = None, "", 0

    def start(self) -> None:
        self.close()
        self.name = f"{uuid.uuid4().hex}{self.suffix}"
        self.stream, self.at = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None, buffer_size=1 << 20), 0
        if self.head:
            self._write(self.head(self.name))

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def full(self) -> bool:
        return self.stream is None or self.at >= self.limit

    def add(self, data: bytes) -> tuple[str, int, int]:
        at = self.at
        self._write(data)
        return self.name, at, len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.write(self.tail)
            self.stream.close()
            self.stream = None

    def __enter__(self):
        return self

    def __exit__(self, *failure):
        self.close()


class ShardReader:
    """Reads ranges of shards in ``folder``; rows sorted by shard and offset open each shard once."""

    def __init__(self, folder: str):
        self.fs, self.root = opened(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.file, self.name = self.fs.open_input_file(f"{self.root}/{name}"), name
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None

    def __enter__(self):
        return self

    def __exit__(self, *failure):
        self.close()
