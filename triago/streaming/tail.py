"""Files that grow, as a stream of their whole lines.

Spark's file streams take a file once and whole. This source keeps an offset for each file, in bytes, and hands on what lies
between two offsets; an offset is always at the end of a line, so a line that is still being written waits. Offsets stand in the
query's checkpoint, so a restart goes on where the last batch ended. Each file is a partition of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "growing_lines"
#: Bytes of a file that are searched at once for its last line break, and the most of a file in a partition.
BLOCK, MOST = 1 << 16, 64 << 20


class Stretch(InputPartition):
    def __init__(self, uri: str, start: int, end: int):
        self.uri, self.start, self.end = uri, start, end


def last_break(file: pyarrow.fs.FileSystem, path: str, start: int, size: int) -> int:
    """The end of the last whole line between start and size; start if there is none."""
    with file.open_input_file(path) as f:
        at = size
        while at > start:
            low = max(start, at - BLOCK)
            found = f.read_at(at - low, low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return start


class GrowingLines(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        """Ends of whole lines by file. Python hands a reader's last offset to ``partitions`` only, so they are found anew."""
        fs, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        infos = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
        ends = {i.base_name: last_break(fs, i.path, 0, i.size) for i in infos if i.type == pyarrow.fs.FileType.File and i.base_name.endswith(self.suffix) and not i.base_name.startswith(".")}
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        fs, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        out = []
        for name, to in now.items():
            at = before.get(name, 0)
            while at < to:  # long stretches are cut, at lines
                cut = last_break(fs, f"{root}/{name}", at, min(to, at + MOST)) if to - at > MOST else to
                cut = to if cut == at else cut
                out.append(Stretch(f"{self.folder.rstrip('/')}/{name}", at, cut))
                at = cut
        return out

    def read(self, part: Stretch) -> Iterator[tuple]:
        fs, path = pyarrow.fs.FileSystem.from_uri(part.uri)
        with fs.open_input_file(path) as f:
            at = part.start
            for line in f.read_at(part.end - part.start, part.start).split(b"\n")[:-1]:
                yield part.uri.rsplit("/", 1)[1], at, line.decode("utf-8", "replace").removesuffix("\r")
                at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class GrowingLinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, offset long, value string"

    def streamReader(self, schema: StructType) -> GrowingLines:
        return GrowingLines(self.options["path"], self.options.get("suffix", ".jsonl"))


def growing_lines(spark: SparkSession, folder: str, suffix: str = ".jsonl"):
    """A stream of (file, offset, value): each whole line of the files in a folder (a URI) once, as they grow."""
    spark.dataSource.register(GrowingLinesSource)
    return spark.readStream.format(NAME).option("path", folder).option("suffix", suffix).load()
