"""Decisions on rows, applied where the rows are read, so that whole texts are not shuffled to meet them.

A row is known by its file and its index in that file. Decisions (file, index, value) are written as small side files, one
for each run of ``RUN`` rows of a data file, so that a large file's decisions are many tasks' work; a scan looks up those of
the run it is in. A task holds one side file at a time, 16 bytes for each decided row of a run. Lists tell which runs have a side file,
so that a lost one raises instead of passing for a run without decisions.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triago.llm.common import shared_dir, tasks, written
from triago.llm.shards import opened

FILE, INDEX = "_row_file", "_row_index"
#: Rows of a data file whose decisions make one side file, and names of side files in one list.
RUN, LISTED = 1 << 20, 4096


def shielded(docs: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but the needed ones under names that no operator uses, and the columns that give the
    original table back."""
    names = [c if c in needed else f"kept_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def _straight(plan: JavaObject) -> bool:
    """Whether each row of a plan is a row of a file, and each file's row comes once at most."""
    children = plan.children()
    known = plan.getClass().getSimpleName() in ("LogicalRelation", "Project", "Filter")
    return known and children.size() <= 1 and all(_straight(children.apply(i)) for i in range(children.size()))


def positioned(docs: DataFrame) -> DataFrame:
    """``docs`` with the file and index of each row. Rows that don't come straight from Parquet files, each once, are
    written first. ``docs`` must have no column of these two names (``shielded``)."""
    if _straight(docs._jdf.queryExecution().optimizedPlan()):
        with contextlib.suppress(AnalysisException):  # a relation of another kind has no such column
            return _with_position(docs)
    return _with_position(written(docs))


def _with_position(docs: DataFrame) -> DataFrame:
    found = docs.metadataColumn("_metadata")
    return docs.withColumns({FILE: found["file_path"], INDEX: found["row_index"]})


def _name(file: str, run: int) -> str:
    return hashlib.md5(f"{run}:{file}".encode()).hexdigest() + ".npy"


def moved(fs: pyarrow.fs.FileSystem, draft: str, to: str) -> None:
    """A repeated task moves the same bytes into place; where a store refuses to replace a file, the first ones stay."""
    try:
        fs.move(draft, to)
    except OSError:
        if fs.get_file_info(to).type != pyarrow.fs.FileType.File:
            raise
        fs.delete_file(draft)


def finder(decisions: DataFrame, value: str = "value") -> Callable[[pd.Series, pd.Series], np.ndarray]:
    """A function for tasks: the long values of rows, given their files and indexes, 0 where there is none.
    ``decisions`` holds one row for each decided position."""
    folder = f"{shared_dir(decisions.sparkSession)}/side"
    path = decisions.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(decisions.sparkSession._jsc.hadoopConfiguration()).mkdirs(path)

    def put(name: str, data: bytes) -> None:
        fs, root = opened(folder)
        draft = f"{root}/{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft, compression=None) as out:
            out.write(data)
        moved(fs, draft, f"{root}/{name}")

    def save(file: str, run: int, parts: list[pd.DataFrame]) -> str:
        rows, data = pd.concat(parts), io.BytesIO()
        np.save(data, np.stack([rows[INDEX].to_numpy(np.int64), rows["value"].to_numpy(np.int64)]))
        put(_name(file, run), data.getvalue())
        return _name(file, run)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, parts, names = None, [], []
        for batch in batches:
            for key, rows in batch.groupby([FILE, "run"], sort=False):
                if key != held and parts:
                    names.append(save(*held, parts))
                    parts = []
                held = key
                parts.append(rows)
        if parts:
            names.append(save(*held, parts))
        yield pd.DataFrame({"name": names}, dtype=object)

    def save_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, names in zip(batch["list"], batch["names"], strict=True):
                put(f"{number}.list", "\n".join(sorted(names)).encode())
            yield batch[["list"]]

    rows = decisions.select(FILE, INDEX, F.floor(F.col(INDEX) / RUN).alias("run"), F.col(value).cast("long").alias("value"))
    saved = written(rows.repartition(tasks(rows), FILE, "run").sortWithinPartitions(FILE, INDEX).mapInPandas(task, "name string"))
    lists = 1 + saved.count() // LISTED
    every = saved.select(F.pmod(F.conv(F.substring("name", 1, 8), 16, 10).cast("long"), F.lit(lists)).alias("list"), "name").unionByName(decisions.sparkSession.range(lists).select(F.col("id").alias("list"), F.lit(None).cast("string").alias("name")))
    written(every.groupBy("list").agg(F.collect_list("name").alias("names")).mapInPandas(save_lists, "list long"))  # about LISTED names each
    held: dict[tuple[str, int], np.ndarray] = {}
    listed: dict[int, frozenset] = {}

    def got(name: str) -> bytes:
        fs, root = opened(folder)
        with fs.open_input_file(f"{root}/{name}") as f:
            return f.read()

    def of(name: str, run: int) -> np.ndarray:
        """The decided rows of a run. Which runs have a side file is listed, so one that is gone is an error."""
        if (name, run) not in held:
            held.clear()
            own = _name(name, run)
            number = int(own[:8], 16) % lists
            if number not in listed:
                listed.clear()
                listed[number] = frozenset(got(f"{number}.list").decode().split("\n"))
            held[name, run] = np.load(io.BytesIO(got(own))) if own in listed[number] else np.zeros((2, 0), dtype=np.int64)
        return held[name, run]

    def find(file: pd.Series, index: pd.Series) -> np.ndarray:
        out, every = np.zeros(len(file), dtype=np.int64), index.to_numpy(np.int64)
        for name, at in file.groupby(file.to_numpy(), sort=False).indices.items():
            for run in np.unique(every[at] // RUN):
                own = at[every[at] // RUN == run]
                known, wanted = of(name, int(run)), every[own]
                place = np.searchsorted(known[0], wanted)
                hit = place < known.shape[1]
                hit[hit] = known[0][place[hit]] == wanted[hit]
                out[own[hit]] = known[1][place[hit]]
        return out

    return find


def lookup(decisions: DataFrame, value: str = "value") -> Callable[[Column, Column], Column]:
    """``finder`` as a function of (file, index) columns; works on the rows' positions only."""
    find = finder(decisions, value)

    @F.pandas_udf("long")
    def found(file: pd.Series, index: pd.Series) -> pd.Series:
        return pd.Series(find(file, index))

    return found.asNondeterministic()  # or a filter on its result would evaluate it a second time


def for_found(rows: DataFrame, find: Callable[[pd.Series, pd.Series], np.ndarray], text: str, make: Callable[[np.ndarray, list], pd.DataFrame], schema: str) -> DataFrame:
    """``make(values, texts)`` of the rows whose value is not 0. One Python node looks up and works on the texts, so that
    a task needs one worker."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = find(batch[FILE], batch[INDEX])
            at = np.flatnonzero(values)
            yield make(values[at], [batch[text].iat[i] for i in at])

    return rows.select(FILE, INDEX, text).mapInPandas(task, schema)
