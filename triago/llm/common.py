"""What the operators share: table access, the shared folder, and small column helpers."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triago.shared import shared_dir, written

__all__ = ["SPACE_CLASS", "WORD", "crc_mod", "let", "release_memory", "shared_dir", "table", "tasks", "written"]

#: White space is 0x20 and 0x09-0x0D; everything else belongs to words.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(df: DataFrame) -> int:
    """The session's number of shuffle partitions: for rows that stand for much more work than their bytes show, and so
    must not be gathered into few tasks by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def release_memory() -> None:
    """Gives freed memory of a Python worker back to the system. Workers live on from stage to stage, and what one stage
    has freed would otherwise count against the next."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text, modulo n; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(n)
