"""Media columns: content-addressed payloads in tar shards.

A payload becomes an 8-bit grey PNG image (filter 0, one IDAT chunk), stored as a member of a tar shard and named by the
SHA-256 of the image. Rows carry digest, shard, offset and length and no bytes, so tables of media stay small through
joins and shuffles. Equal payloads are stored once in all: texts are digested where they are read, the row at the first
position of each digest writes the payload, and the others refer to it. Metadata (format, width, height, depth) comes from
a range read of the image's first 33 bytes; only decoding reads the rest. Stored forms are checked against their digest.

A task writes its rows' payloads one after another in shards of about 32 MB and holds one payload at a time. Shards are
read once for each stored payload, not for each row; what is found joins the rows by digest, where a hot digest is a
skewed join of small rows, which adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triago.llm.common import shared_dir, table, tasks, written
from triago.llm.positions import FILE, INDEX, finder, positioned, shielded
from triago.llm.shards import ShardReader, ShardWriter

UNIT = 576
#: Fixed values of the PNG format.
PNG_SIGN, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33
REFERENCE = "media_sha256 string, shard string, offset long, length long"


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` and bytes 255 up to a positive multiple of ``unit``."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\xff")


def png_encode(payload: bytes, width: int = UNIT) -> bytes:
    """A grey image of ``width`` samples a row that holds the payload, whose length is a multiple of width."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height = len(payload) // width
    rows = b"\0" + b"\0".join(payload[i * width : (i + 1) * width] for i in range(height))
    return PNG_SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from an image's first HEADER_BYTES bytes."""
    if head[:8] != PNG_SIGN or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not the header of a PNG image")
    return struct.unpack(">IIB", head[16:25])


def png_decode(image: bytes) -> bytes:
    """The samples of an image made by ``png_encode``."""
    width, height, _ = png_header(image[:HEADER_BYTES])
    at, packed = HEADER_BYTES, b""
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            packed += image[at + 8 : at + 8 + n]
        at += n + 12
    rows = zlib.decompress(packed)
    if len(rows) != height * (width + 1) or rows[:: width + 1].count(0) != height:
        raise ValueError("the image has other rows than its header tells")
    view = memoryview(rows)
    return b"".join(view[i * (width + 1) + 1 : (i + 1) * (width + 1)] for i in range(height))


def tar_member(name: str, data: bytes) -> tuple[bytes, int]:
    """A tar member and the offset of its data in it."""
    info = tarfile.TarInfo(name)
    info.size = len(data)
    head = info.tobuf(tarfile.USTAR_FORMAT)
    return head + data + b"\0" * (-len(data) % 512), len(head)


def contents(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their positions, and a table of key, n_bytes and content (the SHA-256 digest of the text's UTF-8 form, null
    as empty) of each."""
    own = positioned(shielded(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), ("key", "text"))[0])
    raw = F.coalesce(F.col("text"), F.lit(""))
    return own, written(own.select(FILE, INDEX, "key", F.octet_length(raw).cast("long").alias("n_bytes"), F.unhex(F.sha2(raw.cast("binary"), 256)).alias("content")))


def stored(own: DataFrame, marked: DataFrame, folder: str) -> DataFrame:
    """Writes each content once to tar shards in ``folder`` and lists content, media_sha256, shard, offset, length."""
    first = marked.groupBy("content").agg(F.min(F.struct(FILE, INDEX)).alias("at"))
    find = finder(first.select(F.col(f"at.{FILE}").alias(FILE), F.col(f"at.{INDEX}").alias(INDEX), F.lit(1).alias("value")))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ShardWriter(folder, ".tar", tail=b"\0" * 1024) as out:
            for batch in batches:
                found = []
                for value in batch["text"][find(batch[FILE], batch[INDEX]) == 1]:
                    if out.full():
                        out.start()
                    raw = b"" if value is None else value.encode()
                    image = png_encode(padded(raw))
                    digest = hashlib.sha256(image).hexdigest()
                    member, skip = tar_member(f"{digest}.png", image)
                    shard, at, _ = out.add(member)
                    found.append((hashlib.sha256(raw).digest(), digest, shard, at + skip, len(image)))
                yield pd.DataFrame(found, columns=["content", "media_sha256", "shard", "offset", "length"])

    return written(own.select(FILE, INDEX, "text").mapInPandas(task, f"content binary, {REFERENCE}"))


def store(rows: DataFrame, folder: str, key: str, text: str) -> DataFrame:
    """Writes the text column's UTF-8 payloads (null as empty), equal ones once, to tar shards in ``folder`` and lists
    key, n_bytes, media_sha256, shard, offset, length of each row."""
    own, marked = contents(rows, key, text)
    listed = marked.join(stored(own, marked, folder), "content")
    return listed.select(F.col("key").alias(key), "n_bytes", *(x.split()[0] for x in REFERENCE.split(", ")))


def _by_shard(listed: DataFrame) -> DataFrame:
    return listed.repartition(tasks(listed), "shard").sortWithinPartitions("shard", "offset")


def with_header(listed: DataFrame, folder: str) -> DataFrame:
    """``listed`` with media_format, width, height and depth, by range reads of HEADER_BYTES bytes each."""
    names = listed.columns

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ShardReader(folder) as source:
            for batch in batches:
                heads = [png_header(source.read(s, o, HEADER_BYTES)) for s, o in zip(batch["shard"], batch["offset"], strict=True)]
                batch["media_format"] = "png"
                for i, name in enumerate(("width", "height", "depth")):
                    batch[name] = [h[i] for h in heads]
                yield batch

    return _by_shard(listed.select(*(F.col(c) for c in names))).mapInPandas(task, ", ".join(f"`{n}` {t}" for n, t in listed.dtypes) + ", media_format string, width int, height int, depth int")


def decoded(listed: DataFrame, folder: str) -> DataFrame:
    """``listed`` with payload_bytes, payload_sha256, tail_crc32 (of the last 32 bytes), mean and deviation of the
    samples, read back from the stored images; a stored form with another digest raises."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        last, made = None, ()
        with ShardReader(folder) as source:
            for batch in batches:
                rows = []
                for digest, shard, offset, length in zip(batch["media_sha256"], batch["shard"], batch["offset"], batch["length"], strict=True):
                    if (shard, offset) != last:
                        image = source.read(shard, offset, length)
                        if hashlib.sha256(image).hexdigest() != digest:
                            raise ValueError(f"{shard} holds other bytes at {offset} than {digest}")
                        payload = png_decode(image)
                        counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                        levels, n = np.arange(256), len(payload)
                        total, squares = int(counts @ levels), int(counts @ (levels * levels))
                        made = (n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), total / n, max(0.0, squares / n - (total / n) ** 2) ** 0.5)
                        last = (shard, offset)
                    rows.append(made)
                for i, name in enumerate(("payload_bytes", "payload_sha256", "tail_crc32", "mean", "deviation")):
                    batch[name] = [r[i] for r in rows]
                yield batch

    return _by_shard(listed).mapInPandas(task, ", ".join(f"`{n}` {t}" for n, t in listed.dtypes) + ", payload_bytes long, payload_sha256 string, tail_crc32 long, mean double, deviation double")


def op10_media_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each documents row. Null texts are stored as empty payloads (one padded unit), a null doc_id stays
    null, repeated rows and equal texts have equal values; an empty table gives an empty result. Other columns are not
    read."""
    folder = f"{shared_dir(spark)}/tar"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    own, marked = contents(table(spark, sf_dir, "documents"), "doc_id", "text")
    seen = written(decoded(with_header(stored(own, marked, folder), folder), folder))
    media = marked.withColumnRenamed("key", "doc_id").join(seen, "content")
    feature = F.format_string("%s:%dx%dx%d:mean=%.4f:sd=%.4f", "media_format", "width", "height", "depth", "mean", "deviation")
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", feature.alias("feature"))
