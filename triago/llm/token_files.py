"""Token ids as Parquet list columns: files in document order, made for selective reads.

Documents are put in ascending order by range partitions, encoded where they arrive, and written by Spark's Parquet writer,
whose commit protocol leaves each task's file once, whatever is lost or repeated. ``Layout`` sets what the files look like:
the encoding of ids (a dictionary for each row group, or delta packing), the size of row groups, and the number of bytes and
rows of a page; the writer adds page indexes. Rows also carry their number of ids, the partition they were written by and the
ids of that partition's earlier documents, so that where a document starts in the whole corpus is one addition to its
partition's start. Readers of counts and places leave the column of ids alone, and readers of a range of documents skip row
groups and pages by their statistics, as the files are sorted by doc_id.

Encoding by parts: the vocabulary's normaliser and pattern never look across a space or a line feed (they compose with no
character, white space belongs to no match, and case is folded for each character alone), so ids of a text are those of its
parts between these, one after another. The same holds where an ASCII letter or digit meets one of some ASCII signs, and ASCII
parts have the ids of their lower case, unless a special token may be in them. Of each few megabytes of text the library encodes every distinct part once, unless it is
one of the frequent parts, bounded in number, that a worker keeps.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triago.llm.common import release_memory, shared_dir, table

#: Fixed value: the id that ends each document.
END = 2
VOCABULARY = "word_bpe_49k.json"
#: Frequent parts that a worker keeps the ids of, the longest it keeps, in characters, and how many it has encoded in one call.
KEPT, KEPT_CHARS, TOGETHER = 400_000, 64, 200
#: Where the pattern always cuts, as none of these composes with a character before or after it, begins a
#: contraction or stands in a special token; and what goes there.
APART = (r"([A-Za-z0-9])([,.;:!?)$&%*#])", r"\1 \2")
#: Fixed value: a special token of the vocabulary, which matches verbatim and takes no white space with it.
BETWEEN = "<|endoftext|>"
#: Bytes of texts that are worked on at once, if they are several.
CHARS = 4_000_000
#: Partitions whose starts are added up together; then these sums are.
BLOCK = 1024
SCHEMA = "doc_id long, n_tokens int, part int, before long, ids array<int>"


@dataclass(frozen=True)
class Layout:
    """How files of ids are laid out: ``encoding`` of ids ("dictionary" or "delta"), bytes of a row group, bytes and most
    rows of a page."""

    encoding: str = "dictionary"
    row_group_bytes: int = 16 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 1000

    def options(self) -> dict[str, str]:
        if self.encoding not in ("dictionary", "delta"):
            raise ValueError(f"no encoding {self.encoding!r}: dictionary or delta")
        ids = "ids.list.element"
        return {
            "parquet.writer.version": "PARQUET_2_0", f"parquet.enable.dictionary#{ids}": str(self.encoding == "dictionary").lower(), "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes), "parquet.page.row.count.limit": str(self.page_rows), "compression": "zstd",
        }


class Encoder:
    """Ids of texts by the tokenizers library, each distinct part of them once, and ids of frequent parts kept."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
        self.library = Tokenizer.from_file(vocabulary)
        self.between = self.library.token_to_id(BETWEEN)
        self.known, self.sizes, self.ids = pa.array([], pa.string()), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def _learned(self, parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each part, and the ids of all. Parts are encoded joined by BETWEEN, as the library cuts at
        a special token before anything else; parts that hold one themselves are encoded alone."""
        sizes, found = np.zeros(len(parts), dtype=np.int64), [np.zeros(0, dtype=np.int32)]
        own = pc.match_substring(parts, BETWEEN).to_numpy(zero_copy_only=False)
        for at in range(0, len(parts), TOGETHER):
            some, alone = parts[at : at + TOGETHER].to_pylist(), own[at : at + TOGETHER]
            if alone.any():
                each = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
                sizes[at : at + len(each)] = list(map(len, each))
                found.append(np.fromiter(itertools.chain.from_iterable(each), dtype=np.int32))
                continue
            (joined,) = self.library.encode_batch_fast([BETWEEN.join([*some, ""])], add_special_tokens=False)
            ids = np.array(joined.ids, dtype=np.int32)
            between = ids == self.between
            sizes[at : at + len(some)] = np.diff(np.flatnonzero(between), prepend=-1) - 1
            found.append(ids[~between])
        return sizes, np.concatenate(found)

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and the ids of all."""
        parts = pc.split_pattern(pc.replace_substring(pc.replace_substring_regex(texts, *APART), "\n", " "), " ")
        coded, bounds = pc.list_flatten(parts).dictionary_encode(), np.insert(np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False)), 0, 0)
        plain = pc.and_not(pc.string_is_ascii(coded.dictionary), pc.match_substring(coded.dictionary, "<"))
        folded = pc.if_else(plain, pc.ascii_lower(coded.dictionary), coded.dictionary).dictionary_encode()
        every, used = folded.dictionary, folded.indices.to_numpy()[coded.indices.to_numpy()]
        place = pc.fill_null(pc.index_in(every, value_set=self.known), -1).to_numpy()
        new = np.flatnonzero(place < 0)
        new_sizes, new_ids = self._learned(every.take(pa.array(new)))
        sizes, ids = np.concatenate([self.sizes, new_sizes]), np.concatenate([self.ids, new_ids])
        place = place.astype(np.int64)
        place[new] = len(self.sizes) + np.arange(len(new))
        out = gathered(sizes, ids, place[used])
        self._keep(every, place, np.bincount(used, minlength=len(every)), sizes, ids)
        ends = np.insert(np.cumsum(sizes[place[used]]), 0, 0)[bounds]
        return np.diff(ends), out

    def _keep(self, every: pa.StringArray, place: np.ndarray, counts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """As far as there is room: parts that came twice or more in these texts, those known before, the others."""
        short, often = pc.utf8_length(every).to_numpy() <= KEPT_CHARS, counts > 1
        first, last = np.flatnonzero(often & short), np.flatnonzero(~often & short & (place >= len(self.known)))
        unseen = np.ones(len(self.known), dtype=bool)
        unseen[place[first][place[first] < len(self.known)]] = False
        before = np.flatnonzero(unseen)
        kept = np.concatenate([place[first], before, place[last]])[:KEPT]
        words = pa.concat_arrays([every.take(pa.array(first)), self.known.take(pa.array(before)), every.take(pa.array(last))])
        self.known, self.sizes, self.ids = pa.concat_arrays([words.slice(0, len(kept))]), sizes[kept], gathered(sizes, ids, kept)


def gathered(sizes: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The ids at the given places of a list of parts, of which ``ids`` holds all, one after another."""
    starts, wanted = np.cumsum(sizes) - sizes, sizes[places]
    at = np.repeat((starts[places] - (np.cumsum(wanted) - wanted)).astype(np.int32), wanted)  # slices of text are far below 2^31 ids
    at += np.arange(len(at), dtype=np.int32)
    return ids[at]


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One for each worker process, which keeps what it has learned over tasks."""
    if vocabulary not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def chunks(lengths: list[int], limit: int = CHARS) -> Iterator[slice]:
    """Slices of texts of at most ``limit`` bytes, or of one text."""
    at, n = 0, 0
    for i, length in enumerate(lengths):
        if i > at and n + length > limit:
            yield slice(at, i)
            at, n = i, 0
        n += length
    if lengths:
        yield slice(at, len(lengths))


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, part, before and ids of ``docs`` in range partitions by ascending doc_id, null ids last.

    Null texts count as empty ones and have only the end id. Rows of one doc_id are in the order of their texts' hashes; as
    equal ones can't be told apart, they may be dealt to several partitions.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = (F.col("none"), F.col("doc_id"), F.col("tie"), F.col("row"))
    rows = docs.select(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before, part = encoder(vocabulary), 0, TaskContext.get().partitionId()
        for batch in batches:
            for some in chunks(pc.binary_length(batch.column(1)).to_pylist()):
                rows = batch.slice(some.start, some.stop - some.start)
                sizes, found = encode(rows.column(1))
                ends = np.cumsum(sizes + 1)
                ids = pa.ListArray.from_arrays(pa.array(np.insert(ends, 0, 0).astype(np.int32)), pa.array(np.insert(found, np.cumsum(sizes), END)))
                columns = [rows.column(0), pa.array((sizes + 1).astype(np.int32)), pa.array(np.full(len(sizes), part, dtype=np.int32)), pa.array(before + ends - sizes - 1), ids]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "part", "before", "ids"])
                before += int(ends[-1])
                del found, ids, columns
                release_memory()

    return ranged.mapInArrow(task, SCHEMA)


def write(docs: DataFrame, folder: str, vocabulary: str, layout: Layout | None = None) -> None:
    """Encodes all of ``docs`` (doc_id, text) and writes the ids as Parquet files below ``folder``, with the table of the
    partitions' starts beside them. Files are in document order by name, rows in document order in each."""
    spark, options = docs.sparkSession, (layout or Layout()).options()
    encoded(docs, vocabulary).write.options(**options).parquet(f"{folder}/ids")
    rows = spark.read.schema(SCHEMA).parquet(f"{folder}/ids")
    sums = rows.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("docs")).withColumn("block", F.floor(F.col("part") / BLOCK))
    blocks = sums.groupBy("block").agg(F.sum("tokens").alias("all"))  # one row for each BLOCK partitions
    starts = blocks.select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("start"))
    within = F.sum("tokens").over(Window.partitionBy("block").orderBy("part")) - F.col("tokens")
    sums.withColumn("within", within).join(starts, "block").select("part", "docs", "tokens", (F.col("start") + F.col("within")).alias("start")).write.parquet(f"{folder}/starts")


def _starts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part int, docs long, tokens long, start long").parquet(f"{folder}/starts")


def read(spark: SparkSession, folder: str, parts: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of what ``write`` left in ``folder``, of all partitions
    or the given first to last. Columns that aren't selected aren't read, and conditions on doc_id reach the pages."""
    rows = spark.read.schema(SCHEMA).parquet(f"{folder}/ids")
    if parts:
        rows = rows.where(F.col("part").between(*parts))
    return rows.join(_starts(spark, folder).select("part", "start"), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def tokens(spark: SparkSession, folder: str, start: int, end: int) -> DataFrame:
    """doc_id, start and ids of the stretch [start, end) of the corpus: the first and last document of it give the part of
    their ids that lies inside. Files of partitions that the stretch doesn't touch are skipped by their statistics."""
    touched = _starts(spark, folder).where((F.col("start") < end) & (F.col("start") + F.col("tokens") > start)).agg(F.min("part").alias("a"), F.max("part").alias("b")).first()
    rows = read(spark, folder, (touched.a, touched.b) if touched.a is not None else (0, -1)).where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > start))
    skip = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    size = F.least(F.col("n_tokens"), F.lit(end) - F.col("start")) - skip
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), size.cast("int")).alias("ids"))


def with_crc(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, start, n_tokens, ids) with ids_crc32 in place of ids: of the ids as little-endian 32-bit numbers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            raw, ends = memoryview(ids.values.to_numpy().astype("<i4", copy=False)).cast("B"), ids.offsets.to_numpy() * 4
            found = pa.array([zlib.crc32(raw[a:b]) for a, b in itertools.pairwise(ends.tolist())], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), found], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files read back.

    Null texts are documents of the end id alone, null ids come last, repeated rows and ids are documents of their own, an
    empty table gives an empty result. Other columns are not read.
    """
    import public_tokenizers

    folder = shared_dir(spark)
    write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path(VOCABULARY))
    return with_crc(read(spark, folder))
