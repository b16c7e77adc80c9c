"""SimHash near-duplicates by an inverted index of byte positions with a count filter.

Fingerprints have eight bytes. Two that differ in at most ``max_bits`` bits differ in at most as many bytes, so at least
``8 - max_bits`` positional bytes are shared: the guaranteed minimum of matches. A plain index of single positional bytes
has 2048 posting lists, each of 1/256 of all fingerprints, and tallying its pairs is quadratic. Here the count filter is
applied when postings are made: a posting's key is a set of ``8 - max_bits`` positions with their bytes, so exactly the
pairs whose tally reaches the minimum meet in a list, and no list grows with the square of the corpus (for 3 bits, 56
postings of 40 bits a fingerprint). Members of a list differ in ``max_bits`` known bytes only; the tally and the bits are
verified inside the list.

Only distinct fingerprints are indexed, so copies never meet as pairs. A list yields links that span its connected
parts, at most its length less one, and components over all lists are those over all links: two linked fingerprints
share a list and are connected in it. Lists hold distinct values of ``max_bits`` bytes, so at most 2^24 (for 3 bits) of 8
bytes each; up to ``BLOCK`` members are compared with each other, longer lists are sorted under masks, linear in the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triago.llm.common import release_memory, table, written
from triago.llm.components import components
from triago.llm.near_copies import one_of_each as one_of_each
from triago.llm.near_copies import placed
from triago.llm.positions import finder, for_found
from triago.llm.shingles import SEED, shingles, split_words

BLOCK = 4096


def fingerprint(parts: list[bytes], words: int = 3) -> int:
    """The unsigned fingerprint: a bit is set if it is in over half of the shingles' XXH64 hashes. Without words it is 0."""
    found = shingles(parts, words)
    if not found:
        return 0
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in found], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str, words: int = 3) -> DataFrame:
    """``docs`` without its text column and with fp, 64 bits as a signed number."""

    @F.pandas_udf("long")
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(split_words(t), words) for t in texts], dtype=np.uint64).view(np.int64))
        release_memory()

    return docs.withColumn("fp", marked(F.col(text))).select(*(c for c in docs.columns if c != text), "fp")


def postings(fps: DataFrame, matches: int) -> DataFrame:
    """(positions, bytes, fp): the index entries of each fingerprint, one for each set of ``matches`` positions."""
    masks = [sum(0xFF << 8 * p for p in chosen) for chosen in combinations(range(8), matches)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    entries = F.array(*(F.struct(F.lit(i).cast("byte").alias("positions"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bytes")) for i, m in enumerate(signed)))
    return fps.select("fp", F.inline(entries))


def _masked(fps: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Links of a long list whose members differ in few known bits: two differ in at most ``max_bits`` bits if and only
    if they are equal with some ``max_bits`` of those bits masked."""
    spread = np.bitwise_or.reduce(fps ^ fps[0])
    free = [b for b in range(64) if int(spread) >> b & 1]
    for masked in combinations(free, min(max_bits, len(free))):
        rest = fps & ~np.uint64(sum(1 << b for b in masked))
        order = np.argsort(rest, kind="stable")
        for k in np.flatnonzero(rest[order[1:]] == rest[order[:-1]]):
            yield int(order[k]), int(order[k + 1])


def _nearest(fps: np.ndarray, max_bits: int, matches: int) -> Iterator[tuple[int, int]]:
    """Links of each member with the nearest earlier one in each connected part of the earlier ones that it reaches."""
    part = np.arange(len(fps))
    for i in range(1, len(fps)):
        differ = fps[:i] ^ fps[i]
        bits = np.bitwise_count(differ)
        near = np.flatnonzero(bits <= max_bits)
        if len(near):
            tally = (differ[near].view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = near[tally >= matches]
        near = near[np.argsort(bits[near], kind="stable")]
        for p, at in zip(*np.unique(part[near], return_index=True), strict=True):
            yield i, int(near[at])
            part[: i + 1][part[: i + 1] == p] = i


def links(fps: DataFrame, max_bits: int = 3, matches: int = 5) -> DataFrame:
    """(u, v): links of distinct fingerprints (fp) that share ``matches`` positional bytes or more and differ in at most
    ``max_bits`` bits; not all of them, but what they connect in a list these connect. With ``matches`` of at most
    ``8 - max_bits`` no link is missed."""

    def spanning(list_: pd.Series) -> Iterator[tuple[int, int]]:
        own = np.sort(list_.to_numpy().view(np.uint64))
        found = _masked(own, max_bits) if len(own) > BLOCK and matches >= 8 - max_bits else _nearest(own, max_bits, matches)
        signed = own.view(np.int64)
        return ((int(signed[i]), int(signed[j])) for i, j in found)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def out(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([x for _, g in frame.groupby(["positions", "bytes"], sort=False)["fp"] for x in spanning(g)], columns=["u", "v"], dtype="int64")

        for batch in batches:  # a list may go on in the next batch, so the last one waits
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if batch.empty:
                continue
            last = (batch["positions"] == batch["positions"].iloc[-1]) & (batch["bytes"] == batch["bytes"].iloc[-1])
            held = batch[last]
            yield out(batch[~last])
        if held is not None:
            yield out(held)
        release_memory()

    key = Window.partitionBy("positions", "bytes")
    met = postings(fps, matches).withColumn("n", F.count(F.lit(1)).over(key)).where("n > 1").select("positions", "bytes", "fp")
    return met.mapInPandas(task, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """key, fp and component_id (the smallest key reachable over links of at most ``max_bits`` differing bits, its own
    included) of each row.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Null keys are carried along and never
    name a component that has another key. Repeated rows each get a row. An empty table gives an empty result; other
    columns are not read.
    """
    marked = written(with_fingerprints(docs.select(F.col(key), F.col(text)), text, words).select(key, "fp"))
    distinct = written(marked.groupBy("fp").agg(F.min(key).alias("first")))
    roots = components(links(distinct.select("fp"), max_bits, 8 - max_bits))
    rooted = written(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(key, "fp", "component_id")


def linked_nodes(rows: DataFrame, nodes: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """(node, root): nodes of ``near_copies`` by the components of their fingerprints, each with the least node of its own;
    roots themselves have no row. Texts are read where they lie; a node and its fingerprint are what is shuffled."""

    def make(values: np.ndarray, texts: list) -> pd.DataFrame:
        out = pd.DataFrame({"node": values - 1, "fp": np.array([fingerprint(split_words(t), words) for t in texts], dtype=np.uint64).view(np.int64)})
        release_memory()
        return out

    marked = written(for_found(rows, finder(placed(nodes)), "text", make, "node long, fp long"))
    distinct = written(marked.groupBy("fp").agg(F.min("node").alias("first")))
    parts = components(links(distinct.select("fp"), max_bits, 8 - max_bits)).select(F.col("node").alias("fp"), F.col("root").alias("part"))
    parted = written(distinct.join(parts, "fp", "left").select("fp", "first", F.coalesce("part", "fp").alias("part")))
    least = parted.groupBy("part").agg(F.min("first").alias("root"))
    return written(marked.join(parted.join(least, "part").select("fp", "root"), "fp").where("node <> root").select("node", "root"))


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of all documents, a row for each of theirs; its docstring tells what nulls, repeated rows and
    empty tables give."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
