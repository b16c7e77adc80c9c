"""Near-duplicates by Jaccard similarity of word shingles, all of them, by prefix filtering.

Sets of n and m shingles with a similarity of t or more share at least ``t x max(n, m)`` of them. So a text can have a
partner only if ``t x n`` of its shingles or more occur in other texts too. Shingles are counted over all texts; texts with
too few shared ones go, the shingles of those that stay are counted again, and so on while that takes many away. A passage
that many documents share goes with them unless it is most of them.

What stays has one order: shingles of no other text first, then by rising count. Of two similar texts the first
``n - ceil(t x n) + 1`` shingles of the one (its prefix) and those of the other have one in common: a posting list for each
prefix shingle brings every such pair together. The places of shared shingles and their number bound the similarity, and
what the bounds leave is verified on whole sets. A bitmap bounds it too: each shared shingle flips one of BITS bits, so two
sets differ in at least as many shingles as their bitmaps do in bits. It goes along in the lists and is part of the join's
condition, so that texts that merely have a passage in common leave no row.

Only connected parts matter, and a list whose members are one part needs no more comparisons. So first each member of a
list is compared with the list's hubs: of each band of sizes the member with the fewest shingles of its own, so the text
that edited copies were most likely made from. That is at most three pairs for each entry of a list, however long it is.
Then shingles are counted again, as shared only between different parts: large groups of copies go, as what they share with
other texts is too little. This is done again while most of what is tried proves similar. At the end all pairs of a list
that lie in different parts are compared; as one of the two is outside of the list's largest part, only those outside of it
are compared with the whole list. A link is always a verified pair, so none stands in another's way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triago.llm.common import release_memory, written
from triago.llm.components import components
from triago.llm.positions import FILE, INDEX, finder, for_found, lookup, positioned, shielded
from triago.llm.shingles import SEED, shingles, split_words

#: Counting goes on while the rows left are at most this share of those before.
WORTH = 0.8
#: Hubs are tried again while lists of more members are left.
LONG = 32
#: Bits of a set's bitmap, in longs of 64.
BITS = 256
MAPS = tuple(f"map{k}" for k in range(BITS // 64))


def same_words(text: str) -> Column:
    """a and b: two hashes of the whole sequence of words."""

    @F.pandas_udf("a long, b long")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            whole = [b" ".join(split_words(t)) for t in texts]
            found = np.array([(xxhash.xxh64_intdigest(w, SEED), xxhash.xxh64_intdigest(w, SEED + 1)) for w in whole], dtype=np.uint64).reshape(len(texts), 2).view(np.int64)
            yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})
        release_memory()

    return hashes(F.col(text))


def _distinct(text: str | None, words: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    return np.array(sorted({xxhash.xxh64_intdigest(s, SEED) - (1 << 63) for s in shingles(split_words(text), words)}), dtype=np.int64)


def hash_sets(rows: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the distinct shingles of the rows that ``members`` (their positions and node + 1 as value) names."""

    def make(values: np.ndarray, texts: list) -> pd.DataFrame:
        out = pd.DataFrame({"node": values - 1, "hashes": pd.Series([_distinct(t, words) for t in texts], dtype=object)})
        release_memory()
        return out

    return for_found(rows, finder(members), "text", make, "node long, hashes array<long>")


def placed(nodes: DataFrame) -> DataFrame:
    """The positions of ``nodes`` with node + 1 as value."""
    return nodes.select(F.col("at.file").alias(FILE), F.col("at.index").alias(INDEX), (F.col("node") + 1).alias("value"))


def _shared(entries: DataFrame) -> DataFrame:
    """(shingle, node, n, part) of shingles that nodes of different parts have."""
    key = Window.partitionBy("shingle")
    found = entries.withColumn("least", F.min("part").over(key)).withColumn("most", F.max("part").over(key))
    return written(found.where("least < most").select("shingle", "node", "n", "part"))


def _pruned(entries: DataFrame, similarity: float) -> DataFrame:
    """``entries`` less those of nodes that share too few shingles with other parts, over and over while much goes."""
    entries = _shared(entries)
    left = entries.count()
    while left:
        able = entries.groupBy("node", "n").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= similarity * F.col("n") - 1e-6)
        entries, before = _shared(entries.join(able.select("node"), "node", "left_semi")), left
        left = entries.count()
        if left >= WORTH * before:
            break
    return entries


def _lists(entries: DataFrame, similarity: float) -> DataFrame:
    """(shingle, at, node, n, m, part, members, and MAPS): prefix shingles that nodes of different parts have, and the number
    of these. m is the number of a node's shared shingles, at the place of this one among them, and MAPS their bitmap."""
    own, key = Window.partitionBy("node"), Window.partitionBy("shingle")
    ranked = entries.withColumn("members", F.count(F.lit(1)).over(key)).withColumn("m", F.count(F.lit(1)).over(own)).where(F.col("m") >= similarity * F.col("n") - 1e-6)
    ranked = ranked.withColumn("at", F.row_number().over(own.orderBy("members", "shingle")) - 1)
    bit = F.expr("shiftleft(1L, cast(shingle & 63 as int))")
    ranked = ranked.withColumns({c: F.bit_xor(F.when(F.expr(f"(shiftright(shingle, 6) & {len(MAPS) - 1}) = {k}"), bit).otherwise(F.lit(0).cast("long"))).over(own) for k, c in enumerate(MAPS)})
    # n - m shingles of no other part stand before; rounded so that an inexact product can only lengthen a prefix
    firsts = ranked.where(F.col("n") - F.col("m") + F.col("at") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-6)).drop("members")
    met = firsts.withColumn("least", F.min("part").over(key)).withColumn("most", F.max("part").over(key)).withColumn("members", F.count(F.lit(1)).over(key))
    return written(met.where("least < most").select("shingle", "at", "node", "n", "m", "part", "members", *MAPS))


def _joined(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """``entries`` with the part that each node now belongs to."""
    return entries.drop("part").join(roots.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))


def _possible(similarity: float) -> Column:
    """Whether u and v, which differ in their parts and share a shingle at places u_at and v_at, may be similar. They share
    at most what their places leave, and at most half of what their bitmaps leave of both sets."""
    fits = F.least("u_n", "v_n") >= similarity * F.greatest("u_n", "v_n") - 1e-6
    most = F.least("u_at", "v_at") + F.least(F.col("u_m") - F.col("u_at"), F.col("v_m") - F.col("v_at"))
    differ = sum((F.bit_count(F.col(f"u_{c}").bitwiseXOR(F.col(f"v_{c}"))) for c in MAPS), F.lit(0))
    least = similarity * (F.col("u_n") + F.col("v_n")) - 1e-6
    return (F.col("u_part") != F.col("v_part")) & fits & ((1 + similarity) * most >= least) & ((1 + similarity) * (F.col("u_m") + F.col("v_m") - differ) >= 2 * least)


def _enough(found: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of the pairs that meet in so many lists that they may be similar: what is in one prefix and shared lies in
    the other one too, or the same holds the other way round, so beyond these only the rest of a set can be shared."""
    met = found.groupBy("u", "v", "u_n", "v_n").agg(F.count(F.lit(1)).alias("met"))
    most = F.col("met") + F.ceil(similarity * F.greatest("u_n", "v_n") - 1e-6) - 1
    return met.where((1 + similarity) * most >= similarity * (F.col("u_n") + F.col("v_n")) - 1e-6).select("u", "v")


def _hubs(lists: DataFrame, similarity: float) -> DataFrame:
    """(u, v): members of lists with hubs of their own band of sizes and the two next to it, where the bounds allow. Sums
    go before the shuffle, and of the join back only the side of the entries can be large for a key, so it can be split."""
    band = F.floor(F.log(F.col("n").cast("double")) / (-math.log(similarity) or 1e-9))  # at a similarity of 1 each size is a band
    columns = ("node", "n", "m", "at", "part", *MAPS)
    hub = F.min(F.struct((F.col("n") - F.col("m")).alias("own"), (-F.col("m")).alias("shared"), *(F.col(c) for c in columns))).alias("hub")
    hubs = lists.groupBy("shingle", band.alias("band")).agg(hub).select("shingle", "band", *(F.col(f"hub.{c}").alias("v" if c == "node" else f"v_{c}") for c in columns))
    near = lists.select("shingle", *(F.col(c).alias("u" if c == "node" else f"u_{c}") for c in columns), F.explode(F.array(*(band + step for step in (-1, 0, 1)))).alias("band"))
    return near.join(hubs, ["shingle", "band"]).where(_possible(similarity)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _all_pairs(lists: DataFrame, similarity: float) -> DataFrame:
    """(u, v): pairs of lists whose parts differ, where the bounds allow. At least one of a pair, v, is outside of its
    list's largest part."""
    largest = lists.groupBy("shingle", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("shingle").agg(F.max(F.struct("k", "part"))["part"].alias("largest"))
    outside = F.col("part") != F.col("largest")
    one, other = (rows.select("shingle", F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("n", "m", "at", "part", *MAPS)), outside.alias(f"{end}_outside")) for end, rows in (("u", lists.join(largest, "shingle")), ("v", lists.join(largest, "shingle").where(outside))))
    met = one.join(other, "shingle").where("u < v or not u_outside").where(_possible(similarity))
    return _enough(met.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v"), "u_n": F.least("u_n", "v_n"), "v_n": F.greatest("u_n", "v_n")}), similarity)


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """``pairs`` whose whole sets are similar."""
    members = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes, "node")
    sets = written(hash_sets(rows, placed(members), words))
    for end in ("u", "v"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("hashes").alias(f"{end}_set")), end)
    shared = F.size(F.array_intersect("u_set", "v_set"))
    return written(pairs.where(shared >= similarity * (F.size("u_set") + F.size("v_set") - shared)).select("u", "v"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, linked: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` less near-duplicates: of each group one row stays, all columns kept.

    Rows are linked if the sets of their shingles of ``words`` words have a Jaccard similarity of ``similarity`` or more,
    and groups are the connected parts. Equal sequences of words are one node from the start. Of a group the row with the
    smallest doc_id stays (null ids come last, repeated ids by file and order in it). Null and blank texts are equal to
    each other. An empty table stays empty; other columns may have any names.

    ``linked`` makes of the rows and the nodes (at, node) a table (node, root) of nodes that another method links, each with
    the least of its group: these links count like those by similarity, and groups are the parts connected by both.

    Texts are never shuffled: rows are known by their position, and both the texts to compare and the rows to keep are
    picked out where they are read. What is shuffled is a few numbers for each row, a hash for each distinct shingle of
    each text once, and from then on the shingles of texts that may have a partner.
    """
    own, given = shielded(docs, ("doc_id", "text"))
    rows = positioned(own)
    at = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(FILE).alias("file"), F.col(INDEX).alias("index"))
    marked = rows.select(at.alias("at"), same_words("text").alias("same"))
    nodes = written(marked.groupBy("same.a", "same.b").agg(F.min("at").alias("at")).select("at", F.monotonically_increasing_id().alias("node")))
    roots = linked(rows, nodes) if linked else None
    sets = hash_sets(rows, placed(nodes), words)
    entries = _pruned(sets.select(F.explode("hashes").alias("shingle"), "node", F.size("hashes").alias("n"), F.col("node").alias("part")), similarity)
    if roots is not None:
        entries = _pruned(_joined(entries, roots), similarity)
    lists = _lists(entries, similarity)
    while True:
        tried = written(_hubs(lists, similarity))
        met = _verified(tried, rows, nodes, words, similarity)
        n = met.count()
        if not n:
            break
        roots = components(met if roots is None else met.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        entries = _pruned(_joined(entries, roots), similarity)
        lists = _lists(entries, similarity)
        if 2 * n < tried.count() or lists.where(F.col("members") > LONG).isEmpty():
            break
    met = _verified(written(_all_pairs(lists, similarity)), rows, nodes, words, similarity)
    roots = components(met if roots is None else met.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("at").alias("at"))
    kept = written(kept.select(F.col("at.file").alias(FILE), F.col("at.index").alias(INDEX), F.lit(1).alias("value")))
    return rows.where(lookup(kept)(F.col(FILE), F.col(INDEX)) == 1).select(*given)
