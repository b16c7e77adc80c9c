"""Source divergence audit: how the term frequencies of each source differ from those of its language and of its peers.

Terms are counted where texts are read. Each language's kept terms are dealt to shards by hash and numbered within them, so
what a group (a language and source) counts there is a short compressed vector. Differences are sums over terms, so shards
never need each other.

Within a language and shard the groups meet as in a tournament. They are dealt to blocks, and the blocks are seated as in the
circle method: in each round every block has one opponent, and after blocks - 1 rounds (one more if they are odd in number)
each pair has met once. A block stays where it is, as one table of its groups' frequencies, while the compressed vectors of its
opponents come by in the order of rounds; each of a round's meetings takes place with one of the two, by turns, and is evaluated
in both directions. All of this is one shuffle, sorted by place and round: a task holds one block and one vector at a time. The
language's own vector comes first; for it each resident keeps a heap of its ten most overused terms. What leaves a shard is a
sum for each pair and ten terms for each group.

All arithmetic is in whole numbers of up to 64 bits.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from triago.llm.common import release_memory, table, tasks, written

#: Terms are of A-Z, a-z and what is beyond ASCII; only A-Z are folded. In UTF-8 that holds byte by byte.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
SCALE = 1_000_000_000
MIN_DOCS, TOP = 10, 10
#: Counts a task holds before it hands some on, terms of a shard, and groups of a block.
HELD, SHARD, BLOCK = 400_000, 1 << 14, 4
#: Occurrences of a rare term, counts that a group stands for, rows read at once, and counts handed on at once.
RARE, GROUP, SLICE, OUT = 2, 8, 256, 20_000
KEYS = ("lang", "source")


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up within tasks, so not yet one row for each key.
    A document without terms gives its group a row of the term null. A task that holds HELD counts hands on those of rare
    terms, a few at a time, and goes on adding to the others while they are at most half of HELD."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows(lang: str, source: str, terms: list, n: list, docs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([source] * len(n)), pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

        def handed(most: float) -> Iterator[pa.RecordBatch]:
            """Counts of terms that occurred ``most`` times at most leave, and groups that have none left."""
            for (lang, source), (n, docs) in list(held.items()):
                gone = [t for t, k in n.items() if k <= most]
                for at in range(0, len(gone), OUT):
                    some = gone[at : at + OUT]
                    yield rows(lang, source, [t.decode("utf-8", "replace") for t in some], [n.pop(t) for t in some], [docs.pop(t) for t in some])
                if not n:
                    yield rows(lang, source, [None], [0], [0])
                    del held[lang, source]

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for lang, source, text in zip(*(batch.column(c).slice(at, SLICE).to_pylist() for c in (*KEYS, "text")), strict=True):
                    if (lang, source) not in held:
                        held[lang, source] = Counter(), Counter()
                        size += GROUP
                    n, docs = held[lang, source]
                    terms, before = text.translate(FOLD).split(), len(n)
                    n.update(terms)
                    docs.update(set(terms))
                    size += len(n) - before
                    if size > HELD:
                        for most in (RARE, math.inf):
                            if 2 * size > HELD:
                                yield from handed(most)
                                size = sum(GROUP + len(n) for n, _ in held.values())
                        release_memory()
        yield from handed(math.inf)
        release_memory()

    empty = F.lit("")
    return docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).cast("binary").alias("text")).mapInArrow(task, "lang string, source string, term string, n long, docs long")


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes."""
    return zlib.compress(np.ascontiguousarray(values, dtype="<i8").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype="<i8")


@F.pandas_udf(BinaryType())
def _packed(slots: pd.Series, counts: pd.Series) -> pd.Series:
    """Slots as differences, then their counts, packed; both are null for a group without kept terms in a shard."""
    return pd.Series([packed(np.concatenate([np.diff(s, prepend=0), c]) if s is not None else np.zeros(0)) for s, c in zip(slots, counts, strict=True)])


def frequencies(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(SCALE x (count + 2) / (n + 2 v)), by long division in three digits of thousands, so that no product leaves
    64 bits below 9 x 10^15 occurrences."""
    whole, rest, divisor = np.zeros(len(counts), dtype=np.int64), counts.astype(np.int64) + 2, n + 2 * v
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, divisor)
        whole = whole * 1000 + digit
    return whole + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) for each term."""
    return (p - q) ** 2 // (p + q)


def dense(data: bytes, n: int, v: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and frequencies of all ``size`` terms of a shard."""
    both = unpacked(data)
    counts = np.zeros(size, dtype=np.int64)
    counts[np.cumsum(both[: len(both) // 2])] = both[len(both) // 2 :]
    return counts, frequencies(counts, n, v) if v else counts


def opponent(block: Column, rnd: Column, blocks: Column) -> Column:
    """Whom ``block`` meets in ``rnd``, by the circle method: seats are an even number, the last one stays in place."""
    seats = blocks + blocks % 2
    turned = F.pmod(2 * rnd - block, seats - 1)
    return F.when(block == seats - 1, rnd).when(turned == block, seats - 1).otherwise(turned)


def at_home(block: Column, other: Column) -> Column:
    """Whether the meeting of two blocks takes place with ``block``: for each block with about half of its opponents."""
    return F.when((block + other) % 2 == 1, block < other).otherwise(block > other)


def vectors(counts: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Groups' vectors (lang, shard, shards, source, n, v, size, block, blocks, data) and languages' (with terms, without
    source and block), from ``counted``. Each group has a vector in each shard of its language, and each language a shard."""
    summed = written(counts.groupBy(*KEYS, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = summed.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = written(kept.select("lang", "term", "n"))
    langs = summed.select("lang").distinct().join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")), "lang", "left")
    langs = written(langs.select("lang", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("v", "n"))).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("v") / SHARD)).cast("int")))
    dealt = kept.join(langs.select("lang", "shards"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
    slots = written(dealt.select("lang", "shard", "term", "n", (F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1).alias("slot")))
    shards = slots.groupBy("lang", "shard").agg(F.array_sort(F.collect_list(F.struct("slot", "n", "term"))).alias("x"))  # some SHARD terms
    every = langs.select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    total = every.join(shards, ["lang", "shard"], "left").select("lang", "shard", "n", "v", F.coalesce(F.size("x"), F.lit(0)).alias("size"), _packed("x.slot", "x.n").alias("data"), F.coalesce("x.term", F.array().cast("array<string>")).alias("terms"))
    total = total.withColumn("size", F.greatest("size", F.lit(0)))  # the size of null is -1
    own = summed.where("term is not null").join(slots.select("lang", "term", "shard", "slot"), ["lang", "term"])
    cells = written(own.groupBy(*KEYS, "shard").agg(F.array_sort(F.collect_list(F.struct("slot", "n"))).alias("x"), F.sum("n").alias("part")))
    groups = summed.select(*KEYS).distinct().join(cells.groupBy(*KEYS).agg(F.sum("part").alias("n")), [*KEYS], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    many = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    seated = groups.join(many, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    shared = total.select("lang", "shard", "v", "size")
    full = seated.join(shared, "lang").join(cells.drop("part"), [*KEYS, "shard"], "left")
    return full.select("lang", "shard", "source", "n", "v", "size", "block", "blocks", _packed("x.slot", "x.n").alias("data")), total


def meetings(groups: DataFrame, total: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value) of all meetings: sums of one shard for pairs, ten terms of one shard for terms."""
    groups, total = written(groups), written(total)
    none = F.array().cast("array<string>")
    blocks = groups.select("lang", "shard", "blocks", "block").distinct()
    resident = groups.select("lang", "shard", F.col("block").alias("home"), F.lit(-1).alias("round"), "source", "n", "v", "size", "data", none.alias("terms"))
    first = total.join(blocks, ["lang", "shard"]).select("lang", "shard", F.col("block").alias("home"), F.lit(-2).alias("round"), F.lit("").alias("source"), "n", "v", "size", "data", "terms")
    rounds = F.sequence(F.lit(0), F.col("blocks") + F.col("blocks") % 2 - 2)
    away = groups.where("blocks > 1").select("*", F.explode(rounds).alias("round")).withColumn("home", opponent(F.col("block"), F.col("round"), F.col("blocks")))
    guests = away.where((F.col("home") < F.col("blocks")) & at_home(F.col("home"), F.col("block"))).select("lang", "shard", "home", "round", "source", "n", "v", "size", "data", none.alias("terms"))
    seats = first.unionByName(resident).unionByName(guests)
    dealt = seats.repartition(tasks(seats), "lang", "shard", "home").sortWithinPartitions("lang", "shard", "home", "round", "source")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, names, overall, terms, table_ = None, [], None, None, None
        out: list[tuple] = []

        def both_ways(lang: str, source: str, vector: np.ndarray, against: range | list[int]) -> None:
            if not len(against):
                return
            values = difference(table_[list(against)], vector).sum(axis=1) if len(vector) else np.zeros(len(against), dtype=np.int64)
            for i, value in zip(against, values.tolist(), strict=True):
                out.extend(((lang, names[i], "pair", source, value), (lang, source, "pair", names[i], value)))

        for batch in batches:
            for lang, shard, home, rnd, source, n, v, size, data, own_terms in batch[["lang", "shard", "home", "round", "source", "n", "v", "size", "data", "terms"]].itertuples(index=False):
                if (lang, shard, home) != here:
                    here, names, overall, terms, table_ = (lang, shard, home), [], None, None, np.zeros((0, size), dtype=np.int64)
                counts, p = dense(data, n, v, size)
                if rnd == -2:
                    overall, terms = p, own_terms
                elif rnd == -1:
                    both_ways(lang, source, p, range(len(names)))
                    names.append(source)
                    table_ = np.vstack([table_, p])
                    more = np.flatnonzero((counts > 0) & (p > overall))
                    gained = difference(p[more], overall[more])
                    best = heapq.nsmallest(top, zip((-gained).tolist(), more.tolist(), strict=True))
                    out.extend((lang, source, "term", terms[slot], -value) for value, slot in best)
                else:
                    both_ways(lang, source, p, range(len(names)))
                if len(out) > 10_000:
                    yield pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])
                    out.clear()
        if out:
            yield pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])

    return dealt.mapInPandas(task, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank of ``docs`` (text, lang, source; nulls as empty texts).

    Part "pair": the difference between two sources of a language, over all terms in at least ``min_docs`` of its documents.
    Part "term": a source's ``top`` most overused terms. Ties go by the item's UTF-8 form. A language of one source has no
    pairs, one without kept terms pairs of value 0 and no terms; an empty table gives an empty result.
    """
    met = written(meetings(*vectors(counted(docs), min_docs), top=top))
    pairs = met.where("part = 'pair'").groupBy(*KEYS, "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy(*KEYS, "part").orderBy(F.desc("value"), "item")
    ranked = met.where("part = 'term'").select(*KEYS, "part", "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all sources and overused terms of each, for every language of ``documents``.

    Null texts, langs and sources count as empty ones, repeated rows count each, groups without terms take part, an empty
    table gives an empty result. Columns of other names are not read.
    """
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
found AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT g.lang, g.source, coalesce(sum(f.n), 0)::BIGINT AS total FROM groups g LEFT JOIN found f ON g.lang = f.lang AND g.source = f.source GROUP BY ALL),
v AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(k.n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN kept k ON g.lang = k.lang GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(f.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(f.n, 0) + 2)) // (s.total + 2 * v.v) AS p
      FROM sizes s JOIN v ON s.lang = v.lang JOIN kept k ON k.lang = s.lang LEFT JOIN found f ON f.lang = s.lang AND f.source = s.source AND f.term = k.term),
q AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total + 2 * v.v) AS q FROM kept k JOIN v ON k.lang = v.lang),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' AS part FROM terms))
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
