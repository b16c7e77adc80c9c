import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from triago.llm import simhash
from triago.llm.components import components


def plain_fingerprint(text):
    """The definition, bit by bit."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    runs = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", None, " \t", "One", "One TWO", "a b c", "É À é\u00a0x y z\u2003w", "A b\x0bc\x0cd e f g a b c a b c"])
def test_fingerprint_definition(text):
    assert simhash.fingerprint(simhash.split_words(text)) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    """XXH64 with seed 42 is Spark's own xxhash64 of one string."""
    assert spark.range(1).select(F.xxhash64(F.lit("a b é")).alias("h")).first().h & (2**64 - 1) == xxhash.xxh64_intdigest("a b é".encode(), 42)


def near_values(seed):
    """Fingerprints in chains and balls, bits flipped anywhere, so that links run through every byte."""
    rng, out = random.Random(seed), set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 12])):
            out.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                x ^= 1 << b
    return sorted(out)


@pytest.mark.parametrize("seed, block", [(1, 4096), (2, 4096), (3, 2)])
def test_no_link_is_missed(spark, monkeypatch, seed, block):
    monkeypatch.setattr(simhash, "BLOCK", block)  # 2: every longer list takes the masked way
    values = near_values(seed)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    assert all(bin((r.u ^ r.v) & (2**64 - 1)).count("1") <= 3 for r in found)
    wanted = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3]
    assert brute_components([(r.u, r.v) for r in found], signed) == brute_components(wanted, signed)
    assert len(wanted) > 30


def test_masked_and_nearest_agree():
    own = np.sort(np.array([0b1, 0b11, 0b111, 0b1110000, 0b1111000, 1 << 20, (1 << 20) | 7], dtype=np.uint64))
    parts = lambda found: brute_components([(i, j) for i, j in found], range(len(own)))
    assert parts(simhash._masked(own, 3)) == parts(simhash._nearest(own, 3, 5))


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    wanted = brute_components(pairs, {n for p in pairs for n in p})
    assert got == {n: r for n, r in wanted.items() if n != r}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_against_all_pairs(spark, odd_docs, no_docs):
    rng = random.Random(9)
    base = [" ".join(rng.choice("the of and to in a bc de fg hi jk lm no pq".split()) + str(rng.randrange(50)) for _ in range(300)) for _ in range(6)]
    texts = [t for b in base for t in (b, b, b + " end", b.upper(), b.replace(" the", " thy", 1), "x " + b)] + ["", None, " ", "solo"]
    df = spark.createDataFrame(list(enumerate(texts, 10)), "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts, 10)}
    assert all(r.fp & (2**64 - 1) == fps[i] for i, r in got.items())
    pairs = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3]
    assert {i: r.component_id for i, r in got.items()} == brute_components(pairs, fps)
    odd = simhash.near_duplicates(odd_docs).collect()
    assert len(odd) == 10 and {r.component_id for r in odd if r.fp == 0} == {2} and {r.component_id for r in odd if r.doc_id is None} == {None}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each(spark, odd_docs, no_docs, tmp_path):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10_000)}" for _ in range(4_000)]
    base = [" ".join(words[i * 400 : i * 400 + 400]) for i in range(8)]
    changed = lambda t, n: " ".join("new" if i in set(range(50, 50 + 60 * n, 60)) else w for i, w in enumerate(t.split()))
    rows = [(i * 10, t) for i, t in enumerate(base)] + [(i * 10 + 1, t) for i, t in enumerate(base[:4])] + [(i * 10 + 2, changed(t, 3)) for i, t in enumerate(base[:6])] + [(77, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "'x' AS at")
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [*range(0, 80, 10), 77]
    odd = simhash.one_of_each(odd_docs).collect()
    assert len(odd) == 7 and sum(r.text is None or not r.text.strip() for r in odd) == 1 and sum(r.doc_id == 1 for r in odd) == 2
    assert simhash.one_of_each(no_docs).count() == 0
