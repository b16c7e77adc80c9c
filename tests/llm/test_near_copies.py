import random

import pytest
from test_simhash import brute_components

from triago.llm import near_copies, simhash


def survivors(texts):
    """By all pairs: the least id of each group."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in texts.items())}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return sorted(set(brute_components(pairs, texts).values()))


def kept(spark, texts):
    return sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())


@pytest.mark.parametrize("worth, long", [(0.8, 32), (1.0, 2)])
def test_edits_of_blocks_and_tails(spark, monkeypatch, worth, long):
    """Whole blocks replaced, another text's words appended, tails dropped, about the limit of similarity, beside texts
    that share a common passage: what stays is what all pairs leave."""
    monkeypatch.setattr(near_copies, "WORTH", worth)
    monkeypatch.setattr(near_copies, "LONG", long)
    rng, texts = random.Random(11), {}
    words = lambda n: [f"w{rng.randrange(3_000)}" for _ in range(n)]
    passage = words(60)
    for i in range(20):
        base = words(rng.choice([6, 40, 150, 400])) + (passage if i % 3 else [])
        n = len(base)
        copies = [base, *(base[: n // 3] + words(int(n * s)) + base[n // 3 + int(n * s) :] for s in (0.05, 0.08, 0.1, 0.12)), *(base + words(int(n * s)) for s in (0.1, 0.2, 0.24, 0.27)), *(base[: n - int(n * s)] for s in (0.1, 0.19, 0.22))]
        texts |= {100 * i + k: " ".join(x) for k, x in enumerate(rng.sample(copies, len(copies)))}
    expected = survivors(texts)
    assert 20 < len(expected) < 200 and kept(spark, texts) == expected


def test_a_dissimilar_text_between_two_similar_ones(spark):
    """C, in another order and with half of what sets A and B apart, is nearer to both by words than they are to each other."""
    rng, texts = random.Random(12), {}
    for i in range(60):
        a = [f"v{rng.randrange(10**6)}" for _ in range(200)]
        b = a[:60] + [f"v{rng.randrange(10**6)}" for _ in range(12)] + a[72:]
        texts |= {10 * i: " ".join(a), 10 * i + 1: " ".join(b), 10 * i + 2: " ".join(rng.sample(a[:66] + b[66:], 200))}
    assert survivors(texts) == sorted(x for i in range(60) for x in (10 * i, 10 * i + 2))
    assert kept(spark, texts) == survivors(texts)


def test_similar_texts_among_others_of_the_same_words(spark):
    """A has the words of B and C in another order, and all three one fingerprint of words."""
    rng, texts = random.Random(13), {}
    for i in range(20):
        b = [f"v{rng.randrange(10**6)}" for _ in range(200)]
        c = b[:99] + [b[100], b[99]] + b[101:]
        texts |= {10 * i: " ".join(rng.sample(b, 200)), 10 * i + 1: " ".join(b), 10 * i + 2: " ".join(c)}
    assert survivors(texts) == sorted(x for i in range(20) for x in (10 * i, 10 * i + 1))
    assert kept(spark, texts) == survivors(texts)


def test_a_similarity_of_one_links_equal_sets_only(spark):
    texts = {1: "a b c d e a b c d e", 2: "b c d e a b c d e a", 3: "a b c d e a b c d e a", 4: "a b c d e a b c d f"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    # 3 has all five turns of a b c d e, 1 and 2 too (six runs each, one of them twice)
    assert sorted(r.doc_id for r in simhash.one_of_each(docs, similarity=1.0).collect()) == [1, 4]


def test_bitmaps_hold_back_texts_beside_a_large_group(spark, monkeypatch):
    """One part of copies, each with one edit, and texts of three edits of the same kinds, similar to none of them: the
    join loses no similar pair, and bitmaps leave few of the others."""
    rng = random.Random(14)
    named, sets = {}, []
    for i in range(110):
        words = [f"p{k}" for k in range(90)]
        edits = (0 if i == 0 else 1) if i < 60 else 3
        for k in rng.sample(range(5, 85, 8), edits):
            words[k] = f"x{rng.randrange(5)}.{k}"
        sets.append(frozenset(named.setdefault(tuple(words[k : k + 5]), rng.getrandbits(64) - (1 << 63)) for k in range(86)))
    sets = list(dict.fromkeys(sets))
    part = [0 if len(s & sets[0]) >= 81 else i for i, s in enumerate(sets)]
    similar = {(i, j) for i in range(len(sets)) for j in range(i) if part[i] != part[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    entries = spark.createDataFrame([(x, i, len(s), part[i]) for i, s in enumerate(sets) for x in s], "shingle long, node long, n int, part long")
    met = {}
    monkeypatch.setattr(near_copies, "_enough", lambda found, similarity: found)
    for maps in (near_copies.MAPS, ()):
        monkeypatch.setattr(near_copies, "MAPS", maps)
        rows = near_copies._all_pairs(near_copies._lists(entries, 0.8), 0.8).select("u", "v").collect()
        assert similar <= {(r.v, r.u) for r in rows}
        met[len(maps)] = len(rows)
    assert 0 < 4 * met[4] < met[0], met
