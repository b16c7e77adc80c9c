import re
from collections import defaultdict

import pytest

from triago.llm import mixing


def brute_targets(sizes: dict, weights: list[int], share: float, most: int) -> dict:
    """Shares the budget again and again, as the rule is worded."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total, spare = sum(w[s] for s in open_), 0.0
        for s in sorted(open_, key=str):
            out[s] += left * w[s] / total
        for s in list(open_):
            if out[s] >= most * sizes[s]:
                spare += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
                open_.discard(s)
        left = spare
    return out


@pytest.mark.parametrize("counts", [{"a": 5, "b": 90, "c": 10, None: 7}, {"a": 200, "b": 1}, {"only": 3}])
def test_targets_and_taken_words(spark, counts):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), [3, 1, 2]).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    expected = brute_targets(sizes, [3, 1, 2], 1.5, 2)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source]) and 0 <= r.taken <= 2 * r.size
    assert len(got) == len(rows) and all(abs(taken[s] - t) <= 1 for s, t in expected.items())
    # but for one document cut in each source, whole copies only
    cut = [r.source for r in got if r.taken % max(r.size, 1)]
    assert len(cut) == len(set(cut))


def test_order_is_by_odds(spark):
    """Within a source the extra copies are those of the smallest ratios of odds."""
    rows = [(i, " ".join(["w"] * (10 + i % 30)), "s" if i % 3 else "t") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted((r.doc_id, r.taken) for r in mixing.mix(df.repartition(n), [1, 3, 2]).collect()) for n in (2, 7))
    assert first == again
    other = sorted((r.doc_id, r.taken) for r in mixing.mix(df, [1, 3, 2], seed=7).collect())
    assert other != first


def test_odd_rows(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs, [3, 1, 2]).collect()
    assert len(got) == 10 and all(r.taken == 0 for r in got if r.size == 0)
    assert {r.size for r in got if r.doc_id == 6} == {120_000} and all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", "x")) * 12 for r in got if r.doc_id == 1 and r.size != 6)
    assert mixing.mix(no_docs, [3, 1, 2]).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and 0 < mixed.count() <= 20
