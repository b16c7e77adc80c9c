import math
import sys
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

import corpus_pipeline
from triago.llm import segment


@pytest.fixture(scope="module")
def vocab():
    return segment.load(segment.model_path(), theta=0.5)


def every(vocab, text):
    """All segmentations of a text with their probabilities."""

    def of(rest):
        if not rest:
            yield ()
        for i, p in enumerate(vocab.pieces):
            if p and rest.startswith(p):
                yield from ((i, *more) for more in of(rest[len(p) :]))

    found = list(of(" " + text))
    weights = np.exp([sum(vocab.logs[i] for i in s) for s in found])
    return dict(zip(found, weights / weights.sum(), strict=True))


def test_samples_follow_their_probabilities(vocab):
    """Pairs of samples without replacement come as often as drawing twice without putting back."""
    n, chances = 30_000, every(vocab, "we a")
    seeds = [int(x) for x in np.random.default_rng(3).integers(0, 2**63, n)]
    found = segment.top_k(["we a"] * n, seeds, vocab, 2)
    first, pairs = Counter(tuple(r[0][0].tolist()) for r in found), Counter(tuple(tuple(x[0].tolist()) for x in r) for r in found)
    for s, p in chances.items():
        assert abs(first[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    for a, b in permutations(sorted(chances, key=chances.get)[-4:], 2):
        p = chances[a] * chances[b] / (1 - chances[a])
        assert abs(pairs[a, b] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    for r in found[:50]:
        assert all(math.isclose(x[1], math.log(chances[tuple(x[0].tolist())]), abs_tol=1e-6) for x in r)
        assert r[0][2] >= r[1][2] and all(x[3] <= 0 for x in r)


def test_all_segmentations_come_out(vocab):
    chances = every(vocab, "the")
    (found,) = segment.top_k(["the"], [5], vocab, len(chances) + 3)
    assert {tuple(r[0].tolist()) for r in found} == set(chances) and len(found) == len(chances)
    assert all(r[3] == 0 for r in found)  # nothing is left, so each is certain


def test_inclusion_probabilities(vocab):
    """The estimate sum(f / inclusion) over samples is unbiased: with f the probability it averages to one."""
    n, k = 4_000, 2
    found = segment.top_k(["we"] * n, list(range(n)), vocab, k)
    assert np.mean([sum(math.exp(p - inc) for _, p, _, inc in r) for r in found]) == pytest.approx(1, abs=0.05)


@pytest.mark.parametrize("text", ["", " ", "  two  spaces ", "x\n\ny", "emoji 😀 ▁ é \t tab", "日本語テキスト", "a" * 2000, "ab " * 3000, "\x00\x7f", "nul\u0000 ½ ß"])
def test_lossless_and_distinct(vocab, text):
    (found,) = segment.top_k([text], [1], vocab, 3)
    assert all(segment.decode(ids, vocab) == text for ids, *_ in found) and len({tuple(ids.tolist()) for ids, *_ in found}) == len(found)


def test_rows_do_not_depend_on_their_batch(vocab):
    texts, seeds = ["one text here", "another\nlonger text, with commas", "x"], [1, 2, 3]
    together = segment.top_k(texts, seeds, vocab, 3)
    for i in range(3):
        (alone,) = segment.top_k([texts[i]], [seeds[i]], vocab, 3)
        assert [(a[0].tolist(), *a[1:]) for a in alone] == [(a[0].tolist(), *a[1:]) for a in together[i]]


def test_odd_rows(spark, odd_docs, no_docs):
    got = segment.sampled(odd_docs, k=2).collect()
    assert all(r.decoded and r.n_pieces == len(r.ids) for r in got) and sum(r.sample == 1 for r in got) == 10
    same = [r.ids_xxh64 for r in got if r.doc_id == 1 and r.sample == 1]
    assert len(same) == 3 and len(set(same)) == 2 and segment.sampled(no_docs).count() == 0


def test_query_and_last_stage_return_the_ids(spark, tmp_path, odd_docs, vocab):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = Counter(r.text or "" for r in docs.collect())
    for found in (segment.op8_gumbel_segments(spark, str(tmp_path)), corpus_pipeline.encode_pieces(spark, docs, str(tmp_path))):
        assert dict(found.dtypes)["ids"] == "array<int>"
        assert Counter(segment.decode(np.array(r.ids), vocab) for r in found.where("sample = 1").collect()) == texts


def test_distinct_segments_cost_no_python_calls(vocab):
    """Segments are told apart and put together in whole batches: 20,000 different words don't take a call each."""
    text, calls = " ".join(f"w{i}" for i in range(20_000)), Counter()
    segment.top_k(["a first call imports modules"], [1], vocab, 2)
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        (found,) = segment.top_k([text], [1], vocab, 2)
    finally:
        sys.setprofile(None)
    assert segment.decode(found[1][0], vocab) == text and calls["call"] < 10_000


def test_chances_of_long_segments_of_rare_characters(vocab):
    """Sums of weights neither vanish nor overflow where each character weighs 1e-12."""
    (found,) = segment.top_k(["\U00010348" * 500], [1], vocab, 2)
    assert len(found) == 1 and len(found[0][0]) == 2001 and found[0][1] == pytest.approx(0, abs=1e-6)
    assert segment.top_k([], [], vocab, 2) == []
