import math

import numpy as np
import pytest

from triago.llm import language, quality


def test_quality_separates_and_generalises(spark, tmp_path):
    good = [f"This is a calm sentence number {i}, with several plain words in it. Another one follows here, and it ends well." for i in range(120)]
    poor = [f"BUY!! NOW!! {i}$$$ ### *** CLICK!! HERE!! %%% &&&" for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(good + poor)), "doc_id long, text string").selectExpr("*", "'x' AS key", "1 AS score", "1 AS quality")
    labels = spark.createDataFrame([(i, int(i < 120), None) for i in range(0, 200, 2)] + [(1, None, 0), (3, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    ranking = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.scored(docs, ranking).collect()}
    assert all(got[i] >= quality.CUT for i in range(120)) and all(got[i] < quality.CUT for i in range(120, 200))
    kept = quality.accepted_documents(docs, labels)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(120)) and kept.columns == docs.columns


def test_bradley_terry_weights():
    """Pairs from a known ranking give back its direction, and the threshold lies between the two kinds."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, len(quality.NAMES)))
    truth = np.zeros(len(quality.NAMES))
    truth[[0, 3]] = 2.0, -1.0
    y = (rng.random(2000) < 1 / (1 + np.exp(-(x @ truth)))).astype(int)
    r = quality.fit(x, y)
    w = r.weights / np.linalg.norm(r.weights)
    assert w @ (truth / np.linalg.norm(truth)) > 0.95
    one_kind = quality.fit(x, np.ones(2000))
    assert np.allclose(one_kind.score(x), 0.5)
    assert quality.fit(np.zeros((0, len(quality.NAMES))), np.zeros(0)).score(x[:1])[0] == pytest.approx(0.5)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (9, 0), (8, 1), (2, 0)], "doc_id long, quality int")
    ranking = quality.train(odd_docs, labels)
    got = quality.scored(odd_docs, ranking).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert quality.scored(no_docs, quality.train(no_docs, labels)).count() == 0


def test_language_on_invented_words(spark, odd_docs, no_docs):
    rng = np.random.default_rng(2)
    syllables = {"en": "th er ing and ly ou sh", "fr": "é eau oi que ai ç ez", "de": "sch ung ü ei ß ach lich"}
    rows = [(i, " ".join("".join(rng.choice(s.split(), 3)) for _ in range(12)), lang) for i, (lang, s) in enumerate((x for x in syllables.items() for _ in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.where("doc_id % 4 <> 0"))
    assert model.langs == ["de", "en", "fr"] and 0.05 <= model.temperature <= 20 and (model.weights == 0).mean() > 0.5
    held = language.predicted(docs.where("doc_id % 4 = 0"), model).collect()
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in held]) >= 0.95
    odd = language.predicted(odd_docs, model).collect()
    assert len(odd) == 10 and all((r.lang_pred, r.score) == ("und", 0.0) for r in odd if r.doc_id in (2, 3, 4, 9)) and all(0 <= r.score <= 1 for r in odd)
    kept = language.identified_documents(odd_docs)
    assert kept.columns == odd_docs.columns and not {2, 3, 4, 9} & {r.doc_id for r in kept.collect()}
    none = language.train(no_docs)
    assert none.langs == [] and none.predict("text") == ("und", 0.0) and language.predicted(no_docs, model).count() == 0


def test_letters_and_calibration():
    assert language.has_letter("1 é") and language.has_letter("字") and not language.has_letter("12 ½ _ ² !") and not language.has_letter(None)
    logits, y = np.array([[2.0, 0.0]] * 100), np.array([0] * 80 + [1] * 20)
    p = language.softmax(logits / language.calibrated(logits, y))[0, 0]
    assert p == pytest.approx(0.8, abs=0.02) and language.calibrated(np.zeros((0, 2)), np.zeros(0)) == 1.0
    at, n = language.gram_counts("abab")
    assert n.sum() == 4 + 3 + 2 and math.isclose(n.max(), 2)


def test_ftrl_against_a_plain_loop_over_coordinates():
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6)) for _ in range(30)]
    y, classes, alpha, beta, l1, l2 = rng.integers(0, 3, 30), 3, 0.5, 1.0, 0.02, 0.1
    z, n = {}, {}

    def weight(key):
        zi, ni = z.get(key, 0.0), n.get(key, 0.0)
        return 0.0 if abs(zi) <= l1 else (math.copysign(l1, zi) - zi) / ((beta + math.sqrt(ni)) / alpha + l2)

    order = np.random.default_rng(42)
    for _ in range(2):
        for i in order.permutation(30):
            x = [*zip(rows[i][0].tolist(), rows[i][1].tolist(), strict=True), (language.BUCKETS, 1.0)]
            w = {(f, c): weight((f, c)) for f, _ in x for c in range(classes)}
            e = [math.exp(sum(v * w[f, c] for f, v in x)) for c in range(classes)]
            for f, v in x:
                for c in range(classes):
                    g = v * (e[c] / sum(e) - (c == y[i]))
                    before = n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[f, c]
                    n[f, c] = before + g * g
    got = language.ftrl(rows, y, classes, epochs=2)
    assert all(got[f, c] == pytest.approx(weight((f, c)), abs=1e-12) for f in (*range(40), language.BUCKETS) for c in range(classes))


def test_pairwise_weights_are_a_minimum_of_the_plain_loss():
    """The loss over all drawn pairs, summed one by one, rises in every direction from the weights found."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(60, len(quality.NAMES))), np.array([1, 0, 1] * 20)
    found = quality.fit(x, y, pairs=400)
    z, draw = np.clip((x - found.mean) / found.scale, -8, 8), np.random.default_rng(42)
    pairs = list(zip(draw.choice(np.flatnonzero(y == 1), 400), draw.choice(np.flatnonzero(y == 0), 400), strict=True))
    loss = lambda w: sum(math.log1p(math.exp(-float((z[a] - z[b]) @ w))) for a, b in pairs) / 400 + 1e-3 / 2 * float(w @ w)
    least = loss(found.weights)
    for k in range(0, len(quality.NAMES), 3):
        for step in (-1e-2, 1e-2):
            moved = found.weights.copy()
            moved[k] += step
            assert loss(moved) > least
