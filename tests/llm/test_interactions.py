import itertools
import random
import re

import numpy as np
import pytest

from triago.llm import interactions


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6])
def test_plain_changes_visit_every_order_once(n):
    order = list(range(n))
    seen = [tuple(order)]
    for at in interactions.plain_changes(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(n)))


def brute(cells, filters):
    """Counts by order and step of one part, each step from all masks anew."""
    out, n = {}, len(filters)
    for order in itertools.permutations(range(n)):
        for step, f in enumerate(order):
            before = sum(1 << g for g in order[:step])
            here = [m for m in range(1 << n) if m >> f & 1 and not m & before]
            failing = sum(cells[m][0] for m in range(1 << n) if m >> f & 1)
            removed = sum(cells[m][0] for m in here)
            kept = sum(cells[m][0] for m in range(1 << n) if not m & (before | 1 << f))
            out["".join(filters[g] for g in order), step] = [kept, removed, failing - removed, cells[1 << f][0], sum(cells[m][1] for m in here), sum(cells[m][2] for m in here)]
    total = {f: sum(v[1] for (order, step), v in out.items() if order[step] == f) for f in filters}
    return {key: [*value, total[key[0][key[1]]]] for key, value in out.items()}


@pytest.mark.parametrize("filters", ["A", "AB", "XYZ", "ABCDE"])
def test_walk_equals_a_count_of_each_step(filters):
    rng = np.random.default_rng(len(filters))
    cells = rng.integers(0, 50, (3, 1 << len(filters), 3)) * rng.integers(0, 2, (3, 1 << len(filters), 1))
    names, every = interactions.walk(cells, filters)
    assert len(set(names)) == len(names) == len(list(itertools.permutations(filters)))
    for part in range(3):
        wanted = brute(cells[part].tolist(), filters)
        assert {(name, step): every[i, step, part].tolist() for i, name in enumerate(names) for step in range(len(filters))} == wanted


def plain_masks(rows):
    """The set of failed filters of each (doc_id, text, lang)."""
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search("[#$%&*|]", text), doc_id is not None and doc_id > least[text])
        yield sum(1 << i for i, t in enumerate(tests) if t)


def docs_of(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["ABC", "#x", "é€😀", "50%"]
    rows = []
    for i in range(120):
        words = rng.choices(vocabulary[: rng.choice((3, 150, 304))], k=rng.choice((0, 5, 199, 200, 260)))
        rows.append((rng.choice((i, i, i, None, 7)), rng.choice((" ".join(words), rng.choice(" \t\n\x0b\f\r").join(words), "same text", None, "")), rng.choice(("en", "de", "", None))))
    return rows


def test_query_equals_brute_force(spark, tmp_path):
    rows = docs_of(1)
    labels = [(i, i % 3 % 2, i % 5 % 2) for i in range(0, 120, 2)] + [(7, 0, 0), (7, 1, None), (None, 1, 1), (8, None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS digest", "1 AS part", "2 AS n").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for (doc_id, _, lang), mask in zip(rows, plain_masks(rows), strict=True):
        cell = parts.setdefault(lang or "", [[0, 0, 0] for _ in range(32)])[mask]
        cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] + (doc_id in good), cell[2] + (doc_id in toxic)
    got = interactions.op13_filter_interactions(spark, str(tmp_path)).collect()
    wanted = {(part, order, step + 1): v for part, c in parts.items() for (order, step), v in brute(c, "ABCDE").items()}
    assert len(got) == len(wanted) == 600 * len(parts)
    assert {(r.part, r.filter_order, r.step): [r[c] for c in interactions.COUNTS] for r in got} == wanted


def test_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd_docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    none.write.parquet(str(tmp_path / "a" / "labels.parquet"))
    got = interactions.op13_filter_interactions(spark, str(tmp_path / "a")).collect()
    assert len(got) == 600 * 4 and all(r.good_lost == r.toxic_lost == 0 for r in got)
    assert {r.part: r.kept + r.removed for r in got if r.step == 1} == {"": 2, "en": 5, "fr": 2, "de": 1}
    no_docs.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    none.write.parquet(str(tmp_path / "b" / "labels.parquet"))
    assert interactions.op13_filter_interactions(spark, str(tmp_path / "b")).count() == 0
