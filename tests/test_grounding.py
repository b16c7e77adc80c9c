import random
import re

import pytest
from pyspark.sql import functions as F

from triago import fixed
from triago.functions.text import folded
from triago.operators import engine, extract

REGISTRY = {
    "generic_fields": ["titre", "date"], "sensitive_fields": [], "rules": [],
    "categories": [{"name": "factures", "folder": "F", "keywords": [], "subfolders": [], "fields": ["fournisseur", "objet", "ttc"]}],
}
LINES = f"array<{extract.LINE}>"


def plain_key(text):
    return " ".join(folded(text or "").split())


def plain_positions(whole, target):
    return [i for i in range(len(whole)) if whole.startswith(target, i)] if target else []


def plain_place(value, lines, field):
    """(found, line, conf, on_recipient) by a scan of the joined lines."""
    keys, starts, at = [plain_key(t) for t, _, _ in lines], [], 0
    for k in keys:
        starts.append(at)
        at += len(k) + 1
    barred, label = [], []
    for k in keys:
        hit = re.search(r"\b(client|destinataire|doit)\b", k) if field == "fournisseur" else None
        barred.append(bool(hit))
        label.append(bool(hit) and not re.search(r"\w", k[: hit.start()] + k[hit.end() :]))
    target = plain_key(value)
    covered = [[i for i, s in enumerate(starts) if s < p + len(target) and s + len(keys[i]) >= p] for p in plain_positions(" ".join(keys), target)]
    free = [c for c in covered if not any(barred[i] for i in c) and not (c[0] > 0 and label[c[0] - 1])]
    confs = [lines[i][1] for i in free[0] if lines[i][1] is not None] if free else []
    return bool(covered), free[0][0] if free else None, min(confs) if confs else None, bool(covered) and not free


@pytest.mark.parametrize(("whole", "target"), [("aaaa", "aa"), ("abab ab", "ab"), ("x.y", "."), (r"a\Eb\Eb", r"\Eb"), ("aXa😀a😀", "a😀"), ("", "a"), ("a", ""), ("ab", "abc"), ("$^(a", "^("), ("a b a b a", "a b a")])
def test_positions_of_overlapping_occurrences(spark, whole, target):
    got = spark.createDataFrame([(whole, target)], "w string, t string").select(engine.occurrences(F.col("w"), F.col("t")).alias("at")).first().at
    assert got == plain_positions(whole, target)


@pytest.mark.parametrize("bucket", [1, 7, 256])
def test_grounding_equals_a_scan(spark, monkeypatch, bucket):
    monkeypatch.setattr(engine, "BUCKET", bucket)
    rng = random.Random(bucket)
    words = ["Maison", "maison", "Neuve", "neuve", "Été", "ete", "a", "aa", "client", "Client :", "doit", "l'eau", "́", "n.", "x"]
    docs, replies = [], []
    for i in range(60):
        lines = [(" ".join(rng.choices(words, k=rng.randint(1, 5))), rng.choice((None, 0.95, 0.5)), rng.choice((None, 1, 2))) for _ in range(rng.randint(0, 12))]
        docs.append((i, rng.choice(("factures", "factures", "autre")), lines))
        for field in ("fournisseur", "objet", "titre", "ttc"):
            whole = " ".join(t for t, _, _ in lines).split()
            at = rng.randint(0, max(0, len(whole) - 1))
            said = rng.choice((" ".join(whole[at : at + rng.randint(1, 6)]), "  ".join(rng.choices(words, k=2)), "aa", "invente", " ", None))
            replies.append((i, field, said))
    given = spark.createDataFrame(replies, "doc_id long, field string, value string").selectExpr("*", "'x' AS line", "'y' AS doc", "1 AS at")
    table = spark.createDataFrame(docs, f"doc_id long, type string, lines {LINES}").selectExpr("*", "'z' AS whole", "2 AS i", "3 AS conf")
    got = {(r.doc_id, r.field): r for r in engine.grounded(given, table, REGISTRY).collect()}
    allowed = {"factures": ("fournisseur", "objet"), "autre": ("titre",)}
    asked = [(i, f, " ".join(v.split())) for i, f, v in replies if v and v.split() and f in allowed[docs[i][1]]]
    assert sorted(got) == sorted((i, f) for i, f, _ in asked) and len(asked) > 60
    for i, field, value in asked:
        found, line, conf, on_recipient = plain_place(value, docs[i][2], field)
        row = got[i, field]
        assert (row.value, row.line, row.conf) == (value if found and not on_recipient else None, line, conf), (docs[i], field, value)
        assert not found or line is None or row.page == docs[i][2][line][2]
        if not found:
            assert row.alert == f"{field} : {fixed.NOT_IN_SOURCE}"
        elif on_recipient:
            assert row.alert == f"{field} : {fixed.ON_RECIPIENT}"


def test_grounding_stays_in_the_jvm_and_takes_odd_tables(spark):
    docs = spark.createDataFrame([(1, "factures", [("Maison Neuve", None, None)]), (2, "factures", None), (None, "factures", [("x", None, None)])], f"doc_id long, type string, lines {LINES}")
    replies = spark.createDataFrame([(1, "objet", "maison"), (1, "objet", "neuve"), (1, "objet", "maison"), (2, "objet", "maison"), (3, "objet", "x"), (None, "objet", "x")], "doc_id long, field string, value string")
    got = engine.grounded(replies, docs, REGISTRY)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert sorted((r.doc_id, str(r.value), str(r.line)) for r in got.collect()) == [(1, "maison", "0"), (1, "maison", "0"), (1, "neuve", "0"), (2, "None", "None")]
    assert engine.grounded(replies.limit(0), docs, REGISTRY).count() == engine.grounded(replies, docs.limit(0), REGISTRY).count() == 0
