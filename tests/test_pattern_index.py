import random
import re

import pytest

from triago import fixed
from triago.functions.text import folded
from triago.operators import pattern_index
from triago.operators.pattern_index import matched, required


def test_required_words():
    wanted = {
        r"\bfacture\b": [["facture"]], r"\bentre les deux\b": [["entre"], ["les"], ["deux"]], r"\b(montant|total) ht\b": [["montant", "total"], ["ht"]], r"\bnote d.honoraires\b": [["note"]],
        r"\bdiplome\s+de\s+licence\b": [["diplome"], ["de"], ["licence"]], r"\bfactures?\b": [], r"facture": [], r"\bx+ y\b": [["y"]], r"\b(a|b c)\b": [], r"\ba\b|\bb c\b": [["a", "b"]], r"\ba\b|b": [],
        r"\bart [0-9]+\b": [], r"(?!x)\ba\b": [], r"\ba(?: b)?\b": [], r"\ba b{0}\b": [], "": [], r"\ba *\b": [], r"\b(a|)\b": [], r"\bl'eau\b": [["l"], ["eau"]],
    }
    assert {p: required(p) for p in wanted} == wanted


def test_required_words_are_in_every_match():
    rng = random.Random(4)
    bits = [r"\b", " ", r"\s+", "a", "bc", "d", "(a|bc)", "(?:d|a)", "?", "*", "+", ".", "|", "[ab]", "(a b)", "(", ")", "-", "'"]
    words = ["a", "bc", "d", "ab", "bca", "-", "'", "da"]
    tried = 0
    for _ in range(6000):
        pattern = r"\b" * rng.randint(0, 1) + "".join(rng.choices(bits, k=rng.randint(1, 6))) + r"\b" * rng.randint(0, 1)
        try:
            form = re.compile(pattern)
        except re.error:
            continue
        for lists in required(pattern):
            for _ in range(20):
                text = rng.choice((" ", "")).join(rng.choices(words, k=rng.randint(0, 5)))
                if form.search(text):
                    tried += 1
                    assert set(re.findall(r"\w+", text)) & set(lists), (pattern, text)
    assert tried > 500


def test_matches_equal_trying_all(spark):
    rng = random.Random(9)
    words = ["facture", "Diplôme", "de", "licence", "total", "HT", "d'eau", "note", "notes", "été", "x1", "the"]
    docs = [(i, rng.choice((" ", "\n", ", ")).join(rng.choices(words, k=rng.randint(0, 8)))) for i in range(150)] + [(150, None), (151, "")]
    shipped = [k for c in fixed.REGISTRY["categories"] for k in c["keywords"]]
    patterns = [*shipped, *shipped[:3], r"\bfacture de\b", r"\b(total|note) ht\b", r"\bete\b", r"\bd.eau\b", r"notes?", r"\bde\b|\bx1\b", r"\blicence\s+total\b", r"^the\b", None]
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string").selectExpr("*", "'w' AS word", "1 AS n")
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'k' AS key", "'f' AS folded", "2 AS choice").repartition(3)
    got = sorted((r.doc_id, r.pattern) for r in matched(rows, table).collect())
    assert got == sorted((i, p) for i, t in docs if t is not None for p in {p for p in patterns if p} if re.search(p, folded(t)))
    assert matched(rows.limit(0), table).count() == matched(rows, table.limit(0)).count() == 0


def test_the_plan_does_not_grow_with_the_registry(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    size = lambda n: len(matched(docs, spark.range(n).selectExpr("concat('\\\\bw', id, '\\\\b') AS pattern"))._jdf.queryExecution().optimizedPlan().toString())
    assert size(5000) <= size(5) + 100
    with pytest.raises(ValueError, match="no word"):
        matched(docs, spark.range(pattern_index.OPEN + 1).selectExpr("concat('w', id) AS pattern"))


def test_required_pairs():
    wanted = {
        r"\bles\s+parties\b": [["les parties"]], r"\bentre les deux\b": [["entre les"], ["les deux"]], r"\b(montant|total) ht\b": [["montant ht", "total ht"]], r"\bl'eau, (?:de|du)\b": [["l,eau"], ["eau,de", "eau,du"]],
        r"\bnote d.honoraires\b": [["note"]], r"\ba b\b.*\bc\b": [["a b"], ["c"]], r"\ba\b\bb\b": [["a"], ["b"]], r"\ba\b|\bb c\b": [["a", "b c"]], r"\ba\s*b\b": [], r"\ba?\s+b c\b": [["b c"]], r"\ba\b": [["a"]], r"\ba \s+b\b": [["a b"]],
    }
    assert {p: required(p, True) for p in wanted} == wanted


def test_frequent_words_that_are_no_neighbours_are_not_tried(spark):
    """The patterns' words are in all texts: by words alone each of 900 patterns would be tried on each of 300 texts. Only those of
    neighbours are."""
    names = [a + b for a in "abcdef" for b in "vwxyz"]
    pairs = spark.createDataFrame([(rf"\b{a}\s+{b}\b",) for a in names for b in names], "pattern string")
    rng = random.Random(3)
    docs = [(i, rng.choice((" ", "\n", ", ", "é ")).join(rng.sample(names, len(names)))) for i in range(300)]
    keys = pattern_index.keyed(pairs).collect()
    assert {(r.pattern, *r.words) for r in keys} == {(rf"\b{a}\s+{b}\b", f"{a} {b}") for a in names for b in names}
    got = sorted((r.doc_id, r.pattern) for r in matched(spark.createDataFrame(docs, "doc_id long, text string"), pairs).collect())
    assert got == sorted((i, rf"\b{a}\s+{b}\b") for i, t in docs for a, b in re.findall(r"(?=\b(\w+)\s+(\w+)\b)", folded(t)) if a in names and b in names)
