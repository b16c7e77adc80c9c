import pytest

from triago.operators import engine

REGISTRY = {
    "generic_fields": ["titre", "date"], "sensitive_fields": [], "rules": [],
    "categories": [{"name": "factures", "folder": "F", "keywords": [], "subfolders": [], "fields": ["fournisseur", "ttc"]}, {"name": "rapports", "folder": "R", "keywords": [], "subfolders": [], "fields": ["date"]}],
}


def engines():
    """Defined here so that they travel to the workers by value."""

    class Deaf:
        def reply(self, prompt, schema):
            raise TimeoutError

    class Odd:
        """Leaves a key out."""

        def reply(self, prompt, schema):
            return {}

    return {"deaf": Deaf, "odd": Odd}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "factures", "Maison Noire\nTotal 3"), (2, "rapports", "x"), (3, None, "Titre ici"), (4, "inconnu", None), (5, "factures", "long " * 20_000)]
    return spark.createDataFrame(rows, "doc_id long, type string, text string")


def test_only_free_fields_of_a_type_are_asked_for(docs):
    got = {r.doc_id: r for r in engine.free_field_replies(docs, REGISTRY, "first_line").collect()}
    assert sorted(got) == [1, 3, 4, 5] and all(r.ok and not r.needs_review for r in got.values())
    assert got[1].replies == {"fournisseur": "Maison Noire"} and got[3].replies == {"titre": "Titre ici"} and got[4].replies == {}
    assert got[5].alerts == ["texte tronque pour le moteur"] and got[1].alerts == []
    assert engine.free_field_replies(docs.limit(0), REGISTRY).isEmpty()


@pytest.mark.parametrize("made, error", [("deaf", "moteur en erreur (TimeoutError)"), ("odd", "reponse non conforme")])
def test_a_failing_engine_leaves_documents_to_a_human(docs, made, error):
    rows = engine.free_field_replies(docs.where("doc_id in (1, 3)"), REGISTRY, engines()[made]).collect()
    assert [(r.ok, r.error, r.needs_review, r.replies, r.alerts) for r in rows] == [(False, error, True, {}, [f"champs libres : moteur indisponible ({error})"])] * 2
