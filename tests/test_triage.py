from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from triago import fixed
from triago.operators import classify, engine, extract, filing, registry, review
from triago.plans import batch
from triago.sources import ocr

INVOICE = (
    "Papeterie du Canal\nI.C.E 009 412 776 000 031\nFACTURE\nN° PC/26-318 bis\nDate de la facture : 3 février 2026\nMontant HT 640,50 DH\nTVA 20 %\n128,10 DH\nNet à payer\n768,60 DH\n"
    "À verser au R.I.B. 145 | 640 | 2111178903450006 | 88"
)
INVOICE_FIELDS = {"date_facture": "2026-02-03", "numero": "PC/26-318", "montant_ht": "640.5", "tva": "128.1", "montant_ttc": "768.6", "ice": "009412776000031", "rib": "145640211117890345000688"}
TEXTS = [
    ("Atelier du Port\nNote d'honoraires n° 12\ntva comprise", "factures", "clear", None),
    ("Relevé de compte du trimestre\nancien solde, nouveau solde", "banque", "clear", None),
    ("Entre les soussignés, un contrat est passé ; les parties s'engagent", "contrats", "clear", None),
    ("Certificat de scolarité\nl'école certifie que l'élève suit ses cours", "attestations", "clear", "Scolarite"),
    ("Doctorat décerné au grade de docteur\nmention honorable", "diplomes", "clear", "Doctorat"),
    ("Baccalauréat, grade et mention", "diplomes", "clear", "Autres"),
    ("La banque remet cette attestation de RIB", "banque", "business_rule", None),
    ("L'université remet une attestation de réussite du master", "diplomes", "business_rule", "Master"),
    ("le total HT et la TVA d'un contrat", "factures", "weak", None),
    ("solde d'un contrat", None, "tie", None),
    ("Menu du jour", None, "none", None),
    (None, None, "none", None),
    ("page blanche\n" * 16 + "note d'honoraires, ttc", "factures", "weak", None),
]


def test_verdicts_and_subfolders(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(TEXTS)], "i int, text string")
    got = classify.analysed(rows, fixed.REGISTRY).withColumn("sub", classify.subfolder(F.col("rule_category"), F.col("text"), fixed.REGISTRY)).orderBy("i").collect()
    assert [(r.rule_category, r.rule_verdict, r["sub"]) for r in got] == [x[1:] for x in TEXTS]


def decide(spark, verdict, mine, reply, ocr_mean=None, arabic=0.0):
    row = spark.range(1).select(
        F.lit("").alias("text"), F.lit(verdict).alias("rule_verdict"), F.lit(mine).cast("string").alias("rule_category"),
        F.create_map().cast("map<string, string>").alias("subfolders"), F.struct(F.lit(arabic).alias("arabic_share"), F.lit(0).alias("ocr_lines"), F.lit(ocr_mean).cast("double").alias("ocr_mean"), F.lit(0).alias("ocr_below")).alias("signals"),
    )
    r = F.struct(*(F.lit(x).cast(t).alias(n) for x, (n, t) in zip(reply, (("ok", "boolean"), ("category", "string"), ("proposed", "string"), ("near", "string"), ("error", "string")), strict=True)))
    got = classify.decided(row, r).first()
    return got.category, got.proposed, got.confidence, got.needs_review


@pytest.mark.parametrize("verdict, mine, reply, expected", [
    ("business_rule", "diplomes", (None, None, None, None, None), ("diplomes", None, 0.95, False)),
    ("clear", "factures", (True, "factures", None, None, None), ("factures", None, 0.95, False)),
    ("clear", "factures", (True, "contrats", None, None, None), ("factures", None, 0.6, True)),
    ("clear", "factures", (False, None, None, None, "x"), ("factures", None, 0.6, True)),
    ("weak", "factures", (True, "factures", None, None, None), ("factures", None, 0.6, True)),
    ("tie", None, (True, "contrats", None, None, None), ("contrats", None, 0.6, True)),
    ("none", None, (False, None, None, None, "x"), (None, None, 0.6, True)),
    ("clear", "factures", (True, "autre", None, None, None), ("factures", None, 0.6, True)),
    ("clear", "factures", (True, "autre", "Diplome", "diplomes", None), ("diplomes", None, 0.6, True)),
    ("none", None, (True, "autre", "Bulletin de paie", None, None), (None, "bulletin_de_paie", 0.6, True)),
])
def test_confidence_table(spark, verdict, mine, reply, expected):
    assert decide(spark, verdict, mine, reply) == expected


def test_signals_force_reviews_and_leave_confidence(spark):
    agreed = (True, "factures", None, None, None)
    assert decide(spark, "clear", "factures", agreed, ocr_mean=0.79)[2:] == (0.95, True) and decide(spark, "clear", "factures", agreed, ocr_mean=0.8)[2:] == (0.95, False)
    assert decide(spark, "clear", "factures", agreed, arabic=0.71)[2:] == (0.95, True) and decide(spark, "clear", "factures", agreed, arabic=0.7)[2:] == (0.95, False)


def shown(amount, k):
    """An amount (in cents) as written in one of several ways."""
    whole, cents = f"{amount // 100:,}", f"{amount % 100:02}"
    return (whole.replace(",", " ") + "," + cents, whole.replace(",", ".") + "," + cents + " DH", whole + "." + cents + " MAD", whole.replace(",", "\u202f") + "," + cents + " €")[k % 4]


def cases():
    """(type, text, fields, status of the totals): invoices of one to four tax lines in every layout, sums that meet or miss, and
    each field of each type beside its label, below it, misread, ambiguous or absent."""
    out = [("factures", INVOICE, INVOICE_FIELDS, "ok"), ("factures", "", {}, "missing")]
    for k in range(8):
        net, rates = 61_307 * (k + 1) ** 2, (20, 14, 10, 7)[: k % 4 + 1]
        taxes = [net * r // 100 for r in rates]
        total = net + sum(taxes) + (4_500 if k in (3, 6) else 0)
        gap = "\n" if k % 2 else " "
        lines = [f"{('Total HT', 'T0tal H.T.', 'montant ht', 'TOTAL HT')[k % 4]} :{gap}{shown(net, k)}"] + [f"TVA {r} % :{gap}{shown(t, k + 1)}" for r, t in zip(rates, taxes, strict=True)]
        lines += [f"Total T.V.A :{gap}{shown(sum(taxes), k)}"] * (k == 2) + [f"{('Total TTC', 'Net à payer TTC', 'Montant T.T.C', 'tota1 ttc')[k % 4]} :{gap}{shown(total, k + 2)}"]
        number = lambda cents: f"{Decimal(cents) / 100:f}"
        out.append(("factures", "\n".join(lines), {"montant_ht": number(net), "tva": number(sum(taxes)), "montant_ttc": number(total)}, "gap" if k in (3, 6) else "ok"))
    out += [
        ("factures", "Montant HT\n72,00\nTVA\nexonérée, article 5\nNet à payer\n72,00", {"montant_ht": "72", "montant_ttc": "72"}, "ok"),
        ("factures", "Montant HT : 7.200 DH\nNet à payer : 8 640,00", {"montant_ttc": "8640"}, "missing"), ("factures", "TVA 20 % :\n?? %%\nTotal TTC \\ vide", {}, "missing"),
        ("factures", "Facture n° : 77-B Date : 09.04.2025", {"numero": "77-B", "date_facture": "2025-04-09"}, "missing"), ("factures", "n° de la facture : LOT 9 / 41", {"numero": "LOT 9 / 41"}, "missing"),
        ("factures", "N° : sans", {}, "missing"), ("factures", "Montant HT : 3 O50,00\nICE : 11O222333000044", {}, "missing"),
        ("diplomes", "Née le 21-11-1988\nC.I.N : kb 70412\nDélivré le 2 mars 2011", {"cin": "KB70412", "date_naissance": "1988-11-21", "date_obtention": "2011-03-02"}, None),
        ("contrats", "Date de signature\n30/06/2024\nFait à Agadir, le 01/07/2024", {"date_signature": "2024-06-30"}, None),
        ("banque", "IBAN : MA12 1456 4021 1117 8903 4500 0688\nRelevé d'identité bancaire : 145 640 2111178903450006 88", {"rib": "145640211117890345000688", "iban": "MA12145640211117890345000688"}, None),
        ("banque", "R.I.B\n145 640\n2111178903\n450006 88", {"rib": "145640211117890345000688"}, None), ("banque", "RIB\n145 640\nagence 12\n2111178903450006 88", {}, None),
        ("recettes", "Soupe\nle 12 mai 2020", {"date": "2020-05-12"}, None),
    ]
    return out


def test_extraction(spark):
    given = cases()
    docs = spark.createDataFrame([(i, t, x) for i, (t, x, *_) in enumerate(given)], "doc_id long, type string, text string").withColumn("lines", extract.text_lines(F.col("text")))
    fields = extract.extracted(docs, fixed.REGISTRY, 2026)
    got = {r.doc_id: r for r in extract.document_results(docs, fields, fixed.REGISTRY).collect()}
    plain = lambda d: {k: Decimal(v) if k in fixed.TOTAL_FIELDS else v for k, v in d.items()}
    for i, (_, text, expected, status) in enumerate(given):
        assert plain(got[i].fields) == plain(expected) and (got[i].totals.status if got[i].totals else None) == status, text
    ambiguous = next(i for i, c in enumerate(given) if "7.200" in c[1])
    assert got[ambiguous].alerts == ["montant_ht : ambigu (separateur suivi de 3 chiffres)", fixed.TOTALS_MISSING] and got[0].alerts == []


def test_extraction_of_odd_tables(spark):
    """Nulls, empty lines, columns of names used inside, an empty table; a document without a label has no row of fields."""
    none = spark.createDataFrame([], f"doc_id long, type string, lines array<{extract.LINE}>")
    assert extract.extracted(none, fixed.REGISTRY, 2026).count() == 0
    lines = [("Total HT : 5,00", None, None), (None, None, None), ("", None, None), ("TTC", 0.2, 1)]
    docs = spark.createDataFrame([(1, "factures", lines), (2, None, None), (None, "factures", lines), (3, "x", [])], none.schema).selectExpr("*", "'k' AS key", "1 AS line", "2 AS code", "'n' AS norm", "'w' AS wanted", "'f' AS after", "3 AS end", "'o' AS one")
    found = extract.extracted(docs, fixed.REGISTRY, 2026)
    assert sorted((str(r.doc_id), r.field, r.value) for r in found.collect()) == [("1", "montant_ht", "5.000000"), ("None", "montant_ht", "5.000000")]
    assert extract.document_results(docs, found, fixed.REGISTRY, carried=("key", "line")).count() == 4


def test_labels_with_ways_at_the_top_keep_their_meaning():
    assert extract.any_of([r"\ba(?:x|y)", r"\bb", "c"]) == r"\b(?:(?:a(?:x|y))|(?:b))|(?:c)"
    assert extract.any_of([r"\ba|b", r"\bc[|]"]) == r"\b(?:(?:c[|]))|(?:\ba|b)"


def test_doubtful_line_forces_review(spark):
    lines = [("Total HT :", 0.99, 1), ("1 000,00 DH", 0.99, 1), ("TVA 20 % :", 0.98, 1), ("200,00 DH", 0.97, 1), ("Total TTC :", 0.99, 2), ("1 200,00 DH", 0.75, 2)]
    docs = spark.createDataFrame([(1, "factures", lines)], f"doc_id long, type string, lines array<{extract.LINE}>")
    fields = extract.extracted(docs, fixed.REGISTRY, 2026)
    row = fields.where("field = 'montant_ttc'").first()
    assert (row.conf, row.page, row.line) == (0.75, 2, 5)
    out = extract.document_results(docs, fields, fixed.REGISTRY).first()
    assert out.totals.status == "ok" and out.needs_review and out.alerts == ["montant_ttc : ligne OCR peu sure (confiance 0.75)"]


def test_registry_checks():
    assert registry.registry_problems(fixed.REGISTRY) == [] and registry.settings_problems(fixed.FIELDS) == []
    bad = fixed.REGISTRY | {"categories": [fixed.REGISTRY["categories"][0] | {"name": "autres", "keywords": ["Facture", "x1", "deux", "(", "a", "a"]}], "rules": [{"category": "none", "patterns": []}]}
    text = "\n".join(registry.registry_problems(bad))
    for part in ("is reserved", "lower case", "holds a digit", "number word", "not a valid pattern", "twice", "is unknown", "is missing or empty"):
        assert part in text
    assert registry.registry_problems({}) and registry.settings_problems({"x": {"type": "odd"}, "y": {"type": "digits", "labels": []}})
    assert registry.tolerant(r"(?<![a-z])n\s?[°º]") == r"(?<![a-z])n\s?[°º]" and registry.tolerant(r"\btotal\s*ht") == r"\bt[o0]ta[l1i]\s*ht"
    more = registry.with_category(fixed.REGISTRY, "Bulletin de paie", ["bulletin de paie", "salaire brut", "net imposable"], ["titre", "date"])
    assert registry.category(more, "bulletin_de_paie")["keywords"][0] == r"\bbulletin\s+de\s+paie\b"
    with pytest.raises(registry.RegistryError):
        registry.with_category(more, "bulletin de paie", ["a", "b", "c"], ["titre"])
    assert registry.load_profile("modest")["num_ctx"] == 2048


def test_duplicates_of_null_contents_keep_their_rows(spark):
    files = spark.createDataFrame([("b", None), ("a", None), ("c", "x"), (None, "x"), ("d", "y")], "path string, sha string")
    got = {(r.path, r.sha): r.duplicate for r in filing.with_duplicates(files).collect()}
    assert got == {("b", None): True, ("a", None): False, ("c", "x"): False, (None, "x"): True, ("d", "y"): False}
    assert filing.with_duplicates(files.where("false")).count() == 0


def test_spelled_text_of_patterns():
    wrong = {"a{2}b": None, r"\d+ mot": None, "caf[eé]": "lower case", "mot 3": "digit", "[0-9]": "digit", "(un|deux) mot": "number word", "MOT": "lower case", "": "valid", "(": "valid"}
    for pattern, part in wrong.items():
        bad = fixed.REGISTRY | {"rules": [{"category": "factures", "patterns": [pattern]}]}
        found = registry.registry_problems(bad)
        assert (found == []) if part is None else (len(found) == 1 and part in found[0]), (pattern, found)


def test_engine_replies_are_checked_once_more():
    class Odd:
        def __init__(self, *replies):
            self.replies = list(replies)

        def reply(self, prompt, schema):
            got = self.replies.pop(0)
            if isinstance(got, Exception):
                raise got
            return got

    schema = engine.classification_schema(fixed.REGISTRY)
    good = {"type_document": "factures", "nom_propose": None}
    assert engine.asked(Odd({"type_document": "?"}, good), "p", schema)[0] == good
    assert engine.asked(Odd([], {}), "p", schema)[1] == "reponse non conforme"
    assert engine.asked(Odd(OSError("secret"), good), "p", schema)[1] == "moteur en erreur (OSError)"
    assert engine.near_category("facture_d_avoir", fixed.REGISTRY) == "factures" and engine.near_category("bulletin", fixed.REGISTRY) is None
    assert engine.keyword_proposals({"mots_cles": ["Paie", "paie", "salaire 2", " net  a payer ", "a", "b", "c", "d"]}) == ["Paie", "net a payer", "a", "b", "c"]
    assert engine.keyword_proposals(None) == [] and "- (aucune)" in engine.rule_lines({"rules": []})


def test_grounding(spark):
    lines = [(x, None, None) for x in ("Société Exemple SARL", "Casablanca", "Facture à :", "Maison Neuve", "Client : Autre Société")] + [("bas de page", 0.5, 2)] + [("suite", None, 2)] * 15 + [("Tardive SA", None, 3)]
    docs = spark.createDataFrame([(1, "factures", lines)], f"doc_id long, type string, lines array<{extract.LINE}>")
    said = ["societe  EXEMPLE sarl casablanca", "Maison Neuve", "Autre Société", "Inventée", "Bas de page", "Tardive SA"]
    for value, kept, alert in zip(said, (True, False, False, False, True, True), (None, fixed.ON_RECIPIENT, fixed.ON_RECIPIENT, fixed.NOT_IN_SOURCE, "ligne OCR peu sure (confiance 0.50)", fixed.OUTSIDE_TITLE), strict=True):
        got = engine.grounded(spark.createDataFrame([(1, "fournisseur", value), (1, "montant_ht", "1")], "doc_id long, field string, value string"), docs, fixed.REGISTRY).collect()
        assert len(got) == 1 and (got[0].value is not None) == kept and got[0].alert == (alert and f"fournisseur : {alert}"), value


def test_names_without_collisions(spark):
    rows = [("a", "F", "x"), ("b", "F", "X"), ("c", "F", "x_1"), ("d", "F", "x"), ("e", "G", "x"), ("f", "F", "y")]
    taken = spark.createDataFrame([("F", "Y"), ("F", "y_1")], "folder string, name string")
    got = filing.without_collisions(spark.createDataFrame(rows, "source string, folder string, base string"), taken).collect()
    names = {r.source: r.name for r in got}
    assert names == {"a": "x", "b": "X_2", "c": "x_1", "d": "x_3", "e": "x", "f": "y_2"}


def test_duplicates_and_state(spark):
    files = spark.createDataFrame([("b", b"1"), ("a", b"1"), ("c", b"2")], "path string, content binary").withColumn("sha", filing.fingerprint(F.col("content")))
    assert {r.path for r in filing.with_duplicates(files).where("duplicate").collect()} == {"b"}
    assert [r.path for r in filing.unprocessed(files, files.where("path = 'a'")).collect()] == ["c"]


def test_copies_pages_and_accuracy(spark):
    copies = spark.createDataFrame([(1, "a", 1, "a"), (1, "a", 2, "a"), (1, "a", None, None)], "length long, sha string, copy_length long, copy_sha string")
    assert [r.ok for r in filing.deposited(copies).collect()] == [True, False, False]
    ocr_ = "map<int, struct<status: string, reason: string, lines: array<struct<text: string, conf: double, frame: array<array<int>>>>>>"
    pages = spark.createDataFrame([({2: ("ok", None, []), 1: ("erreur", "x", [])},)], f"ocr {ocr_}").select(filing.review_pages(F.col("ocr")).alias("p")).first().p
    assert [(p.page, p.status) for p in pages] == [(1, "erreur"), (2, "ok")]
    truth = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", "z"), (4, "a", None)], "doc_id long, field string, value string")
    found = spark.createDataFrame([(1, "a", "x"), (2, "a", "no")], "doc_id long, field string, value string")
    assert tuple(filing.field_accuracy(found, truth).first()) == ("a", 3, 1, 1, 1)


def test_records_and_status(spark):
    rows = spark.createDataFrame([("factures", "a.pdf", 0.95, False, False), ("Bad", "", 1.5, False, False), ("factures", "a", 0.6, False, False), ("factures", "a", 0.6, False, True)], "type string, source string, confidence double, needs_review boolean, checked_by_human boolean")
    assert [r.problems for r in filing.record_problems(rows).collect()] == [[], ["type", "source", "confidence"], ["review"], []]
    states = spark.createDataFrame([("A_Valider", None, True), ("Autres", None, False), ("F", ["x"], True), ("F/S", [], True), ("F", None, False)], "folder string, history array<string>, needs_review boolean")
    assert [(r.status, r["rank"]) for r in review.listing(states).collect()] == [("a_valider", 0), ("autres", 4), ("valide", 3), ("a_verifier", 1), ("range", 2)]


def test_corrections(spark):
    docs = spark.createDataFrame([(1, "factures", None, {"numero": "FA-1", "montant_ht": "10.00"}), (2, "factures", "contrats", {"numero": "FA-1"}), (3, "factures", None, {"numero": "A"})], "doc_id long, type string, new_type string, fields map<string, string>")
    given = spark.createDataFrame([(1, "numero", " FA-2 "), (1, "montant_ht", "10,00 DH"), (1, "date_facture", "1er mai 2026"), (3, "numero", "B"), (3, "rib", "12"), (3, "duree", "x")], "doc_id long, field string, input string")
    got = {r.doc_id: r for r in review.corrected(docs, given, fixed.REGISTRY, 2026, F.lit("2026-01-01").cast("timestamp")).collect()}
    assert [(c.field, c.old, c.new) for c in got[1].changes] == [("date_facture", None, "2026-05-01"), ("numero", "FA-1", "FA-2")] and got[1].fields["numero"] == "FA-2"
    assert [(c.field, c.old, c.new) for c in got[2].changes] == [("type", "factures", "contrats"), ("numero", "FA-1", None)] and "numero" not in got[2].fields
    assert got[3].changes == [] and got[3].errors == ["rib : invalide", "duree : champ non prevu"] and got[3].fields == {"numero": "A"}


def test_pages_and_batch(spark):
    page = "array<struct<page: int, status: string, text: string>>"
    docs = spark.createDataFrame(
        [(1, "scan 1.pdf", "", [(1, ocr.NATIVE, INVOICE.split("Net à payer")[0]), (2, ocr.SCAN, "")]), (2, "b.docx", "facture tva\nttc", None), (3, "c.pdf", "", [(1, ocr.SCAN, "")])],
        f"doc_id long, source string, text string, pages {page}",
    )
    pages = spark.createDataFrame([(1, 2, "ok", None, [("Net à payer : 768,60 DH", 0.98, None)]), (3, 1, "erreur", "delai", [])], "doc_id long, page int, status string, reason string, lines array<struct<text: string, conf: double, frame: array<array<int>>>>")
    got = {r.doc_id: r for r in batch.processed(docs, fixed.REGISTRY, 2026, pages).collect()}
    assert Decimal(got[1].fields["montant_ttc"]) == Decimal("768.60") and got[1].totals.status == "ok" and "Net à payer" in got[1].text
    assert got[1].name in ("scan_1", "facture_2026-02-03_pc_26-318")
    assert got[3].alerts[0] == "page 1 : OCR indisponible (delai)" and got[3].folder == fixed.REVIEW_FOLDER and got[3].name == "c" and got[2].text == "facture tva\nttc"


def test_lines_below_a_label_are_read_only_where_the_line_itself_gives_no_value(spark, monkeypatch):
    whole = extract.raw_value
    monkeypatch.setattr(extract, "raw_value", lambda setting, text, alone: F.raise_error(F.lit("read")).cast("string") if alone else whole(setting, text, alone))
    docs = spark.createDataFrame([(1, "factures", "Total HT : 5,00 DH\nTVA 20 % : 1,00 DH\nDate : 03/02/2026\nN° : A1\nTotal TTC : 6,00 DH")], "doc_id long, type string, text string").withColumn("lines", extract.text_lines(F.col("text")))
    got = {r.field: r.value for r in extract.extracted(docs, fixed.REGISTRY, 2026).collect()}
    assert got == {"montant_ht": "5.000000", "tva": "1.000000", "date_facture": "2026-02-03", "numero": "A1", "montant_ttc": "6.000000"}


def test_a_string_that_all_matches_hold():
    wanted = {
        r"\bnote d.honoraires\b": "honoraires", r"\b(montant|total) ht\b": " ht", r"\bttc\b": "ttc", r"\b(deug|master)\b": "", r"(?i)\bttc\b": "", r"\bfactures?\b": "facture", r"a|b": "", r"(": "", r"(?:abc)?de*f": "d", r"\barticle \d+\b": "article ",
    }
    assert {p: registry.literal_in(p) for p in wanted} == wanted
