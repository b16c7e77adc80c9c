import os

from pyspark.sql import functions as F

from triago import fixed
from triago.operators import filing
from triago.sources import journal


def at(day=1):
    return F.lit(f"2026-05-{day:02d} 10:00:00").cast("timestamp")


def test_journal_of_runs(spark, tmp_path):
    folder = str(tmp_path / "logs")
    assert journal.journal(spark, folder).isEmpty() and journal.last_run(journal.journal(spark, folder)).isEmpty()
    docs = spark.createDataFrame([("in/Contrat Martin 0612345678.pdf", "factures", "range"), ("in/b.pdf", None, "a_valider"), ("in/c.pdf", None, None)], "source string, type string, decision string")
    journal.write_events(journal.document_events(docs, at(), fixed.REGISTRY), folder, "20260501")
    journal.write_events(journal.end_event(docs, at()), folder, "20260501")
    os.makedirs(tmp_path / "logs" / "run=20260501", exist_ok=True)
    (tmp_path / "logs" / "run=20260501" / "broken.json").write_text("{ not JSON\n\n")
    events = journal.journal(spark, folder)
    assert events.count() == 4
    assert not any("Martin" in r.d or "0612345678" in r.d for r in events.where("event.document is not null").select(F.col("event.document").alias("d")).collect())
    end = journal.last_run(events).first().event
    assert (end.total, end.ranges, end.a_valider, end.erreurs) == (3, 1, 1, 0)
    journal.write_events(journal.document_events(docs, at(), fixed.REGISTRY), folder, "20260502")  # not ended yet
    assert journal.last_run(journal.journal(spark, folder)).isEmpty()
    assert [r.run for r in journal.last_events(journal.journal(spark, folder), ["event.horodatage"]).collect()] == ["20260501"]
    journal.write_events(journal.end_event(docs.limit(0), at()), folder, "20260503")
    assert journal.last_run(journal.journal(spark, folder)).first().event.total == 0


def test_state_outlives_runs_and_damage(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert journal.state(spark, folder).isEmpty()
    docs = spark.createDataFrame([("a", "range"), ("b", "a_valider"), (None, "range")], "sha string, decision string")
    journal.add_state(docs, folder, at())
    journal.add_state(docs.where("sha = 'b'").withColumn("decision", F.lit("range")), folder, at(2))
    (tmp_path / "state" / "torn.parquet").write_bytes(b"PAR1 torn")
    found = {r.sha: r.decision for r in journal.state(spark, folder).collect()}
    assert found == {"a": "range", "b": "range", None: "range"}
    files = spark.createDataFrame([("a",), ("c",)], "sha string")
    assert [r.sha for r in filing.unprocessed(files, journal.state(spark, folder)).collect()] == ["c"]


def test_review_record_of_an_unreadable_document(spark):
    docs = spark.createDataFrame(
        [("x.pdf", "factures", 0.4, {"ttc": "1"}, "texte", "doute", ["a"], None), ("y.pdf", "factures", 0.9, {"ttc": "1"}, "texte", "illisible", None, True)],
        "source string, type string, confidence double, fields map<string, string>, text string, reason string, alerts array<string>, unreadable boolean",
    )
    good, lost = filing.review_records(docs, at()).orderBy("source").collect()
    assert list(good.asDict()) == list(lost.asDict())
    assert (good.type, good.categorie_proposee, good.champs, good.texte_brut, good.has_text) == ("factures", "factures", {"ttc": "1"}, "texte", True)
    assert (lost.type, lost.categorie_proposee, lost.confiance_classification, lost.champs, lost.texte_brut, lost.alertes, lost.has_text) == (None, None, None, {}, "", [], False)
    assert lost.necessite_validation_humaine and lost.raison == "illisible"
