"""What runs leave behind: the journal of their events, and the state of contents that are done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triago.functions.masking import displayed_path

# The journal's keys and its closing event.
EVENT, END = "struct<horodatage: timestamp, evenement: string, document: string, categorie: string, decision: string, total: long, ranges: long, a_valider: long, erreurs: long>", "fin"
STATE = "sha string, date timestamp, decision string"


def document_events(docs: DataFrame, at: Column, registry: dict) -> DataFrame:
    """One event for each of ``docs`` (source, type, decision); names are masked, texts and values never appear."""
    return docs.select(at.alias("horodatage"), F.lit("document").alias("evenement"), displayed_path(F.col("source"), registry).alias("document"), F.col("type").alias("categorie"), "decision")


def end_event(docs: DataFrame, at: Column) -> DataFrame:
    """The event that closes a run over ``docs`` (decision: range, a_valider or erreur; null counts for the total only).
    A run without documents has one too, of zeros."""
    count = lambda d: F.count_if(F.col("decision") == d)
    return docs.agg(F.count(F.lit(1)).alias("total"), count("range").alias("ranges"), count("a_valider").alias("a_valider"), count("erreur").alias("erreurs")).select(at.alias("horodatage"), F.lit(END).alias("evenement"), "*")


def write_events(events: DataFrame, folder: str, run: str) -> None:
    """Appends ``events`` to the journal of ``run``, one JSON object in a line. Run names sort by time."""
    events.write.mode("append").json(f"{folder}/run={run}")


def journal(spark: SparkSession, folder: str) -> DataFrame:
    """(run, event) of all journals below a folder; lines that can't be parsed are left out, a missing folder has none."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], f"run string, event {EVENT}")
    lines = spark.read.schema("value string, run string").text(folder)
    return lines.select("run", F.from_json("value", EVENT).alias("event")).where("event.evenement is not null")


def last_events(events: DataFrame, order: list[str], kind: str = END) -> DataFrame:
    """(run, event): of each run the last event of a kind by ``order`` within it; runs without one have no row. ``events``:
    (run, event with evenement). A maximum with partial sums, so a run may have any number of events."""
    return events.where(F.col("event.evenement") == kind).groupBy("run").agg(F.max_by("event", F.struct(*order)).alias("event"))


def last_run(events: DataFrame) -> DataFrame:
    """The closing event of the last run; none if that run has not ended, whatever earlier ones have."""
    latest = events.agg(F.max("run")).scalar()
    return last_events(events.where(F.col("run") == latest), ["event.horodatage"])


def recorded(state: DataFrame) -> DataFrame:
    """The latest entry of each content in ``state`` (sha, date, decision); of entries of one date the greatest decision.
    Null contents are one content."""
    latest = F.max(F.struct("date", "decision")).alias("last")
    return state.groupBy("sha").agg(latest).select("sha", "last.date", "last.decision")


def state(spark: SparkSession, folder: str) -> DataFrame:
    """The contents done so far. Files that can't be read count for nothing, so their contents are processed again; a
    missing folder is an empty state."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], STATE)
    return recorded(spark.read.schema(STATE).option("ignoreCorruptFiles", True).parquet(folder))


def add_state(docs: DataFrame, folder: str, at: Column) -> None:
    """Adds ``docs`` (sha, decision), which must have been deposited; the committer makes the write all or nothing."""
    docs.select("sha", at.alias("date"), "decision").write.mode("append").parquet(folder)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
