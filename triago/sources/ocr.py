"""OCR output as a table of pages, merged with the pages that have text of their own.

The OCR engine runs elsewhere and leaves one JSON line a page. A page of a document is a struct (page, status, text); its
status is ``texte`` or ``OCR requis``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triago import fixed
from triago.functions.text import java, lines_of, needs_ocr
from triago.operators.extract import LINE
from triago.operators.prefix import running

NATIVE, SCAN = "texte", "OCR requis"
PAGES = (
    "doc_id long, page int, status string, reason string, width int, height int, dpi int, orientation int, reduction double, peak_mb double, "
    "lines array<struct<text: string, conf: double, frame: array<array<int>>>>"
)


def ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).json(path)


def page_status(text: Column) -> Column:
    return F.when(needs_ocr(text), SCAN).otherwise(NATIVE)


def ocr_tasks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page) of the pages that need OCR."""
    return docs.select(key, F.explode("pages").alias("p")).where(F.col("p.status") != NATIVE).select(key, "p.page")


def with_ocr(docs: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` (key, text, pages) with ocr: the document's OCR pages by number. One exchange of either side, on key."""
    found = pages.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("page", F.struct("status", "reason", "lines")))).alias("ocr"))
    return docs.join(found, key, "left")


def _page(ocr: Column, number: Column) -> Column:
    return F.try_element_at(ocr, number)


def merged_text(text: Column, pages: Column, ocr: Column) -> Column:
    """struct(text, alerts): native and OCR text in the order of pages; a page without its OCR gives an alert."""

    def part(p: Column) -> Column:
        seen = _page(ocr, p["page"])
        scanned = F.when(seen["status"] == "ok", F.array_join(F.transform(seen["lines"], lambda x: x["text"]), "\n"))
        return F.when(p["status"] == NATIVE, p["text"]).otherwise(scanned)

    def alert(p: Column) -> Column:
        seen = _page(ocr, p["page"])
        bad = (p["status"] != NATIVE) & ~F.coalesce(seen["status"] == "ok", F.lit(False))
        reason = F.when(seen.isNull(), fixed.NO_OCR).otherwise(F.coalesce(seen["reason"], F.lit("None")))
        return F.when(bad, F.concat(F.lit("page "), p["page"].cast("string"), F.lit(" : OCR indisponible ("), reason, F.lit(")")))

    parts = F.filter(F.transform(pages, part), lambda x: x.rlike(java(r"\S")))
    paged = F.struct(F.array_join(parts, fixed.PAGE_SEPARATOR).alias("text"), F.array_compact(F.transform(pages, alert)).alias("alerts"))
    unpaged = F.struct(text.alias("text"), F.array().cast("array<string>").alias("alerts"))
    return F.when(F.coalesce(F.size(pages) > 0, F.lit(False)), paged).otherwise(unpaged)


def document_lines(text: Column, pages: Column, ocr: Column) -> Column:
    """The lines with something in them, in the order of pages; native ones have no confidence."""

    def of(p: Column) -> Column:
        seen = _page(ocr, p["page"])
        native = F.transform(lines_of(p["text"]), lambda x: F.struct(x.alias("text"), F.lit(None).cast("double").alias("conf"), p["page"].cast("int").alias("page")))
        scanned = F.transform(F.filter(seen["lines"], lambda x: x["text"].rlike(java(r"\S"))), lambda x: F.struct(x["text"].alias("text"), x["conf"].alias("conf"), p["page"].cast("int").alias("page")))
        return F.when(p["status"] == NATIVE, native).when(seen["status"] == "ok", scanned).otherwise(F.array().cast(f"array<{LINE}>"))

    plain = F.transform(lines_of(text), lambda x: F.struct(x.alias("text"), F.lit(None).cast("double").alias("conf"), F.lit(None).cast("int").alias("page")))
    return F.when(F.coalesce(F.size(pages) > 0, F.lit(False)), F.flatten(F.transform(pages, of))).otherwise(plain)


def confidences(ocr: Column) -> Column:
    """All confidences of the pages that OCR could read."""
    good = F.filter(F.map_values(F.coalesce(ocr, F.create_map().cast("map<int, struct<status: string, reason: string, lines: array<struct<text: string, conf: double, frame: array<array<int>>>>>>"))), lambda p: p["status"] == "ok")
    return F.flatten(F.transform(good, lambda p: F.transform(p["lines"], lambda x: x["conf"])))


def page_quality(pages: DataFrame) -> DataFrame:
    """(doc_id, page, n_lines, mean_conf); a page without lines has no mean."""
    lines = F.col("lines")
    mean = F.aggregate(lines, F.lit(0.0), lambda a, x: a + x["conf"]) / F.size(lines)
    return pages.select("doc_id", "page", F.size(lines).alias("n_lines"), F.when(F.size(lines) > 0, mean).alias("mean_conf"))


def lot_summary(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == "ok").alias("ok"), F.max("peak_mb").alias("peak_mb"))


def upright(pages: DataFrame) -> DataFrame:
    """Pages read upside down, with their lines turned back into reading order."""
    return pages.withColumn("lines", F.when(F.col("orientation") == 180, F.reverse("lines")).otherwise(F.col("lines")))


def worker_runs(pages: DataFrame, order: list[str], run: str = "run", worker: str = "worker", memory: str = "memory_mb") -> DataFrame:
    """(run, worker, start, pages, peak_mb): the stretches in which one worker read a run's pages, in the order of ``order``; each
    but a run's first is a restart. Null runs and workers are ones like others, null memory counts for no peak.

    A page's place in the run less its place among its worker's pages is the same along a stretch and differs between a
    worker's stretches. Both places are running sums over ranges, so a run may have any number of pages.
    """
    rows = pages.select(F.col(run).alias("run"), F.col(worker).alias("worker"), F.col(memory).alias("memory"), F.struct(*order).alias("at"))
    placed = running(running(rows, ["run"], ["at"], "place"), ["run", "worker"], ["at"], "own")
    runs = placed.groupBy("run", "worker", (F.col("place") - F.col("own")).alias("gap")).agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("pages"), F.max("memory").alias("peak_mb"))
    return runs.drop("gap")
