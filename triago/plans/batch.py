"""The batch: pages to lines, verdicts, engine replies, fields, checks and filing decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triago import fixed
from triago.functions.naming import proposed_name
from triago.operators import classify, engine, extract, filing
from triago.shared import written
from triago.sources import ocr


def prepared(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``docs`` (doc_id, source, text, pages) with native, lines, confidences and merge_alerts; text is the merged one."""
    empty = "map<int, struct<status: string, reason: string, lines: array<struct<text: string, conf: double, frame: array<array<int>>>>>>"
    rows = docs.withColumn("ocr", F.lit(None).cast(empty)) if pages is None else ocr.with_ocr(docs, pages)
    merged = ocr.merged_text(F.col("text"), F.col("pages"), F.col("ocr"))
    rows = rows.withColumn("merged", merged).withColumn("lines", ocr.document_lines(F.col("text"), F.col("pages"), F.col("ocr")))
    return rows.select(
        "doc_id", "source", F.col("text").alias("native"), F.col("merged.text").alias("text"), "lines",
        ocr.confidences(F.col("ocr")).alias("confidences"), F.col("merged.alerts").alias("merge_alerts"),
    )


def classified(docs: DataFrame, registry: dict, engine_name: str = "stub", num_ctx: int = 2048) -> DataFrame:
    """Prepared ``docs`` with the verdict, the engine's reply, the decision and the final type."""
    rows = classify.analysed(docs, registry, native="native", confidences=F.col("confidences"))
    replies = engine.engine_replies(rows, registry, engine_name, num_ctx=num_ctx).withColumn("name", F.when(F.col("category") == fixed.ENGINE_OTHER, F.nullif(proposed_name(F.col("proposed")), F.lit(""))))
    replies = engine.with_near_category(replies, registry).select("doc_id", F.struct("ok", "category", "proposed", "near", "error").alias("reply"))
    rows = rows.join(replies, "doc_id", "left")
    return classify.decided(rows, F.col("reply")).withColumn("type", classify.final_type())


def processed(docs: DataFrame, registry: dict, ref_year: int, pages: DataFrame | None = None, engine_name: str = "stub", free_replies: DataFrame | None = None, taken: DataFrame | None = None) -> DataFrame:
    """One row for each document: type, confidence, fields, alerts, folder and name.

    ``free_replies``: (doc_id, field, value) of an engine for free fields, grounded here; ``taken``: names in use.
    """
    rows = classified(prepared(docs, pages), registry, engine_name)
    carried = ("source", "text", "lines", "merge_alerts", "category", "proposed", "subfolder", "rule_verdict", "confidence", "doubt")
    # written once, as fields and documents are two passes
    rows = written(rows.withColumn("doubt", F.col("needs_review")).select("doc_id", "type", *carried))
    rows = extract.document_results(rows, extract.extracted(rows, registry, ref_year), registry, carried=carried)
    rows = rows.withColumnsRenamed({"alerts": "field_alerts", "needs_review": "field_review"})
    free_review, free_alerts = F.lit(False), F.array().cast("array<string>")
    if free_replies is not None:
        free = engine.grounded(free_replies, rows, registry)
        more = free.groupBy("doc_id").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("field", "value"))))).alias("free"), F.max("needs_review").alias("free_review"), F.array_sort(F.array_compact(F.collect_list("alert"))).alias("free_alerts"),
        )
        rows = rows.join(more, "doc_id", "left")
        kept = F.map_filter(F.coalesce("free", F.create_map().cast("map<string, string>")), lambda k, v: ~F.map_contains_key(F.col("fields"), k))
        rows = rows.withColumn("fields", F.map_concat("fields", kept))
        free_review, free_alerts = F.coalesce("free_review", F.lit(False)), F.coalesce("free_alerts", free_alerts)
    review = F.col("doubt") | F.col("field_review") | free_review | (F.size("merge_alerts") > 0)
    rows = rows.withColumn("needs_review", review).withColumn("alerts", F.concat("merge_alerts", "field_alerts", free_alerts))
    rows = filing.with_base(filing.routed(rows, registry), registry)
    rows = filing.without_collisions(rows, taken)
    return rows.select("doc_id", "source", "type", "category", "proposed", "subfolder", "rule_verdict", "confidence", "needs_review", "reason", "fields", "totals", "alerts", "folder", "name", "text")
