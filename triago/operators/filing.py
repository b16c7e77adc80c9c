"""Filing decisions: fingerprints, duplicates, routing, names without collisions, output records and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triago import fixed
from triago.functions.naming import base_name, shortened
from triago.operators.prefix import running
from triago.operators.registry import SUBFOLDER_PART, expected_fields, name_model
from triago.shared import written


def fingerprint(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def with_duplicates(files: DataFrame, sha: str = "sha", path: str = "path") -> DataFrame:
    """``files`` with duplicate: of equal contents the first path is kept. The first path of each content is worked out by
    a partial aggregate, so many copies of one file are no heavy window. Null contents are one content; a null path
    comes last. A column named duplicate is replaced, others may have any names."""
    rows = files.select(F.struct(*(c for c in files.columns if c != "duplicate")).alias("file"), F.col(sha).alias("sha"), F.col(path).alias("path"))
    first = rows.groupBy(F.col("sha").alias("content")).agg(F.min("path").alias("first"))
    found = rows.join(first, F.col("sha").eqNullSafe(F.col("content")))
    return found.select("file.*", (~F.col("path").eqNullSafe(F.col("first"))).alias("duplicate"))


def unprocessed(files: DataFrame, done: DataFrame, sha: str = "sha") -> DataFrame:
    """The files whose content is not among those done. Null contents are one content, as for ``with_duplicates`` and the
    journal's state."""
    rows = files.select(F.struct("*").alias("file"), F.col(sha).alias("sha"))
    known = done.select(F.col(sha).alias("content")).distinct()
    return rows.join(known, F.col("sha").eqNullSafe(F.col("content")), "left_anti").select("file.*")


def routed(docs: DataFrame, registry: dict) -> DataFrame:
    """``docs`` (type, subfolder, needs_review) with to_review, reason and folder."""
    folders = F.create_map(*(x for c in registry["categories"] for x in (F.lit(c["name"]), F.lit(c["folder"]))))
    known = F.try_element_at(folders, F.col("type"))
    reason = F.when(F.col("needs_review"), fixed.NEEDS_REVIEW).when(known.isNull() & (F.col("type") != fixed.OTHER), fixed.UNKNOWN_CATEGORY)
    folder = F.when(reason.isNotNull(), fixed.REVIEW_FOLDER).when(known.isNull(), fixed.OTHER_FOLDER).otherwise(F.concat_ws("/", known, "subfolder"))
    return docs.withColumn("reason", reason).withColumn("to_review", reason.isNotNull()).withColumn("folder", folder)


def with_base(docs: DataFrame, registry: dict) -> DataFrame:
    """Routed ``docs`` (type, subfolder, fields: map, source) with base: for review the cleaned original name, else the
    type's prefix and parts; cut to the room there is (null if there is none)."""
    stem = F.regexp_replace("source", r"(?s)(?<=[^.])\.[^.]+$", "")
    # the parts are chosen first and cleaned after, so that there is one cleaning expression for all types
    parts = F.array(F.col("type"), *(F.try_element_at("fields", F.lit(p)) for p in ("titre", "personne")))
    for c in registry["categories"]:
        model = name_model(registry, c["name"])
        own = (F.col("subfolder") if p == SUBFOLDER_PART else F.try_element_at("fields", F.lit(p)) for p in model["parts"])
        parts = F.when(F.col("type") == c["name"], F.array(F.lit(model["prefix"]), *own)).otherwise(parts)
    base = base_name(F.when(F.col("to_review"), F.array(stem)).otherwise(parts))
    return docs.withColumn("base", shortened(base, F.col("folder"), [".txt", ".json"]))


def without_collisions(docs: DataFrame, taken: DataFrame | None = None, order: str = "source") -> DataFrame:
    """``docs`` (folder, base) with name: the base, or the base with the first free number.

    Names are given in the order of ``order`` within (folder, base without regard to case); ``taken`` holds (folder, name)
    in use. Bases that themselves end in a number can meet names given to others, so numbers avoid every base of the
    folder that is wanted as it stands and every taken name. A null base or folder is one like others; a null base has no
    name. A column called name is replaced, others may have any names.

    A popular base is never one task's: places are running sums over ranges. The nth free number of a base is n and the
    number of blocked ones below it. As the ith blocked number b has b - i free ones below it, it counts for every n above
    b - i, so these values and all n are sorted together and another running sum counts the blocked ones before each n.
    """
    # written once: its ranges are drawn, and its names and places read, in passes of their own
    mine = written(docs.select(F.struct(*(c for c in docs.columns if c != "name")).alias("doc"), "folder", F.lower("base").alias("low"), F.lit(1).alias("kind"), F.col(order).alias("at")))
    names = mine.select("folder", "low")
    queue = mine
    if taken is not None:
        used = taken.select("folder", F.lower("name").alias("low")).distinct()
        names = names.unionByName(used)
        queue = mine.unionByName(used.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    waiting = running(queue, ["folder", "low"], ["kind", "at"], "place").where("kind = 1").select("doc", "folder", "low", (F.col("place") - 1).alias("v"))
    form = r"(?s)^(.*)_([1-9]\d{0,8})$"
    ended = names.where(F.col("low").rlike(form)).distinct()
    numbers = ended.select("folder", F.regexp_extract("low", form, 1).alias("low"), F.regexp_extract("low", form, 2).cast("long").alias("b"))
    blocked = running(numbers, ["folder", "low"], ["b"], "i").select("folder", "low", (F.col("b") - F.col("i") + 1).alias("v"))
    points = waiting.withColumn("kind", F.lit(1)).unionByName(blocked.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    swept = running(points, ["folder", "low"], ["v", "kind"], "below", 1 - F.col("kind")).where("kind = 1")
    name = F.when(F.col("v") == 0, F.col("doc.base")).otherwise(F.concat(F.col("doc.base"), F.lit("_"), (F.col("v") + F.col("below")).cast("string")))
    return swept.select("doc.*", name.alias("name"))


def completed_fields(fields: Column, registry: dict, type_: str) -> Column:
    """All expected fields of a type, in order, absent ones null."""
    return F.array(*(F.struct(F.lit(f).alias("field"), F.try_element_at(fields, F.lit(f)).alias("value")) for f in expected_fields(registry, type_)))


def unknown_fields(fields: Column, registry: dict, type_: str) -> Column:
    return F.array_sort(F.array_except(F.map_keys(fields), F.array(*map(F.lit, expected_fields(registry, type_)))))


def record_problems(docs: DataFrame) -> DataFrame:
    """``docs`` (type, source, confidence, needs_review, checked_by_human) with problems of the output record."""
    rules = {
        "type": ~F.coalesce(F.col("type").rlike(f"^{fixed.CATEGORY_NAME}$"), F.lit(False)),
        "source": F.coalesce(F.col("source"), F.lit("")) == "",
        "confidence": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "review": (F.col("confidence") < fixed.AUTO_FILE_CONFIDENCE) & ~F.col("needs_review") & ~F.col("checked_by_human"),
    }
    return docs.withColumn("problems", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items()))))


def amount_text(amount: Column) -> Column:
    """An amount as it is written out: two decimals, half up."""
    return F.round(amount, 2).cast("decimal(18,2)")


def output_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "pretty": "true"})


def write_filed(docs: DataFrame, path: str) -> None:
    """Output records by folder; the committer makes the write all or nothing."""
    docs.write.mode("append").partitionBy("folder").json(path)


def deposited(copies: DataFrame) -> DataFrame:
    """``copies`` (length, sha, copy_length, copy_sha) with ok: the copy is there and has the original's size and content.
    Only documents whose every copy is ok may leave the inbox."""
    same = (F.col("length") == F.col("copy_length")) & (F.col("sha") == F.col("copy_sha"))
    return copies.withColumn("ok", F.coalesce(same, F.lit(False)))


def review_pages(ocr: Column) -> Column:
    """The OCR pages of a document, by number, as they go into a review record."""
    return F.array_sort(F.transform(F.map_entries(ocr), lambda e: F.struct(e["key"].alias("page"), e["value"]["status"].alias("status"), e["value"]["lines"].alias("lines"))))


def review_records(docs: DataFrame, at: Column) -> DataFrame:
    """The records of ``docs`` that go to review (source, type, confidence, fields, text, reason, alerts, unreadable): the
    keys of a filed record, then raison, alertes and categorie_proposee. An unreadable document has the same keys with
    nothing in them, and no text to be written beside (has_text false); null for unreadable counts as readable."""
    lost = F.coalesce("unreadable", F.lit(False))
    own = lambda c, empty: F.when(lost, empty).otherwise(F.col(c))
    return docs.select(
        own("type", None).alias("type"), "source", at.alias("date_traitement"), own("confidence", None).alias("confiance_classification"),
        own("fields", F.create_map().cast("map<string, string>")).alias("champs"), F.lit(True).alias("necessite_validation_humaine"), own("text", F.lit("")).alias("texte_brut"),
        F.col("reason").alias("raison"), F.coalesce("alerts", F.array().cast("array<string>")).alias("alertes"), own("type", None).alias("categorie_proposee"), (~lost).alias("has_text"),
    )


def field_accuracy(found: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """(field, expected, exact, missing, wrong) of found (key, field, value) against the truth of the same columns."""
    t = truth.select(key, "field", F.col("value").alias("true_value")).where("true_value is not null")
    rows = t.join(found.select(key, "field", "value"), [key, "field"], "left")
    exact = F.coalesce(F.col("value") == F.col("true_value"), F.lit(False))
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("expected"), F.count_if(exact).alias("exact"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(F.col("value").isNotNull() & ~exact).alias("wrong"))


def expired(rows: DataFrame, ts: str, now: Column, days: int = fixed.RETENTION_DAYS) -> DataFrame:
    """Rows older than the retention, strictly."""
    return rows.where(F.col(ts) < now - F.make_interval(days=F.lit(days)))


def batch_summary(docs: DataFrame, by: str = "decision") -> DataFrame:
    """Documents, pages and seconds by decision."""
    return docs.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"), F.sum("seconds").alias("seconds"))
