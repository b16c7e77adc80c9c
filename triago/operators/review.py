"""Human review: status of filed documents, typed input, corrections as history, changes of type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triago import fixed
from triago.functions.text import java
from triago.functions.values import amount_value, blank, date_value
from triago.operators.registry import expected_fields

STATUS_ORDER = {"a_valider": 0, "a_verifier": 1, "range": 2, "valide": 3, "autres": 4}


def status(folder: Column, history: Column, needs_review: Column) -> Column:
    root = F.substring_index(folder, "/", 1)
    return (
        F.when(root == fixed.REVIEW_FOLDER, "a_valider").when(root == fixed.OTHER_FOLDER, "autres").when(F.coalesce(F.size(history) > 0, F.lit(False)), "valide")
        .when(F.coalesce(needs_review, F.lit(False)), "a_verifier").otherwise("range")
    )


def status_rank(state: Column) -> Column:
    order = F.create_map(*(F.lit(x) for pair in STATUS_ORDER.items() for x in pair))
    return F.coalesce(F.try_element_at(order, state), F.lit(9))


def listing(docs: DataFrame) -> DataFrame:
    """``docs`` (path, folder, history, needs_review) with status and rank; show them by rank, then path."""
    return docs.withColumn("status", status(F.col("folder"), F.col("history"), F.col("needs_review"))).withColumn("rank", status_rank(F.col("status")))


def typed_input(field: Column, text: Column, ref_year: int, settings: dict = fixed.FIELDS) -> Column:
    """struct(value, error) of what a human typed: blank is null, an invalid value an error that names the field only."""
    kind = F.create_map(*(F.lit(x) for n, s in settings.items() for x in (n, s["type"])))
    size = F.create_map(*(F.lit(x) for n, s in settings.items() if s.get("length") for x in (n, s["length"])))
    tight = field.isin(*(n for n, s in settings.items() if s.get("no_spaces")))
    known = F.try_element_at(kind, field)
    plain = F.trim(F.regexp_replace(text, java(r"\s+"), " "))
    digits = F.regexp_replace(text, java(r"\D"), "")
    value = (
        F.when(known == "date", date_value(text, ref_year)["value"]).when(known == "amount", amount_value(text)["value"].cast("string"))
        .when(known == "digits", F.when(F.length(digits) == F.try_element_at(size, field), digits)).when(tight, F.upper(F.regexp_replace(text, java(r"\s"), ""))).otherwise(plain)
    )
    value = F.when(~blank(text), value)
    return F.struct(value.alias("value"), F.when(~blank(text) & value.isNull(), F.concat(field, F.lit(" : invalide"))).alias("error"))


def different(old: Column, new: Column) -> Column:
    """Unequal values; numbers are compared as numbers."""
    as_number = lambda c: c.try_cast("decimal(38,6)")
    numeric = as_number(old).isNotNull() & as_number(new).isNotNull()
    return F.when(numeric, as_number(old) != as_number(new)).otherwise(~old.eqNullSafe(new))


def allowed_fields(registry: dict) -> Column:
    """The expected fields of a type, by a map from type to list."""
    types = [c["name"] for c in registry["categories"]]
    known = F.create_map(*(x for t in types for x in (F.lit(t), F.array(*map(F.lit, expected_fields(registry, t))))))
    return F.coalesce(F.try_element_at(known, F.col("new_type")), F.array(*map(F.lit, expected_fields(registry, None))))


def corrected(docs: DataFrame, corrections: DataFrame, registry: dict, ref_year: int, at: Column, key: str = "doc_id") -> DataFrame:
    """(key, new_type, fields, changes, errors) of documents (key, type, fields: map, new_type) under corrections (key,
    field, input).

    All or nothing: with an error (an unknown field, an invalid value) the fields stay and there are no changes. Changes
    hold the type, corrected fields that differ, and filled fields that the new type doesn't have.
    """
    typed = corrections.withColumn("typed", typed_input(F.col("field"), F.col("input"), ref_year))
    given = typed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "typed.value"))).alias("given"), F.array_sort(F.array_compact(F.collect_list("typed.error"))).alias("bad"))
    rows = docs.withColumn("new_type", F.coalesce("new_type", "type")).join(given, key, "left").withColumn("allowed", allowed_fields(registry))
    given_keys = F.coalesce(F.map_keys("given"), F.array().cast("array<string>"))
    unknown = F.transform(F.array_sort(F.array_except(given_keys, "allowed")), lambda f: F.concat(f, F.lit(" : champ non prevu")))
    rows = rows.withColumn("errors", F.concat(F.coalesce("bad", F.array().cast("array<string>")), unknown))
    old = lambda f: F.try_element_at("fields", f)
    new = lambda f: F.when(F.array_contains(given_keys, f), F.try_element_at("given", f)).otherwise(old(f))
    entry = lambda f, a, b: F.struct(f.alias("field"), a.alias("old"), b.alias("new"), at.alias("at"))
    own = F.transform(F.filter("allowed", lambda f: F.array_contains(given_keys, f) & different(old(f), new(f))), lambda f: entry(f, old(f), new(f)))
    lost = F.transform(F.array_sort(F.filter(F.array_except(F.map_keys("fields"), "allowed"), lambda f: old(f).isNotNull())), lambda f: entry(f, old(f), F.lit(None).cast("string")))
    moved = F.when(F.col("new_type") != F.col("type"), F.array(entry(F.lit("type"), F.col("type"), F.col("new_type")))).otherwise(F.array().cast("array<struct<field: string, old: string, new: string, at: timestamp>>"))
    ok = F.size("errors") == 0
    fields = F.map_from_arrays("allowed", F.transform("allowed", new))
    # changes come first: in one projection the names inside lambdas would mean the new fields
    rows = rows.withColumn("changes", F.when(ok, F.concat(moved, own, lost)))
    return rows.select(key, F.when(ok, F.col("new_type")).otherwise(F.col("type")).alias("new_type"), F.when(ok, fields).otherwise(F.col("fields")).alias("fields"), F.coalesce("changes", F.array().cast(rows.schema["changes"].dataType)).alias("changes"), "errors")


def rejected(docs: DataFrame) -> DataFrame:
    """Documents turned down by a human: they become of the type for others."""
    return docs.withColumn("new_type", F.lit(fixed.OTHER))


def doubtful_frames(lines: Column) -> Column:
    """How many lines with a frame a page's preview marks."""
    return F.size(F.filter(lines, lambda x: (x["conf"] < fixed.OCR_LINE) & x["frame"].isNotNull()))
