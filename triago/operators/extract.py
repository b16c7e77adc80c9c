"""Labelled fields from the lines of documents, with the line, page and confidence that each value comes from.

One pattern of all labels picks lines out of a document; these alone are exploded, once for each field with a label in them and
with the next four lines, and each row is read by the patterns of its own field. Patterns are known when the plan is made, so the
only exchange is that of the candidates found, a few rows for each document, by document.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triago import fixed
from triago.functions.text import fold_line, java, let, lines_of, stripped
from triago.functions.values import DECIMAL, amount_value, date_value, totals_check
from triago.operators.registry import expected_fields, tolerant

LINE = "struct<text: string, conf: double, page: int>"
AHEAD = 4


def text_lines(text: Column) -> Column:
    """The lines of a text without pages."""
    return F.transform(lines_of(text), lambda x: F.struct(x.alias("text"), F.lit(None).cast("double").alias("conf"), F.lit(None).cast("int").alias("page")))


def raw_value(setting: dict, text: Column, alone: bool) -> Column:
    """What a text holds of a field, as written: null if nothing fits; ``alone``: the text must hold nothing else. Values
    of the types text and digits are final, dates and amounts are read later."""
    if setting.get("ignore"):
        text = F.regexp_replace(text, java(setting["ignore"]), " ")
    if setting["type"] == "date":
        return F.when(F.length(stripped(text)) <= fixed.NEXT_LINE_DATE_CHARS, text) if alone else text
    if setting["type"] == "amount":
        a, b, after = fixed.AMOUNT_GROUPED, fixed.AMOUNT_PLAIN, fixed.CURRENCY_AFTER
        if alone:
            return F.nullif(F.regexp_extract(text, rf"(?iU)^\s*((?:{a}|{b})(?!\d))\s*{after}?\.?\s*\z", 1), F.lit(""))
        # the first number that has decimals or a currency after it; the atomic group keeps it whole
        return F.nullif(F.regexp_extract(text, rf"(?iU)(?<![\w.,])(?>{a}(?!\d)|{b}(?!\d))(?:(?<=[.,]\d{{1,2}})|(?=\s*{after}\b))", 0), F.lit(""))
    raw = F.regexp_extract(text, java(rf"^\s*[:\-]?\s*({setting['value']})\s*\z"), 1) if alone else F.regexp_extract(text, java(setting["value"]), 0)
    if setting["type"] == "digits":
        return let(F.regexp_replace(raw, java(r"\D"), ""), lambda d: F.when(F.length(d) == setting["length"], d))
    clean = F.upper(F.regexp_replace(raw, java(r"\s"), "")) if setting.get("no_spaces") else stripped(raw)
    return let(clean, lambda v: F.when(v.rlike(java(r"\d")), v))


def labels_of(settings: dict, known: list[str]) -> list[tuple[str, int, str]]:
    """(field, place, pattern) of all labels; its index in this list is a label's code."""
    return [(f, i, tolerant(x)) for f in known for i, x in enumerate(settings[f]["labels"])]


def any_of(patterns: list[str]) -> str:
    """One pattern for all; a word boundary that many begin with is looked for once."""

    def split(p: str) -> bool:
        while (inner := re.sub(r"\[[^\]]*\]|\([^()]*\)", "", p)) != p:
            p = inner
        return "|" in p

    at_word = [p[2:] for p in patterns if p.startswith(r"\b") and not split(p)]
    other = [p for p in patterns if not p.startswith(r"\b") or split(p)]
    ways = ([r"\b(?:" + "|".join(f"(?:{p})" for p in at_word) + ")"] if at_word else []) + [f"(?:{p})" for p in other]
    return "|".join(ways)


def labelled(docs: DataFrame, key: str, type_: str, lines: str, registry: dict, settings: dict, known: list[str]) -> DataFrame:
    """key, type, line, text, conf, page, norm, after and code: one row for each line and field that the type expects whose label
    occurs in it. The first label of a field's list that occurs counts. One pattern of all labels picks the lines; only they
    are tested for each label, get the lines after them, and become rows."""
    labels = labels_of(settings, known)
    some = java(any_of([p for _, _, p in labels]))
    types = [c["name"] for c in registry["categories"]]
    flags = lambda t: F.array(*(F.lit(f in expected_fields(registry, t)) for f in known))
    wanted = F.coalesce(F.try_element_at(F.create_map(*(x for t in types for x in (F.lit(t), flags(t)))), F.col(type_)), flags(None))
    fits = lambda patterns: F.col("norm").rlike(java(any_of(patterns)))
    hits = []
    for i, f in enumerate(known):
        own = [(code, p) for code, (name, _, p) in enumerate(labels) if name == f]
        which = F.lit(own[-1][0])
        for code, pattern in reversed(own[:-1]):
            which = F.when(fits([pattern]), F.lit(code)).otherwise(which)
        hits.append(F.when(F.get("wanted", F.lit(i)) & fits([p for _, p in own]), which))
    codes = F.array_compact(F.array(*hits))
    near = F.transform(F.col(lines), lambda x, i: F.struct(x["text"].alias("text"), x["conf"].alias("conf"), x["page"].alias("page"), F.slice(F.col(lines), i + 2, AHEAD).alias("after")))
    rows = docs.select(F.col(key).alias("key"), F.col(type_).alias("type"), wanted.alias("wanted"), F.posexplode(near).alias("line", "at")).select("key", "type", "wanted", "line", "at.*")
    rows = rows.withColumn("norm", fold_line(F.col("text"))).where(F.col("norm").rlike(some))
    return rows.select("key", "type", "line", "text", "conf", "page", "norm", "after", F.explode(codes).alias("code"))


def written_values(rows: DataFrame, settings: dict, known: list[str]) -> tuple[DataFrame, Column, Column]:
    """key, type, field, kind, label, line, more, page, conf and beside of ``labelled`` rows: what is written after the label. With
    them what is written below it and its confidence, over ``more`` lines, as columns to be worked out where beside gives no
    value. Of all fields' patterns only those of a row's own field are tried."""
    labels = labels_of(settings, known)
    code, more, after = F.col("code"), F.col("more"), F.col("after")
    alike: dict[str, list[int]] = {}  # fields whose values are written alike share their patterns
    for i, (f, _, _) in enumerate(labels):
        alike.setdefault(repr({k: v for k, v in settings[f].items() if k not in ("labels", "choice")}), []).append(i)
    kinds = [(code.isin(codes), settings[labels[codes[0]][0]]) for codes in alike.values()]

    def by_kind(make: Callable[[dict], Column | None], other: Column | None = None) -> Column:
        out = F
        for own, setting in kinds:
            if (value := make(setting)) is not None:
                out = out.when(own, value)
        return (other if other is not None else F.lit(None)) if out is F else out.otherwise(other)

    def digit_lines(most: int) -> Column:
        """How many of the lines right below hold digits and separators only."""
        fits = lambda y: y["text"].rlike(java(rf"^{fixed.DIGIT_LINE}\z"))
        count = lambda acc, y: F.struct((acc["n"] + (acc["on"] & fits(y)).cast("int")).alias("n"), (acc["on"] & fits(y)).alias("on"))
        return F.aggregate(F.slice(after, 1, most), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), count)["n"]

    end = F
    for i, (_, _, pattern) in enumerate(labels):
        end = end.when(code == i, F.length(F.regexp_extract("norm", f"(?sU)^(.*?)(?:{pattern})", 0)))
    rows = rows.withColumn("end", end).withColumn("rest", F.substring(F.col("text"), F.col("end") + 1, F.length("text")))
    rows = rows.withColumn("more", by_kind(lambda s: digit_lines(s["more_lines"]) if s.get("more_lines") else None, F.least(F.size(after), F.lit(1))))
    used = F.concat(F.array("conf"), F.transform(F.slice(after, F.lit(1), more), lambda y: y["conf"]))
    whole = F.array_join(F.concat(F.array("rest"), F.transform(F.slice(after, F.lit(1), more), lambda y: y["text"])), " ")
    below = by_kind(lambda s: F.when(more > 0, raw_value(s, whole, False)) if s.get("more_lines") else raw_value(s, F.get(after, F.lit(0))["text"], True))
    named = lambda values: F.element_at(F.array(*map(F.lit, values)), code + 1)
    rows = rows.select(
        "key", "type", named([f for f, _, _ in labels]).alias("field"), named([settings[f]["type"] for f, _, _ in labels]).alias("kind"), named([i for _, i, _ in labels]).alias("label"),
        "line", "more", "page", "conf", by_kind(lambda s: raw_value(s, F.col("rest"), False)).alias("beside"), "code", "rest", "after",
    )
    return rows, below, F.array_min(used)


def read_values(found: DataFrame, below: Column, conf_below: Column, ref_year: int) -> DataFrame:
    """``written_values`` rows with value, amount, alerts, value_line and conf. What stands beside the label is read first and,
    if that gives no value, what stands below it."""
    none, no_alerts = F.lit(None).cast(DECIMAL), F.array().cast("array<string>")

    def read(raw: Column) -> Column:
        date, amount = date_value(raw, ref_year), amount_value(raw)
        return (
            F.when(F.col("kind") == "date", let(date, lambda d: F.struct(d["value"].alias("value"), none.alias("amount"), d["alerts"].alias("alerts"))))
            .when(F.col("kind") == "amount", let(amount, lambda m: F.struct(m["value"].cast("string").alias("value"), m["value"].alias("amount"), F.array_compact(F.array(m["alert"])).alias("alerts"))))
            .otherwise(F.struct(raw.alias("value"), none.alias("amount"), no_alerts.alias("alerts")))
        )

    # a projection each: the second holds the expressions of the lines below and works them out for few rows
    rows = found.withColumn("first", let(F.col("beside"), read))
    rows = rows.withColumn("second", F.when(F.col("first.value").isNull(), let(below, read)))
    is_below = F.col("second.value").isNotNull()
    return rows.select(
        *(c for c in found.columns if c not in ("kind", "more", "conf", "beside", "code", "rest", "after")), (F.col("line") + F.when(is_below, F.col("more")).otherwise(0)).alias("value_line"),
        F.when(is_below, conf_below).otherwise(F.col("conf")).alias("conf"), F.coalesce("first.value", "second.value").alias("value"), F.coalesce("first.amount", "second.amount").alias("amount"),
        F.concat("first.alerts", F.coalesce("second.alerts", no_alerts)).alias("alerts"),
    )


def candidates(docs: DataFrame, key: str, type_: str, lines: str, registry: dict, settings: dict, ref_year: int) -> DataFrame:
    """(key, type, candidate fields) of every line and expected field with a label."""
    types = [c["name"] for c in registry["categories"]]
    known = [f for f in settings if any(f in expected_fields(registry, t) for t in (*types, None))]
    rows, below, conf_below = written_values(labelled(docs, key, type_, lines, registry, settings, known), settings, known)
    return read_values(rows, below, conf_below, ref_year).withColumnRenamed("key", key)


def chosen(found: DataFrame, key: str, settings: dict) -> DataFrame:
    """One row for each document and field with a label: the value chosen (null if none), its label, line, page,
    confidence, the number of candidates, the summed amounts and the alerts."""
    rows = found.groupBy(key, "type", "field").agg(F.array_sort(F.collect_list(F.struct("line", "value_line", "label", "page", "conf", "value", "amount", "alerts"))).alias("all"))
    last = F.col("field").isin(*(f for f, s in settings.items() if s.get("choice") == "last"))
    summed = F.col("field").isin(*(f for f, s in settings.items() if s.get("choice") == "sum"))
    with_value = F.filter("all", lambda x: x["value"].isNotNull())
    rows = rows.withColumn("with_value", with_value)
    best = F.array_min(F.transform("with_value", lambda x: x["label"]))
    rows = rows.withColumn("best", best).withColumn("group", F.filter("with_value", lambda x: x["label"] == F.col("best")))
    group = F.col("group")
    own = F.filter(group, lambda x, i: ~F.exists(F.slice(group, i + 2, F.size(group)), lambda y: y["value_line"] == x["value_line"]))
    rows = rows.withColumn("own", own)
    total = F.aggregate("own", F.lit(0).cast(DECIMAL), lambda acc, x: (acc + x["amount"]).cast(DECIMAL))
    one = F.when(last | summed, F.try_element_at(group, F.lit(-1))).otherwise(F.get(group, F.lit(0)))
    rows = rows.withColumn("one", one)
    missing = F.flatten(F.transform(F.filter("all", lambda x: x["value"].isNull()), lambda x: x["alerts"]))
    rows = rows.withColumn("conf", F.when(summed, F.array_min(F.transform("own", lambda x: x["conf"]))).otherwise(F.col("one.conf")))
    rule = F.when(last, "dernier").otherwise("premier")
    differ = ~summed & (F.size(F.array_distinct(F.transform(group, lambda x: x["value"]))) > 1)
    low = F.coalesce(F.col("conf") < fixed.OCR_LINE, F.lit(False))
    prefix = F.concat(F.col("field"), F.lit(" : "))
    alerts = F.concat(
        F.transform(missing, lambda a: F.concat(prefix, a)),
        F.array_compact(F.array(
            F.when(differ, F.concat(prefix, F.size(group).cast("string"), F.lit(" valeurs candidates differentes, retenue selon la regle « "), rule, F.lit(" »"))),
            F.when(low, F.concat(prefix, F.format_string("ligne OCR peu sure (confiance %.2f)", "conf"))),
        )),
    )
    has = F.size("group") > 0
    amount = F.when(has, F.when(summed, total).otherwise(F.col("one.amount")))
    return rows.select(
        key, "type", "field", F.when(summed & has, total.cast("string")).otherwise(F.col("one.value")).alias("value"), amount.alias("amount"),
        F.col("best").alias("label"), F.col("one.value_line").alias("line"), F.when(summed, F.get(group, F.lit(0))["page"]).otherwise(F.col("one.page")).alias("page"), "conf",
        F.size("with_value").alias("n_candidates"), F.when(summed & (F.size("own") > 1), F.transform("own", lambda x: x["amount"])).alias("detail"), low.alias("low"), alerts.alias("alerts"),
    )


def extracted(docs: DataFrame, registry: dict, ref_year: int, key: str = "doc_id", type_: str = "type", lines: str = "lines", settings: dict = fixed.FIELDS) -> DataFrame:
    """The table of ``chosen`` fields of ``docs`` (key, type, lines: array of struct(text, conf, page)). Documents without
    a label give no row; key must tell documents apart; ``ref_year`` stands for the year of the run."""
    return chosen(candidates(docs, key, type_, lines, registry, settings, ref_year), key, settings)


def document_results(docs: DataFrame, fields: DataFrame, registry: dict, key: str = "doc_id", type_: str = "type", carried: tuple[str, ...] = ()) -> DataFrame:
    """key, type, the carried columns, fields (map of values), totals, alerts and needs_review of every document, also
    without fields.

    Totals are checked for types that expect all three amounts. Alerts follow the order of the type's fields.
    """
    types = [c["name"] for c in registry["categories"]]
    place = F.create_map(*(x for t in types for i, f in enumerate(expected_fields(registry, t)) for x in (F.lit(f"{t}/{f}"), F.lit(i))))
    generic = F.create_map(*(x for i, f in enumerate(expected_fields(registry, None)) for x in (F.lit(f), F.lit(i))))
    order = F.coalesce(F.try_element_at(place, F.concat_ws("/", "type", "field")), F.try_element_at(generic, F.col("field")))
    rows = fields.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("place"), "field", "value", "amount", "detail", "low", "alerts"))).alias("rows"))
    whole = docs.select(key, F.col(type_).alias("type"), *carried).join(rows, key, "left").withColumn("rows", F.coalesce("rows", F.array().cast(rows.schema["rows"].dataType)))
    kept = F.filter("rows", lambda r: r["value"].isNotNull())
    amount = lambda name: F.get(F.filter("rows", lambda r: r["field"] == name), F.lit(0))["amount"]
    totalled = F.col("type").isin(*(t for t in types if set(fixed.TOTAL_FIELDS) <= set(expected_fields(registry, t))))
    taxes = F.array_compact(F.array(amount("tva")))
    whole = whole.withColumn("totals", F.when(totalled, totals_check(amount("montant_ht"), taxes, amount("montant_ttc"))))
    alerts = F.concat(F.flatten(F.transform("rows", lambda r: r["alerts"])), F.coalesce(F.col("totals.alerts"), F.array().cast("array<string>")))
    review = F.exists("rows", lambda r: r["low"]) | F.coalesce(F.col("totals.review"), F.lit(False))
    return whole.select(key, "type", *carried, F.map_from_arrays(F.transform(kept, lambda r: r["field"]), F.transform(kept, lambda r: r["value"])).alias("fields"), "totals", alerts.alias("alerts"), review.alias("needs_review"))
