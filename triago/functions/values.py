"""Dates, amounts and totals as written, normalised. Every function gives its value and its alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triago import fixed
from triago.functions.text import fold, java, let, stripped

DECIMAL = "decimal(38,6)"
ARABIC_DIGITS, DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(java(r"\S"))


def _alerts(*flags: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(flag, F.lit(message)) for flag, message in flags)))


def date_value(text: Column, ref_year: int) -> Column:
    """struct(value: ISO text or null, alerts). ISO dates win; else day-month-year in digits and in words are pooled.
    Two different dates as written give none. ``ref_year`` places two-digit years and bounds the rest."""
    none = F.struct(F.lit(None).cast("string").alias("value"), F.array().cast("array<string>").alias("alerts"))
    months = F.create_map(*(F.lit(x) for pair in fixed.MONTHS.items() for x in pair))

    def found(t: Column, pattern: str, day: int, month: int, year: int, words: bool = False) -> Column:
        def one(m: Column) -> Column:
            part = lambda i: F.regexp_extract(m, pattern, i)
            named = F.try_element_at(months, part(month)).cast("string") if words else part(month)
            return F.struct(part(day).alias("d"), named.alias("m"), part(year).alias("y"))

        return F.filter(F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), one), lambda x: x["m"].isNotNull())

    def read(c: Column) -> Column:
        short = F.length(c["y"]) == 2
        y = c["y"].cast("int")
        year = F.when(short, F.when(y + 2000 <= ref_year + 1, y + 2000).otherwise(y + 1900)).otherwise(y)
        inside = (year >= 1900) & (year <= ref_year + 50)
        day = F.try_to_timestamp(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(c["m"], 2, "0"), F.lpad(c["d"], 2, "0")), F.lit("yyyy-MM-dd"))
        value = F.when(inside, F.date_format(day, "yyyy-MM-dd"))
        return F.struct(value.alias("value"), _alerts((short, fixed.SHORT_YEAR), (~inside, fixed.YEAR_RANGE), (inside & day.isNull(), fixed.NO_DAY)).alias("alerts"))

    def pick(all_: Column) -> Column:
        alert = lambda message: F.struct(F.lit(None).cast("string").alias("value"), F.array(F.lit(message)).alias("alerts"))
        return F.when(F.size(all_) == 0, alert(fixed.NO_DATE)).when(F.size(all_) > 1, alert(fixed.MANY_DATES)).otherwise(read(all_[0]))

    def parse(t: Column) -> Column:
        iso = found(t, fixed.DATE_ISO, 3, 2, 1)
        rest = F.concat(found(t, fixed.DATE_DIGITS, 1, 2, 3), found(t, java(fixed.DATE_WORDS), 1, 2, 3, True))
        return let(F.array_distinct(F.when(F.size(iso) > 0, iso).otherwise(rest)), pick)

    return F.when(blank(text), none).otherwise(let(F.translate(fold(text), ARABIC_DIGITS, DIGITS), parse))


def amount_value(text: Column) -> Column:
    """struct(value: exact decimal or null, alert or null). The last separator is the decimal one where both occur; one
    separator before exactly three digits is ambiguous."""

    def result(number: Column | None, alert: str | None) -> Column:
        value = F.lit(None).cast(DECIMAL) if number is None else number.try_cast(DECIMAL)
        return F.struct(value.alias("value"), F.lit(alert).cast("string").alias("alert"))

    def count(t: Column, sign: str) -> Column:
        return F.length(t) - F.length(F.replace(t, F.lit(sign), F.lit("")))

    def grouped(whole: Column, sign: str) -> Column:
        return whole.rlike(rf"^\d{{1,3}}(?:\{sign}\d{{3}})*$")

    def both(t: Column, sign: Column, dec: str, group: str) -> Column:
        whole, rest = F.substring_index(t, dec, 1), F.substring_index(t, dec, -1)
        number = F.concat(sign, F.replace(whole, F.lit(group), F.lit("")), F.lit("."), rest)
        return F.when((count(t, dec) > 1) | ~grouped(whole, group), result(None, fixed.MIXED_SEPARATORS)).otherwise(result(number, None))

    def single(t: Column, sign: Column, sep: str) -> Column:
        tail = F.substring_index(t, sep, -1)
        many = F.when(grouped(t, sep), result(F.concat(sign, F.replace(t, F.lit(sep), F.lit(""))), None)).otherwise(result(None, fixed.MIXED_SEPARATORS))
        return F.when(count(t, sep) > 1, many).when(F.length(tail) == 3, result(None, fixed.AMBIGUOUS)).otherwise(result(F.concat(sign, F.replace(t, F.lit(sep), F.lit("."))), None))

    def body(p: Column) -> Column:
        t, sign = p["t"], p["sign"]
        commas, points = count(t, ","), count(t, ".")
        comma_last = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
        return (
            F.when(~t.rlike(r"^\d[\d.,]*\z") | t.rlike(r"[.,]\z"), result(None, fixed.NO_AMOUNT))
            .when((commas > 0) & (points > 0), F.when(comma_last, both(t, sign, ",", ".")).otherwise(both(t, sign, ".", ",")))
            .when(commas > 0, single(t, sign, ","))
            .when(points > 0, single(t, sign, "."))
            .otherwise(result(F.concat(sign, t), None))
        )

    def parse(t: Column) -> Column:
        bad = F.regexp_replace(t, r"^[- ]+", "").rlike(r" (?!\d{3}(?!\d))")
        tight = F.replace(t, F.lit(" "), F.lit(""))
        minus = tight.startswith("-")
        split = F.struct(F.when(minus, F.substring(tight, F.lit(2), F.length(tight))).otherwise(tight).alias("t"), F.when(minus, "-").otherwise("").alias("sign"))
        return F.when(bad, result(None, fixed.NO_AMOUNT)).otherwise(let(split, body))

    spaced = stripped(F.regexp_replace(F.translate(text, ARABIC_DIGITS, DIGITS), java(r"\s+"), " "))
    bare = stripped(F.regexp_replace(spaced, rf"(?iU)^\s*{fixed.CURRENCY}\s*|\s*{fixed.CURRENCY}\s*$", ""))
    return F.when(blank(text), result(None, None)).otherwise(let(bare, parse))


def totals_check(net: Column, taxes: Column, gross: Column, unreadable_tax: Column | None = None) -> Column:
    """struct(ok, gap, review, status, alerts) of net + sum(taxes) against gross, all decimals; taxes is an array."""
    missing = net.isNull() | gross.isNull()
    bad = F.lit(False) if unreadable_tax is None else unreadable_tax
    lines = F.filter(F.coalesce(taxes, F.array().cast(f"array<{DECIMAL}>")), lambda x: x.isNotNull())
    total = F.aggregate(lines, F.lit(0).cast(DECIMAL), lambda acc, x: (acc + x).cast(DECIMAL))
    gap = F.when(~missing & ~bad, (net + total - gross).cast(DECIMAL))
    ok = F.coalesce(F.abs(gap) <= F.lit(fixed.TOLERANCE).cast("decimal(4,2)"), F.lit(False))
    untaxed = F.size(lines) == 0
    gap_text = F.concat(F.lit(" (ecart de "), F.round(gap, 2).cast("decimal(38,2)").cast("string"), F.lit(")"))
    alert = (
        F.when(missing, fixed.TOTALS_MISSING).when(bad, fixed.TOTALS_TAX).when(ok & untaxed, fixed.TOTALS_NO_TAX)
        .when(~ok & untaxed, F.concat(F.lit(fixed.TOTALS_NO_TAX_GAP), gap_text)).when(~ok, F.concat(F.lit(fixed.TOTALS_GAP), gap_text))
    )
    status = F.when(ok, "ok").when(gap.isNotNull(), "gap").otherwise("missing")
    return F.struct(ok.alias("ok"), gap.alias("gap"), (~ok).alias("review"), status.alias("status"), F.array_compact(F.array(alert)).alias("alerts"))
