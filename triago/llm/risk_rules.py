"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Base measures are counted on whole texts inside one projection. Rules compare ratios of them with cutoffs; a document that
passes the base rules is turned away if any rule's ratio is above its cutoff. Cutoffs are chosen for each stratum (a band
of text lengths) by tests on labelled documents:

* Units. Copies and near copies among the labels are no independent trials. Documents with the same least hash of their
  windows of eight words are one unit, which is turned away if any of its members is.
* Tuning. A fifth of the good units, by their hash, and all poor ones put the steps (rule, cutoff) of a stratum in a row:
  those that turn away fewer good units first, loose before strict. Steps that are not the first to catch some poor unit
  are left out, as they could only cost good ones.
* Holdout. Each prefix of the row is one hypothesis, "the rules with these cutoffs together turn away a share of alpha or
  more of the good units". Its exact binomial p-value on the other good units, k of n turned away, is
  P(Binomial(n, alpha) <= k), the same as a Clopper-Pearson upper bound below alpha. Prefixes are tested in order, each at
  level delta / strata, up to the first that can't be rejected. A fixed sequence needs no further share of delta for its
  members, and Bonferroni covers the strata, so with probability 1 - delta every stratum's rules together keep the promise.

With n holdout units and none turned away a prefix passes from n = ln(delta / strata) / ln(1 - alpha) on: 203 units for the
values below. A stratum with fewer has no rules but the base ones.

Good documents are those whose labels are all 1 and that pass the base rules. Only counts for each stratum and step reach
the driver, as many for any input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triago.llm.common import SPACE_CLASS, WORD, let, table, written

WINDOW = 8
#: Strata by number of words: under 100, under 400, the rest.
BANDS = (100, 400)
#: Cutoffs of each rule, loosest first. A rule turns a document away if its ratio is above the cutoff.
GRID = {
    "symbols": (0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01, 0.005),
    "exclaims": (0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01, 0.005),
    "capitals": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "repeats": (0.28, 0.25, 0.22, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02),
    "long_words": (20.0, 15.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5),
    "short_words": (-1.5, -2.0, -2.5, -3.0, -3.25, -3.5, -3.75, -4.0, -4.25, -4.5),
}
#: Good units with this remainder of their hash tune, the others are the holdout.
TUNING = 5


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more, given the words' hashes."""
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(F.slice(hashes, i + 1, WINDOW)))

    def covered(starts: Column) -> Column:
        step = lambda acc, i: acc + F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - F.get(starts, i), F.lit(WINDOW)))
        return F.when(F.size(starts) > 0, F.aggregate(F.sequence(F.lit(0), F.size(starts) - 1), F.lit(0), step)).otherwise(F.lit(0))

    def starts(ranked: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(ranked, i)["h"] == F.get(ranked, j)["h"], F.lit(False))
        twice = lambda x, i: same(i, i - 1) | same(i, i + 1)
        return F.array_sort(F.transform(F.filter(ranked, twice), lambda x: x["at"]))

    def counted(w: Column) -> Column:
        ranked = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(ranked, lambda r: let(starts(r), covered)))

    return F.when(F.size(hashes) <= WINDOW, F.lit(0)).otherwise(let(windows, counted))


def _unit(hashes: Column) -> Column:
    """The least hash of a window of WINDOW words (of all words where there are fewer)."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - WINDOW, F.lit(0)))
    return F.array_min(F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i + 1, WINDOW))))


def measures(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word), n_exclaims, n_capitals
    (A-Z) and unit (the least hash of a window of words) of whole texts; a null text has none of them."""
    text = F.coalesce(text, F.lit(""))
    spaces = F.regexp_count(text, F.lit(rf"[{SPACE_CLASS}]"))
    hashes = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def of(hashed: Column, kept: Column) -> Column:
        return F.struct(
            F.size(hashed).cast("long").alias("n_words"),
            (F.length(text) - spaces).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
            _repeat_words(hashed).cast("long").alias("n_repeat_words"),
            F.size(kept).cast("long").alias("n_lines"),
            (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
            F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
            _unit(hashed).alias("unit"),
        )

    words = F.filter(F.split(text, rf"[{SPACE_CLASS}]+", -1), lambda w: w != "")
    return let(hashes(words), lambda h: let(lines, lambda x: of(h, x)))


def ratios() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / chars,
        "exclaims": F.col("n_exclaims") / chars,
        "capitals": F.col("n_capitals") / chars,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
        "short_words": -F.col("word_chars") / words,
    }


def stratum() -> Column:
    band = F.lit(len(BANDS))
    for i, most in reversed(list(enumerate(BANDS))):
        band = F.when(F.col("n_words") < most, F.lit(i)).otherwise(band)
    return band


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed downwards from its largest term until terms no longer matter."""
    if k >= n:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    if k > n * p:  # the other side is the smaller one
        total, i = 0.0, k + 1
        term *= (n - k) / (k + 1) * p / (1 - p)
        while i <= n and term > total * 1e-17:
            total += term
            term *= (n - i) / (i + 1) * p / (1 - p)
            i += 1
        return 1.0 - total
    total, i = 0.0, k
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i / (n - i + 1) * (1 - p) / p
        i -= 1
    return min(1.0, total)


def units(labelled: DataFrame) -> DataFrame:
    """(stratum, unit, good, tuning and the greatest ratio of each rule) of measured rows with ``good``."""
    greatest = (F.max(column).alias(rule) for rule, column in ratios().items())
    return labelled.groupBy(stratum().alias("stratum"), "unit", "good").agg(*greatest).withColumn("tuning", F.pmod("unit", F.lit(TUNING)) == 0)


def steps(tuning: dict[bool, dict]) -> list[tuple[str, float]]:
    """The row of (rule, cutoff) of a stratum. ``tuning`` has the counts of good and of poor units that each step turns
    away, by (rule, place in the rule's grid)."""
    out, lost, caught = [], tuning.get(True, {}), tuning.get(False, {})
    for rule, grid in GRID.items():
        before = 0
        for i, cutoff in enumerate(grid):
            if (now := caught.get((rule, i), 0)) > before:
                out.append((lost.get((rule, i), 0), i / len(grid), rule, cutoff))
                before = now
    return [(rule, cutoff) for *_, rule, cutoff in sorted(out)]


def first_step(row: list[tuple[str, float]]) -> Column:
    """The first step of a row that turns a unit away, null if none does."""
    return F.least(*(F.when(F.col(rule) > cutoff, F.lit(i)) for i, (rule, cutoff) in enumerate(row)), F.lit(None).cast("int"), F.lit(None).cast("int"))


def first_counts(known: DataFrame, rows: dict[int, list[tuple[str, float]]]) -> dict[int, dict[int | None, int]]:
    """Units by stratum and the first step that turns them away: a number for each step of each band."""
    first, out = F.coalesce(*(F.when(F.col("stratum") == band, first_step(row)) for band, row in sorted(rows.items()))), {}
    for r in known.groupBy("stratum", first.alias("first")).count().collect():
        out.setdefault(r["stratum"], {})[r["first"]] = r["count"]
    return out


def passed(lost: dict[int | None, int], row: list[tuple[str, float]], alpha: float, level: float) -> int:
    """How many steps of a row are admissible, given the good holdout units by the first step that turns them away."""
    n, k = sum(lost.values()), 0
    for i in range(len(row)):
        k += lost.get(i, 0)
        if not n or binomial_tail(k, n, alpha) > level:
            return i
    return len(row)


def cutoffs(labelled: DataFrame, alpha: float, delta: float) -> dict[tuple[int, str], float]:
    """The strictest admissible cutoff of each (stratum, rule); those without one are missing. ``labelled`` holds measured
    rows that pass the base rules, with ``good``."""
    known = written(units(labelled))
    sums = [F.count_if(F.col(rule) > c).alias(f"{rule}_{i}") for rule, grid in GRID.items() for i, c in enumerate(grid)]
    counted = known.where("tuning or not good").groupBy("stratum", "good").agg(*sums).collect()  # two rows for each band
    seen: dict[int, dict] = {}
    for r in counted:
        seen.setdefault(r["stratum"], {})[r["good"]] = {(rule, i): r[f"{rule}_{i}"] for rule, grid in GRID.items() for i in range(len(grid))}
    rows = {band: row for band, tuning in seen.items() if (row := steps(tuning))}
    if not rows:
        return {}
    caught = first_counts(known.where("not good"), rows)
    rows = {band: [step for i, step in enumerate(row) if caught.get(band, {}).get(i)] for band, row in rows.items()}
    lost = first_counts(known.where("good and not tuning"), rows)
    out = {}
    for band, row in rows.items():
        for rule, cutoff in row[: passed(lost.get(band, {}), row, alpha, delta / (len(BANDS) + 1))]:
            out[band, rule] = min(cutoff, out.get((band, rule), cutoff))
    return out


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """doc_id, the base measures, base_failed, rejected_by (names of rules) and kept of each row of (doc_id, text).

    labels: (doc_id, quality); null labels are ignored, a document with different labels is neither good nor poor. A null
    or blank text has no words and fails the base rules. Repeated rows each get a row and are one unit of a test. An empty
    table gives an empty result; with too few labels all rules but the base ones are off. Other columns are not read.
    """
    base = written(docs.select("doc_id", measures(F.col("text")).alias("m")).select("doc_id", "m.*"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    base = base.withColumn("base_failed", failed)
    marked = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most")).where("least = most")
    labelled = base.where("not base_failed").join(marked.select("doc_id", (F.col("least") == 1).alias("good")), "doc_id")
    chosen = cutoffs(labelled, alpha, delta)
    hits = [F.when((stratum() == band) & (ratios()[rule] > c), F.lit(rule)) for (band, rule), c in sorted(chosen.items())]
    rejected = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return base.withColumn("rejected_by", rejected).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def op5_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each documents row; see ``judge``. Null and empty texts have no word and fail the base rules, repeated rows are
    judged alike, without labels only the base rules count, an empty table gives an empty result; other columns are not read."""
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
