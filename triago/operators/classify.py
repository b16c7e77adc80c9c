"""Classification by keywords, business rules and an engine's reply. All of it is column expressions: the registry is
unrolled into literal patterns, so a plan has no join and no exchange."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triago import fixed
from triago.functions.naming import proposed_name
from triago.functions.text import arabic_share, fold, java, let, title_zone
from triago.operators.registry import literal_in

CLEAR, WEAK, TIE, NONE, RULE = "clear", "weak", "tie", "none", "business_rule"
REPLY = "struct<ok: boolean, category: string, proposed: string, near: string, error: string>"


def folded_pair(text: Column) -> Column:
    """struct(all, title): the folded text and its folded title zone, which everything below searches."""
    return F.struct(fold(F.coalesce(text, F.lit(""))).alias("all"), fold(title_zone(text)).alias("title"))


def occurs(t: Column, pattern: str) -> Column:
    """Whether a pattern occurs in a folded text; looked for only where the string that its matches hold is there."""
    found, literal = t.rlike(java(pattern)), literal_in(pattern)
    return F.contains(t, F.lit(literal)) & found if literal else found


def folded_scores(t: Column, registry: dict) -> Column:
    hits = ((F.lit(c["name"]), reduce(lambda a, b: a + b, (occurs(t, k).cast("int") for k in c["keywords"]), F.lit(0))) for c in registry["categories"])
    return F.create_map(*(x for pair in hits for x in pair))


def scores(text: Column, registry: dict) -> Column:
    """A map of category to the number of its patterns that occur in the folded text, zeros included."""
    return let(fold(F.coalesce(text, F.lit(""))), lambda t: folded_scores(t, registry))


def verdict(found: Column, in_title: Column, registry: dict) -> Column:
    """struct(category, verdict). Equal scores keep the registry's order."""
    ranked = F.array_sort(F.array(*(F.struct((-found[c["name"]]).alias("minus"), F.lit(i).alias("place"), F.lit(c["name"]).alias("name")) for i, c in enumerate(registry["categories"]))))

    def decide(r: Column) -> Column:
        first, second = -r[0]["minus"], -F.coalesce(F.get(r, F.lit(1))["minus"], F.lit(0))
        out = lambda name, v: F.struct(name.alias("category"), F.lit(v).alias("verdict"))
        name, nothing = r[0]["name"], F.lit(None).cast("string")
        sure = (first >= 2) & (second == 0)
        return F.when(first == 0, out(nothing, NONE)).when(sure & (in_title[name] > 0), out(name, CLEAR)).when(first > second, out(name, WEAK)).otherwise(out(nothing, TIE))

    return let(ranked, decide)


def folded_rule(t: Column, registry: dict) -> Column:
    """struct(category, description) of the first rule whose patterns all occur in a folded text, else null."""
    out = F.lit(None).cast("struct<category: string, description: string>")
    for r in reversed(registry["rules"]):
        every = reduce(lambda a, b: a & b, (occurs(t, p) for p in r["patterns"]))
        out = F.when(every, F.struct(F.lit(r["category"]).alias("category"), F.lit(r["description"]).alias("description"))).otherwise(out)
    return out


def folded_subfolders(pair: Column, registry: dict) -> Column:
    """A map of each category with subfolders to the one of a document: the only one that the title zone names, or if it
    names none the only one of the whole text; else the one for others."""

    def named(t: Column, own: dict) -> Column:
        hits = (F.when(reduce(lambda a, b: a | b, (occurs(t, k) for k in s["keywords"])), F.lit(s["name"])) for s in own["subfolders"] if s["keywords"])
        return F.array_compact(F.array(*hits))

    def only(names: Column) -> Column:
        return F.when(F.size(names) == 1, names[0]).otherwise(fixed.OTHER_FOLDER)

    def choice(own: dict) -> Column:
        return let(named(pair["title"], own), lambda a: F.when(F.size(a) > 0, only(a)).otherwise(only(named(pair["all"], own))))

    own = [c for c in registry["categories"] if any(s["keywords"] for s in c["subfolders"])]
    return F.create_map(*(x for c in own for x in (F.lit(c["name"]), choice(c)))) if own else F.create_map().cast("map<string, string>")


def subfolder(category: Column, text: Column, registry: dict) -> Column:
    """The subfolder of a document of a category; null for categories without subfolders."""
    return F.try_element_at(let(folded_pair(text), lambda p: folded_subfolders(p, registry)), category)


def signals(native: Column, confidences: Column) -> Column:
    """struct(arabic_share, ocr_lines, ocr_mean, ocr_below): quality of the text; they decide nothing here."""
    conf = F.coalesce(confidences, F.array().cast("array<double>"))
    mean = F.when(F.size(conf) > 0, F.round(F.aggregate(conf, F.lit(0.0), lambda a, x: a + x) / F.size(conf), 4))
    return F.struct(
        F.round(arabic_share(native), 4).alias("arabic_share"), F.size(conf).alias("ocr_lines"), mean.alias("ocr_mean"),
        F.size(F.filter(conf, lambda x: x < fixed.OCR_LINE)).alias("ocr_below"),
    )


def analysed(docs: DataFrame, registry: dict, text: str = "text", native: str | None = None, confidences: Column | None = None) -> DataFrame:
    """``docs`` with scores, title_scores, subfolders, rule_category, rule_verdict, rule_text and signals.

    A null text counts as empty. A business rule overrides the verdict of the scores.
    """
    conf = F.lit(None).cast("array<double>") if confidences is None else confidences
    # the folded text stands in a projection of its own: it is searched often and folded once
    pair = F.col("_folded")
    out = docs.withColumn("_folded", folded_pair(F.col(text))).select(
        *docs.columns, folded_scores(pair["all"], registry).alias("scores"), folded_scores(pair["title"], registry).alias("title_scores"),
        folded_rule(pair["all"], registry).alias("_rule"), folded_subfolders(pair, registry).alias("subfolders"),
    )
    out = out.withColumn("_found", verdict(F.col("scores"), F.col("title_scores"), registry))
    return out.select(
        *docs.columns, "scores", "title_scores", "subfolders",
        F.when(F.col("_rule").isNotNull(), F.col("_rule.category")).otherwise(F.col("_found.category")).alias("rule_category"),
        F.when(F.col("_rule").isNotNull(), RULE).otherwise(F.col("_found.verdict")).alias("rule_verdict"),
        F.col("_rule.description").alias("rule_text"), signals(F.col(native or text), conf).alias("signals"),
    )


def decided(docs: DataFrame, reply: Column) -> DataFrame:
    """``analysed`` rows with category, subfolder, confidence, proposed and needs_review.

    ``reply`` is a struct (ok, category, proposed, near, error); near is the known category that a proposed name
    resembles. Only a clear verdict that the engine shares, or a business rule, is sure; the signals force a review and
    leave the confidence alone.
    """
    v, mine, name = F.col("rule_verdict"), F.col("rule_category"), proposed_name(reply["proposed"])
    answered, other = F.coalesce(reply["ok"], F.lit(False)), reply["category"] == fixed.ENGINE_OTHER
    agreed = answered & F.coalesce(reply["category"] == mine, F.lit(False))
    out = docs.withColumn("category", F.when((v == RULE) | ~answered, mine).when(other & (name != "") & reply["near"].isNotNull(), reply["near"]).when(other, mine).otherwise(F.coalesce(mine, reply["category"])))
    out = out.withColumn("proposed", F.when((v != RULE) & answered & other & (name != "") & reply["near"].isNull(), name))
    out = out.withColumn("confidence", F.when((v == RULE) | ((v == CLEAR) & agreed), fixed.SURE).otherwise(fixed.DOUBTFUL))
    doubt = F.coalesce(F.col("signals.ocr_mean") < fixed.OCR_DOCUMENT_MEAN, F.lit(False)) | (F.col("signals.arabic_share") > fixed.ARABIC_SHARE)
    review = (F.col("confidence") < fixed.AUTO_FILE_CONFIDENCE) | doubt | F.col("category").isNull() | F.col("proposed").isNotNull()
    return out.withColumn("subfolder", F.try_element_at("subfolders", F.col("category"))).withColumn("needs_review", review)


def final_type() -> Column:
    """The type that the rest of the batch works with."""
    return F.coalesce("category", "proposed", F.lit(fixed.OTHER))
