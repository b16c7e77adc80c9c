"""Language-model engines: the interface, prompts, checked replies, and grounding of what an engine says.

An engine is any object with ``reply(prompt, schema) -> dict``; it is built once in each task. Engines never see documents
that a business rule settles: their rows are split off before the Python node, as a ``when`` would not skip it.
"""

from __future__ import annotations

import difflib
import json
import time
import zlib
from collections.abc import Callable, Iterator
from string import Template
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triago import fixed
from triago.functions.text import char_budget, compare_key, fold_line, java, title_zone, truncated
from triago.operators.classify import RULE
from triago.operators.registry import category, expected_fields, tolerant

REPLY = "ok boolean, category string, proposed string, error string, seconds double, alerts array<string>"


class Engine(Protocol):
    def reply(self, prompt: str, schema: dict) -> dict:
        """A JSON object for a prompt; may raise."""


class StubEngine:
    """A deterministic stand-in for a model: it names the category that the text's checksum picks among the allowed ones,
    and proposes a name where that is the other one."""

    def reply(self, prompt: str, schema: dict) -> dict:
        text = prompt.rpartition("<<<")[2]
        out = {}
        for name, rule in schema["properties"].items():
            if "enum" in rule:
                out[name] = rule["enum"][zlib.crc32(text.encode()) % len(rule["enum"])]
            else:
                out[name] = None
        if out.get("type_document") == fixed.ENGINE_OTHER:
            out["nom_propose"] = "bulletin de paie"
        return out


class FirstLineEngine:
    """A deterministic stand-in that fills every field it is asked for with the document's first line."""

    def reply(self, prompt: str, schema: dict) -> dict:
        line = next((x for x in prompt.rpartition("<<<")[2].rpartition(">>>")[0].splitlines() if x.strip()), None)
        return {name: line for name in schema["properties"]}


ENGINES: dict[str, Callable[[], Engine]] = {"stub": StubEngine, "first_line": FirstLineEngine}


def make_engine(name: str) -> Engine:
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name!r} (known: {', '.join(ENGINES)})")
    return ENGINES[name]()


def classification_schema(registry: dict) -> dict:
    names = [c["name"] for c in registry["categories"]] + [fixed.ENGINE_OTHER]
    return {"type": "object", "properties": {"type_document": {"enum": names}, "nom_propose": {"type": ["string", "null"]}}, "required": ["type_document", "nom_propose"]}


def category_lines(registry: dict) -> str:
    """The prompt's lines on categories: their subfolders, but the one for others, and fields."""
    out = []
    for c in registry["categories"]:
        named = [s["name"] for s in c["subfolders"] if s["name"] != fixed.OTHER_FOLDER]
        out.append(f"- {c['name']}" + (f" ({', '.join(named)})" if named else "") + f" : {', '.join(c['fields'])}")
    return "\n".join(out)


def rule_lines(registry: dict) -> str:
    return "\n".join(f"- {r['description']}" for r in registry["rules"]) or "- (aucune)"


def prompt_parts(name: str, num_ctx: int, **values: str) -> tuple[str, str, int]:
    """What stands before and after the document in a prompt, and the characters left for it."""
    whole = Template(fixed.PROMPTS[name]).substitute(texte="\0", **values)
    before, _, after = whole.partition("\0")
    return before, after, char_budget(before + after, num_ctx)


def prompted(text: Column, name: str, num_ctx: int, **values: str) -> Column:
    """struct(prompt, truncated) with the document compacted and cut to the budget."""
    before, after, room = prompt_parts(name, num_ctx, **values)
    cut = truncated(text, F.lit(room))
    return F.struct(F.concat(F.lit(before), cut["text"], F.lit(after)).alias("prompt"), cut["truncated"].alias("truncated"))


def conforms(reply: object, schema: dict) -> bool:
    """An object with all required keys, and listed values where a list is given."""
    return isinstance(reply, dict) and all(k in reply for k in schema.get("required", [])) and all(reply[k] in r["enum"] for k, r in schema.get("properties", {}).items() if "enum" in r and k in reply)


def asked(engine: Engine, prompt: str, schema: dict) -> tuple[dict | None, str | None, float]:
    """(reply, error, seconds). A reply that doesn't conform is asked for once more; an engine that raises is not."""
    began = time.perf_counter()
    for _ in range(2):
        try:
            reply = engine.reply(prompt, schema)
        except Exception as error:  # whatever an engine raises means that it is not there
            return None, f"moteur en erreur ({type(error).__name__})", time.perf_counter() - began
        if conforms(reply, schema):
            return reply, None, time.perf_counter() - began
    return None, "reponse non conforme", time.perf_counter() - began


def near_category(name: str, registry: dict, least: float = fixed.NAME_SIMILARITY) -> str | None:
    """The category whose name, singular or folder a proposed name resembles most, if enough; the same first word as a
    singular counts as the same."""

    def likeness(c: dict) -> float:
        single = c["name"].rstrip("s")
        alike = max(difflib.SequenceMatcher(None, name, form).ratio() for form in (c["name"], single, c["folder"].lower()))
        return 1.0 if name.split("_")[0] == single else alike

    found = [(likeness(c), -i, c["name"]) for i, c in enumerate(registry["categories"])]
    best = max(found, default=(0.0, 0, None))
    return best[2] if best[0] >= least and best[0] > 0 else None


def with_near_category(rows: DataFrame, registry: dict, name: str = "name") -> DataFrame:
    """``rows`` with near: worked out once for each distinct name, then joined back."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(near=[near_category(x, registry) if x else None for x in batch[name]])

    names = rows.select(name).where(F.col(name).isNotNull()).distinct()
    return rows.join(names.mapInPandas(task, f"{name} string, near string"), name, "left")


def engine_replies(docs: DataFrame, registry: dict, engine: str = "stub", key: str = "doc_id", text: str = "text", num_ctx: int = 2048) -> DataFrame:
    """(key, reply) of the analysed ``docs`` that no business rule settles."""
    schema = classification_schema(registry)
    made = prompted(F.col(text), "classification", num_ctx, categories=category_lines(registry), regles=rule_lines(registry))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = make_engine(engine)
        for batch in batches:
            rows = []
            for prompt, cut in zip(batch["prompt"], batch["truncated"], strict=True):
                reply, error, seconds = asked(own, prompt, schema)
                found = reply or {}
                rows.append((reply is not None, found.get("type_document"), found.get("nom_propose"), error, seconds, ["texte tronque pour le moteur"] if cut else []))
            frame = pd.DataFrame(rows, columns=[x.split()[0] for x in REPLY.split(", ")])
            frame.insert(0, key, batch[key].array)
            yield frame

    kind = docs.schema[key].dataType.simpleString()
    open_ = docs.where(F.col("rule_verdict") != RULE).select(key, made.alias("p")).select(key, "p.*")
    return open_.mapInPandas(task, f"`{key}` {kind}, {REPLY}")


def free_field_requests(registry: dict, type_: str) -> list[str]:
    """The fields of a type that an engine may fill."""
    return [f for f in expected_fields(registry, type_) if f in fixed.FREE_FIELDS]


def free_field_prompt(text: Column, registry: dict, type_: str, num_ctx: int = 2048) -> Column:
    lines = "\n".join(f"- {f} : {fixed.FREE_FIELDS[f]}" for f in free_field_requests(registry, type_))
    return prompted(text, "extraction", num_ctx, categorie=type_, champs=lines)


def free_field_schema(names: list[str]) -> dict:
    return {"type": "object", "properties": {f: {"type": ["string", "null"]} for f in names}, "required": names}


FREE_REPLY = "ok boolean, error string, seconds double, replies map<string, string>"


def free_field_replies(docs: DataFrame, registry: dict, engine: str | Callable[[], Engine] = "stub", key: str = "doc_id", type_: str = "type", text: str = "text", num_ctx: int = 2048) -> DataFrame:
    """key, ok, error, seconds, replies (map), alerts, needs_review of ``docs`` whose type has free fields; others are not
    asked and have no row.

    An engine that fails leaves its document to a human; a document cut to the prompt's budget has an alert. Types that
    the registry doesn't know, null too, have the generic fields; a null text is an empty one. ``engine`` is a name of
    ENGINES, or a function that makes one in each task. ``grounded`` checks what is said; see ``spoken``.
    """
    wanted = {c["name"]: free_field_requests(registry, c["name"]) for c in registry["categories"]}
    generic = free_field_requests(registry, None)
    kind = F.when(F.col(type_).isin(*wanted), F.col(type_))
    content = F.coalesce(F.col(text), F.lit(""))
    made = free_field_prompt(content, registry, None, num_ctx) if generic else F.lit(None)
    for name, names in wanted.items():
        made = F.when(kind == name, free_field_prompt(content, registry, name, num_ctx) if names else F.lit(None)).otherwise(made)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = engine() if callable(engine) else make_engine(engine)
        for batch in batches:
            rows = []
            for name, prompt in zip(batch["kind"], batch["prompt"], strict=True):
                names = wanted.get(name, generic)
                reply, error, seconds = asked(own, prompt, free_field_schema(names))
                said = {f: str(reply[f]) for f in names if reply[f] is not None} if reply else {}
                rows.append((reply is not None, error, seconds, said))
            frame = pd.DataFrame(rows, columns=[x.split()[0] for x in FREE_REPLY.split(", ", 3)])
            yield pd.concat([batch[[key, "truncated"]].reset_index(drop=True), frame], axis=1)

    id_ = docs.schema[key].dataType.simpleString()
    open_ = docs.select(key, kind.alias("kind"), made.alias("p")).where(F.col("p").isNotNull()).select(key, "kind", "p.*")
    found = open_.mapInPandas(task, f"`{key}` {id_}, truncated boolean, {FREE_REPLY}")
    failed = F.when(~F.col("ok"), F.concat(F.lit("champs libres : moteur indisponible ("), "error", F.lit(")")))
    alerts = F.array_compact(F.array(F.when(F.col("truncated"), "texte tronque pour le moteur"), failed))
    return found.withColumn("alerts", alerts).withColumn("needs_review", ~F.col("ok")).drop("truncated")


def spoken(replies: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, field, value) of what engines said, as ``grounded`` takes it."""
    return replies.select(key, F.explode("replies").alias("field", "value"))


#: Characters of a document's joined lines that make one bucket of the range join.
BUCKET = 256


def occurrences(whole: Column, target: Column) -> Column:
    """Where each occurrence of ``target`` in ``whole`` starts, from 0, overlapping ones too; none for an empty target. The text
    is split before each occurrence, so they are where its pieces end, and at 0 if the first piece starts with the target."""
    literal = F.concat(F.lit(r"(?=\Q"), F.replace(target, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    pieces = F.transform(F.split(whole, literal), lambda p: F.length(p))
    state = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("at"))
    ends = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), state, lambda s, n: F.struct(F.array_append(s["ends"], s["at"] + n).alias("ends"), (s["at"] + n).alias("at")))["ends"]
    first = F.when(F.startswith(whole, target), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.when((target == "") | whole.isNull() | target.isNull(), F.array().cast("array<int>")).otherwise(F.concat(first, ends))


def _buckets(first: Column, last: Column) -> Column:
    return F.sequence(F.floor(first / BUCKET), F.floor(F.greatest(first, last) / BUCKET))


def _located(said: DataFrame, lines: DataFrame) -> DataFrame:
    """doc, field, target, found, line, conf, on_recipient of ``said`` (doc, field, target, whole) that occur, from ``lines``
    (doc, i, start, size, conf, flags, above): a range join of occurrences and lines within buckets of offsets. The two are
    paired in the later of their first buckets only."""
    spans = said.select("doc", "field", "target", F.explode(occurrences(F.col("whole"), F.col("target"))).alias("at")).withColumn("last", F.col("at") + F.length("target") - 1)
    spans = spans.withColumn("bucket", F.explode(_buckets(F.col("at"), F.col("last"))))
    rows = lines.withColumn("end", F.col("start") + F.col("size")).withColumn("bucket", F.explode(_buckets(F.col("start"), F.col("end"))))
    over = spans.join(rows, ["doc", "bucket"]).where((F.col("start") <= F.col("last")) & (F.col("end") >= F.col("at")) & (F.col("bucket") == F.floor(F.greatest("at", "start") / BUCKET)))
    flag = F.coalesce(F.try_element_at("flags", F.col("field")), F.lit(0))
    above = F.coalesce(F.try_element_at("above", F.col("field")), F.lit(0))
    each = over.groupBy("doc", "field", "target", "at").agg(F.min("i").alias("line"), F.min("conf").alias("conf"), F.max(flag >= 1).alias("barred"), F.min_by(above == 2, "i").alias("under"))
    free = ~F.col("barred") & ~F.col("under")
    best = F.min_by(F.when(free, F.struct("line", "conf")), F.when(free, F.col("at"))).alias("best")
    return each.groupBy("doc", "field", "target").agg(best, F.max(free).alias("any")).select("doc", "field", "target", F.lit(True).alias("found"), "best.line", "best.conf", (~F.col("any")).alias("on_recipient"))


def grounded(replies: DataFrame, docs: DataFrame, registry: dict, key: str = "doc_id", type_: str = "type", lines: str = "lines") -> DataFrame:
    """key, field, value, line, page, conf, alert, needs_review of engine replies (key, field, value).

    A value must occur in the document's lines, without regard to accents, case and white space, also across lines; else
    it is rejected. A field may be barred from lines that name a recipient, or from those right under a line with such a
    label only; and may be expected in the title zone. Rejected values are null. Fields that the type doesn't allow, and blank
    values, are left out; a document without lines has nothing to find a value in.

    A document's lines, joined, are searched as one text. Its lines have running offsets in that text, and a range join tells
    which of them an occurrence lies on. Nothing leaves the JVM.
    """
    types = [c["name"] for c in registry["categories"]]
    allowed = F.create_map(*(x for t in types for x in (F.lit(t), F.array(*map(F.lit, free_field_requests(registry, t))))))
    generic = F.array(*map(F.lit, free_field_requests(registry, None)))
    texts = F.transform(lines, lambda x: F.coalesce(x["text"], F.lit("")))
    sources = docs.select(F.col(key).alias("doc"), F.col(type_).alias("type"), F.col(lines).alias("lines"), F.array_join(F.transform(texts, compare_key), " ").alias("whole"), compare_key(title_zone(F.array_join(texts, "\n"))).alias("zone"))
    value = F.trim(F.regexp_replace("value", java(r"\s+"), " "))
    said = replies.select(F.col(key).alias("doc"), "field", value.alias("value")).where("value <> ''").join(sources, "doc")
    said = said.where(F.array_contains(F.coalesce(F.try_element_at(allowed, F.col("type")), generic), F.col("field"))).withColumn("target", compare_key(F.col("value")))

    norm = fold_line(F.col("l.text"))
    flags: list[Column] = []
    for f, check in fixed.FREE_FIELD_CHECKS.items():
        pattern = "|".join(f"(?:{tolerant(p)})" for p in check.get("not_on", []))
        if pattern:
            rest = F.regexp_replace(F.regexp_replace(norm, f"(?U)^(.*?)(?:{pattern})", "$1"), ":", "")
            flags += [F.lit(f), F.when(~norm.rlike(java(pattern)), 0).when(rest.rlike(java(r"\w")), 1).otherwise(2)]
    of_doc = Window.partitionBy("doc").orderBy("i")  # the lines of one document
    wanted = said.select("doc").distinct()
    parts = sources.join(wanted, "doc", "left_semi").select("doc", F.posexplode("lines").alias("i", "l"))
    parts = parts.select("doc", "i", F.length(compare_key(F.col("l.text"))).alias("size"), F.col("l.conf").alias("conf"), (F.create_map(*flags) if flags else F.create_map().cast("map<string, int>")).alias("flags"))
    starts = F.sum(F.col("size") + 1).over(of_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") - 1
    located = _located(said.select("doc", "field", "target", "whole").distinct(), parts.withColumn("start", starts).withColumn("above", F.lag("flags").over(of_doc)))

    placed = said.drop("whole").join(located, ["doc", "field", "target"], "left")
    found, on_recipient = F.coalesce("found", F.lit(False)), F.coalesce("on_recipient", F.lit(False))
    titled = F.col("field").isin(*(f for f, c in fixed.FREE_FIELD_CHECKS.items() if c.get("in_title")))
    outside = titled & ~F.contains(F.col("zone"), F.col("target"))
    low = F.coalesce(F.col("conf") < fixed.OCR_LINE, F.lit(False))
    message = (
        F.when(~found, fixed.NOT_IN_SOURCE).when(on_recipient, fixed.ON_RECIPIENT).when(outside, fixed.OUTSIDE_TITLE)
        .when(low, F.format_string("ligne OCR peu sure (confiance %.2f)", "conf"))
    )
    kept = F.when(found & ~on_recipient, F.col("value"))
    return placed.select(F.col("doc").alias(key), "field", kept.alias("value"), "line", F.get(F.col("lines"), F.col("line"))["page"].alias("page"), "conf", F.concat(F.col("field"), F.lit(" : "), message).alias("alert"), message.isNotNull().alias("needs_review"))


def merged(fields: DataFrame, free: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, field, value, line, page, conf, method): labelled fields, and free ones where there is none of that name."""
    own = fields.where("value is not null").select(key, "field", "value", "line", "page", "conf", F.lit("regex").alias("method"))
    more = free.where("value is not null").select(key, "field", "value", "line", "page", "conf", F.lit("llm").alias("method"))
    return own.unionByName(more.join(own.select(key, "field"), [key, "field"], "left_anti"))


def keyword_proposals(reply: object) -> list[str]:
    """At most five keywords of an engine's reply: none with a digit, each once without regard to case."""
    found = reply.get("mots_cles") if isinstance(reply, dict) else None
    words = [" ".join(str(w).split()) for w in found] if isinstance(found, list) else []
    known: dict[str, str] = {}
    for w in words:
        if w and not any(c.isdigit() for c in w):
            known.setdefault(w.lower(), w)
    return list(known.values())[:5]


def name_of(registry: dict, type_: str) -> str | None:
    own = category(registry, type_)
    return own["folder"] if own else None
