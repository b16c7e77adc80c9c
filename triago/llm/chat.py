"""Chat formatting with a grammar round trip, in DataFrame operations only.

Grammar: ``conversation := turn*``, ``turn := <s> role | level [INST] text [/INST]</s>``. The role is always escaped.
The text stands verbatim at level 0 and escaped at level 1 (``~`` ``<`` ``[`` ``|`` become ``~0`` ``~1`` ``~2`` ``~3``, which
leaves no control string in it and can be undone). The control strings are ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``: a
text that holds one is always escaped, as a tokenizer would read it as a mark even where the parser could tell. Texts
stand between marks, so none can make up a control string together with its neighbours.
The parser splits at ``</s>`` and reads each piece with one anchored pattern.

Each conversation is rendered and parsed again. If the recovered turns differ from the source, the turns that don't
survive a round trip by themselves are escaped too and the conversation is parsed again; if that still differs, all its
turns are escaped. ``round_trip`` tells that the kept form gave back the source exactly.

A formatted conversation is one value, so the rows of one conversation meet in one row, as its hash needs them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triago.llm.common import let, table

#: The marks of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
PROBE = "</s>[INST] ok [/INST]"
TURN = r"(?s)\A<s>([^|]*)\|([01])\[INST\](.*)\[/INST\]\z"


def escaped(text: Column) -> Column:
    for a, b in (("~", "~0"), ("<", "~1"), ("[", "~2"), ("|", "~3")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column) -> Column:
    for a, b in (("|", "~3"), ("[", "~2"), ("<", "~1"), ("~", "~0")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def conflicting(text: Column) -> Column:
    """Whether a text holds a control string."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(c)) for c in CONTROLS))


def rendered_turn(turn: Column, level: Column) -> Column:
    text = F.when(level == 0, turn["text"]).otherwise(escaped(turn["text"]))
    return F.concat(F.lit("<s>"), escaped(turn["role"]), F.lit("|"), level.cast("string"), F.lit("[INST]"), text, F.lit("[/INST]</s>"))


def rendered(turns: Column, levels: Column) -> Column:
    return F.array_join(F.zip_with(turns, levels, rendered_turn), "")


def parsed(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation; a piece that doesn't fit the grammar gives null fields."""

    def turn(piece: Column) -> Column:
        fits = piece.rlike(TURN)
        body = F.regexp_extract(piece, TURN, 3)
        return F.struct(F.when(fits, unescaped(F.regexp_extract(piece, TURN, 1))).alias("role"), F.when(fits, F.when(F.regexp_extract(piece, TURN, 2) == "0", body).otherwise(unescaped(body))).alias("text"))

    return let(F.split(text, "</s>", -1), lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), turn))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, turns (recovered from formatted), escaped_turns and round_trip of each conversation.

    Rows are ordered by turn (nulls first), then role and text, so ties have one result. Null roles and texts count as
    empty. Rows with a null conv_id form one conversation. An empty table gives an empty result; columns other than
    conv_id, turn, role and text are not read.
    """
    row = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    convs = convs.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"))
    source = F.col("source")

    def attempt(levels: Column) -> Column:
        return let(rendered(source, levels), lambda f: F.struct(f.alias("formatted"), parsed(f).alias("turns"), levels.alias("levels")))

    def unless_identical(tried: Column, levels: Column) -> Column:
        return F.when(tried["turns"] == source, tried).otherwise(attempt(levels))

    level = lambda t: conflicting(t["text"]).cast("int")
    alone = F.transform(source, lambda t: F.when(parsed(rendered_turn(t, level(t))) == F.array(t), level(t)).otherwise(F.lit(1)))
    everywhere = F.transform(source, lambda t: F.lit(1))
    kept = let(attempt(F.transform(source, level)), lambda a: let(unless_identical(a, alone), lambda b: unless_identical(b, everywhere)))
    return convs.select("conv_id", "source", kept.alias("kept")).select(
        "conv_id", F.size("kept.turns").cast("long").alias("n_turns"), F.col("kept.formatted").alias("formatted"), F.col("kept.turns").alias("turns"),
        F.aggregate("kept.levels", F.lit(0), lambda a, x: a + x).alias("escaped_turns"), (F.col("kept.turns") == F.col("source")).alias("round_trip"),
    )


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask: that of the role's turns, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


def op7_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conversation and one for the probe, -7, which an empty table has too. Null texts are empty ones; ties of
    turns and null ids are as ``format_conversations`` tells; other columns are not read."""
    probe = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{PROBE}'), (-7L, 1L, 'assistant', '{PROBE}') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    chats = format_conversations(rows).withColumn("loss", loss_text(F.col("turns")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", "n_turns", F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "round_trip",
    )


def _longer(column: str, signs: str) -> str:
    return " + ".join(f"(length({column}) - length(replace({column}, '{s}', '')))" for s in signs)


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
u AS (SELECT *, 22 + length(role) + {_longer("role", "~<[|")} + length(text) + CASE WHEN {" OR ".join(f"strpos(text, '{c}') > 0" for c in CONTROLS)} THEN {_longer("text", "~<[|")} ELSE 0 END AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(n)::BIGINT AS formatted_chars, true AS round_trip
FROM u GROUP BY conv_id
"""
