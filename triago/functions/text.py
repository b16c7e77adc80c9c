"""Text columns: folding, lines, title zone, compaction, budgets and shares."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from triago import fixed

LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it often or inside lambdas."""
    return F.transform(F.array(value), body)[0]


def java(pattern: str) -> str:
    """A pattern whose \\s \\w \\d \\b have their Unicode meanings."""
    return f"(?U){pattern}"


def folded(text: str) -> str:
    """Driver-side folding: compatibility decomposition, no combining marks, lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


@lru_cache
def _tables() -> tuple[str, str, str, str, str, tuple[tuple[str, str], ...]]:
    """From the Unicode data: one-to-one pairs, deletions, pairs that keep the length, and longer expansions of Latin
    letters, signs and ligatures."""
    one, to, gone, long_from, long_to, wide = [], [], [], [], [], []
    for i in (*range(1, 0xD800), *range(0xE000, 0x10000)):
        c = chr(i)
        f = folded(c)
        if f != c:
            if len(f) == 1:
                one.append(c)
                to.append(f)
            elif not f:
                gone.append(c)
            elif i < 0x2600 or 0xFB00 <= i <= 0xFB06:
                wide.append((c, f))
        kept = f if len(f) == 1 else c.lower() if len(c.lower()) == 1 else c
        if kept != c:
            long_from.append(c)
            long_to.append(kept)
    return "".join(one) + "".join(gone), "".join(to), "", "".join(long_from), "".join(long_to), tuple(wide)


def fold(text: Column) -> Column:
    """Lower case without accents. Letters that fold to several (ﬁ, ½, ŉ) are expanded first; such expansions outside
    Latin and general signs (Hangul, Arabic presentation ligatures) stay as they are."""
    source, target, _, _, _, wide = _tables()
    chars = "".join(c for c, _ in wide)
    expanded = F.when(F.length(F.translate(text, chars, "")) < F.length(text), _expanded(text, wide)).otherwise(text)
    return _ascii_apart(text, F.translate(expanded, source, target))


def _ascii_apart(text: Column, otherwise: Column) -> Column:
    """ASCII only needs lower case: the tables of all letters cost more than a short line itself."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(otherwise)


def _expanded(text: Column, wide: tuple[tuple[str, str], ...]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in wide for x in pair))
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def fold_line(text: Column) -> Column:
    """Folding that keeps the length: a position in the result is the same in the original."""
    _, _, _, source, target, _ = _tables()
    return _ascii_apart(text, F.translate(text, source, target))


def compare_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), java(r"\s+"), " "))


def lines_of(text: Column) -> Column:
    """The lines with something in them, as they stand."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), LINE_BREAK, -1), lambda x: x.rlike(java(r"\S")))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, java(r"^\s+|\s+$"), "")


def title_zone(text: Column) -> Column:
    """The first lines, stripped and joined, and of them the first characters."""
    head = F.slice(F.transform(lines_of(text), stripped), 1, fixed.TITLE_LINES)
    return F.left(F.array_join(head, "\n"), F.lit(fixed.TITLE_CHARS))


def visible_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), java(r"\s"), ""))


def needs_ocr(text: Column) -> Column:
    return visible_chars(text) < fixed.PAGE_VISIBLE_CHARS


def compacted(text: Column) -> Column:
    """Runs of blanks to one, no blanks around line feeds, at most two line feeds."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\u00A0\\u202F]+", " ")
    text = F.regexp_replace(text, " *\\n *", "\n")
    return stripped(F.regexp_replace(text, "\\n{3,}", "\n\n"))


def char_budget(instruction: str, num_ctx: int) -> int:
    """Characters left for the document beside the instruction and the reply."""
    return max(0, int((num_ctx - len(instruction) / fixed.TOKEN_CHARS - fixed.REPLY_TOKENS) * fixed.TOKEN_CHARS))


def truncated(text: Column, budget: Column) -> Column:
    """(text, truncated): compacted, and if longer than the budget cut, at a line feed where one lies in its last fifth,
    with a mark after it."""
    room = F.greatest(F.lit(0), budget - len(fixed.TRUNCATED))

    def cut(whole: Column) -> Column:
        head = F.left(whole, room)
        last = F.length(head) - F.instr(F.reverse(head), "\n")
        at_line = (F.instr(head, "\n") > 0) & (last > room * 0.8)
        kept = F.when(at_line, F.substring(head, F.lit(1), last)).otherwise(head)
        fits = F.length(whole) <= budget
        return F.struct(F.when(fits, whole).otherwise(F.concat(kept, F.lit(fixed.TRUNCATED))).alias("text"), (~fits).alias("truncated"))

    return let(compacted(text), cut)


def arabic_share(text: Column) -> Column:
    """Arabic letters over all letters; 0 without letters."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", "")
    arabic = F.regexp_count(letters, F.lit(fixed.ARABIC_LETTERS))
    return F.when(F.length(letters) == 0, F.lit(0.0)).otherwise(arabic / F.length(letters))
