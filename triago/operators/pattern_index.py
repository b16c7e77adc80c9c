"""Keyword patterns of large registries: an inverted index instead of one test for each pattern and document.

``classify`` unrolls a registry's patterns into the plan, which suits tens of them. Here patterns are a table. From each pattern
the words are read that every match must hold as whole words, or lists of words of which a match must hold one; of words that
must follow each other the pair is read, as two frequent words are seldom neighbours. Of these the rarest in the documents become
the pattern's keys; an equi-join of document words and pairs with keys gives the few patterns that can match a document, and only
these are tried on its text. A pattern that is no more than a word, or two words with white space between them, matches where its
key is found and isn't tried. The plan doesn't grow with the registry.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triago.functions.text import fold, java, let
from triago.shared import written

#: The most patterns without a required word, as each of them is tried on every document.
OPEN = 256
_PIECES = re.compile(r"(?P<edge>\\b(?![*+?{]))|(?P<gap>(?:\\s|[ ,;:'/-])(?:[+]|(?![*?{])))|(?P<word>[a-z0-9]+)|\((?:\?:)?(?P<group>[a-z0-9|]+)\)|(?P<other>\\.|.)", re.DOTALL)


#: Patterns that match wherever their one word, or pair of words, is.
_PLAIN = re.compile(r"\\b[a-z0-9]+(?:\\s\+[a-z0-9]+)?\\b")


def _is_pair(word: str) -> bool:
    return " " in word or "," in word


def required(pattern: str, pairs: bool = False) -> list[list[str]]:
    """Lists of words: of each list every match of the pattern holds one as a whole word. Empty if none is sure to be there.

    Only what is plain counts: words, and groups of them, between word boundaries, spaces or signs, and none that a quantifier
    or anything else touches. Of a pattern with ways at the top a list holds a word of each way. With ``pairs`` words between
    which there are only signs and spaces give lists of pairs in place of their own ("a b": b is the next word after a, white
    space between them; "a,b": something else between them).
    """
    ways, depth, start = [], 0, 0
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]])*\]|[()|]", pattern, re.DOTALL):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if m[0] == "|" and not depth:
            ways.append(pattern[start : m.start()])
            start = m.end()
    if ways:
        each = [required(way, pairs) for way in (*ways, pattern[start:])]
        return [sorted({w for lists in each for w in min(lists, key=lambda x: (pairs and not _is_pair(x[0]), len(x)))})] if all(each) else []
    if "[" in pattern or "{" in pattern or re.search(r"\(\?(?!:)", pattern):
        return []
    items = [(m.lastgroup, m[m.lastgroup]) for m in _PIECES.finditer(pattern)]
    if any(kind == "other" and value == "(" for kind, value in items):  # a group that isn't plain may be left out as a whole
        return []
    clear = ("edge", "gap")
    found = {}
    for i, (kind, value) in enumerate(items):
        if kind in ("word", "group") and i and items[i - 1][0] in clear and i + 1 < len(items) and items[i + 1][0] in clear and all(value.split("|")):
            found[i] = sorted(set(value.split("|")))
    if not pairs:
        return list(found.values())
    out, paired = [], set()
    for i, j in zip(list(found), list(found)[1:], strict=False):
        gaps = [value.rstrip("+") for kind, value in items[i + 1 : j] if kind == "gap"]
        if gaps and all(kind in clear for kind, _ in items[i + 1 : j]):
            sign = " " if set(gaps) <= {" ", r"\s"} else ","
            out.append([f"{a}{sign}{b}" for a in found[i] for b in found[j]])
            paired |= {i, j}
    return out + [words for i, words in found.items() if i not in paired]


def keyed(patterns: DataFrame) -> DataFrame:
    """(pattern, choice, words, plain): the lists of required words and pairs of each distinct pattern, none for one without any;
    plain: the pattern matches wherever its only word or pair is."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, words, _PLAIN.fullmatch(p) is not None) for p in batch["pattern"] for i, words in enumerate(required(p, True) or [[]])]
            yield pd.DataFrame(rows, columns=["pattern", "choice", "words", "plain"])

    return patterns.select("pattern").where("pattern is not null").distinct().mapInPandas(task, "pattern string, choice int, words array<string>, plain boolean")


def words_of(folded: Column, pairs: list[bool]) -> Column:
    """The distinct words of a text (``pairs`` holds False) and pairs of neighbouring words (it holds True)."""

    def pair(a: Column, b: Column) -> Column:
        return F.concat(F.when(a.endswith(" "), a).otherwise(F.concat(a, F.lit(","))), F.rtrim(b))

    def of(found: Column) -> Column:
        alone = F.transform(found, lambda a: F.rtrim(a))
        both = F.zip_with(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))), F.slice(found, F.lit(2), F.size(found)), pair)
        return F.array_distinct(F.concat(*([alone] if False in pairs else []), *([both] if True in pairs else [])))

    # a word that white space parts from the next one keeps a space
    return let(F.regexp_extract_all(F.regexp_replace(folded, java(r"\s+"), " "), F.lit(java(r"\w++(?: (?=\w))?")), F.lit(0)), of)


def matched(docs: DataFrame, patterns: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pattern) of all patterns that occur in the folded texts of ``docs``; ``patterns`` has a column pattern.

    Repeated patterns count once, null ones and null texts match nothing; rows of one key each give their own, so keys should
    tell documents apart; empty tables give an empty result. Columns of other names are not read. A registry with more than
    OPEN patterns that have no required word is refused.
    """
    lists = written(keyed(patterns))
    whole = docs.select(F.col(key).alias("key"), fold(F.col(text)).alias("folded")).where("folded is not null and key is not null")
    open_ = [r.pattern for r in lists.where("size(words) = 0").select("pattern").limit(OPEN + 1).collect()]
    if len(open_) > OPEN:
        raise ValueError(f"over {OPEN} patterns have no word that all their matches hold")
    options = lists.select("pattern", "choice", "plain", F.explode("words").alias("word"))
    kinds = options.select("plain", F.col("word").rlike("[ ,]").alias("pair")).distinct().collect()
    words = {plain: whole.select("key", F.explode(words_of(F.col("folded"), [r.pair for r in kinds if r.plain == plain])).alias("word")) for plain in {r.plain for r in kinds}}
    found = whole.select("key", F.lit("").alias("pattern")).limit(0)
    if True in words:
        found = words[True].join(options.where("plain").select("word", "pattern"), "word").select("key", "pattern")
    if False in words:
        # words are counted only for patterns that leave a choice
        several = lists.where("choice > 0").select("pattern").distinct()
        asked = options.join(several, "pattern", "left_semi")
        counts = words[False].join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        sums = asked.join(counts, "word", "left").groupBy("pattern", "choice").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
        rarest = sums.groupBy("pattern").agg(F.min(F.struct("n", "choice"))["choice"].alias("rarest"))
        keys = options.where("not plain").join(rarest, "pattern", "left").where("choice = coalesce(rarest, 0)").select("word", "pattern")
        tried = words[False].join(keys, "word").groupBy("key").agg(F.collect_set("pattern").alias("patterns"))
        found = found.unionByName(whole.join(tried, "key").select("key", F.explode(F.filter("patterns", lambda p: F.regexp_like("folded", F.concat(F.lit("(?U)"), p)))).alias("pattern")))
    if open_:
        hits = F.array_compact(F.array(*(F.when(F.col("folded").rlike(java(p)), F.lit(p)) for p in open_)))
        found = found.unionByName(whole.select("key", F.explode(hits).alias("pattern")))
    return found.withColumnRenamed("key", key)
