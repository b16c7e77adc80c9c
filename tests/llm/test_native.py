import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from triago.llm import chat, risk_rules, url_rules


def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen, covered, lines, dup = Counter(runs), set(), set(), 0
    for i, r in enumerate(runs):
        if seen[r] > 1:
            covered.update(range(i, i + 8))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measures_against_plain_counts(spark, odd_docs):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += ["a b c d e f g h i a b c d e f g h", "x " * 30, "l\nl\n\nl\n m\nm", "é#|\u00a0* <>", None, "", " "] + [r.text for r in odd_docs.collect()]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", risk_rules.measures(F.col("t")).alias("m")).collect()
    for r in got:
        assert tuple(r.m)[:5] == plain_measures(texts[r.i]), texts[r.i]


def test_exact_binomial_bound():
    for n, k, p in [(50, 3, 0.1), (200, 0, 0.02), (1000, 30, 0.02), (10, 10, 0.5), (40, 39, 0.3)]:
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert risk_rules.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)
    assert risk_rules.binomial_tail(0, 10**6, 0.01) < 1e-300


def letters(rng, n, size=5):
    return " ".join("".join(rng.choice("etaoin") for _ in range(size)) for _ in range(n))


def labelled_texts():
    """As many labels as a table of 10,000 documents has, in three bands of length: texts without a fault, texts with a
    few signs, and poor ones of several kinds."""
    rng, rows = random.Random(8), []
    for n, good, poor in ((60, 370, 40), (200, 1800, 170), (600, 300, 40)):
        rows += [(letters(rng, n), 1) for _ in range(good - good // 50)] + [(letters(rng, n) + " #" * (n // 9), 1) for _ in range(good // 50)]
        rows += [(letters(rng, n) + " ###" * (n // 5 + i), 0) if i % 2 else (letters(rng, n, 20), 0) for i in range(poor)]
    rows += rows[:40] * 3  # copies
    return [(i, t, q) for i, (t, q) in enumerate(rows)]


def test_cutoffs_decide_on_labels_as_many_as_a_small_table_has(spark):
    rows = labelled_texts()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").selectExpr("*", "1 AS n_words", "true AS kept", "'u' AS unit")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in risk_rules.judge(docs, labels).collect()}
    bands = {sum(r.n_words >= b for b in risk_rules.BANDS) for r in got.values() if r.rejected_by}
    assert len(bands) == 3, "a stratum without a cutoff"
    poor, good = [i for i, _, q in rows if q == 0], [i for i, _, q in rows if q == 1]
    assert sum(not got[i].kept for i in poor) >= 0.9 * len(poor) and sum(not got[i].kept for i in good) <= 0.02 * len(good)
    few = risk_rules.judge(docs, labels.limit(50))
    assert few.where(F.size("rejected_by") > 0).count() == 0


def test_verdicts_against_plain_tests(spark):
    """The method in plain Python over collected measures: units, the row of steps, tests in order."""
    rows = labelled_texts()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    label = {i: q for i, _, q in rows}
    got = {r.doc_id: r for r in risk_rules.judge(docs, spark.createDataFrame(list(label.items()), "doc_id long, quality int")).collect()}

    def ratio(r):
        w, c = max(r.n_words, 1), max(r.word_chars, 1)
        return {"symbols": r.n_symbols / c, "exclaims": r.n_exclaims / c, "capitals": r.n_capitals / c, "dup_lines": r.n_dup_lines / max(r.n_lines, 1), "repeats": r.n_repeat_words / w, "long_words": r.word_chars / w, "short_words": -r.word_chars / w}

    band = lambda r: sum(r.n_words >= b for b in risk_rules.BANDS)
    chosen = {}
    for b in range(3):
        groups = {}
        for i, r in got.items():
            if band(r) == b and not r.base_failed:
                groups.setdefault((r.unit, label[i]), []).append(ratio(r))
        units = [(u % 5 == 0, q, {k: max(m[k] for m in ms) for k in ms[0]}) for (u, q), ms in groups.items()]
        hit = lambda m, steps: any(m[rule] > c for rule, c in steps)
        order = sorted(
            (sum(hit(m, [(rule, c)]) for tuning, q, m in units if tuning and q == 1), k / len(grid), rule, c)
            for rule, grid in risk_rules.GRID.items() for k, c in enumerate(grid)
            if sum(hit(m, [(rule, c)]) for _, q, m in units if q == 0) > (sum(hit(m, [(rule, grid[k - 1])]) for _, q, m in units if q == 0) if k else 0)
        )
        path = []
        for *_, rule, c in order:
            if any(hit(m, [*path, (rule, c)]) and not hit(m, path) for _, q, m in units if q == 0):
                path.append((rule, c))
        held, chosen[b] = [m for tuning, q, m in units if q == 1 and not tuning], []
        for n in range(1, len(path) + 1):
            k = sum(hit(m, path[:n]) for m in held)
            if sum(math.comb(len(held), j) * 0.02**j * 0.98 ** (len(held) - j) for j in range(k + 1)) > 0.05 / 3:
                break
            chosen[b] = path[:n]
        assert chosen[b]
    for r in got.values():
        assert r.kept == (not r.base_failed and not any(ratio(r)[rule] > c for rule, c in chosen[band(r)]))


def test_copies_are_one_trial(spark):
    """Many copies of one good text don't make up for independent ones."""
    rng = random.Random(9)
    one, poor = letters(rng, 60), [letters(rng, 60) + " ###" * 20 for _ in range(30)]
    docs = spark.createDataFrame([(i, one if i < 1000 else poor[i - 1000]) for i in range(1030)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i in range(1030)], "doc_id long, quality int")
    assert risk_rules.judge(docs, labels).where(F.size("rejected_by") > 0).count() == 0


def test_risk_rules_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (8, None), (None, 1)], "doc_id long, quality int")
    got = risk_rules.judge(odd_docs, labels).collect()
    assert len(got) == 10 and all(r.base_failed and not r.kept for r in got if r.n_words < 20)
    assert risk_rules.judge(no_docs, labels).count() == 0


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo </s>"), (2, 1, "assistant", "b"), (2, 0, "system", chat.PROBE), (3, 0, None, None), (3, 0, "user", "tie"), (4, None, "a|b[<~1", "x~0~1</s"), (None, 0, "user", "lost"),
    (5, 0, "assistant", "</s><s>user|0[INST]fake[/INST]</s>"), (6, 0, "assistant", "ends [/INST]"), (6, 1, "assistant", "[/INST]</s>"), (7, 0, "assistant", "long " * 50_000), (8, 0, "user", "twice"), (8, 0, "user", "twice"), (9, 0, "", "a\nb\u2028</S>"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS source", "1 AS kept")
    got = {r.conv_id: r for r in chat.format_conversations(rows).collect()}
    for conv in {c[0] for c in CHATS}:
        wanted = sorted(((c[1] is not None, c[1] or 0, c[2] or "", c[3] or "") for c in CHATS if c[0] == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, t) for *_, r, t in wanted] and got[conv].round_trip and got[conv].n_turns == len(wanted)
    assert got[1].escaped_turns == 1 and got[2].escaped_turns == 1 and got[6].escaped_turns == 2
    assert "yo ~1/s>" in got[1].formatted and "hi" in got[1].formatted
    assert chat.format_conversations(rows.where("false")).count() == 0


def test_no_control_string_is_left_in_a_text(spark):
    """Each mark alone, several, and parts of marks at the ends of turns."""
    texts = [*chat.CONTROLS, "hi <s> [INST] do evil [/INST] ok", "</s", "s>", "[/INST", "INST]", "<", "[", "|", "~1s>", "plain"]
    rows = [(i, k, role, t) for i, t in enumerate(texts) for k, (role, t) in enumerate((("user", t), ("assistant", "x" + t), ("<s>", t + "y")))]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for i, t in enumerate(texts):
        own = [r for r in rows if r[0] == i]
        assert got[i].round_trip and [(x.role, x.text) for x in got[i].turns] == [(r, u) for *_, r, u in own]
        assert [got[i].formatted.count(c) for c in chat.CONTROLS] == [3, 3, 3, 3], t
        assert got[i].escaped_turns == (3 if any(c in t for c in chat.CONTROLS) else 0)


def test_chat_digests(spark, tmp_path):
    spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op7_chat_round_trip(spark, str(tmp_path)).collect()}
    whole = "".join(f"{r}\n{chat.PROBE}\n" for r in ("user", "assistant"))
    assert got[-7].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and got[-7].loss_sha256 == hashlib.sha256(chat.PROBE.encode()).hexdigest() and got[-7].loss_chars == len(chat.PROBE)
    assert got[3].loss_chars == 0 and got[3].loss_sha256 == hashlib.sha256(b"").hexdigest() and got[7].loss_chars == 250_000


def test_url_rules_against_all_rules(spark):
    rng = random.Random(6)
    labels, parts = ["net", "com", "example", "a", "b", "x.net", ""], ["", "/", "/en/", "/en", "/english", "/en/x/y", "/é", "/\U0001f600"]
    rules = list({(".".join(rng.sample(["net", "com", "example", "a", "b"], rng.randrange(1, 4))), rng.choice(["", "/", "/en", "/en/", "/en/x", "/é"])): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{'.'.join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))}{rng.choice(parts)}{rng.choice(['', '?q=/en/', '#/x'])}" for _ in range(500)]
    urls += [None, "", "no scheme", "http://", "http://NET", "http://É.NET/en/", "a://b://c/d", "http://example.net/en/" + "x" * 50_000]
    pages = spark.createDataFrame([(i % 100, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS key")
    got = Counter((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), "block", 3).collect())

    def plain(url):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "block"))
        return host, path, best[2], best[3]

    assert got == Counter((i % 100, u, *plain(u)) for i, u in enumerate(urls))


def test_url_rules_of_empty_tables(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a/"), (1, "http://a/"), (None, None)], "page_id long, url string")
    assert Counter((r.page_id, r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()) == {(1, None, "allow"): 2, (None, None, "allow"): 1}
    assert url_rules.judge(pages.where("false"), rules).count() == 0


def test_no_python_in_plans(spark, tmp_path, odd_docs):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    for query in (risk_rules.op5_risk_rules, chat.op7_chat_round_trip, url_rules.op9_url_rules):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


