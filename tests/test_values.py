import random
import re
from calendar import monthrange
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from triago import fixed
from triago.functions import masking, naming, text, values

YEARS, REF = (1931, 1987, 2003, 2024, 2027), 2026


def written_dates():
    """Days of several years in every form that the rules know, with the day they stand for; then what has none."""
    out = []
    for k, (spelling, month) in enumerate(fixed.MONTHS.items()):
        d = date(YEARS[k % len(YEARS)], month, 1 + 7 * k % 28)
        sep, short = "/-."[k % 3], f"{d.year % 100:02}"
        century = d.replace(year=d.year % 100 + (2000 if d.year % 100 + 2000 <= REF + 1 else 1900))
        forms = [(f"{d.day}{'er' if d.day == 1 else ''} {spelling}{'.' * (k % 2)} {d.year}", d), (f"{d.day} {spelling.upper()} {d.year}", d), (f"{d.day:02}{sep}{month:02}{sep}{d.year}", d), (f"{d.day}{sep}{month}{sep}{d.year}", d)]
        forms += [(d.isoformat(), d), (f"fait en ville, le {d.day:02}/{month:02}/{d.year}", d), (f"{d.day:02}{sep}{month:02}{sep}{short}", century)]
        out += [(t, x.isoformat()) for t, x in forms]
        out += [(f"{monthrange(d.year, month)[1] + 1}/{month}/{d.year}", None), (f"{d.day}/{month + 12}/{d.year}", None), (f"{d.day} {spelling}x {d.year}", None)]
        out += [(f"{d.day:02}/{month:02}/{d.year} - {d.day:02}/{month:02}/{d.year + 1}", None), (f"{d.day}/{month}/{1700 + k}", None)]
    return [*out, ("sans date", None), ("", None), ("\t", None), (None, None)]


def written_amounts():
    """Numbers of several sizes under every pair of separators and with every currency, with their value; then what can't
    be read."""
    out = []
    for k, number in enumerate(("0.75", "7.5", "86", "940.20", "3207.08", "58410.6", "905333.41", "72004118.09")):
        whole, _, cents = number.partition(".")
        for group, decimal in ((" ", ","), (".", ","), (",", "."), ("\u00a0", ","), ("\u202f", ","), ("", ","), ("", ".")):
            shown = f"{int(whole):,}".replace(",", group) + (decimal + cents if cents else "")
            out += [(shown, number), (f"-{shown}", f"-{number}"), (shown + ("", " DH", " mad", " Dhs", " €", "\u00a0DH")[k % 6], number)]
        if len(whole) == 4:
            out += [(f"{whole[0]}{sep}{whole[1:]}", None) for sep in ",."]
        if len(whole) > 4:
            out += [(f"{whole[:2]},{whole[2:4]}.{whole[4:]},0", None), (f"{whole[:2]} {whole[2:4]} {whole[4:]}", None), (f"{whole[:-1]},{whole[-1]},1", None), (f"{whole} DH {k}5", None), (f"{whole},", None)]
    return [*out, ("néant", None), ("", None), (None, None)]


DATES, AMOUNTS = written_dates(), written_amounts()


def rows(spark, pairs, column):
    return spark.createDataFrame(pairs, "t string, e string").select("t", "e", column.alias("got")).collect()


def test_dates(spark):
    got = rows(spark, DATES, values.date_value(F.col("t"), REF))
    assert [(r.t, r.got.value) for r in got] == DATES
    alerts = dict(r.got.alerts and (r.t, r.got.alerts) or (r.t, []) for r in got)
    assert alerts["1/1/1700"] == [fixed.YEAR_RANGE] and alerts["sans date"] == [fixed.NO_DATE] and alerts[None] == alerts[""] == alerts["\t"] == []
    for t, day in DATES:
        if t and " - " in t:
            assert alerts[t] == [fixed.MANY_DATES], t
        elif day and re.fullmatch(r"\d\d[/.-]\d\d[/.-]\d\d", t):
            assert alerts[t] == [fixed.SHORT_YEAR], t
        elif day:
            assert alerts[t] == [], t


def test_amounts(spark):
    got = rows(spark, AMOUNTS, values.amount_value(F.col("t")))
    assert [(r.t, r.got.value) for r in got] == [(t, None if e is None else Decimal(e)) for t, e in AMOUNTS]
    alerts = {r.t: r.got.alert for r in got}
    assert alerts["3,207"] == alerts["3.207"] == fixed.AMBIGUOUS and alerts["5841,0,1"] == fixed.MIXED_SEPARATORS and alerts["néant"] == fixed.NO_AMOUNT and alerts[""] is None


def written_totals():
    """(net, taxes, gross, status, gap): sums of several tax lines that meet, miss by a cent, or miss by more; then what lacks."""
    out = []
    for k, net in enumerate((Decimal("83.10"), Decimal("4417.55"), Decimal("920006"))):
        taxes = [(net * rate / 100).quantize(Decimal("0.01")) for rate in (20, 14, 10, 7)[: k + 1]]
        for off in (Decimal(0), Decimal("0.01"), Decimal("-0.01"), Decimal("0.02"), Decimal(-30 * k - 5)):
            out.append((net, taxes, net + sum(taxes) - off, "ok" if abs(off) <= Decimal("0.01") else "gap", off))
        out += [(net, [], net, "ok", Decimal(0)), (net, [None], net - 7, "gap", Decimal(7)), (None, taxes, net, "missing", None), (net, taxes, None, "missing", None)]
    return out


def test_totals(spark):
    cases = written_totals()
    d = values.DECIMAL
    row = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, n decimal(18,2), t array<decimal(18,2)>, g decimal(18,2)")
    got = {r.i: r.x for r in row.select("i", values.totals_check(F.col("n").cast(d), F.col("t").cast(f"array<{d}>"), F.col("g").cast(d)).alias("x")).collect()}
    for i, (net, taxes, gross, status, gap) in enumerate(cases):
        untaxed = not [t for t in taxes if t is not None]
        said = {"ok": [fixed.TOTALS_NO_TAX] * untaxed, "missing": [fixed.TOTALS_MISSING]}.get(status, [f"{fixed.TOTALS_NO_TAX_GAP if untaxed else fixed.TOTALS_GAP} (ecart de {gap if gap is None else gap.quantize(Decimal('0.01'))})"])
        assert (got[i].status, got[i].gap, got[i].alerts, got[i].review) == (status, gap, said, status != "ok"), (net, taxes, gross)


def test_folding_matches_unicode(spark):
    samples = ["Diplôme ÉTÉ à Fès", "Straße ﬁn ½ ŉ", "ÇÀÉÎÕÜ œ Æ ß", "Ǆ ij", "e\u0301", "ﻓﺎﺗﻮرة", "x😀É"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in samples], "t string").select(text.fold(F.col("t"))).collect()]
    assert got == [text.folded(s) for s in samples]
    kept = [r[0] for r in spark.createDataFrame([(s,) for s in samples], "t string").select(text.fold_line(F.col("t"))).collect()]
    assert [len(k) for k in kept] == [len(s) for s in samples] and kept[0] == "diplome ete a fes"


def test_title_zone_and_budget(spark):
    whole = "\n".join(["", "  "] + [f" line {i} " for i in range(30)])
    row = spark.createDataFrame([(whole,)], "t string").select(text.title_zone(F.col("t")).alias("z"), text.truncated(F.col("t"), F.lit(60)).alias("c")).first()
    assert row.z == "\n".join(f"line {i}" for i in range(15))
    assert row.c.truncated and row.c.text.endswith(fixed.TRUNCATED) and len(row.c.text) <= 60
    assert text.char_budget("x" * 1000, 2048) == int((2048 - 400 - 400) * 2.5) and text.char_budget("x" * 9000, 2048) == 0


def secrets():
    """(text, what must not be seen of it) for each kind of secret, with drawn digits and every separator of its kind."""
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    out = []
    for k in range(12):
        sep = (" ", ".", "-", "")[k % 4]
        pairs = [digits(2) for _ in range(4)]
        card, account, gap = digits(6), digits(24), ("", " ")[k % 2]
        out += [(f"{word} {'ptu'[k % 3]}{'' if k % 2 else ' '}{card}", card) for word in ("CIN :", "c.i.n n°", "Carte nationale numéro", "CNIE no.", "carte nationale d'identité électronique :")]
        out += [(f"joindre le 0{5 + k % 3}{sep}{sep.join(pairs)} avant midi", sep.join(pairs[1:])), (f"(+212{gap}{5 + k % 3}{sep}{sep.join(pairs)})", sep.join(pairs[1:])), (f"00212{5 + k % 3}{sep}{sep.join(pairs)}", sep.join(pairs[1:]))]
        out += [(f"compte {gap.join(account)} clos", gap.join(account[4:20])), (f"MA{digits(2)}{gap}{gap.join(account)}", gap.join(account[4:20])), (f"dossier{' '}{digits(8 + k)}", "dossier ~"), (f"écrire à u{card}.x+{k}@boite-{k}.{('org', 'co.ma')[k % 2]}", f"u{card}")]
    return out


def test_masking(spark):
    hidden = secrets()
    plain = [f"lot {n} sur {n * 7}, total {n * 113 % 9999},50 DH le {n:02}/11/2019" for n in range(1, 9)] + ["Le cinquième carton, vaccin inclus", "maison MA 12, 123 4567", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in [*(t for t, _ in hidden), *plain]], "t string").select(masking.mask_text(F.col("t"))).collect()]
    for (t, secret), g in zip(hidden, got, strict=False):
        assert secret not in g and fixed.MASK in g and g.split(fixed.MASK)[0] == t[: len(g.split(fixed.MASK)[0])], (t, g)
    assert got[len(hidden) :] == plain
    assert spark.range(1).select(masking.mask_text(F.lit(None).cast("string"))).first()[0] == ""


def test_displayed_paths(spark):
    pairs = []
    for k, c in enumerate(fixed.REGISTRY["categories"]):
        root, single = fixed.SAFE_FOLDERS[k % 2].title(), c["name"].rstrip("s")
        pairs += [(f"{root}/{c['folder']}/{single}_karim_{k}.JSON", f"{root}/{c['folder']}/{single}_***_{k}.json"), (f"/srv/lot{k}/{root}/mon reçu {k}.docx", None)]
        pairs += [(f"{root}/{c['folder']}/{s['name']}/{single}_{s['name'].lower()}_une_autre.pdf", f"{root}/{c['folder']}/{s['name']}/{single}_{s['name'].lower()}_***.pdf") for s in c["subfolders"]]
    for t, got in ((r.t, r.got) for r in rows(spark, pairs, masking.displayed_path(F.col("t"), fixed.REGISTRY))):
        wanted = dict(pairs)[t]
        assert got == wanted if wanted else (fixed.STARS in got and "mon" not in got and "lot" not in got and got.endswith(".docx")), (t, got)


def test_names(spark):
    pairs = [("Société  Exemple, S.A.R.L.", "societe_exemple_s_a_r_l"), ("--É/É--", "e_e"), ("???", "")]
    assert [(r.t, r.got) for r in rows(spark, pairs, naming.clean_part(F.col("t")))] == pairs
    pairs = [("Bulletin de Paie", "bulletin_de_paie"), ("Autres", ""), ("2024 relevé", "releve"), (None, ""), ("x" * 50, "x" * 40)]
    assert [(r.t, r.got) for r in rows(spark, pairs, naming.proposed_name(F.col("t")))] == pairs
    got = spark.createDataFrame([("con",), ("",), ("ok",)], "b string").select(naming.safe_base(F.col("b"))).collect()
    assert [r[0] for r in got] == ["con_doc", "document", "ok"]
    assert naming.keyword_pattern("Bulletin de paie") == r"\bbulletin\s+de\s+paie\b" and naming.keyword_pattern("l'avis n°") == r"\bl.avis\s+n.\b"
    with pytest.raises(ValueError):
        naming.keyword_pattern("!!!")
    long = spark.range(1).select(naming.shortened(F.lit("a" * 300), F.lit("f" * 100), [".json"]).alias("b"), naming.shortened(F.lit("a"), F.lit("f" * 255), [".json"]).alias("n")).first()
    assert len(long.b) == 259 - 100 - 1 - 5 - 4 and long.n is None
