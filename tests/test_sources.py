import io
import zipfile
from datetime import date, datetime

from pyspark.sql import functions as F

from triago.sources import inbox, office
from triago.streaming import inbox as stream

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
SS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def p(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


WORD = packed({
    "word/header1.xml": f"<w:hdr {NS}>{p('Tête')}</w:hdr>", "word/header2.xml": f"<w:hdr {NS}>{p('Tête')}</w:hdr>",
    "word/document.xml": f"<w:document {NS}><w:body>{p('Un')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('')}"
    f"<w:p><w:r><w:t>Deux</w:t></w:r><w:r><w:txbxContent>{p('Boîte')}</w:txbxContent><w:txbxContent>{p('Boîte')}</w:txbxContent></w:r></w:p></w:body></w:document>",
    "word/footer1.xml": f"<w:ftr {NS}>{p('Pied')}</w:ftr>",
})
BOOK = packed({
    "xl/workbook.xml": f'<workbook {SS}><sheets><sheet name="Feuil" sheetId="1" r:id="r1"/><sheet name="Vide" sheetId="2" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {SS}><si><t>Total HT</t></si></sst>",
    "xl/styles.xml": f'<styleSheet {SS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": f'<worksheet {SS}><sheetData><row><c t="s"><v>0</v></c><c><v>1200</v></c><c><v>1.5</v></c></row><row/><row><c s="1"><v>46280</v></c><c s="1"><v>46280.5</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": f"<worksheet {SS}><sheetData/></worksheet>",
})


def test_word_and_excel():
    assert office.read_file("x.docx", WORD)[0] == "Tête\nUn\na | b\nDeux\nBoîte\nPied"
    text, pages, *_ = office.read_file("x.XLSX", BOOK)
    assert text == "[Feuille : Feuil]\nTotal HT | 1200 | 1.5\n2026-09-15 | 2026-09-15 12:00 | VRAI" and pages == 2


def test_unreadable_files():
    assert office.read_file("x.docx", b"no zip")[3:] == (True, ["fichier corrompu ou protege (BadZipFile)"])
    assert office.read_file("x.odt", b"")[4] == ["format inconnu (.odt)"] and office.read_file("noext", b"")[4] == ["format inconnu (sans extension)"]
    assert office.read_file("x.pdf", b"")[4] == ["lecteur absent pour .pdf"]
    empty = packed({"word/document.xml": f"<w:document {NS}><w:body>{p('')}</w:body></w:document>"})
    assert office.read_file("x.dotx", empty)[3:] == (False, ["aucun texte extrait"])


def test_cells():
    assert [office.cell_text(v) for v in (True, 1200.0, 1.5, date(2026, 1, 2), datetime(2026, 1, 2), datetime(2026, 1, 2, 3, 4), " x ")] == ["VRAI", "1200", "1.5", "2026-01-02", "2026-01-02", "2026-01-02 03:04", "x"]


def test_inbox_and_stream(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    for name, data in {"a.docx": WORD, "b.docx": WORD, "~$a.docx": b"x", "Thumbs.db": b"x", ".hid": b"x"}.items():
        (box / name).write_bytes(data)
    rows = inbox.inbox(spark, str(box))
    assert sorted(r[0].rsplit("/")[-1] for r in rows.select("path").collect()) == ["a.docx", "b.docx"]
    assert inbox.inbox(spark, str(tmp_path / "none")).count() == 0
    assert office.extracted_text(rows).where(F.col("text").contains("Boîte")).count() == 2
    seen = []
    run = lambda: stream.process_new(spark, str(box), str(tmp_path / "state"), lambda df, _: seen.extend(r.path for r in df.select("path").collect())).awaitTermination()
    run()
    assert len(seen) == 1
    (box / "c.docx").write_bytes(WORD)
    (box / "d.xlsx").write_bytes(BOOK)
    run()
    assert len(seen) == 2 and seen[1].endswith("d.xlsx")


def test_records_and_companions(spark, tmp_path):
    (tmp_path / "F").mkdir()
    (tmp_path / "F" / "x.json").write_text('{"type": "factures", "champs": {"a": "1"}}')
    (tmp_path / "F" / "bad.json").write_text("{")
    (tmp_path / "F" / "other.json").write_text('{"type": "x"}')
    got = inbox.records(spark, str(tmp_path), "type string, champs map<string, string>").collect()
    assert [r.type for r in got] == ["factures"]
    files = spark.createDataFrame([("d/x.json",), ("d/x.txt",), ("d/x.pdf",), ("d/y.json",), ("d/y_original.json",)], "path string")
    found = {r.stem: r for r in inbox.companions(files).collect()}
    assert (found["x"].txt, found["x"].original, found["y"].original, found["y"].txt) == ("d/x.txt", "d/x.pdf", "d/y_original.json", None)
    own = inbox.loaded(spark.createDataFrame([("d/x.json", "old"), ("d/y.json", "kept")], "path string, texte_brut string"), spark.createDataFrame([("d/x.txt", "new")], "path string, value string"))
    assert sorted((r.path, r.text) for r in own.collect()) == [("d/x.json", "new"), ("d/y.json", "kept")]
    names = inbox.accepted_uploads(spark.createDataFrame([("C:\\dir\\a.PDF",), ("b.exe",)], "name string")).collect()
    assert [(r.name, r.accepted) for r in names] == [("a.PDF", True), ("b.exe", False)]
