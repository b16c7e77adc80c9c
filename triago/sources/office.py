"""Word and Excel files by the standard library (both are zip archives of XML), and the dispatch by extension.

Readers for PDF, images and old Excel need libraries that are not part of this package: pass a function for their
extensions. A reader never raises; what can't be read is marked with a reason.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import date, datetime, time, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from triago import fixed

# XML names of the office formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}

Read = tuple[str, int, str, list[str]]  # text, pages, method, alerts
READ = "text string, n_pages int, method string, unreadable boolean, alerts array<string>"


def _paragraph(p: ElementTree.Element) -> str:
    """A paragraph's own text; text boxes inside it are read elsewhere."""
    out: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        for x in e:
            if x.tag in (f"{W}txbxContent", f"{W}pPr"):
                continue
            if x.tag == f"{W}t":
                out.append(x.text or "")
            elif x.tag == f"{W}tab":
                out.append("\t")
            elif x.tag in (f"{W}br", f"{W}cr"):
                out.append("\n")
            else:
                walk(x)

    walk(p)
    return "".join(out).strip()


def _blocks(part: ElementTree.Element) -> list[str]:
    """Paragraphs and tables in order; a table's rows with cells apart, merged cells once."""
    out = []
    for e in part:
        if e.tag == f"{W}p":
            out.append(_paragraph(e))
        elif e.tag == f"{W}tbl":
            for row in e.iter(f"{W}tr"):
                cells = []
                for cell in row.findall(f"{W}tc"):
                    merge = cell.find(f"{W}tcPr/{W}vMerge")
                    if merge is None or merge.get(f"{W}val") == "restart":
                        cells.append("\n".join(_paragraph(p) for p in cell.findall(f"{W}p")).strip())
                out.append(fixed.CELL_SEPARATOR.join(c for c in cells if c))
    return [x for x in out if x]


def _boxes(part: ElementTree.Element) -> list[str]:
    """Text boxes; the format often stores them twice."""
    return list(dict.fromkeys(t for box in part.iter(f"{W}txbxContent") for p in box.iter(f"{W}p") if (t := _paragraph(p))))


def read_word(content: bytes) -> Read:
    """Headers, the body with its text boxes, footers; repeated headers and footers count once. Templates are read like
    documents."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        parts = lambda kind: [ElementTree.fromstring(z.read(n)) for n in sorted(names) if re.fullmatch(rf"word/{kind}\d*\.xml", n)]
        around = lambda kind: list(dict.fromkeys(x for p in parts(kind) for x in _blocks(p) + _boxes(p)))
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        lines = around("header") + _blocks(body) + _boxes(body) + around("footer")
    return "\n".join(lines), 1, "xml", []


def cell_text(value: object) -> str:
    """A cell as text: dates in ISO form (with the time unless it is midnight), whole numbers without decimals."""
    if isinstance(value, bool):
        return "VRAI" if value else "FAUX"
    if isinstance(value, datetime):
        return value.date().isoformat() if value.time() == time() else value.strftime("%Y-%m-%d %H:%M")
    if isinstance(value, (date, time)):
        return value.isoformat()
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value).strip()


def _is_date(code: int, formats: dict[int, str]) -> bool:
    plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", formats.get(code, ""))
    return code in DATE_FORMATS or bool(re.search("[dmyhs]", plain.lower()) and "general" not in plain.lower())


def read_xlsx(content: bytes) -> Read:
    """All sheets: a title line, then rows with something in them. Formulas give their stored values."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        load = lambda n: ElementTree.fromstring(z.read(n))
        strings = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in load("xl/sharedStrings.xml").findall(f"{S}si")] if "xl/sharedStrings.xml" in names else []
        styles = load("xl/styles.xml") if "xl/styles.xml" in names else ElementTree.Element("none")
        formats = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{S}numFmt")}
        cell_formats = [int(x.get("numFmtId", 0)) for x in (styles.find(f"{S}cellXfs") if styles.find(f"{S}cellXfs") is not None else [])]
        book = load("xl/workbook.xml")
        epoch = datetime(1904, 1, 1) if (pr := book.find(f"{S}workbookPr")) is not None and pr.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        targets = {r.get("Id"): r.get("Target") for r in load("xl/_rels/workbook.xml.rels")}

        def value(c: ElementTree.Element) -> object:
            kind, v = c.get("t", "n"), c.find(f"{S}v")
            if kind == "inlineStr":
                return "".join(t.text or "" for t in c.iter(f"{S}t"))
            if v is None or v.text is None:
                return None
            if kind == "s":
                return strings[int(v.text)]
            if kind == "b":
                return v.text == "1"
            if kind in ("str", "e"):
                return v.text
            number = float(v.text)
            style = int(c.get("s", 0))
            dated = style < len(cell_formats) and _is_date(cell_formats[style], formats)
            return epoch + timedelta(seconds=round(number * 86400)) if dated else number

        blocks, sheets = [], book.find(f"{S}sheets")
        for sheet in sheets:
            target = targets[sheet.get(f"{R}id")]
            root = load(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            rows = [[t for c in row.findall(f"{S}c") if (v := value(c)) is not None and (t := cell_text(v))] for row in root.iter(f"{S}row")]
            lines = [fixed.CELL_SEPARATOR.join(r) for r in rows if r]
            if lines:
                blocks.append("\n".join([f"[Feuille : {sheet.get('name')}]", *lines]))
        return fixed.PAGE_SEPARATOR.join(blocks), len(sheets), "xml", []


READERS: dict[str, Callable[[bytes], Read]] = {".docx": read_word, ".dotx": read_word, ".xlsx": read_xlsx}


def read_file(name: str, content: bytes, readers: dict[str, Callable[[bytes], Read]] = READERS) -> tuple[str, int, str, bool, list[str]]:
    """text, pages, method, unreadable, alerts of one file; never raises."""
    ext = m[0].lower() if (m := re.search(r"(?<=[^/.])\.[^./]+$", name)) else ""
    if ext not in readers:
        known = f"lecteur absent pour {ext}" if ext in fixed.EXTENSIONS else f"format inconnu ({ext or 'sans extension'})"
        return "", 0, "", True, [known]
    try:
        text, pages, method, alerts = readers[ext](content)
    except Exception as error:  # any damage makes a file unreadable, and only that file
        return "", 0, "", True, [f"fichier corrompu ou protege ({type(error).__name__})"]
    return text, pages, method, False, alerts if text.strip() else [*alerts, "aucun texte extrait"]


def extracted_text(files: DataFrame, readers: dict[str, Callable[[bytes], Read]] | None = None) -> DataFrame:
    """(path, text, n_pages, method, unreadable, alerts) of (path, content) rows, as the binaryFile source gives them."""
    own = READERS | (readers or {})

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *read_file(path, content, own)) for path, content in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", *(x.split()[0] for x in READ.split(", "))])

    return files.select("path", "content").mapInPandas(task, f"path string, {READ}")
