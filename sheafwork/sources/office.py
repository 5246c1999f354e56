"""Office files, read from and written to their bytes: a package is a zip of XML parts."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.formats import BUILT_IN, DATES, shown
from ..functions.names import EXTENSION, distinct, made_safe

RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
ON = (None, "1", "true", "on")


def name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def value(e: ET.Element | None, key: str = "val") -> str | None:
    """An attribute, whatever its namespace."""
    return None if e is None else next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == key), None)


def every(e: ET.Element | None, *names: str) -> Iterator[ET.Element]:
    return (x for x in (e.iter() if e is not None else ()) if name(x) in names)


def first(e: ET.Element | None, n: str) -> ET.Element | None:
    return next(every(e, n), None)


class Package:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def part(self, path: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(path)) if path in self.names else None

    def relations(self, path: str) -> dict[str, str]:
        """Ids to the paths of a part's relations within the package."""
        folder, file = posixpath.split(path)
        out = {}
        for e in every(self.part(f"{folder}/_rels/{file}.rels".lstrip("/")), "Relationship"):
            target = e.get("Target", "")
            if e.get("Id") and target and not re.match("(?i)[a-z]+:", target):
                out[e.get("Id")] = target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        return out


def run_text(run: ET.Element) -> str:
    """Words, tabs as four spaces, breaks as newlines, page breaks as form feeds."""
    out = []
    for e in run:
        if name(e) == "t":
            out.append(e.text or "")
        elif name(e) == "tab":
            out.append("    ")
        elif name(e) == "br":
            out.append("\f" if value(e, "type") == "page" else "\n")
    return "".join(out)


def word_rows(data: bytes) -> Iterator[tuple]:
    """(kind, level, row, col, text): paragraphs, headings, list items and the cells of tables, in order."""
    body = first(Package(data).part("word/document.xml"), "body")
    text = lambda p: "".join(map(run_text, every(p, "r")))
    for e in body if body is not None else ():
        if name(e) == "p":
            style = value(first(e, "pStyle")) or ""
            heading = re.fullmatch(r"(?i)Heading(\d)|(Title)", style)
            level = int(heading[1] or 1) if heading else 0
            kind = "heading" if heading else "item" if first(e, "numPr") is not None else "para"
            yield kind, level, None, None, ("\f" if value(first(e, "pageBreakBefore")) in ON and first(e, "pageBreakBefore") is not None else "") + text(e)
        elif name(e) == "tbl":
            for r, row in enumerate(x for x in e if name(x) == "tr"):
                for c, cell in enumerate(x for x in row if name(x) == "tc"):
                    yield "cell", 0, r, c, "\n".join(text(p) for p in every(cell, "p"))


def slide_rows(data: bytes) -> Iterator[tuple]:
    """(slide, nth, kind, text): the paragraphs of each slide's shapes and the cells of its tables, slides in their order."""
    package = Package(data)
    paths = package.relations("ppt/presentation.xml")
    for n, e in enumerate(every(package.part("ppt/presentation.xml"), "sldId"), 1):
        slide = package.part(paths.get(e.get(RELATION + "id"), ""))
        cells = {p for c in every(slide, "tc") for p in every(c, "p")}
        for nth, p in enumerate(every(slide, "p"), 1):
            text = "".join("\n" if name(x) == "br" else x.text or "" for x in every(p, "t", "br"))
            if text.strip():
                yield n, nth, "cell" if p in cells else "para", text


def position(ref: str | None) -> tuple[int, int]:
    """(row, col) of a reference, from 0."""
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref or "")
    if not m:
        return 0, 0
    col = 0
    for c in m[1]:
        col = 26 * col + ord(c) - 64
    return int(m[2]) - 1, col - 1


def day(serial: float, from_1904: bool) -> str:
    stamp = datetime(1899, 12, 30) + timedelta(days=serial + (1462 if from_1904 else 0))
    return stamp.strftime("%Y-%m-%d" if serial % 1 == 0 else "%Y-%m-%d %H:%M")


def plain(number: float) -> str:
    """Without the noise of binary fractions."""
    return f"{round(number, 10):.15g}"


def sheet_rows(data: bytes) -> Iterator[tuple]:
    """(sheet, name, row, col, text, numeric): the cells of a workbook as they are shown. Formulas stand with their last
    results; hidden rows and columns and what merged cells cover are left out."""
    package = Package(data)
    workbook = package.part("xl/workbook.xml")
    paths = package.relations("xl/workbook.xml")
    from_1904 = value(first(workbook, "workbookPr"), "date1904") in ("1", "true")
    shared = ["".join(t.text or "" for t in every(si, "t")) for si in every(package.part("xl/sharedStrings.xml"), "si")]
    styles = package.part("xl/styles.xml")
    own = {int(value(f, "numFmtId")): value(f, "formatCode") for f in every(styles, "numFmt")}
    xfs = first(styles, "cellXfs")
    ids = [int(value(x, "numFmtId") or 0) for x in (xfs if xfs is not None else ()) if name(x) == "xf"]
    codes = [(own.get(i, BUILT_IN.get(i, "")), i) for i in ids]
    dated = [i in DATES or bool(re.search("(?i)[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", c))) for c, i in codes]
    for n, e in enumerate(every(workbook, "sheet")):
        sheet = package.part(paths.get(e.get(RELATION + "id"), ""))
        hidden = {k for c in every(sheet, "col") if value(c, "hidden") == "1" for k in range(int(value(c, "min")) - 1, int(value(c, "max")))} if sheet is not None else set()
        covered = set()
        for m in every(sheet, "mergeCell"):
            (r0, c0), (r1, c1) = map(position, (value(m, "ref") or "").partition(":")[::2])
            covered |= {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)} - {(r0, c0)}
        for row in every(sheet, "row"):
            if value(row, "hidden") == "1":
                continue
            for c in every(row, "c"):
                at = position(value(c, "r")) if value(c, "r") else (int(value(row, "r") or 1) - 1, 0)
                kind, style, v = value(c, "t") or "n", int(value(c, "s") or -1), first(c, "v")
                raw, text, numeric = (v.text or "" if v is not None else ""), "", False
                if kind == "s":
                    text = shared[int(raw)] if raw.isdecimal() and int(raw) < len(shared) else ""
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in every(c, "t"))
                elif kind == "b":
                    text = "TRUE" if raw == "1" else "FALSE"
                elif kind in ("e", "str") or not re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", raw):
                    text = raw
                elif 0 <= style < len(dated) and dated[style]:
                    text = day(float(raw), from_1904)
                else:
                    numeric = True
                    text = (shown(float(raw), codes[style][0]) if 0 <= style < len(codes) else None) or plain(float(raw))
                if text and at not in covered and at[1] not in hidden:
                    yield n, e.get("name"), *at, text, numeric


READERS = {
    "docx": (word_rows, "kind string, level long, row long, col long, text string"),
    "pptx": (slide_rows, "slide long, nth long, kind string, text string"),
    "xlsx": (sheet_rows, "sheet long, name string, row long, col long, text string, numeric boolean"),
}


def read(files: DataFrame, kind: str) -> DataFrame:
    """file, error and the rows of each file (file, content); one row with the error for a file that can't be read."""
    reader, schema = READERS[kind]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch.file, batch.content):
                try:
                    rows = [(file, None, i, *r) for i, r in enumerate(reader(bytes(content)))]
                except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, TypeError) as e:
                    rows = [(file, type(e).__name__, 0, *[None] * len(names))]
                out = pd.DataFrame(rows, columns=["file", "error", "ord", *names])
                yield out.astype({c: "Int64" for c in names if f"{c} long" in schema})

    return files.select("file", "content").mapInPandas(run, f"file string, error string, ord long, {schema}")


CONTENT = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: The formats of written cells, in the order of their styles.
WRITTEN = {"general": 0, "decimal": 4, "thousands": 3, "percent": 9, "date": 14, "text": 49}


def letters(col: int) -> str:
    out = ""
    while col >= 0:
        out, col = chr(65 + col % 26) + out, col // 26 - 1
    return out


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, text in parts.items():
            z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), CONTENT + text)
    return out.getvalue()


def escaped(text: str) -> str:
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def workbook(sheets: list[tuple[str, list[tuple[int, int, str | None, float | None, str]]]]) -> bytes:
    """A workbook of sheets (name, cells of row, col, text, number, format); the first row stays in view."""
    parts = {}
    kinds = [("/xl/workbook.xml", "sheet.main"), ("/xl/styles.xml", "styles")]
    for n, (_, cells) in enumerate(sheets, 1):
        rows: dict[int, list[str]] = {}
        for r, c, text, number, form in sorted(cells, key=lambda x: x[:2]):
            at, style = f"{letters(c)}{r + 1}", list(WRITTEN).index(form if form in WRITTEN else "general")
            body = f'<c r="{at}" s="{style}"><v>{number!r}</v></c>' if number is not None else f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escaped(text or "")[:32767]}</t></is></c>'
            rows.setdefault(r, []).append(body)
        view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
        data = "".join(f'<row r="{r + 1}">{"".join(c)}</row>' for r, c in rows.items())
        parts[f"xl/worksheets/sheet{n}.xml"] = f'<worksheet xmlns="{MAIN}">{view}<sheetData>{data}</sheetData></worksheet>'
        kinds.append((f"/xl/worksheets/sheet{n}.xml", "worksheet"))
    listed = "".join(f'<sheet name="{escaped(s)}" sheetId="{n}" r:id="s{n}"/>' for n, (s, _) in enumerate(sheets, 1))
    xfs = "".join(f'<xf numFmtId="{i}" applyNumberFormat="1"/>' for i in WRITTEN.values())
    relation = lambda i, kind, to: f'<Relationship Id="{i}" Type="{OFFICE}/{kind}" Target="{to}"/>'
    types = "".join(f'<Override PartName="{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for p, k in kinds)
    parts |= {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships">{relation("r1", "officeDocument", "xl/workbook.xml")}</Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">{"".join(relation(f"s{n}", "worksheet", f"worksheets/sheet{n}.xml") for n in range(1, len(sheets) + 1))}{relation("styles", "styles", "styles.xml")}</Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{listed}</sheets></workbook>',
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><fonts><font/></fonts><fills><fill/></fills><borders><border/></borders><cellXfs>{xfs}</cellXfs></styleSheet>',
    }
    return zipped(parts)


def document(blocks: list[tuple[str, int, str]]) -> bytes:
    """A text document of blocks (kind, level, text): headings, list items, paragraphs, and tables (cells by tabs, rows by
    newlines)."""
    main = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escaped(t)}</w:t></w:r>'
    para = lambda t, p="": f"<w:p>{f'<w:pPr>{p}</w:pPr>' if p else ''}{'<w:r><w:br/></w:r>'.join(map(run, t.split(chr(10))))}</w:p>"
    body = []
    for kind, level, text in blocks:
        if kind == "table":
            rows = ("".join(f"<w:tc>{para(c)}</w:tc>" for c in r.split("\t")) for r in text.split("\n"))
            body.append(f"<w:tbl>{''.join(f'<w:tr>{r}</w:tr>' for r in rows)}</w:tbl>")
        else:
            style = f'<w:pStyle w:val="Heading{level}"/>' if kind == "heading" else f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr>' if kind in ("item", "numbered") else ""
            body.append(para(text, style))
    return zipped({
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{main}"><w:body>{"".join(body)}</w:body></w:document>',
    })


def write_workbooks(cells: DataFrame) -> DataFrame:
    """file, content of the cells (file, sheet, name, row, col, text, number, format) of each workbook."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sheets = [(str(s["name"].iloc[0]), [(int(r), int(c), t, None if pd.isna(n) else float(n), f) for r, c, t, n, f in zip(s.row, s.col, s.text, s.number, s.format)]) for _, s in rows.groupby("sheet")]
        return pd.DataFrame({"file": [rows.file.iloc[0]], "content": [workbook(sheets)]})

    return cells.groupBy("file").applyInPandas(run, "file string, content binary")


def write_documents(blocks: DataFrame) -> DataFrame:
    """file, content of the blocks (file, ord, kind, level, text) of each document."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        return pd.DataFrame({"file": [rows.file.iloc[0]], "content": [document(list(zip(rows.kind, rows.level, rows.text)))]})

    return blocks.groupBy("file").applyInPandas(run, "file string, content binary")


def archives(files: DataFrame) -> DataFrame:
    """job, content: the files (job, ord, name, content) of each job as a zip that stores them as they are, no two names
    alike but for case."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("ord"), io.BytesIO()
        end = lambda n: (re.search(EXTENSION, n) or [None, ""])[1].lower()
        names = distinct(list(rows["name"]), lambda n: made_safe(n, end(n)), lambda n, k: made_safe(f"{k} - {re.sub(EXTENSION, '', n)}", end(n)))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for n, content in zip(names, rows.content):
                z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), bytes(content))
        return pd.DataFrame({"job": [rows.job.iloc[0]], "content": [out.getvalue()]})

    return files.groupBy("job").applyInPandas(run, "job long, content binary")
