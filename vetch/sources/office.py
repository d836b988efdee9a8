"""Facts of one file's bytes: small parsers for formats that Spark doesn't read. Each yields (kind, page, ordinal, sheet, cell, text, formula)."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

Fact = tuple[str, int | None, int, str | None, str | None, str | None, str | None]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def cell_name(row: int, column: int) -> str:
    letters, n = "", column
    while n:
        n, rest = divmod(n - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row}"


def delimited(content: bytes, mark: str) -> Iterator[Fact]:
    rows = csv.reader(io.StringIO(content.decode("utf-8-sig", "replace")), delimiter=mark)
    for r, row in enumerate(rows, 1):
        for c, value in enumerate(row, 1):
            yield "cell", None, r, None, cell_name(r, c), value, None


def _joined(node: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def docx(content: bytes) -> Iterator[Fact]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    n = tables = 0
    for node in body if body is not None else ():
        if node.tag == f"{_W}p" and (text := _joined(node, f"{_W}t").strip()):
            n += 1
            style = node.find(f"{_W}pPr/{_W}pStyle")
            yield "heading" if style is not None and style.get(f"{_W}val", "").lower().startswith(("heading", "title")) else "paragraph", None, n, None, None, text, None
        elif node.tag == f"{_W}tbl":
            tables += 1
            for r, row in enumerate(node.iter(f"{_W}tr"), 1):
                for c, cell in enumerate(row.iter(f"{_W}tc"), 1):
                    n += 1
                    yield "table_cell", None, n, f"table{tables}", cell_name(r, c), _joined(cell, f"{_W}t").strip(), None


def _related(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """What a part refers to: by id, the last word of the relation's type and the part's path."""
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    nodes = ElementTree.fromstring(z.read(rels)) if rels in z.namelist() else ()
    target = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"{folder}/{t}")
    return {n.get("Id", ""): (n.get("Type", "").rpartition("/")[2], target(n.get("Target", ""))) for n in nodes}


def _slide_parts(z: zipfile.ZipFile) -> list[str]:
    """The slides as they are shown; without a list of them, by the numbers of their files."""
    main = "ppt/presentation.xml"
    if main in z.namelist():
        related, ids = _related(z, main), [n.get(f"{_R}id") for n in ElementTree.fromstring(z.read(main)).iter(f"{_P}sldId")]
        if shown := [related[i][1] for i in ids if i in related and related[i][1] in z.namelist()]:
            return shown
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
    return [n for _, n in sorted(found)]


def pptx(content: bytes) -> Iterator[Fact]:
    """Texts, notes and charts of the slides, which count from 1 in the order shown; notes are those that the slide refers to."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for number, slide in enumerate(_slide_parts(z), 1):
            related = list(_related(z, slide).values())
            notes = [path for kind, path in related if kind == "notesSlide" and path in z.namelist()]
            for kind, part in [("slide_text", slide), *[("slide_note", n) for n in notes]]:
                for n, p in enumerate(ElementTree.fromstring(z.read(part)).iter(f"{_A}p"), 1):
                    if text := _joined(p, f"{_A}t").strip():
                        yield kind, number, n, None, None, text, None
            for n, path in enumerate((path for kind, path in related if kind == "chart"), 1):
                yield "chart_reference", number, n, None, None, path, None


def xlsx(content: bytes) -> Iterator[Fact]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_joined(x, f"{_S}t") for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target", "").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for n, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"), 1):
            title = sheet.get("name")
            yield "sheet", None, n, title, None, sheet.get("state", "visible"), None
            path = f"xl/{targets.get(sheet.get(f'{_R}id'), '')}"
            for cell in ElementTree.fromstring(z.read(path)).iter(f"{_S}c") if path in names else ():
                value, formula, kind = cell.find(f"{_S}v"), cell.find(f"{_S}f"), cell.get("t")
                text = value.text if value is not None else _joined(cell, f"{_S}t") if kind == "inlineStr" else None
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                if text is not None or formula is not None:
                    row = int(re.sub(r"\D", "", cell.get("r", "0")) or 0)
                    yield "number" if kind in (None, "n") and formula is None else "cell", None, row, title, cell.get("r"), text, formula.text or "" if formula is not None else None


_LITERAL, _HEX = rb"\((?:[^()\\]|\\.)*\)", rb"<[0-9A-Fa-f\s]*>"
_SHOWN = re.compile(rb"(?:%b|%b)\s*(?:Tj|')|\[(?:%b|%b|[^\]()<])*\]\s*TJ|T\*|\bTd\b|\bTD\b|\bET\b" % (_LITERAL, _HEX, _LITERAL, _HEX), re.S)
_STRING = re.compile(rb"%b|%b" % (_LITERAL, _HEX), re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t"}


def _pdf_string(token: bytes) -> bytes:
    """The bytes of a literal or hexadecimal string. Two-byte codes, which need a font's table, give nothing."""
    if token.startswith(b"("):
        return re.sub(rb"\\(.)", lambda e: _ESCAPED.get(e[1], e[1]), token[1:-1], flags=re.S)
    digits = re.sub(rb"\s", b"", token[1:-1])
    codes = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return b"" if b"\0" in codes else codes


def _pdf_text(stream: bytes) -> str:
    out = []
    for m in _SHOWN.finditer(stream):
        strings = _STRING.findall(m[0])
        out.append(b"".join(map(_pdf_string, strings)) if strings else b"\n")
    return b"".join(out).decode("latin-1")


def _pdf_stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\nendstream", body, re.S)
    if not m:
        return b""
    if b"/FlateDecode" in body[: m.start()]:
        try:
            return zlib.decompress(m[1])
        except zlib.error:
            return b""
    return m[1]


def _pdf_objects(content: bytes) -> dict[int, bytes]:
    """The objects by number, those inside of object streams too."""
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+) 0 obj(.*?)endobj", content, re.S)}
    for body in list(objects.values()):
        first = re.search(rb"/First\s+(\d+)", body)
        if first and re.search(rb"/Type\s*/ObjStm\b", body):
            packed, start = _pdf_stream(body), int(first[1])
            heads = [int(x) for x in re.findall(rb"\d+", packed[:start])]
            places = list(zip(heads[::2], heads[1::2], strict=False))
            ends = [at for _, at in places[1:]] + [len(packed)]
            for (number, at), end in zip(places, ends, strict=True):
                objects.setdefault(number, packed[start + at : start + end if end < len(packed) else None])
    return objects


def _pdf_pages(objects: dict[int, bytes]) -> list[bytes]:
    """The pages in the order of the page tree; those of a file without one by their numbers."""
    is_page = lambda b: re.search(rb"/Type\s*/Page\b", b)
    catalog = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    root, pages, seen = re.search(rb"/Pages\s+(\d+) 0 R", catalog), [], set()
    todo = [int(root[1])] if root else []
    while todo:
        number = todo.pop()
        body = objects.get(number, b"")
        if number in seen:
            continue
        seen.add(number)
        if is_page(body):
            pages.append(body)
        elif kids := re.search(rb"/Kids\s*\[([^\]]*)\]", body):
            todo += [int(k) for k in reversed(re.findall(rb"(\d+) 0 R", kids[1]))]
    return pages or [b for _, b in sorted(objects.items()) if is_page(b)]


def pdf(content: bytes) -> Iterator[Fact]:
    """Blocks of simple text PDFs, by page: text operators of plain or Flate streams. What it can't read yields nothing."""
    objects = _pdf_objects(content)
    for page, body in enumerate(_pdf_pages(objects), 1):
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+ 0 R)", body)
        parts = [_pdf_stream(objects.get(int(r), b"")) for r in re.findall(rb"(\d+) 0 R", refs[1])] if refs else []
        blocks = [b.strip("\n") for b in re.split(r"\n\s*\n+", _pdf_text(b"\n".join(parts)))]
        for n, block in enumerate((b for b in blocks if b.strip()), 1):
            yield "page_paragraph", page, n, None, None, block, None


def text(content: bytes) -> Iterator[Fact]:
    body = content.decode("utf-8-sig", "replace").replace("\r\n", "\n")
    for n, block in enumerate((b.strip() for b in re.split(r"\n[ \t]*\n", body) if b.strip()), 1):
        yield "heading" if re.match(r"#{1,6}\s+\S", block) else "paragraph", None, n, None, None, block, None


READERS = {"csv": lambda b: delimited(b, ","), "tsv": lambda b: delimited(b, "\t"), "txt": text, "md": text, "docx": docx, "pptx": pptx, "xlsx": xlsx, "pdf": pdf}


def facts(ext: str, content: bytes) -> tuple[str, list[Fact]]:
    """How the file was inspected, and its facts: a file that can't be parsed is reported, not skipped."""
    if ext not in READERS:
        return "unsupported", []
    try:
        found = list(READERS[ext](content))
    except (KeyError, ValueError, IndexError, zipfile.BadZipFile, ElementTree.ParseError, csv.Error) as e:
        return f"unreadable: {type(e).__name__}", []
    return ("inspected" if found else "no text"), found
