"""A small packet with planted defects, made from scratch: for tests, demonstrations and the queries that need files."""

from __future__ import annotations

import io
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8"?>' + body)
    return out.getvalue()


def xlsx(sheets: dict[str, tuple[str, list[list]]]) -> bytes:
    """sheets: name to (state, rows); a cell is a number, a text, or a formula that begins with =."""
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" state="{state}" r:id="rId{k}"/>' for k, (n, (state, _)) in enumerate(sheets.items(), 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>",
    }
    for k, (_, rows) in enumerate(sheets.values(), 1):
        body = ""
        for y, row in enumerate(rows, 1):
            for x, v in enumerate(row):
                at = f"{chr(65 + x)}{y}"
                body += f'<c r="{at}"><f>{v[1:]}</f><v>0</v></c>' if isinstance(v, str) and v.startswith("=") else f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{at}"><v>{v}</v></c>'
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{s}"><sheetData>{body}</sheetData></worksheet>'
    return _zip(parts)


def docx(blocks: list) -> bytes:
    """Blocks: ("Heading1", text), text, or a table as a list of rows."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    body = ""
    for b in blocks:
        if isinstance(b, tuple):
            body += f'<w:p><w:pPr><w:pStyle w:val="{b[0]}"/></w:pPr>{run(b[1])}</w:p>'
        elif isinstance(b, list):
            body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in row) + "</w:tr>" for row in b) + "</w:tbl>"
        else:
            body += f"<w:p>{run(b)}</w:p>"
    return _zip({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'})


def pptx(slides: list[tuple[list[str], list[str], bool]]) -> bytes:
    """Slides: texts, notes, and whether there is a chart."""
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    page = lambda texts: f'<p xmlns:a="{a}">' + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in texts) + "</p>"
    parts = {}
    for k, (texts, notes, chart) in enumerate(slides, 1):
        parts[f"ppt/slides/slide{k}.xml"] = page(texts)
        kinds = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        related = [f'<Relationship Id="rId2" Type="{kinds}/notesSlide" Target="../notesSlides/notesSlide{k}.xml"/>'] if notes else []
        if notes:
            parts[f"ppt/notesSlides/notesSlide{k}.xml"] = page(notes)
        if chart:
            related.append(f'<Relationship Id="rId1" Type="{kinds}/chart" Target="../charts/chart{k}.xml"/>')
        parts[f"ppt/slides/_rels/slide{k}.xml.rels"] = f"<Relationships>{''.join(related)}</Relationships>"
    return _zip(parts)


#: What stands for brackets and backslashes in a PDF string.
ESCAPES = {40: r"\(", 41: r"\)", 92: r"\\"}


def pdf(pages: list[list[str]], flate: bool = True) -> bytes:
    """Pages of blocks; lines of a block are its line ends, blocks are set apart by an empty line."""
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{3 + 2 * k} 0 R' for k in range(len(pages)))}] >>"]
    out = [b"%PDF-1.4\n"] + [f"{n} 0 obj\n{o}\nendobj\n".encode() for n, o in enumerate(objects, 1)]
    for k, blocks in enumerate(pages):
        shown = "\n".join("\n".join(f"({line.translate(ESCAPES)}) Tj T*" for line in b.split("\n")) + " T*" for b in blocks)
        stream = f"BT\n{shown}\nET".encode("latin-1") if blocks else b""
        body = zlib.compress(stream) if flate else stream
        out.append(f"{3 + 2 * k} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * k} 0 R >>\nendobj\n".encode())
        out.append(f"{4 + 2 * k} 0 obj\n<< /Length {len(body)}{' /Filter /FlateDecode' if flate else ''} >>\nstream\n".encode() + body + b"\nendstream\nendobj\n")
    return b"".join(out) + b"%%EOF\n"


def packet() -> dict[str, bytes]:
    """File names and contents, with a defect of every kind that the rules look for."""
    model = [["item", "units", "total"], ["north", 3, "=B2*2"], ["south", 4, "=B3*2"], ["east", 5, 10], ["west", 6, "=B5*2"], ["sum", 18, "=C2+C3"], ["sum", 18, "=C2+C3"], ["sum", 18, "=C2+C3"]]
    return {
        "quarter-model.xlsx": xlsx({"Model": ("visible", model), "Old inputs": ("hidden", [["rate", 7]])}),
        "figures-final.csv": b"metric,value,as_of_date\nsales,120,2025-03-31\nchurn,4,2025-03-31\n",
        "figures-old.csv": b"metric,value,as_of_date\nrevenue,110,2025-01-31\nchurn,4,2025-01-31\n",
        "2025-04-02-answers-raw.csv": b"who,program,score\nA1,blue,3\nA2,green,4\n",
        "field-notes.md": b"# Notes\n\nVisitors described the northern branch as calmer than the southern branch.\n\nStaff said the queue never exceeds the waiting room.\n",
        "summary-draft.docx": docx([("Heading1", "Summary"), "Revenue reached 120 million in the first quarter across all branches.", [["branch", "share"], ["north", "40%"]]]),
        "board-deck.pptx": pptx([(["Northern branch revenue grew strongly last quarter"], ["Mention that churn stayed flat overall"], True)]),
        "2025-03-01-method.pdf": pdf([["1. Scope of the Study\nBranches   units   share", "Revenue figures follow the audited ledger [Ledger 12] for northern branches."]]),
        "scanned.pdf": pdf([[]]),
    }


def legal_packet() -> dict[str, bytes]:
    return {
        "task.md": b"# Task\n\nCourse: Property\n\nJurisdiction: Maine\n\nQuestion presented: Who owns a found ring?\n\nPrepare a short legal memo using only the supplied packet.\n",
        "finder-v-owner.md": b"# Finder v. Owner\n\n12 Me. 34\nPacket source date: 2025-02-03\n\nCourt of Appeals of Maine\n\nA finder holds a lost ring against everyone but its owner.\n",
        "memo-draft.md": b'# Memo\n\nPacket source date: 2025-02-04\n\nLEGAL-MAP [rule] source=finder-v-owner.md passage=passage_finder-v-owner_p0004 pin="para. 4" authority=binding: A finder holds a lost ring against everyone but its owner.\n\nLEGAL-DRAFT [rule]: A finder holds a lost ring against everyone but its owner.\n\nLEGAL-DRAFT [conclusion]: The finder should keep the ring for now.\n',
    }


def files(spark: SparkSession, contents: dict[str, bytes]) -> DataFrame:
    """What scanning a folder with these files gives."""
    rows = spark.createDataFrame([(n, len(b), bytearray(b)) for n, b in contents.items()], "name string, bytes long, content binary")
    rows = rows.withColumn("sha256", F.sha2("content", 256)).withColumn("ext", F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1)))
    return rows.withColumn("source_id", X.content_id("source", F.col("name"), F.col("sha256")))
