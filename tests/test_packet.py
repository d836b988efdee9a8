import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from vetch.operators import inspection as I
from vetch.operators import workbook as W
from vetch.plans import sample
from vetch.sources import packet as P
from vetch.sources.office import cell_name, facts


@pytest.fixture(scope="module")
def inspected(spark):
    return P.inspect(sample.files(spark, sample.packet())).cache()


def test_formats(inspected):
    kinds = {(r["name"], r["kind"]) for r in inspected.select("name", "kind").distinct().collect()}
    assert {("summary-draft.docx", "heading"), ("summary-draft.docx", "table_cell"), ("board-deck.pptx", "slide_note"), ("board-deck.pptx", "chart_reference"), ("2025-03-01-method.pdf", "page_paragraph"), ("field-notes.md", "heading"), ("figures-old.csv", "cell"), ("quarter-model.xlsx", "sheet")} <= kinds
    assert ("scanned.pdf", None) in kinds
    how = {r["name"]: r["inspection"] for r in inspected.select("name", "inspection").distinct().collect()}
    assert how["scanned.pdf"] == "no text" and how["field-notes.md"] == "inspected"


def test_scan_reads_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a b.md").write_text("# T\n\nbody")
    (tmp_path / "x.bin").write_bytes(b"\0")
    rows = {r["name"]: r["inspection"] for r in P.inspect(P.scan(spark, str(tmp_path))).collect()}
    assert rows == {"deep/a b.md": "inspected", "x.bin": "unsupported"}


def test_damaged_files_are_reported():
    assert facts("xlsx", b"no zip")[0].startswith("unreadable") and facts("docx", b"")[1] == []
    assert facts("pdf", b"%PDF-1.4 garbage") == ("no text", []) and facts("zzz", b"") == ("unsupported", [])
    assert cell_name(3, 28) == "AB3"


def test_pdf_with_and_without_compression():
    for flate in (True, False):
        how, found = facts("pdf", sample.pdf([["First (1) block\nsecond line", "Other"], ["Page two"]], flate))
        assert [(f[1], f[5]) for f in found] == [(1, "First (1) block\nsecond line"), (1, "Other"), (2, "Page two")] and how == "inspected"


def test_pdf_of_packed_objects_in_the_order_of_its_tree():
    """Page 5 comes before page 4 in the tree; both are inside of an object stream, and their texts are hexadecimal and in arrays."""
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [5 0 R 3 0 R] >>", 3: b"<< /Type /Pages /Kids [4 0 R 2 0 R] >>", 4: b"<< /Type /Page /Contents 8 0 R >>", 5: b"<< /Type /Page /Contents [7 0 R] >>"}
    heads, body = [], b""
    for number, b in inner.items():
        heads.append(f"{number} {len(body)}")
        body += b + b" "
    head = " ".join(heads).encode() + b" "
    packed = zlib.compress(head + body)
    streams = {7: b"BT <48656C6C 6F> Tj T* [(a]b) -20 <63>] TJ ET", 8: b"BT (last\\) one) Tj <00480065> Tj ET"}
    out = b"%%PDF-1.5\n6 0 obj\n<< /Type /ObjStm /N 5 /First %d /Filter /FlateDecode >>\nstream\n%b\nendstream\nendobj\n" % (len(head), packed)
    out += b"".join(b"%d 0 obj\n<< >>\nstream\n%b\nendstream\nendobj\n" % x for x in streams.items())
    assert [(f[1], f[5]) for f in facts("pdf", out)[1]] == [(1, "Hello\na]bc"), (2, "last) one")]


def test_slides_in_the_order_shown_with_their_own_notes():
    """The first slide shown is file 2, whose notes are file 1."""
    p, a, r = (f"http://schemas.openxmlformats.org/{x}" for x in ("presentationml/2006/main", "drawingml/2006/main", "officeDocument/2006/relationships"))
    said = lambda t: f'<p xmlns:a="{a}"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p>'
    rels = lambda *x: "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{r}/{kind}" Target="{t}"/>' for i, kind, t in x) + "</Relationships>"
    parts = {
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{p}" xmlns:r="{r}"><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("a", "slide", "slides/slide1.xml"), ("b", "slide", "/ppt/slides/slide2.xml")),
        "ppt/slides/slide1.xml": said("second"),
        "ppt/slides/slide2.xml": said("first"),
        "ppt/slides/_rels/slide2.xml.rels": rels(("n", "notesSlide", "../notesSlides/notesSlide1.xml"), ("c", "chart", "../charts/chart4.xml")),
        "ppt/notesSlides/notesSlide1.xml": said("of the first"),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    assert [(f[0], f[1], f[5]) for f in facts("pptx", out.getvalue())[1]] == [("slide_text", 1, "first"), ("slide_note", 1, "of the first"), ("chart_reference", 1, "ppt/charts/chart4.xml"), ("slide_text", 2, "second")]


def test_pdf_structure(inspected):
    assert [r["text"] for r in I.pdf_sections(inspected).collect()] == ["1. Scope of the Study"]
    assert [r["citation"] for r in I.pdf_citations(inspected).collect()] == ["[Ledger 12]"]
    assert [r["cells"] for r in I.pdf_table_rows(inspected).collect()] == [["Branches", "units", "share"]]


def test_workbook(inspected):
    assert [(r["sheet"], r["cell"], r["value"]) for r in W.hardcodes(inspected).collect()] == [("Model", "C4", "10")]
    assert [r["sheet"] for r in W.hidden_sheets(inspected).collect()] == ["Old inputs"]
    assert W.without_checks(inspected).count() == 1
    assert [(r["formula"], r["n"]) for r in W.repeated_formulas(inspected).collect()] == [("C2+C3", 3)]
    assert sorted(r["header"] for r in W.headers(inspected).where("sheet = 'Model'").collect()) == ["item", "total", "units"]
    r = W.repair_packet(inspected).collect()
    assert len(r) == 1 and r[0]["suggested_input"] == "B3*2" and len(r[0]["checklist"]) == 3


def test_inventory(inspected):
    s = {r["name"]: r for r in I.inventory(inspected).collect()}
    assert len(s) == len(sample.packet())
    assert (s["figures-old.csv"]["status"], str(s["figures-old.csv"]["source_date"]), s["figures-old.csv"]["role"]) == ("old", "2025-01-31", "data_export")
    assert s["field-notes.md"]["status"] == "unclear" and not s["field-notes.md"]["number_bearing"]
    assert s["quarter-model.xlsx"]["source_date"] is None and s["quarter-model.xlsx"]["number_bearing"]
    assert s["figures-old.csv"]["stem"] == s["figures-final.csv"]["stem"]
    assert I.slides(inspected).count() == 3 and I.headings(inspected).count() == 2 and I.tables(inspected).where("value = '40%'").count() == 1


def test_unknown_draft_fails(inspected):
    with pytest.raises(ValueError, match="nothing.md"):
        P.drafts(I.inventory(inspected), ["nothing.md"])


@pytest.mark.parametrize("band", [1 << 16, 7])
def test_nearest_formulas(spark, band):
    rng = random.Random(band)
    rows = [(f"s{k % 3}", "m", "ABC"[k % 2], rng.randrange(120), f"c{k}", rng.choice([None, "x", "y", "z"]) if k % 3 else None) for k in range(300)]
    numbers, formulas = [r for r in rows if r[5] is None], [r for r in rows if r[5]]
    want = {}
    for s, t, c, r, cell, _ in numbers:
        near = min(((abs(r - o), o, f) for a, b, d, o, _, f in formulas if (a, b, d) == (s, t, c)), default=None)
        if near:
            want[cell] = near[2]
    make = lambda x: spark.createDataFrame(x, "source_id string, sheet string, column string, row int, cell string, formula string")
    assert len(want) < len(numbers)
    assert {r["cell"]: r["suggested_input"] for r in W.nearest_formulas(make(numbers), make(formulas), band).collect()} == want


def test_a_column_of_a_million_cells(spark):
    cells = spark.range(1_000_000).selectExpr("'s' as source_id", "'m' as sheet", "'A' as column", "cast(id as int) as row", "concat('A', id) as cell", "if(id % 10 = 0, concat('f', id), null) as formula")
    near = W.nearest_formulas(cells.where("formula is null"), cells.where("formula is not null"))
    wrong = near.where("suggested_input <> concat('f', cast(if(row % 10 <= 5, row - row % 10, least(row - row % 10 + 10, 999990)) as string))")
    assert near.count() == 900_000 and wrong.count() == 0


def test_tasks_of_repairs_grow_with_the_cells(spark, monkeypatch):
    """Four times the cells are looked through by more tasks, no task with more of them, and bands dealt out anew give the same."""
    cells = spark.range(4000).selectExpr("concat('s', id % 2) as source_id", "'b' as name", "'m' as sheet", "'xlsx' as ext", "'number' as kind", "cast(id as int) as ordinal", "concat('A', id) as cell", "'1' as text", "if(id % 10 < 6, concat('f', id), null) as formula")
    monkeypatch.setattr(W, "BAND", 64)
    monkeypatch.setattr(W, "TASK_CELLS", 100)
    most = []
    for n in (1000, 4000):
        found = W.repair_packet(cells.where(f"ordinal < {n}"))
        most.append(found.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("*")).first())
    assert most[1][1] > 2 * most[0][1] and most[1][0] <= 2 * most[0][0]
    want = W.nearest_formulas(W.hardcodes(cells), W.formulas(cells))
    assert {(r["cell"], r["suggested_input"]) for r in found.collect()} == {(r["cell"], r["suggested_input"]) for r in want.collect()} and found.count() == 1600
