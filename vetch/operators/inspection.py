"""Inventory, dates, states, roles, structure and evidence of inspected sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# What a file of each type is in a packet.
ROLES = {"csv": "data_export", "tsv": "data_export", "xlsx": "workbook", "md": "narrative", "txt": "narrative", "docx": "narrative", "pdf": "narrative", "pptx": "narrative"}
CELLS = ("cell", "number", "table_cell")
#: Kinds of facts that claims are seeded from.
CLAIM_KINDS = ("paragraph", "page_paragraph", "slide_text", "slide_note", "table_cell")
STATUS_LINE = r"(?i)^(status|course|jurisdiction|packet source date|question presented):"


def rows_of(facts: DataFrame) -> DataFrame:
    """Facts with the cells of a row as one: (source_id, kind, page, ordinal, sheet, text, n_cells)."""
    order = F.struct(F.length("cell").alias("n"), "cell", "text")
    cells = facts.where(F.col("kind").isin(*CELLS)).groupBy("source_id", "page", "ordinal", "sheet").agg(F.sort_array(F.collect_list(order)).alias("c"))
    cells = cells.select("source_id", F.lit("row").alias("kind"), "page", "ordinal", "sheet", F.array_join(F.transform("c", lambda x: x["text"]), ",").alias("text"), F.size("c").alias("n_cells"))
    other = facts.where(F.col("kind").isNotNull() & ~F.col("kind").isin(*CELLS, "sheet"))
    return cells.unionByName(other.select("source_id", "kind", "page", "ordinal", "sheet", "text", F.lit(1).alias("n_cells")))


def inventory(facts: DataFrame) -> DataFrame:
    """A row for each source: how it was inspected, its date, status, role, whether it has numbers and rows of one length.

    What counts of a source is what its blocks say first, in the order of page, sheet and place. Each block is looked through where it is, and
    the least place decides, which partial aggregation finds: no file's text is put together.
    """
    text = F.col("text")
    place = F.struct(F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("sheet", F.lit("")).alias("sheet"), "ordinal", "text")
    first = lambda said: F.min(F.when(said.isNotNull(), F.struct(place.alias("at"), said.alias("said"))))["said"]
    width = F.when(F.col("kind") == "row", F.col("n_cells"))
    said = rows_of(facts).groupBy("source_id").agg(
        first(X.status_line(text)).alias("line"), first(X.date_phrase(text)).alias("phrase"), first(X.any_date(text)).alias("day"), first(X.heads_dates(text)).alias("dated"),
        F.max(X.number_bearing(text)).alias("number_bearing"), F.min(width).alias("least"), F.max(width).alias("most"),
    )
    files = facts.select("source_id", "name", "ext", "bytes", "sha256", "inspection").distinct()
    s = files.join(said, "source_id", "left")
    role = F.coalesce(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[F.col("ext")], F.lit("unknown"))
    return s.select(
        "source_id", "name", "ext", "bytes", "sha256", "inspection", X.stem(F.col("name")).alias("stem"), X.name_state(F.col("name")).alias("name_state"),
        F.coalesce("line", X.name_state(F.col("name")), F.lit("unclear")).alias("status"), X.first_date(X.name_date(F.col("name")), F.col("phrase"), F.when(F.col("dated"), F.col("day"))).alias("source_date"), role.alias("role"),
        F.coalesce("number_bearing", F.lit(False)).alias("number_bearing"), F.coalesce(F.col("least") == F.col("most"), F.lit(True)).alias("consistent"),
    )


def headings(facts: DataFrame) -> DataFrame:
    """Headings with their level: of Markdown by its marks, of documents 1."""
    h = facts.where("kind = 'heading'")
    return h.select("source_id", "ordinal", F.greatest(X.heading_level(F.col("text")), F.lit(1)).alias("level"), F.regexp_replace("text", r"^#+\s+", "").alias("text"))


def tables(facts: DataFrame) -> DataFrame:
    """Cells of delimited files and document tables."""
    return facts.where("kind in ('table_cell', 'cell') and ext in ('csv', 'tsv', 'docx')").select("source_id", "sheet", F.col("ordinal").alias("row"), "cell", F.col("text").alias("value"))


def slides(facts: DataFrame) -> DataFrame:
    return facts.where("ext = 'pptx' and kind is not null").select("source_id", F.col("page").alias("slide"), F.col("kind").alias("part_kind"), "ordinal", "text")


def _pdf_lines(facts: DataFrame) -> DataFrame:
    p = facts.where("kind = 'page_paragraph'")
    return p.select("source_id", "page", "ordinal", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def pdf_sections(facts: DataFrame) -> DataFrame:
    """Lines that look like section titles: numbered, or short and in title case, without an end mark."""
    title = F.col("text").rlike(r"^\d+(\.\d+)*\.?\s+[A-Z].{0,70}$") | F.col("text").rlike(r"^([A-Z][\w'-]*|of|and|the|in|for|to)( ([A-Z][\w'-]*|of|and|the|in|for|to)){0,7}$")
    return _pdf_lines(facts).where(title & ~F.col("text").rlike(r"[.,;:]\s*$"))


def pdf_citations(facts: DataFrame) -> DataFrame:
    """Bracketed cites, law reports and addresses in page paragraphs."""
    pattern = r"\[[^\]]{2,60}\]|\b\d+ [A-Z][A-Za-z.]*(?: [A-Z][A-Za-z.]*)? \d+\b|https?://\S+"
    return facts.where("kind = 'page_paragraph'").select("source_id", "page", "ordinal", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("citation"))


def pdf_table_rows(facts: DataFrame) -> DataFrame:
    """Lines of three or more columns set apart by two or more spaces."""
    cells = F.split(F.trim("text"), r"\s{2,}")
    return _pdf_lines(facts).where(F.size(cells) >= 3).withColumn("cells", cells)


def evidence(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence snippets: blocks of sources that are no draft, but headings and status lines, and rows of tables."""
    keep = (F.col("kind") != "heading") & F.col("text").isNotNull() & ~F.col("text").rlike(STATUS_LINE)
    rows = rows_of(facts).where(keep & (F.col("text") != "")).join(sources.where("not is_draft").select("source_id", "name", "status"), "source_id")
    anchor = F.struct(F.col("kind"), "page", "ordinal", "sheet")
    return rows.select(X.content_id("evidence", F.col("source_id"), F.col("kind"), F.col("page"), F.col("sheet"), F.col("ordinal"), F.col("text")).alias("evidence_id"), "source_id", "name", "status", anchor.alias("anchor"), "text", X.terms(F.col("text")).alias("terms"), X.numbers(F.col("text")).alias("numbers"))


def selection(sources: DataFrame, findings: DataFrame) -> DataFrame:
    """sources with selected and excluded_reason: a source with a finding that must be fixed is excluded, for that reason."""
    blocked = findings.where("severity = 'must_fix' and source_id is not null").groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("issue")), "; ").alias("excluded_reason"))
    out = sources.join(blocked, "source_id", "left")
    return out.withColumn("selected", F.col("excluded_reason").isNull())


