"""The review operators on a packet shaped from the plain tables, with their SQL.

Each document is a file: its number gives a name with or without a state and a date, its lines are the facts. Line items are workbook
cells, orders rows of dated exports, benchmark passages evidence and authorities, events the decision log. The queries shape the tables and
call the operators; the SQL starts from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.shared import cut
from ..operators import amounts as A
from ..operators import claims as C
from ..operators import conflicts as K
from ..operators import decisions as D
from ..operators import findings as N
from ..operators import gate as G
from ..operators import inspection as I
from ..operators import legal as L
from ..operators import matching as M
from ..operators import versions as V
from ..operators import workbook as W
from ..sources import delimited as DL
from .run import source_diff

# Expressions that Spark and the SQL share.
_K = "CAST((doc_id - doc_id % 5) / 5 AS BIGINT)"
_NAME = f"CASE doc_id % 5 WHEN 0 THEN concat('doc', {_K}, '-final.md') WHEN 1 THEN concat('doc', {_K}, '-draft.txt') WHEN 2 THEN concat('2025-03-1', doc_id % 9, '-doc', {_K}, '-raw.csv') WHEN 3 THEN concat('2025-02-0', 1 + doc_id % 8, '-doc', {_K}, '.md') ELSE concat('doc', {_K}, '.pdf') END"
_EXT = "CASE doc_id % 5 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' WHEN 2 THEN 'csv' WHEN 3 THEN 'md' ELSE 'pdf' END"
_HOW = "CASE WHEN doc_id % 35 = 4 THEN 'no text' WHEN doc_id % 35 = 7 THEN 'unreadable: ValueError' ELSE 'inspected' END"
_KIND = "CASE WHEN line IS NULL THEN NULL WHEN doc_id % 5 = 4 THEN 'page_paragraph' WHEN line_no = 1 AND doc_id % 5 = 0 THEN 'heading' ELSE 'paragraph' END"
_PAGE = "CASE WHEN doc_id % 5 = 4 THEN 1 END"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _facts(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.expr(_NAME).alias("name"), F.expr(_EXT).alias("ext"), F.expr(_HOW).alias("inspection"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"), F.posexplode_outer(X.lines(F.col("text"))).alias("pos", "line"))
    d = d.withColumn("line_no", F.col("pos") + 1)
    none = F.lit(None).cast("string")
    return d.select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source_id"), "name", "ext", "bytes", "sha256", "inspection", F.expr(_KIND).alias("kind"), F.expr(_PAGE).alias("page"), F.col("line_no").alias("ordinal"),
        none.alias("sheet"), none.alias("cell"), F.col("line").alias("text"), none.alias("formula"),
    )


def _sources(spark, sf):
    return I.inventory(_facts(spark, sf)).withColumn("is_draft", F.col("name").contains("-draft"))


def packet_inventory(spark, sf):
    s = I.inventory(_facts(spark, sf))
    return s.select("source_id", "name", "ext", "inspection", "stem", "name_state", "status", F.col("source_date").cast("string").alias("source_date"), "role", "number_bearing", "consistent")


def packet_headings(spark, sf):
    f = _facts(spark, sf).withColumn("text", F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("ordinal") + F.length("source_id") % 3), F.lit(" "), F.col("text"))).otherwise(F.col("text")))
    return I.headings(f).select("source_id", "ordinal", F.col("level").cast("long").alias("level"), "text")


def packet_pdf_sections(spark, sf):
    return I.pdf_sections(_facts(spark, sf)).select("source_id", "page", "ordinal", "text")


def packet_slides(spark, sf):
    c = _t(spark, sf, "conversations")
    f = c.select(F.concat(F.lit("deck"), F.col("conv_id").cast("string")).alias("source_id"), F.lit("pptx").alias("ext"), F.when(F.col("role") == "user", "slide_text").otherwise("slide_note").alias("kind"), (F.col("turn") + 1).alias("page"), F.lit(1).alias("ordinal"), "text")
    return I.slides(f).select("source_id", "slide", "part_kind", "text")


def packet_tables(spark, sf):
    n = _t(spark, sf, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("source_id"), F.col("n_nationkey").alias("ordinal"), F.posexplode(F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))).alias("c", "text"))
    f = n.select("source_id", F.lit("csv").alias("ext"), F.lit("cell").alias("kind"), F.lit(None).cast("string").alias("sheet"), "ordinal", F.concat(F.chr(F.lit(65) + F.col("c")), F.col("ordinal").cast("string")).alias("cell"), "text")
    return I.tables(f).select("source_id", "row", "cell", "value")


def packet_evidence(spark, sf):
    e = I.evidence(_facts(spark, sf), _sources(spark, sf))
    return e.select("evidence_id", "source_id", "status", F.col("anchor.kind").alias("kind"), F.col("anchor.ordinal").alias("ordinal"), F.size("terms").cast("long").alias("n_terms"))


def _seeded(spark, sf):
    return C.seed(_facts(spark, sf), _sources(spark, sf))


def packet_claims(spark, sf):
    return _seeded(spark, sf).select("claim_id", "source_id", "origin", F.col("anchor.ordinal").alias("ordinal"), F.size("terms").cast("long").alias("n_terms"))


def packet_empty_drafts(spark, sf):
    return C.empty_drafts(_sources(spark, sf), _seeded(spark, sf)).select("source_id", "name")


def _plain_findings(f):
    return f.select("finding_id", "rule_id", "severity", "location", "issue", "source_id", "subject")


def packet_source_findings(spark, sf):
    return _plain_findings(N.source_findings(_sources(spark, sf)))


def packet_selection(spark, sf):
    s = _sources(spark, sf)
    return I.selection(s, N.source_findings(s)).select("source_id", "selected", "excluded_reason")


def packet_clean_sources(spark, sf):
    s = _sources(spark, sf)
    return N.clean_sources(s, N.source_findings(s)).select("source_id", "name")


def packet_version_conflicts(spark, sf):
    return K.version_conflicts(_sources(spark, sf)).select("conflict_id", "kind", F.array_join("sources", ",").alias("sources"))


def packet_conflict_findings(spark, sf):
    return _plain_findings(N.conflict_findings(K.version_conflicts(_sources(spark, sf))))


def _metrics(spark, sf):
    """Exports of counts by order priority: one file for each year, dated by its last month, one row for each priority."""
    o = _t(spark, sf, "orders")
    year = F.date_format("o_orderdate", "yyyy")
    rows = o.groupBy(year.alias("y"), F.col("o_orderpriority").alias("metric")).agg(F.count("*").alias("n"))
    cell = lambda col, text, row: F.struct(F.concat(F.lit(col), row.cast("string")).alias("cell"), text.alias("text"), row.alias("ordinal"))
    row = (F.substring("metric", 1, 1).cast("int") + 1).alias("row")
    body = rows.select("y", F.explode(F.array(cell("A", F.col("metric"), row), cell("B", F.col("n").cast("string"), row), cell("C", F.concat("y", F.lit("-12-31")), row))).alias("c"))
    one = F.lit(1)
    head = rows.select("y").distinct().select("y", F.explode(F.array(cell("A", F.lit("Metric"), one), cell("B", F.lit("Value"), one), cell("C", F.lit("As_of"), one))).alias("c"))
    f = body.unionByName(head).select(F.concat(F.lit("x"), F.col("y")).alias("source_id"), F.lit("cell").alias("kind"), F.lit("csv").alias("ext"), F.col("c.ordinal").alias("ordinal"), F.col("c.cell").alias("cell"), F.col("c.text").alias("text"))
    s = f.select("source_id", F.concat("source_id", F.lit(".csv")).alias("name"), F.lit("data_export").alias("role"), F.lit(None).cast("date").alias("source_date")).distinct()
    return K.metrics(f, s)


def packet_metrics(spark, sf):
    return _metrics(spark, sf).select("source_id", "metric", "value", F.col("as_of").cast("string").alias("as_of"))


def packet_metric_conflicts(spark, sf):
    return K.metric_conflicts(_metrics(spark, sf)).select("conflict_id", "metric", F.array_join("sources", ",").alias("sources"))


def packet_wide_conflicts(spark, sf, narrative=""):
    """Counts by order priority in three exports: a long one of the first years, a wide one from the second year on that spells numbers otherwise and
    has some with another sign, and a wide one of the last year alone."""
    o = _t(spark, sf, "orders")
    n = o.groupBy(F.date_format("o_orderdate", "yyyy").cast("int").alias("y"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    k = F.substring("p", 1, 1).cast("int")
    cell = lambda name, row, column, text: F.struct(F.lit(name).alias("source_id"), row.cast("int").alias("ordinal"), F.concat(column, row.cast("string")).alias("cell"), text.alias("text"))
    day = F.concat("y", F.lit("-12-31"))
    one, a = F.lit(1), F.lit("A")
    long = F.array(*[cell("all", (F.col("y") - 1990) * 10 + k, F.lit(c), t) for c, t in zip("ABC", (F.col("p"), F.format_number("n", 0), day))], *[cell("all", one, F.lit(c), F.lit(t)) for c, t in zip("ABC", ("Metric", "Value", "As_of"))])
    letter = F.chr(F.lit(65) + k)
    signed = F.when((F.col("y") % 4 == 1) & (k == 2), F.concat(F.lit("($"), F.col("n").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit(" "), F.col("n").cast("string"), F.lit(".0")))
    wide = lambda name, value: F.array(cell(name, F.col("y") - 1980, letter, value), cell(name, F.col("y") - 1980, a, day), cell(name, one, a, F.lit("report date")), cell(name, one, letter, F.col("p")))
    last = n.join(F.broadcast(n.agg(F.max("y").alias("y"))), "y").where(F.col("p").startswith("1"))
    cells = n.where("y <= 1995").select(F.explode(long).alias("c")).unionByName(n.where("y >= 1993").select(F.explode(wide("wide", signed)).alias("c"))).unionByName(last.select(F.explode(wide("last", F.col("n").cast("string"))).alias("c")))
    f = cells.select("c.*").distinct().select("*", F.lit("cell").alias("kind"), F.lit("csv").alias("ext"))
    s = f.select("source_id", F.concat("source_id", F.lit(".csv")).alias("name"), F.when(F.col("source_id") == narrative, "narrative").otherwise("data_export").alias("role"), F.lit(None).cast("date").alias("source_date")).distinct()
    return K.metric_conflicts(K.metrics(f, s)).select("conflict_id", "metric", F.array_join("sources", ",").alias("sources"))


def packet_guarded_conflicts(spark, sf):
    """The same, with the wide export of several years as part of a narrative."""
    return packet_wide_conflicts(spark, sf, "wide")


def _cells(spark, sf):
    """Return flags as workbooks, line statuses as sheets, orders as rows, line numbers as columns; higher discounts are formulas."""
    i = _t(spark, sf, "lineitem")
    column = F.chr(F.lit(64) + F.col("l_linenumber"))
    cells = i.select(
        F.concat(F.lit("w"), F.col("l_returnflag")).alias("source_id"), F.concat(F.lit("book"), F.col("l_returnflag"), F.lit(".xlsx")).alias("name"), F.lit("xlsx").alias("ext"), F.col("l_orderkey").cast("int").alias("ordinal"),
        F.concat(F.col("l_linestatus"), F.lit("-sheet")).alias("sheet"), F.concat(column, F.col("l_orderkey").cast("string")).alias("cell"), F.when((F.col("l_orderkey") % 7 == 0) & (F.col("l_linenumber") < 3), "cell").otherwise("number").alias("kind"),
        F.col("l_quantity").cast("long").cast("string").alias("text"), F.when(F.col("l_discount") >= 0.05, F.concat(F.lit("SUM(A1:A"), F.col("l_quantity").cast("long").cast("string"), F.lit(")"))).alias("formula"),
    )
    sheets = cells.select("source_id", "name", "ext", "sheet").distinct().select("source_id", "name", "ext", F.lit(1).alias("ordinal"), "sheet", F.lit(None).cast("string").alias("cell"), F.lit("sheet").alias("kind"), F.when(F.col("sheet") == "O-sheet", "hidden").otherwise("visible").alias("text"), F.lit(None).cast("string").alias("formula"))
    checks = sheets.where("source_id = 'wA'").limit(1).withColumn("sheet", F.lit("Checks")).withColumn("text", F.lit("visible"))
    return cells.unionByName(sheets).unionByName(checks)


def book_sheets(spark, sf):
    return W.sheets(_cells(spark, sf)).select("source_id", "sheet", "state")


def book_hidden_sheets(spark, sf):
    return W.hidden_sheets(_cells(spark, sf)).select("source_id", "sheet")


def book_headers(spark, sf):
    return W.headers(_cells(spark, sf)).select("source_id", "sheet", "row", "cell", "header")


def book_formulas(spark, sf):
    return W.formulas(_cells(spark, sf)).select("source_id", "sheet", "cell", "formula")


def book_hardcodes(spark, sf):
    return W.hardcodes(_cells(spark, sf)).select("source_id", "sheet", "cell", "value")


def book_without_checks(spark, sf):
    return W.without_checks(_cells(spark, sf))


def book_repeated_formulas(spark, sf):
    return W.repeated_formulas(_cells(spark, sf)).select("source_id", "sheet", "formula", "n")


def book_repairs(spark, sf):
    return W.repair_packet(_cells(spark, sf)).select("source_id", "sheet", "cell", "value", "suggested_input", F.size("checklist").cast("long").alias("steps"))


def _claims(spark, sf):
    d = _t(spark, sf, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("claim_id"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source_id"), F.expr(_NAME).alias("name"), "text")
    anchor = F.struct(F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("page"), F.lit(1).alias("ordinal"), F.lit(None).cast("string").alias("sheet"))
    return d.select("claim_id", "source_id", "name", anchor.alias("anchor"), "text", F.lit("seeded").alias("origin"), X.terms(F.col("text")).alias("terms"), X.numbers(F.col("text")).alias("numbers"))


def _evidence(spark, sf):
    e = _t(spark, sf, "benchmark").select(F.concat(F.lit("e"), F.col("item_id").cast("string")).alias("evidence_id"), F.concat(F.lit("b"), (F.col("item_id") % 7).cast("string")).alias("source_id"), "text")
    return e.withColumn("anchor", F.struct(F.lit("paragraph").alias("kind"), F.lit(1).alias("ordinal")))


_LOG = {"purchase": ("claim", "delete"), "signup": ("claim", "edit"), "view": ("support", "attach"), "click": ("claim", "create"), "error": ("conflict", "resolve")}


def _log(spark, sf):
    """Events as decisions on claims (users), support (pairs of a document and a passage) and conflicts (stems)."""
    e = _t(spark, sf, "events")
    of = lambda k: F.create_map(*[F.lit(x) for name, v in _LOG.items() for x in (name, v[k])])[F.col("event_type")]
    claim = F.concat(F.when(F.col("event_type") == "click", "n").otherwise("c"), F.col("user_id").cast("string"))
    evidence = F.concat(F.lit("e"), (F.col("event_id") % 40).cast("string"))
    target = F.when(of(0) == "claim", claim).when(of(0) == "support", F.concat_ws("/", claim, evidence)).otherwise(X.content_id("conflict", F.lit("version"), F.concat(F.lit("doc"), F.col("user_id").cast("string"))))
    payload = F.create_map(F.lit("text"), F.concat(F.lit("Edited statement number "), F.col("event_id").cast("string")), F.lit("claim_id"), claim, F.lit("evidence_id"), evidence, F.lit("quote"), F.lit("q"))
    stale = F.when(F.col("event_id") % 11 == 0, F.lit("0" * 64))
    return e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("decision_id"), of(0).alias("target_kind"), target.alias("target_id"), of(1).alias("action"), F.lit("u").alias("actor"), F.lit("r").alias("rationale"), F.col("ts").cast("timestamp").alias("at"), payload.alias("payload"), stale.alias("content_hash"))


def decision_latest(spark, sf):
    return D.latest(_log(spark, sf), "claim").select("target_id", "decision_id", "action")


def reviewed_claims(spark, sf):
    return D.apply_to_claims(_claims(spark, sf), _log(spark, sf)).select("claim_id", "origin", F.sha2("text", 256).alias("text_sha256"), F.size("terms").cast("long").alias("n_terms"))


def replayed_claims(spark, sf):
    """Every event as a decision on one of few claims, half of which documents seed: created, edited, deleted, merged, in any order."""
    e = _t(spark, sf, "events").where("user_id is not null")
    action = F.expr("CASE event_type WHEN 'click' THEN 'create' WHEN 'signup' THEN 'edit' WHEN 'purchase' THEN 'delete' WHEN 'view' THEN 'merge' ELSE 'edit' END")
    payload = F.create_map(F.lit("text"), F.when(F.col("event_type") != "error", F.concat(F.lit("t"), F.col("event_id").cast("string"))), F.lit("into"), F.concat(F.lit("c"), (F.col("user_id") + 1).cast("string")))
    log = e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("decision_id"), F.lit("claim").alias("target_kind"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("target_id"), action.alias("action"), F.col("ts").cast("timestamp").alias("at"), payload.alias("payload"))
    return D.replayed(_claims(spark, sf).where("cast(substr(claim_id, 2) as bigint) % 2 = 0"), log).select("claim_id", "live", "origin", F.sha2("text", 256).alias("text_sha256"), "into")


def attached_support(spark, sf):
    return D.support(_log(spark, sf), _evidence(spark, sf)).select("claim_id", "evidence_id", "source_id", "decision_id")


def merged_support(spark, sf):
    """Every third document's claim is merged into the one three before, which makes chains; support follows to the end of each."""
    d = _t(spark, sf, "documents").where("doc_id % 3 = 0 and doc_id % 30 <> 0")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    merge = d.select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("decision_id"), F.lit("claim").alias("target_kind"), name(F.col("doc_id")).alias("target_id"), F.lit("merge").alias("action"), F.lit("u").alias("actor"), F.lit("r").alias("rationale"), F.lit("2024-01-01").cast("timestamp").alias("at"), F.create_map(F.lit("into"), name(F.col("doc_id") - 3)).alias("payload"), F.lit(None).cast("string").alias("content_hash"))
    log = _log(spark, sf).where("target_kind = 'support'").unionByName(merge)
    return D.support(log, _evidence(spark, sf)).select("claim_id", "evidence_id", "decision_id")


def reviewed_conflicts(spark, sf):
    return D.open_conflicts(K.version_conflicts(_sources(spark, sf)), _log(spark, sf)).select("conflict_id", F.array_join("sources", ",").alias("sources"))


def reviewed_findings(spark, sf):
    """Findings of sources, those of every fourth document accepted."""
    f = N.source_findings(_sources(spark, sf))
    log = f.where("cast(substr(source_id, 2) as bigint) % 4 = 0").select(F.col("finding_id").alias("decision_id"), F.lit("finding").alias("target_kind"), F.col("finding_id").alias("target_id"), F.lit("accept").alias("action"), F.lit("u").alias("actor"), F.lit("r").alias("rationale"), F.lit("2024-01-01").cast("timestamp").alias("at"), F.create_map(F.lit("a"), F.lit("b")).alias("payload"), F.lit(None).cast("string").alias("content_hash"))
    return D.open_findings(f, log).select("finding_id", "location", "issue")


def packet_claim_findings(spark, sf):
    c = _claims(spark, sf)
    return _plain_findings(N.claim_findings(c, D.support(_log(spark, sf), _evidence(spark, sf)), _sources(spark, sf).where("1 = 0")))


def contradicted_numbers(spark, sf):
    """Prices of parts as claims, and as evidence the same, a higher one or half of one, of an earlier or a later date."""
    p = _t(spark, sf, "part").where("p_retailprice > 0")
    price, id_ = F.col("p_retailprice").cast("decimal(12,2)"), F.col("p_partkey").cast("string")
    other = F.when(F.col("p_partkey") % 3 == 0, price).when(F.col("p_partkey") % 3 == 1, price * 3).otherwise((price + 1).cast("decimal(12,2)"))
    day = F.when(F.col("p_partkey") % 4 == 0, "2019-12-31").when(F.col("p_partkey") % 4 == 1, "2020-01-01").otherwise("2021-06-30")
    claims = p.select(F.concat(F.lit("c"), id_).alias("claim_id"), F.concat(F.lit("On January 1, 2020 part "), id_, F.lit(" retailed at $"), price.cast("string"), F.lit(", 5% off.")).alias("text"))
    evidence = p.select(F.concat(F.lit("e"), id_).alias("evidence_id"), F.concat(F.lit("Part "), id_, F.lit(" retails at $"), other.cast("decimal(14,2)").cast("string"), F.lit(" on "), day, F.lit(", of 12 left 7 percent off.")).alias("text"))
    pairs = p.select(F.concat(F.lit("c"), id_).alias("claim_id"), F.concat(F.lit("e"), id_).alias("evidence_id"), F.lit(3).alias("term_overlap"))
    return A.contradicted(claims, evidence, pairs)


def balance_overlap(spark, sf):
    """Customers and suppliers whose balances in whole dollars meet, in whatever spelling."""
    dollars = lambda c: F.abs(F.col(c).cast("long"))
    a = _t(spark, sf, "customer").select("c_custkey", X.numbers(F.concat(F.lit("A balance of $"), F.format_number(dollars("c_acctbal"), 0), F.lit(" on 2020-01-01"))).alias("numbers"))
    b = _t(spark, sf, "supplier").select("s_suppkey", X.numbers(F.concat(F.lit("It came to "), dollars("s_acctbal").cast("string"), F.lit(".00 dollars [note 7]"))).alias("numbers"))
    return M.overlap(a, b, "c_custkey", "s_suppkey", "numbers", "number_overlap", unique=True)


def _part_pages(spark, sf):
    p, id_ = _t(spark, sf, "part"), F.col("p_partkey").cast("string")
    text = F.concat(F.lit("See [Part "), id_, F.lit("] and https://parts.example/"), id_, F.lit(" too\n"), id_, F.lit("   "), "p_brand", F.lit("     "), F.col("p_size").cast("string"), F.lit("\nno  table"))
    return p.select(F.concat(F.lit("p"), id_).alias("source_id"), F.lit("page_paragraph").alias("kind"), F.lit(1).alias("page"), F.col("p_size").alias("ordinal"), text.alias("text"))


def packet_pdf_citations(spark, sf):
    return I.pdf_citations(_part_pages(spark, sf))


def packet_pdf_table_rows(spark, sf):
    return I.pdf_table_rows(_part_pages(spark, sf)).select("source_id", "page", "ordinal", F.col("line").cast("long").alias("line"), F.array_join("cells", "|").alias("cells"))


def packet_undeclared_claims(spark, sf):
    """Without a declared draft every source seeds claims."""
    return C.seed(_facts(spark, sf), _sources(spark, sf).withColumn("is_draft", F.lit(False))).select("claim_id", "source_id", F.col("anchor.ordinal").alias("ordinal"))


def book_findings(spark, sf):
    return _plain_findings(N.workbook_findings(_cells(spark, sf)))


def reviewed_calculations(spark, sf):
    """Findings of workbooks; the hardcodes of all but one are resolved."""
    f = N.workbook_findings(_cells(spark, sf))
    log = f.where("rule_id = 'hardcodes' and source_id <> 'wN'").select(F.col("finding_id").alias("decision_id"), F.lit("calculation").alias("target_kind"), F.col("finding_id").alias("target_id"), F.lit("resolve").alias("action"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    return _plain_findings(D.open_findings(f, log))


def _generated(spark, sf):
    e = _evidence(spark, sf)
    dated = F.when(F.col("source_id") != "b3", F.lit("2025-01-01").cast("date"))
    s = e.select("source_id").distinct().select("source_id", F.concat("source_id", F.lit(".md")).alias("name"), dated.alias("source_date"), (F.col("source_id") != "b5").alias("selected"))
    support = D.support(_log(spark, sf), e)
    return C.generated(_claims(spark, sf), support, e, s), s, support


def generated_claims(spark, sf):
    return _generated(spark, sf)[0].select("generated_id", "claim_id", "evidence_id", "source_name", F.col("source_date").cast("string").alias("source_date"), "selected")


def claim_receipt(spark, sf):
    r = G.receipt(_generated(spark, sf)[0])
    return r.select("claim_id", F.col("n_evidence").cast("long").alias("n_evidence"), F.array_join("pointers", ",").alias("pointers"), F.array_join("sources", ",").alias("sources"))


def receipt_citations(spark, sf):
    """Each piece of evidence that a receipt's JSON cites, with its source's id and date."""
    r = G.receipt(_generated(spark, sf)[0]).select("claim_id", F.explode("cited").alias("c"))
    return r.select("claim_id", "c.evidence_id", "c.source_id", F.col("c.source_date").cast("string").alias("source_date"))


def receipt_sources(spark, sf):
    """The sources of a receipt's JSON; the one that isn't selected with the reason."""
    g, s, _ = _generated(spark, sf)
    s = s.withColumn("excluded_reason", F.when(~F.col("selected"), F.lit("Number-bearing source has no source date.")))
    return G.receipt_sources(s, g).select("source_id", F.col("source_date").cast("string").alias("source_date"), "excluded_reason", "claims")


def gate_blockers(spark, sf):
    """What keeps a receipt of the attached support from being written."""
    g, s, support = _generated(spark, sf)
    conflicts = F.array(F.lit("b1.md"), F.lit("b9.md"))
    k = spark.range(2).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("conflict_id"), F.when(F.col("id") == 0, conflicts).otherwise(F.array(F.lit("b5.md"))).alias("sources"))
    return G.blockers(k, s, g, C.unsupported(_claims(spark, sf), support))


def _legal_facts(spark, sf):
    """Benchmark passages as authorities; a memo that maps them: word for word, changed, to a passage that isn't there, or not at all."""
    b = _t(spark, sf, "benchmark").select("item_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "line"))
    n = F.col("item_id").cast("string")
    of = lambda i, name, ordinal, text: (F.concat(F.lit(i), n).alias("source_id"), F.concat(F.lit(name), n, F.lit(".md")).alias("name"), F.lit("md").alias("ext"), F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("page"), ordinal.alias("ordinal"), text.alias("text"))
    passages = b.select(*of("a", "item", F.col("pos") + 1, F.col("line")))
    first = b.where("pos = 0")
    to = F.when(F.col("item_id") % 5 == 0, "p0099").otherwise("p0001")
    said = F.when(F.col("item_id") % 2 == 0, F.replace("line", F.lit(" "), F.lit("  "))).otherwise(F.concat("line", F.lit(" More.")))
    mapped = first.select(*of("m", "memo", F.lit(1), F.concat(F.lit('LEGAL-MAP [rule] source="item'), n, F.lit('.md" passage=passage_item'), n, F.lit("_"), to, F.lit(' pin="para. 1" authority=binding: '), said)))
    draft = first.select(*of("m", "memo", F.lit(2), F.concat(F.lit("LEGAL-DRAFT ["), F.when(F.col("item_id") % 3 == 0, "conclusion").otherwise("rule"), F.lit("]: "), F.when(F.col("item_id") % 2 == 0, F.col("line")).otherwise(F.concat("line", F.lit(" More."))))))
    task = first.where("item_id % 4 = 0").select(*of("t", "task", F.lit(1), F.concat(F.lit("Course: Law "), (F.col("item_id") % 3).cast("string"), F.lit("\nJurisdiction: State "), n, F.lit("\nQuestion presented: Is it "), n, F.lit("?\nPrepare a short memo using only the supplied packet."))))
    return passages.unionByName(mapped).unionByName(draft).unionByName(task)


def _legal_sources(f):
    return f.select("source_id", "name").distinct()


def legal_passages(spark, sf):
    return L.passages(_legal_facts(spark, sf)).where("source_id like 'a%'").select("source_id", "passage_id", "paragraph", "quote_hash")


def legal_propositions(spark, sf):
    return L.propositions(_legal_facts(spark, sf)).select("source_id", "marker", "kind", "source", "passage", "pin", "authority", F.sha2("text", 256).alias("text_sha256"))


def legal_support(spark, sf):
    f = _legal_facts(spark, sf)
    return L.legal_map(L.propositions(f), L.passages(f)).select("source_id", "passage", "verbatim", "quote_hash")


def legal_unresolved(spark, sf):
    f = _legal_facts(spark, sf)
    return L.unresolved(L.propositions(f), L.passages(f)).select("source_id", "passage")


def legal_unmapped(spark, sf):
    return L.unmapped(L.propositions(_legal_facts(spark, sf))).select("source_id", "kind")


def legal_trust(spark, sf):
    f = _legal_facts(spark, sf)
    sources = _legal_sources(f).withColumn("source_date", F.when(F.col("name") != "item1.md", F.lit("2025-01-01").cast("date")))
    t = L.trust_findings(L.propositions(f), L.passages(f), sources)
    return t.groupBy("rule_id", "severity", "location").agg(F.count("*").alias("n"))


def legal_classes(spark, sf):
    f = _legal_facts(spark, sf)
    return L.classify(_legal_sources(f), L.marks(f)).select("source_id", "classification", "treatment_state")


def legal_boundaries(spark, sf):
    f = _legal_facts(spark, sf)
    return L.boundary(_legal_sources(f), L.marks(f)).select("source_id", "boundary_key", "jurisdiction")


def legal_output(spark, sf):
    f = _legal_facts(spark, sf)
    return L.output_spec(_legal_sources(f), L.marks(f)).select("source_id", "kind", "question", "source_scope")


def legal_reuse(spark, sf):
    """Every other mapped proposition accepted, within the boundary of the run's assignment."""
    f = _legal_facts(spark, sf)
    mapped = L.legal_map(L.propositions(f), L.passages(f))
    accepted = mapped.where("cast(substr(source_id, 2) as int) % 2 = 1").select(F.col("proposition_id").alias("target_id"))
    return L.reuse_library(mapped, accepted, L.boundary(_legal_sources(f), L.marks(f))).select("boundary_key", F.sha2("text", 256).alias("text_sha256"))


def source_history(spark, sf):
    s = _facts(spark, sf).select("source_id", "name", "sha256").distinct()
    return L.history(s)


def packet_refresh(spark, sf):
    """The packet against itself with every seventh document changed, every eleventh gone and every thirteenth new."""
    d = _t(spark, sf, "documents").select("doc_id", F.expr(_NAME).alias("name"), F.sha2("text", 256).alias("sha256"))
    new = d.where("doc_id % 11 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 7 == 0, F.lit("new")).otherwise(F.col("sha256")))
    return source_diff(d.where("doc_id % 13 <> 0"), new).select("name", "change")


def _two_versions(spark, sf):
    """Each document as a file of lines, and a later version of it: lines dropped, edited, put in and moved to the end; a quarter of the files renamed."""
    d = _t(spark, sf, "documents")
    old = d.select(F.expr("concat('doc', doc_id, '.md')").alias("name"), F.expr("CASE WHEN doc_id % 4 = 1 THEN concat('renamed', doc_id, '.md') ELSE concat('doc', doc_id, '.md') END").alias("later"), "doc_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "line"))
    old = old.select("name", "later", (F.col("pos") + 1).cast("long").alias("place"), "line", F.expr("CASE WHEN doc_id % 8 = 5 THEN 0 ELSE (pos + 1 + doc_id) % 143 END").alias("m"))
    same = old.where("m % 7 <> 3").select("later", F.expr("2 * place + IF(m % 13 = 6, 1000000, 0)").alias("at"), F.expr("IF(m % 11 = 5, concat('Changed: ', line), line)").alias("line"))
    more = old.where("m % 9 = 4").select("later", F.expr("2 * place + 1").alias("at"), F.expr("concat('Added after line ', place)").alias("line"))
    new = same.unionByName(more).withColumn("place", F.row_number().over(Window.partitionBy("later").orderBy("at")).cast("long"))
    files = lambda p: p.groupBy("name").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"]), ""), 256).alias("sha256"))
    sides = [cut(x.withColumn("hash", F.sha2("line", 256)).withColumn("evidence_id", F.concat_ws("_", "name", "place")).select("name", "place", "hash", "evidence_id")) for x in (old, new.withColumnRenamed("later", "name"))]  # read by many plans
    return (*(files(x) for x in sides), *sides)


def paired_files(spark, sf):
    return V.paired(*_two_versions(spark, sf))


def passage_changes(spark, sf):
    """Kept, moved, changed, removed and new lines of all files between the two versions."""
    sides = _two_versions(spark, sf)
    return V.aligned(V.paired(*sides), *sides[2:]).na.fill("", ["old_name", "new_name"]).na.fill(0, ["old_place", "new_place"])


def voided_approvals(spark, sf):
    """Every third line was approved: what became of it, and whether the approval is void."""
    sides = _two_versions(spark, sf)
    approved = sides[2].where("place % 3 = 0").select("evidence_id")
    return V.approvals(V.aligned(V.paired(*sides), *sides[2:]), sides[2], approved).select("evidence_id", "change", F.when(F.col("new_place").isNotNull(), F.col("new_name")).alias("new_name"), "new_place", "void").na.fill("", ["new_name"]).na.fill(0, ["new_place"])


def delimited_cells(spark, sf):
    """Documents as delimited files, one for each source, with their texts in quotes, line ends and all; a split ends in the middle of each text."""
    d = _t(spark, sf, "documents").select(F.coalesce("source", F.lit("")).alias("path"), "doc_id", F.expr("""concat(doc_id, ',', lang, ',"', replace(text, '"', '""'), '"')""").alias("record"))
    parts = d.select("path", "doc_id", F.posexplode(F.split("record", "\n", -1)).alias("k", "line"), F.size(F.split("record", "\n", -1)).alias("n"))
    parts = parts.withColumn("split", F.col("doc_id") + (2 * F.col("k") > F.col("n")).cast("long"))
    lines = parts.select("path", "split", F.row_number().over(Window.partitionBy("path", "split").orderBy("doc_id", "k")).cast("long").alias("pos"), "line")
    return DL.cells(DL.records(lines)).select("path", "row", "cell", F.sha2("value", 256).alias("value_sha256"))


NAMES = (
    packet_inventory, packet_headings, packet_pdf_sections, packet_slides, packet_tables, packet_evidence, packet_claims, packet_empty_drafts, packet_source_findings, packet_selection,
    packet_clean_sources, packet_version_conflicts, packet_conflict_findings, packet_metrics, packet_metric_conflicts, packet_wide_conflicts, packet_guarded_conflicts, contradicted_numbers, balance_overlap, packet_pdf_citations, packet_pdf_table_rows, packet_undeclared_claims, book_findings, reviewed_calculations, book_sheets, book_hidden_sheets, book_headers, book_formulas,
    book_hardcodes, book_without_checks, book_repeated_formulas, book_repairs, decision_latest, reviewed_claims, replayed_claims, attached_support, merged_support, reviewed_conflicts, reviewed_findings,
    packet_claim_findings, generated_claims, claim_receipt, receipt_citations, receipt_sources, gate_blockers, legal_passages, legal_propositions, legal_support, legal_unresolved, legal_unmapped, legal_trust, legal_classes,
    legal_boundaries, legal_output, legal_reuse, source_history, packet_refresh, paired_files, delimited_cells, passage_changes, voided_approvals,
)


def queries():
    return {f.__name__: f for f in NAMES}


def _id(kind: str, *parts: str) -> str:
    said = ", ".join(f"coalesce(CAST({p} AS VARCHAR), chr(0))" for p in parts)
    return f"concat('{kind}_', substr(sha256(concat_ws(chr(31), {said})), 1, 16))"


def _plain_text() -> str:
    plain = "coalesce(text, '')"
    for pattern in (X.CITE, X.ISO_DATE, X.LONG_DATE, X.MONTH_YEAR):
        plain = f"regexp_replace({plain}, '{pattern}', ' ', 'g')"
    return plain


_STATES = "|".join(X.STATES)
_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def _terms(text: str) -> str:
    return rf"list_filter(list_distinct(regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}]+')), lambda t: length(t) >= {X.LEAST_TERM} AND NOT list_contains({_STOP}, t))"


def _date(text: str) -> str:
    return f"CAST(try_strptime(nullif({text}, ''), '%Y-%m-%d') AS DATE)"


_F = rf"""d0 AS (SELECT doc_id, text AS body0, {_NAME} AS name, {_EXT} AS ext, {_HOW} AS inspection, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS ls FROM documents),
l AS (SELECT doc_id, name, ext, inspection, unnest(CASE WHEN len(ls) = 0 THEN [NULL] ELSE ls END) AS line, unnest(range(1, greatest(len(ls), 1) + 1)) AS line_no FROM d0),
f AS (SELECT concat('s', doc_id) AS source_id, name, ext, inspection, {_KIND} AS kind, {_PAGE} AS page, CAST(line_no AS INT) AS ordinal, line AS text FROM l)"""
_INV = rf"""{_F}, b AS (SELECT source_id, any_value(name) AS name, any_value(ext) AS ext, any_value(inspection) AS inspection, coalesce(string_agg(text, chr(10) ORDER BY ordinal, text), '') AS body,
  coalesce(bool_or(regexp_matches(text, '[0-9]')), false) AS number_bearing FROM f GROUP BY source_id),
i AS (SELECT source_id, name, ext, inspection, number_bearing, true AS consistent,
  regexp_replace(regexp_replace(regexp_replace(lower(name), '\.[a-z0-9]+$', ''), '^\d{{4}}-\d{{2}}-\d{{2}}-', ''), '[-_ ](?:{_STATES})$', '') AS stem,
  nullif(regexp_extract(lower(name), '[-_ ]({_STATES})(?:[-_ ][a-z]+)?\.[a-z0-9]+$', 1), '') AS name_state,
  coalesce(nullif(lower(regexp_extract(body, '(?im)^Status: *({_STATES})\b', 1)), ''), nullif(regexp_extract(lower(name), '[-_ ]({_STATES})(?:[-_ ][a-z]+)?\.[a-z0-9]+$', 1), ''), 'unclear') AS status,
  coalesce({_date(r"regexp_extract(name, '(\d{4}-\d{2}-\d{2})', 1)")}, {_date(r"regexp_extract(body, '(?i)(?:data as of|filed|compiled|source date:?|as of) (\d{4}-\d{2}-\d{2})', 1)")},
    CASE WHEN regexp_matches(body, '\A[^\n]*(?:as_of|date)') THEN {_date(r"regexp_extract(body, '\b(\d{4}-\d{2}-\d{2})\b', 1)")} END) AS source_date,
  CASE ext WHEN 'csv' THEN 'data_export' ELSE 'narrative' END AS role, contains(name, '-draft') AS is_draft FROM b)"""
_STATUS_LINE = I.STATUS_LINE
_SEED = rf"""{_INV}, c AS (SELECT {_id("claim", "source_id", "kind", "page", "ordinal", "NULL", "text")} AS claim_id, source_id, 'seeded' AS origin, ordinal, CAST(len({_terms("text")}) AS BIGINT) AS n_terms
  FROM f WHERE contains(name, '-draft') AND kind IN ('paragraph', 'page_paragraph') AND NOT regexp_matches(text, '{_STATUS_LINE}') AND len({_terms("text")}) >= {C.LEAST_TERMS})"""


def _found(rule: str, severity: str, location: str, issue: str, source: str, subject: str, rest: str) -> str:
    row = f"SELECT DISTINCT '{rule}' AS rule_id, '{severity}' AS severity, {location} AS location, {issue} AS issue, CAST({source} AS VARCHAR) AS source_id, CAST({subject} AS VARCHAR) AS subject {rest}"
    return f"SELECT {_id('finding', 'rule_id', 'location', 'issue', 'source_id', 'subject')} AS finding_id, * FROM ({row})"


_AT = "concat('source:', name)"
_SOURCE_RULES = [
    ("undated_numbers", N.MUST, "Number-bearing source has no source date.", "number_bearing AND source_date IS NULL"),
    ("unclear_status", N.SHOULD, "Source status is unclear.", "status = 'unclear'"),
    ("scanned_pdf", N.MUST, "PDF has no extractable text: it needs OCR or replacement.", "ext = 'pdf' AND inspection = 'no text'"),
    ("unreadable", N.MUST, "Source could not be read.", "inspection LIKE 'unreadable%'"),
]
_SF = f"{_INV}, sf AS (" + " UNION ALL ".join(_found(rule, severity, _AT, f"'{issue}'", "source_id", "NULL", f"FROM i WHERE {where}") for rule, severity, issue, where in _SOURCE_RULES) + ")"
_VC = f"{_INV}, v AS (SELECT {_id('conflict', chr(39) + 'version' + chr(39), 'stem')} AS conflict_id, 'version' AS kind, list_sort(list(DISTINCT name)) AS names FROM i WHERE name_state IS NOT NULL GROUP BY stem HAVING count(DISTINCT name_state) > 1)"
_ALIAS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in K.ALIASES.items()) + "}"
_MET = rf"""m AS (SELECT concat('x', strftime(o_orderdate, '%Y')) AS source_id, array_to_string(list_transform(string_split(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_'),
  lambda w: coalesce({_ALIAS}[w], {_ALIAS}[regexp_replace(w, 's$', '')], w)), '_') AS metric, CAST(count(*) AS VARCHAR) AS value, concat(strftime(o_orderdate, '%Y'), '-12-31') AS as_of
  FROM orders GROUP BY strftime(o_orderdate, '%Y'), o_orderpriority)"""
#: Exports that disagree, by pairs of points p (metric, as_of, value, name): of one date, or of two dates with none between that no export has both of.
_APART = f"""y AS (SELECT a.metric, a.name AS one, b.name AS other FROM p a JOIN p b ON a.metric = b.metric AND a.value <> b.value AND a.name <> b.name AND a.as_of = b.as_of UNION
  SELECT a.metric, a.name, b.name FROM p a JOIN p b ON a.metric = b.metric AND a.as_of < b.as_of
  WHERE (SELECT list_sort(list(DISTINCT value)) FROM p c WHERE c.metric = a.metric AND c.as_of = a.as_of) <> (SELECT list_sort(list(DISTINCT value)) FROM p c WHERE c.metric = b.metric AND c.as_of = b.as_of)
    AND NOT EXISTS (SELECT 1 FROM p c WHERE c.metric = a.metric AND c.as_of > a.as_of AND c.as_of < b.as_of)
    AND NOT EXISTS (SELECT 1 FROM p c JOIN p d ON c.metric = d.metric AND c.name = d.name WHERE c.metric = a.metric AND c.as_of = a.as_of AND d.as_of = b.as_of)),
n AS (SELECT metric, one AS name FROM y UNION SELECT metric, other FROM y)
SELECT {_id('conflict', chr(39) + 'metric' + chr(39), 'metric')} AS conflict_id, metric, string_agg(name, ',' ORDER BY name) AS sources FROM n GROUP BY metric"""
_WIDE = r"""q AS (SELECT CAST(strftime(o_orderdate, '%Y') AS INT) AS y, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') AS metric, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT metric, concat(y, '-12-31') AS as_of, CAST(n AS VARCHAR) AS value, 'all.csv' AS name FROM q WHERE y <= 1995 UNION ALL SELECT metric, concat(y, '-12-31'), CAST(CASE WHEN y % 4 = 1 AND metric LIKE '2%' THEN -n ELSE n END AS VARCHAR), 'wide.csv' FROM q WHERE y >= 1993
  UNION ALL SELECT metric, concat(y, '-12-31'), CAST(n AS VARCHAR), 'last.csv' FROM q WHERE metric LIKE '1%' AND y = (SELECT max(y) FROM q))"""
_BOOK = """x AS (SELECT concat('w', l_returnflag) AS source_id, concat('book', l_returnflag, '.xlsx') AS name, concat(l_linestatus, '-sheet') AS sheet, CAST(l_orderkey AS INT) AS "row", chr(64 + CAST(l_linenumber AS INT)) AS col,
  concat(chr(64 + CAST(l_linenumber AS INT)), l_orderkey) AS cell, l_orderkey % 7 = 0 AND l_linenumber < 3 AS word, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value,
  CASE WHEN l_discount >= 0.05 THEN concat('SUM(A1:A', CAST(l_quantity AS BIGINT), ')') END AS formula FROM lineitem),
s AS (SELECT DISTINCT source_id, name, sheet, CASE sheet WHEN 'O-sheet' THEN 'hidden' ELSE 'visible' END AS state FROM x UNION ALL SELECT DISTINCT 'wA', 'bookA.xlsx', 'Checks', 'visible' FROM x WHERE source_id = 'wA'),
h AS (SELECT * FROM (SELECT *, avg(CASE WHEN formula IS NULL THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY source_id, sheet, col) AS share FROM x WHERE NOT word OR formula IS NOT NULL) WHERE formula IS NULL AND share >= 0.5)"""
_LOGS = f"""g AS (SELECT *, lpad(CAST(event_id AS VARCHAR), 12, '0') AS decision_id, concat(CASE event_type WHEN 'click' THEN 'n' ELSE 'c' END, user_id) AS claim, concat('e', event_id % 40) AS ev FROM events),
lc AS (SELECT claim AS target_id, decision_id, CASE event_type WHEN 'purchase' THEN 'delete' WHEN 'signup' THEN 'edit' ELSE 'create' END AS action, concat('Edited statement number ', event_id) AS said
  FROM g WHERE event_type IN ('purchase', 'signup', 'click') QUALIFY row_number() OVER (PARTITION BY claim ORDER BY ts DESC, decision_id DESC) = 1),
ls AS (SELECT claim AS claim_id, ev AS evidence_id, decision_id, event_id FROM g WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY claim, ev ORDER BY ts DESC, decision_id DESC) = 1),
su AS (SELECT claim_id, evidence_id, concat('b', item_id % 7) AS source_id, decision_id FROM ls JOIN benchmark ON evidence_id = concat('e', item_id) WHERE event_id % 11 <> 0)"""
_GEN = f"""{_LOGS}, ge AS (SELECT {_id("generated", "claim_id", "evidence_id")} AS generated_id, claim_id, evidence_id, concat(source_id, '.md') AS source_name, CASE WHEN source_id <> 'b3' THEN '2025-01-01' END AS source_date, source_id <> 'b5' AS selected
  FROM su JOIN documents ON claim_id = concat('c', doc_id))"""
_CLAIM_RULES = " UNION ALL ".join([
    _found("no_attribution", N.MUST, "'section-map'", "'Claim has no source attribution.'", "NULL", "concat('c', doc_id)", "FROM documents WHERE concat('c', doc_id) NOT IN (SELECT claim_id FROM su)"),
    _found("risky_claim", N.SHOULD, "'section-map'", "'Claim states an absolute.'", "NULL", "concat('c', doc_id)", f"FROM documents WHERE regexp_matches(text, '{N.RISKY}')"),
    _found("unsourced_number", N.SHOULD, "'section-map'", "'Claim has a number without a source.'", "NULL", "concat('c', doc_id)", f"FROM documents WHERE concat('c', doc_id) NOT IN (SELECT claim_id FROM su) AND regexp_matches({_plain_text()}, '[0-9]')"),
])
_BOOK_AT = "concat('workbook:', name)"
_BOOK_RULES = " UNION ALL ".join([
    _found("hardcodes", N.MUST, _BOOK_AT, "'Hardcoded numbers appear in calculation-like zones.'", "source_id", "NULL", "FROM h"),
    _found("hidden_sheet", N.SHOULD, "concat('workbook:', name, ':', sheet)", "'Workbook contains a hidden sheet.'", "source_id", "NULL", "FROM s WHERE state = 'hidden'"),
    _found("no_checks", N.SHOULD, _BOOK_AT, "'No checks sheet detected.'", "source_id", "NULL", "FROM s WHERE source_id NOT IN (SELECT source_id FROM s WHERE contains(lower(sheet), 'check'))"),
    _found("repeated_formula", N.SHOULD, "concat('workbook:', name, ':', sheet)", "'A static formula is repeated.'", "source_id", "NULL", f"FROM (SELECT source_id, name, sheet, formula FROM x WHERE formula IS NOT NULL GROUP BY ALL HAVING count(*) >= {W.REPEATED})"),
])
_LAW = r"""b0 AS (SELECT item_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS ls FROM benchmark),
pa AS (SELECT concat('a', item_id) AS source_id, item_id, unnest(range(1, len(ls) + 1)) AS paragraph, unnest(ls) AS line FROM b0),
fi AS (SELECT item_id, ls[1] AS line FROM b0 WHERE len(ls) > 0),
ma AS (SELECT item_id, concat('m', item_id) AS source_id, CASE WHEN item_id % 2 = 0 THEN replace(line, ' ', '  ') ELSE concat(line, ' More.') END AS text, CASE WHEN item_id % 5 = 0 THEN 'p0099' ELSE 'p0001' END AS pn, line FROM fi),
dr AS (SELECT item_id, concat('m', item_id) AS source_id, CASE WHEN item_id % 3 = 0 THEN 'conclusion' ELSE 'rule' END AS kind, CASE WHEN item_id % 2 = 0 THEN line ELSE concat(line, ' More.') END AS text FROM fi),
un AS (SELECT * FROM dr d WHERE NOT EXISTS (SELECT 1 FROM ma m WHERE d.kind = 'rule' AND trim(regexp_replace(lower(m.text), '\s+', ' ', 'g')) = trim(regexp_replace(lower(d.text), '\s+', ' ', 'g')))),
me AS (SELECT *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) = trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS verbatim FROM ma WHERE pn = 'p0001')"""
_FINDING = "SELECT finding_id, rule_id, severity, location, issue, source_id, subject"
_PDF_TITLE = r"regexp_matches(t, '^\d+(\.\d+)*\.?\s+[A-Z].{0,70}$') OR regexp_matches(t, '^([A-Z][\w''-]*|of|and|the|in|for|to)( ([A-Z][\w''-]*|of|and|the|in|for|to)){0,7}$')"


_VERSIONS = """l AS (SELECT concat('doc', doc_id, '.md') AS name, CASE WHEN doc_id % 4 = 1 THEN concat('renamed', doc_id, '.md') ELSE concat('doc', doc_id, '.md') END AS later, line, CAST(place AS BIGINT) AS place, CASE WHEN doc_id % 8 = 5 THEN 0 ELSE (place + doc_id) % 143 END AS m
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS place FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents))),
o AS (SELECT name, place, line FROM l),
w AS (SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY spot) AS BIGINT) AS place, line FROM (
  SELECT later AS name, 2 * place + CASE WHEN m % 13 = 6 THEN 1000000 ELSE 0 END AS spot, CASE WHEN m % 11 = 5 THEN 'Changed: ' || line ELSE line END AS line FROM l WHERE m % 7 <> 3
  UNION ALL SELECT later, 2 * place + 1, 'Added after line ' || place FROM l WHERE m % 9 = 4)),
fo AS (SELECT name, string_agg(sha256(line), '' ORDER BY place) AS body FROM o GROUP BY name), fw AS (SELECT name, string_agg(sha256(line), '' ORDER BY place) AS body FROM w GROUP BY name),
t AS (SELECT name FROM fo JOIN fw USING (name)),
ao AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY name) AS k FROM fo WHERE name NOT IN (FROM t)), aw AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY name) AS k FROM fw WHERE name NOT IN (FROM t)),
eq AS (SELECT ao.name AS old_name, aw.name AS new_name FROM ao JOIN aw USING (body, k)),
so AS (SELECT DISTINCT name, line FROM o WHERE name IN (SELECT name FROM ao) AND name NOT IN (SELECT old_name FROM eq)), sw AS (SELECT DISTINCT name, line FROM w WHERE name IN (SELECT name FROM aw) AND name NOT IN (SELECT new_name FROM eq)),
sh AS (SELECT so.name AS old_name, sw.name AS new_name, count(*) AS shared FROM so JOIN sw USING (line) GROUP BY ALL),
ne AS (SELECT * FROM sh JOIN (SELECT name AS old_name, count(*) AS p FROM so GROUP BY ALL) USING (old_name) JOIN (SELECT name AS new_name, count(*) AS q FROM sw GROUP BY ALL) USING (new_name) WHERE 2 * shared >= greatest(p, q)),
be AS (SELECT * FROM ne QUALIFY row_number() OVER (PARTITION BY old_name ORDER BY shared DESC, new_name) = 1 AND row_number() OVER (PARTITION BY new_name ORDER BY shared DESC, old_name) = 1),
pa AS (SELECT name AS old_name, name AS new_name, 'same name' AS how FROM t UNION ALL SELECT *, 'same content' FROM eq UNION ALL SELECT old_name, new_name, 'shared passages' FROM be)"""
#: Levels by rounds: a passage is on level k + 1 if one of level k stands before it in both versions. Of a level's passages on a longest run the first counts.
_ALIGNED = f"""{_VERSIONS}, po AS (SELECT pa.*, place, line, row_number() OVER (PARTITION BY old_name, line ORDER BY place) AS k FROM pa JOIN o ON name = old_name), pw AS (SELECT pa.*, place, line, row_number() OVER (PARTITION BY new_name, line ORDER BY place) AS k FROM pa JOIN w ON name = new_name),
x AS (SELECT old_name, new_name, po.place AS a, pw.place AS b FROM po FULL JOIN pw USING (old_name, new_name, line, k)), mt AS (SELECT * FROM x WHERE a IS NOT NULL AND b IS NOT NULL),
up AS (SELECT old_name, a, b, 1 AS r FROM mt UNION SELECT y.old_name, y.a, y.b, up.r + 1 FROM up JOIN mt y ON y.old_name = up.old_name AND y.a > up.a AND y.b > up.b),
dn AS (SELECT old_name, a, b, 1 AS r FROM mt UNION SELECT y.old_name, y.a, y.b, dn.r + 1 FROM dn JOIN mt y ON y.old_name = dn.old_name AND y.a < dn.a AND y.b < dn.b),
lv AS (SELECT * FROM (SELECT old_name, a, max(r) AS u FROM up GROUP BY ALL) JOIN (SELECT old_name, a, max(r) AS d FROM dn GROUP BY ALL) USING (old_name, a)),
kp AS (SELECT old_name, min(a) AS a FROM lv JOIN (SELECT old_name, max(u) AS most FROM lv GROUP BY ALL) USING (old_name) WHERE u + d - 1 = most GROUP BY old_name, u),
mk AS (SELECT x.*, kp.a IS NOT NULL AS kept FROM x LEFT JOIN kp USING (old_name, a)),
ga AS (SELECT *, row_number() OVER (PARTITION BY old_name, g ORDER BY a) AS k FROM (SELECT *, count(*) FILTER (kept) OVER (PARTITION BY old_name ORDER BY a) AS g FROM mk WHERE a IS NOT NULL) WHERE b IS NULL),
gb AS (SELECT *, row_number() OVER (PARTITION BY old_name, g ORDER BY b) AS k FROM (SELECT *, count(*) FILTER (kept) OVER (PARTITION BY old_name ORDER BY b) AS g FROM mk WHERE b IS NOT NULL) WHERE a IS NULL),
ch AS (SELECT old_name, new_name, CASE WHEN kept THEN 'kept' ELSE 'moved' END AS change, a AS old_place, b AS new_place FROM mk WHERE a IS NOT NULL AND b IS NOT NULL
  UNION ALL SELECT old_name, new_name, CASE WHEN gb.b IS NULL THEN 'removed' WHEN ga.a IS NULL THEN 'new' ELSE 'changed' END, ga.a, gb.b FROM ga FULL JOIN gb USING (old_name, new_name, g, k)
  UNION ALL SELECT name, NULL, 'removed', place, NULL FROM o WHERE name NOT IN (SELECT old_name FROM pa) UNION ALL SELECT NULL, name, 'new', NULL, place FROM w WHERE name NOT IN (SELECT new_name FROM pa))"""


def oracle_sql():
    return {
        "packet_inventory": f"WITH {_INV} SELECT source_id, name, ext, inspection, stem, name_state, status, CAST(source_date AS VARCHAR) AS source_date, role, number_bearing, consistent FROM i",
        "packet_headings": f"WITH {_F} SELECT source_id, ordinal, CAST(1 + length(source_id) % 3 AS BIGINT) AS level, text FROM f WHERE kind = 'heading'",
        "packet_pdf_sections": f"WITH {_F} SELECT source_id, page, ordinal, text FROM (SELECT *, text AS t FROM f WHERE kind = 'page_paragraph') WHERE ({_PDF_TITLE}) AND NOT regexp_matches(t, '[.,;:]\\s*$')",
        "packet_slides": "SELECT concat('deck', conv_id) AS source_id, turn + 1 AS slide, CASE role WHEN 'user' THEN 'slide_text' ELSE 'slide_note' END AS part_kind, text FROM conversations",
        "packet_tables": "SELECT concat('r', n_regionkey) AS source_id, n_nationkey AS \"row\", concat('A', n_nationkey) AS cell, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT concat('r', n_regionkey), n_nationkey, concat('B', n_nationkey), n_name FROM nation",
        "packet_evidence": f"WITH {_INV} SELECT {_id('evidence', 'source_id', 'kind', 'page', 'NULL', 'ordinal', 'text')} AS evidence_id, source_id, status, kind, ordinal, CAST(len({_terms('text')}) AS BIGINT) AS n_terms FROM f JOIN i USING (source_id) WHERE NOT is_draft AND kind <> 'heading' AND text IS NOT NULL AND NOT regexp_matches(text, '{_STATUS_LINE}')",
        "packet_claims": f"WITH {_SEED} SELECT * FROM c",
        "packet_empty_drafts": f"WITH {_SEED} SELECT source_id, name FROM i WHERE is_draft AND source_id NOT IN (SELECT source_id FROM c)",
        "packet_source_findings": f"WITH {_SF} {_FINDING} FROM sf",
        "packet_selection": f"WITH {_SF} SELECT i.source_id, bool_and(sf.issue IS NULL) AS selected, string_agg(DISTINCT sf.issue, '; ' ORDER BY sf.issue) AS excluded_reason FROM i LEFT JOIN sf ON i.source_id = sf.source_id AND sf.severity = 'must_fix' GROUP BY i.source_id",
        "packet_clean_sources": f"WITH {_SF} SELECT source_id, name FROM i WHERE source_id NOT IN (SELECT source_id FROM sf)",
        "packet_version_conflicts": f"WITH {_VC} SELECT conflict_id, kind, array_to_string(names, ',') AS sources FROM v",
        "packet_conflict_findings": f"WITH {_VC} " + _found("conflict", N.MUST, "'source-conflict'", "concat('Potential version/status conflict across: ', array_to_string(names, ', '))", "NULL", "conflict_id", "FROM v"),
        "packet_metrics": f"WITH {_MET} SELECT source_id, metric, value, as_of FROM m",
        "packet_metric_conflicts": f"WITH {_MET}, p AS (SELECT metric, as_of, value, concat(source_id, '.csv') AS name FROM m), {_APART}",
        "packet_wide_conflicts": f"WITH {_WIDE}, {_APART}",
        "packet_guarded_conflicts": f"WITH {_WIDE.replace('p AS (', 'p0 AS (')}, p AS (SELECT * FROM p0 WHERE name <> 'wide.csv'), {_APART}",
        "contradicted_numbers": """WITH p AS (SELECT p_partkey AS id, CAST(p_retailprice AS DECIMAL(12,2)) AS price FROM part WHERE p_retailprice > 0), s AS (SELECT *, price + 1 AS other, regexp_replace(regexp_replace(CAST(price AS VARCHAR), '0+$', ''), '[.]$', '') AS a, regexp_replace(regexp_replace(CAST(price + 1 AS VARCHAR), '0+$', ''), '[.]$', '') AS b FROM p WHERE id % 3 = 2 AND id % 4 <> 0)
            SELECT DISTINCT concat('c', id) AS claim_id, concat('e', id) AS evidence_id, concat('$', a) AS amount, concat('$', b) AS other, CASE id % 4 WHEN 1 THEN 'contradicted' ELSE 'outdated' END AS relation FROM s
            UNION SELECT concat('c', p_partkey), concat('e', p_partkey), '5%', '7%', CASE p_partkey % 4 WHEN 1 THEN 'contradicted' ELSE 'outdated' END FROM part WHERE p_retailprice > 0 AND p_partkey % 4 <> 0""",
        "balance_overlap": "SELECT c_custkey, s_suppkey, CAST(1 AS BIGINT) AS number_overlap FROM customer JOIN supplier ON abs(trunc(c_acctbal)) = abs(trunc(s_acctbal))",
        "packet_pdf_citations": "SELECT concat('p', p_partkey) AS source_id, 1 AS page, p_size AS ordinal, unnest([concat('[Part ', p_partkey, ']'), concat('https://parts.example/', p_partkey)]) AS citation FROM part",
        "packet_pdf_table_rows": "SELECT concat('p', p_partkey) AS source_id, 1 AS page, p_size AS ordinal, CAST(1 AS BIGINT) AS line, concat_ws('|', p_partkey, p_brand, p_size) AS cells FROM part",
        "packet_undeclared_claims": rf"""WITH {_INV} SELECT {_id("claim", "source_id", "kind", "page", "ordinal", "NULL", "text")} AS claim_id, source_id, ordinal FROM f WHERE kind IN ('paragraph', 'page_paragraph') AND NOT regexp_matches(text, '{_STATUS_LINE}') AND len({_terms("text")}) >= {C.LEAST_TERMS}""",
        "book_findings": f"WITH {_BOOK} {_FINDING} FROM ({_BOOK_RULES})",
        "reviewed_calculations": f"WITH {_BOOK} {_FINDING} FROM ({_BOOK_RULES}) WHERE rule_id <> 'hardcodes' OR source_id = 'wN'",
        "book_sheets": f"WITH {_BOOK} SELECT source_id, sheet, state FROM s",
        "book_hidden_sheets": f"WITH {_BOOK} SELECT source_id, sheet FROM s WHERE state = 'hidden'",
        "book_headers": f'WITH {_BOOK}, r AS (SELECT source_id, sheet, "row" FROM x GROUP BY source_id, sheet, "row" HAVING bool_and(word AND formula IS NULL) QUALIFY row_number() OVER (PARTITION BY source_id, sheet ORDER BY "row") = 1) SELECT source_id, sheet, "row", cell, value AS header FROM x JOIN r USING (source_id, sheet, "row")',
        "book_formulas": f"WITH {_BOOK} SELECT source_id, sheet, cell, formula FROM x WHERE formula IS NOT NULL",
        "book_hardcodes": f"WITH {_BOOK} SELECT source_id, sheet, cell, value FROM h",
        "book_without_checks": f"WITH {_BOOK} SELECT DISTINCT source_id, name FROM s WHERE source_id NOT IN (SELECT source_id FROM s WHERE contains(lower(sheet), 'check'))",
        "book_repeated_formulas": f"WITH {_BOOK} SELECT source_id, sheet, formula, count(*) AS n FROM x WHERE formula IS NOT NULL GROUP BY ALL HAVING count(*) >= {W.REPEATED}",
        "book_repairs": f'WITH {_BOOK} SELECT h.source_id, h.sheet, h.cell, h.value, arg_min(o.formula, ROW(abs(h."row" - o."row"), o."row", o.formula)) AS suggested_input, CAST({len(W.REPAIRS["hardcode"])} AS BIGINT) AS steps FROM h JOIN x o ON o.formula IS NOT NULL AND h.source_id = o.source_id AND h.sheet = o.sheet AND h.col = o.col GROUP BY h.source_id, h.sheet, h.cell, h.value',
        "decision_latest": f"WITH {_LOGS} SELECT target_id, decision_id, action FROM lc",
        "reviewed_claims": f"""WITH {_LOGS}, a AS (SELECT concat('c', doc_id) AS claim_id, text FROM documents), u AS (SELECT claim, event_type, concat('Edited statement number ', event_id) AS said, ROW(ts, decision_id) AS place FROM g),
            r AS (SELECT claim_id, CASE WHEN e.said IS NULL THEN 'seeded' ELSE 'edited' END AS origin, coalesce(e.said, text) AS text FROM a LEFT JOIN (SELECT claim, arg_max(said, place) AS said FROM u WHERE event_type = 'signup' GROUP BY claim) e ON claim = claim_id
                WHERE claim_id NOT IN (SELECT claim FROM u WHERE event_type = 'purchase')
              UNION ALL SELECT claim, 'created', arg_min(said, place) FROM u WHERE event_type = 'click' GROUP BY claim)
            SELECT claim_id, origin, sha256(text) AS text_sha256, CAST(len({_terms("text")}) AS BIGINT) AS n_terms FROM r""",
        "replayed_claims": """WITH RECURSIVE e AS (SELECT concat('c', user_id) AS claim_id, CASE event_type WHEN 'click' THEN 'create' WHEN 'signup' THEN 'edit' WHEN 'purchase' THEN 'delete' WHEN 'view' THEN 'merge' ELSE 'edit' END AS action, CASE WHEN event_type <> 'error' THEN concat('t', event_id) END AS said,
              concat('c', user_id + 1) AS goal, row_number() OVER (PARTITION BY user_id ORDER BY ts, lpad(CAST(event_id AS VARCHAR), 12, '0')) AS n FROM events WHERE user_id IS NOT NULL),
            s AS (SELECT concat('c', doc_id) AS claim_id, text FROM documents WHERE doc_id % 2 = 0),
            r AS (SELECT claim_id, 0 AS n, s.claim_id IS NOT NULL AS live, CASE WHEN s.claim_id IS NOT NULL THEN 'seeded' END AS origin, text, CAST(NULL AS VARCHAR) AS "into" FROM (SELECT DISTINCT claim_id FROM e) FULL JOIN s USING (claim_id)
              UNION ALL SELECT claim_id, r.n + 1, CASE action WHEN 'create' THEN live OR said IS NOT NULL WHEN 'edit' THEN live WHEN 'merge' THEN false ELSE false END,
                CASE WHEN action = 'create' AND NOT live AND said IS NOT NULL THEN 'created' WHEN action = 'edit' AND live AND said IS NOT NULL AND origin <> 'created' THEN 'edited' ELSE origin END,
                CASE WHEN said IS NOT NULL AND ((action = 'create' AND NOT live) OR (action = 'edit' AND live)) THEN said ELSE text END,
                CASE WHEN action = 'delete' OR (action = 'create' AND NOT live AND said IS NOT NULL) THEN NULL WHEN action = 'merge' AND (live OR "into" IS NOT NULL) THEN goal ELSE "into" END
                FROM r JOIN e USING (claim_id) WHERE e.n = r.n + 1)
            SELECT claim_id, arg_max(live, n) AS live, arg_max(ROW(origin), n)[1] AS origin, sha256(arg_max(ROW(text), n)[1]) AS text_sha256, arg_max(ROW("into"), n)[1] AS "into" FROM r GROUP BY claim_id""",
        "attached_support": f"WITH {_LOGS} SELECT claim_id, evidence_id, source_id, decision_id FROM su",
        "merged_support": f"""WITH RECURSIVE {_LOGS}, mg AS (SELECT doc_id, doc_id AS pos FROM documents WHERE doc_id % 3 = 0 AND doc_id % 30 <> 0 UNION ALL SELECT doc_id, pos - 3 FROM mg WHERE pos % 30 <> 0),
            en AS (SELECT concat('c', doc_id) AS claim_id, concat('c', min(pos)) AS ending FROM mg GROUP BY doc_id) SELECT coalesce(ending, claim_id) AS claim_id, evidence_id, decision_id FROM su LEFT JOIN en USING (claim_id)""",
        "reviewed_conflicts": f"WITH {_VC} SELECT conflict_id, array_to_string(names, ',') AS sources FROM v WHERE conflict_id NOT IN (SELECT {_id('conflict', chr(39) + 'version' + chr(39), 'concat(' + chr(39) + 'doc' + chr(39) + ', user_id)')} FROM events WHERE event_type = 'error')",
        "reviewed_findings": f"WITH {_SF} SELECT finding_id, location, issue FROM sf WHERE CAST(substr(source_id, 2) AS BIGINT) % 4 <> 0",
        "packet_claim_findings": f"WITH {_LOGS} {_FINDING} FROM ({_CLAIM_RULES})",
        "generated_claims": f"WITH {_GEN} SELECT * FROM ge",
        "claim_receipt": f"WITH {_GEN}, r AS (SELECT claim_id, list_sort(list(DISTINCT evidence_id)) AS e, list_sort(list(DISTINCT source_name)) AS s FROM ge JOIN documents ON claim_id = concat('c', doc_id) GROUP BY claim_id, text) SELECT claim_id, CAST(len(e) AS BIGINT) AS n_evidence, array_to_string(e[1:3], ',') AS pointers, array_to_string(s, ',') AS sources FROM r",
        "receipt_citations": f"WITH {_GEN} SELECT DISTINCT claim_id, evidence_id, replace(source_name, '.md', '') AS source_id, source_date FROM ge",
        "receipt_sources": f"""WITH {_GEN} SELECT s.source_id, CASE WHEN s.source_id <> 'b3' THEN '2025-01-01' END AS source_date, CASE WHEN s.source_id = 'b5' THEN 'Number-bearing source has no source date.' END AS excluded_reason, count(DISTINCT claim_id) AS claims
            FROM (SELECT DISTINCT concat('b', item_id % 7) AS source_id FROM benchmark) s LEFT JOIN ge ON ge.source_name = concat(s.source_id, '.md') GROUP BY s.source_id""",
        "gate_blockers": rf"""WITH {_GEN} SELECT 'selected source conflict' AS blocker, 'k0' AS subject UNION ALL SELECT 'unsupported claim', concat('c', doc_id) FROM documents WHERE concat('c', doc_id) NOT IN (SELECT claim_id FROM su)
            UNION ALL SELECT DISTINCT 'undated numeric claim', generated_id FROM ge JOIN documents ON claim_id = concat('c', doc_id) WHERE source_date IS NULL AND regexp_matches({_plain_text()}, '[0-9]') UNION ALL SELECT DISTINCT 'claim rests on an excluded source', generated_id FROM ge WHERE NOT selected
            UNION ALL SELECT 'no generated claim', 'receipt' WHERE NOT EXISTS (SELECT 1 FROM ge)""",
        "legal_passages": f"WITH {_LAW} SELECT source_id, printf('passage_item%d_p%04d', item_id, paragraph) AS passage_id, CAST(paragraph AS INT) AS paragraph, sha256(line) AS quote_hash FROM pa",
        "legal_propositions": f"""WITH {_LAW} SELECT source_id, 'LEGAL-MAP' AS marker, 'rule' AS kind, concat('item', item_id, '.md') AS source, concat('passage_item', item_id, '_', pn) AS passage, 'para. 1' AS pin, 'binding' AS authority, sha256(text) AS text_sha256 FROM ma
            UNION ALL SELECT source_id, 'LEGAL-DRAFT', kind, NULL, NULL, NULL, NULL, sha256(text) FROM dr""",
        "legal_support": f"WITH {_LAW} SELECT source_id, concat('passage_item', item_id, '_p0001') AS passage, verbatim, sha256(line) AS quote_hash FROM me",
        "legal_unresolved": f"WITH {_LAW} SELECT source_id, concat('passage_item', item_id, '_p0099') AS passage FROM ma WHERE pn = 'p0099'",
        "legal_unmapped": f"WITH {_LAW} SELECT source_id, kind FROM un",
        "legal_trust": f"""WITH {_LAW}, t AS (SELECT 'unresolved_pin' AS rule_id, 'must_fix' AS severity, concat('source:memo', item_id, '.md') AS location FROM ma WHERE pn = 'p0099' UNION ALL SELECT 'draft_discipline', 'must_fix', concat('source:memo', item_id, '.md') FROM un
            UNION ALL SELECT 'paraphrase', 'should_fix', concat('source:memo', item_id, '.md') FROM me WHERE NOT verbatim UNION ALL SELECT 'undated_authority', 'should_fix', 'source:item1.md' FROM me WHERE item_id = 1)
            SELECT rule_id, severity, location, count(*) AS n FROM t GROUP BY ALL""",
        "legal_classes": f"""WITH {_LAW}, n AS (SELECT concat('a', item_id) AS source_id, CASE WHEN regexp_matches(text, '\\b\\d+ [A-Z][A-Za-z.]*(?: [A-Z][A-Za-z.]*)? \\d+\\b') OR regexp_matches(text, '(?i)\\bcourt of\\b') THEN 'case' ELSE 'other' END AS classification, text FROM benchmark JOIN fi USING (item_id)
            UNION ALL SELECT concat('m', item_id), 'draft', text FROM ma UNION ALL SELECT concat('t', item_id), 'assignment', '' FROM fi WHERE item_id % 4 = 0)
            SELECT source_id, classification, CASE WHEN regexp_matches(text, '(?i)\\b(overruled|reversed|superseded)\\b') THEN 'negative' ELSE 'unreviewed' END AS treatment_state FROM n""",
        "legal_boundaries": f"WITH {_LAW} SELECT concat('t', item_id) AS source_id, concat('law ', item_id % 3) AS boundary_key, concat('State ', item_id) AS jurisdiction FROM fi WHERE item_id % 4 = 0",
        "legal_output": f"WITH {_LAW} SELECT concat('t', item_id) AS source_id, 'memo' AS kind, concat('Is it ', item_id, '?') AS question, 'supplied packet only' AS source_scope FROM fi WHERE item_id % 4 = 0",
        "legal_reuse": f"WITH {_LAW} SELECT DISTINCT (SELECT min(concat('law ', item_id % 3)) FROM fi WHERE item_id % 4 = 0) AS boundary_key, sha256(text) AS text_sha256 FROM me WHERE item_id % 2 = 1",
        "source_history": f"SELECT concat('s', doc_id) AS source_id, {_NAME} AS name, sha256(text) AS fingerprint FROM documents",
        "paired_files": f"WITH {_VERSIONS} SELECT * FROM pa",
        "passage_changes": f"WITH RECURSIVE {_ALIGNED} SELECT coalesce(old_name, '') AS old_name, coalesce(new_name, '') AS new_name, change, coalesce(old_place, 0) AS old_place, coalesce(new_place, 0) AS new_place FROM ch",
        "voided_approvals": f"WITH RECURSIVE {_ALIGNED} SELECT concat(old_name, '_', old_place) AS evidence_id, change, CASE WHEN new_place IS NULL THEN '' ELSE new_name END AS new_name, coalesce(new_place, 0) AS new_place, change IN ('changed', 'removed') AS void FROM ch WHERE old_place % 3 = 0",
        "delimited_cells": """WITH d AS (SELECT coalesce(source, '') AS path, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS "row", doc_id, lang, text FROM documents), c AS (
            SELECT path, "row", 'A' AS l, CAST(doc_id AS VARCHAR) AS v FROM d UNION ALL SELECT path, "row", 'B', lang FROM d UNION ALL SELECT path, "row", 'C', text FROM d)
            SELECT path, "row", concat(l, "row") AS cell, sha256(v) AS value_sha256 FROM c""",
        "packet_refresh": f"""WITH d AS (SELECT doc_id, {_NAME} AS name FROM documents) SELECT name, CASE WHEN doc_id % 13 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM d WHERE NOT (doc_id % 13 = 0 AND doc_id % 11 = 0)""",
    }
