"""The legal profile: classes, passages, history, markers, pinpoint support, draft discipline, boundaries and reuse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .findings import MUST, SHOULD, _found, union

MAP = r"^LEGAL-MAP \[([^\]]+)\] *([^:]*?(?:\"[^\"]*\"[^:]*?)*): *(.+)$"
DRAFT = r"^LEGAL-DRAFT \[([^\]]+)\]: *(.+)$"
PASSAGE_KINDS = ("paragraph", "heading", "page_paragraph")


def marks(facts: DataFrame) -> DataFrame:
    """(source_id, ...) for each file with blocks: whether any has what tells the file's class, and the first line of each key.

    Blocks are looked at one by one and only what they say is aggregated, partly before the shuffle: no file's text is put together.
    """
    place = [F.coalesce("page", F.lit(0)).alias("page"), "ordinal"]

    def any_has(*patterns: str) -> Column:
        return F.coalesce(F.bool_or(reduce(Column.__or__, [F.col("text").rlike(p) for p in patterns])), F.lit(False))

    def first(pattern: str) -> Column:
        found = F.regexp_extract("text", pattern, 1)
        return F.coalesce(F.min(F.when(found != "", F.struct(*place, found.alias("found"))))["found"], F.lit(""))

    line = lambda key: F.nullif(F.trim(first(rf"(?im)^{key}: *(.+)$")), F.lit(""))
    return (
        facts.where(F.col("kind").isin(*PASSAGE_KINDS))
        .groupBy("source_id")
        .agg(
            any_has(r"(?m)^LEGAL-(MAP|DRAFT) ").alias("marked"),
            any_has(r"(?im)^(question presented|course):").alias("assigned"),
            any_has(r"(?m)\b\d+ [A-Z][A-Za-z.]*(?: [A-Z][A-Za-z.]*)? \d+\b", r"(?i)\bcourt of\b").alias("reported"),
            any_has(r"(?i)\b(overruled|reversed|superseded)\b").alias("negative"),
            any_has(r"(?im)^(course|matter):").alias("bounded"),
            F.lower(F.coalesce(line("course"), line("matter"))).alias("boundary_key"),
            line("jurisdiction").alias("jurisdiction"),
            any_has(r"(?im)^question presented:").alias("asks"),
            F.trim(first(r"(?im)^question presented: *(.+)$")).alias("question"),
            F.nullif(F.lower(first(r"(?i)prepare an? (?:short |brief |long )?(?:legal )?(\w+)")), F.lit("")).alias("output"),
            any_has(r"(?i)using only the supplied packet|only the packet").alias("packet_only"),
        )
    )


def classify(sources: DataFrame, marks: DataFrame) -> DataFrame:
    """(source_id, classification, treatment_state): draft by its markers, assignment by its questions, case by its reporter or court."""
    b = sources.join(marks.drop("name"), "source_id", "left")
    kind = F.when(F.col("marked"), "draft").when(F.col("assigned"), "assignment").when(F.coalesce("reported", F.lit(False)) | F.lower("name").rlike(r"-v-"), "case").otherwise("other")
    return b.select("source_id", "name", kind.alias("classification"), F.when(F.col("negative"), "negative").otherwise("unreviewed").alias("treatment_state"))


def passages(facts: DataFrame) -> DataFrame:
    """Citeable passages: (source_id, name, passage_id, page, paragraph, text, quote_hash). Paragraphs count blocks, headings too; on pages, those of the page."""
    f = facts.where(F.col("kind").isin(*PASSAGE_KINDS) & F.col("ext").isin("md", "txt", "docx", "pdf"))
    return f.select("source_id", "name", X.passage_id(F.col("name"), F.col("ordinal"), F.col("page")).alias("passage_id"), "page", F.col("ordinal").alias("paragraph"), "text", F.sha2("text", 256).alias("quote_hash"))


def history(sources: DataFrame) -> DataFrame:
    return sources.select("source_id", "name", F.col("sha256").alias("fingerprint"))


def _attribute(attributes: Column, key: str) -> Column:
    quoted = F.regexp_extract(attributes, rf'\b{key}="([^"]*)"', 1)
    plain = F.regexp_extract(attributes, rf"\b{key}=([^\s\"]+)", 1)
    return F.nullif(F.coalesce(F.nullif(quoted, F.lit("")), plain), F.lit(""))


def propositions(facts: DataFrame) -> DataFrame:
    """Marked propositions: (source_id, name, marker, kind, source, passage, pin, authority, text)."""
    lines = facts.where(F.col("kind").isin(*PASSAGE_KINDS)).select("source_id", "name", F.explode(F.split("text", "\n")).alias("line"))
    mapped, draft = lines.where(F.col("line").startswith("LEGAL-MAP ")), lines.where(F.col("line").startswith("LEGAL-DRAFT "))
    part = lambda k: F.regexp_extract("line", MAP, k)
    none = F.lit(None).cast("string")
    m = mapped.select("source_id", "name", F.lit("LEGAL-MAP").alias("marker"), part(1).alias("kind"), *[_attribute(part(2), k).alias(k) for k in ("source", "passage", "pin", "authority")], part(3).alias("text"))
    d = draft.select("source_id", "name", F.lit("LEGAL-DRAFT").alias("marker"), F.regexp_extract("line", DRAFT, 1).alias("kind"), none.alias("source"), none.alias("passage"), none.alias("pin"), none.alias("authority"), F.regexp_extract("line", DRAFT, 2).alias("text"))
    p = m.unionByName(d)
    return p.withColumn("proposition_id", X.content_id("proposition", F.col("marker"), F.col("kind"), F.col("passage"), F.col("text")))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def legal_map(propositions: DataFrame, passages: DataFrame) -> DataFrame:
    """Mapped propositions with the passage that they pin and whether its words are the proposition's."""
    p = passages.select(F.col("passage_id").alias("passage"), F.col("name").alias("source"), "quote_hash", F.col("text").alias("passage_text"))
    m = propositions.where("marker = 'LEGAL-MAP'").join(p, ["passage", "source"])
    return m.withColumn("verbatim", _plain(F.col("text")) == _plain(F.col("passage_text")))


def unresolved(propositions: DataFrame, passages: DataFrame) -> DataFrame:
    """Mapped propositions whose passage isn't in the packet."""
    p = passages.select(F.col("passage_id").alias("passage"), F.col("name").alias("source"))
    return propositions.where("marker = 'LEGAL-MAP'").join(p, ["passage", "source"], "left_anti")


def unmapped(propositions: DataFrame) -> DataFrame:
    """Draft propositions without a mapped one of the same kind and words."""
    key = propositions.withColumn("key", F.concat_ws("\x1f", F.lower("kind"), _plain(F.col("text"))))
    return key.where("marker = 'LEGAL-DRAFT'").join(key.where("marker = 'LEGAL-MAP'").select("key"), "key", "left_anti").drop("key")


def trust_findings(propositions: DataFrame, passages: DataFrame, sources: DataFrame) -> DataFrame:
    name = F.concat(F.lit("source:"), F.col("name"))
    words = lambda text: F.concat(F.lit(text), F.col("text"))
    undated = sources.where("source_date is null").join(legal_map(propositions, passages).select(F.col("source").alias("name")).distinct(), "name", "left_semi")
    return union(
        _found(unresolved(propositions, passages), "unresolved_pin", MUST, name, words("Mapped proposition pins no passage of the packet: "), F.col("source_id")),
        _found(unmapped(propositions), "draft_discipline", MUST, name, words("Draft proposition is not mapped: "), F.col("source_id")),
        _found(legal_map(propositions, passages).where("not verbatim"), "paraphrase", SHOULD, name, words("Mapped proposition differs from its passage: "), F.col("source_id")),
        _found(undated, "undated_authority", SHOULD, name, "Pinned source has no date.", F.col("source_id")),
    )


def boundary(sources: DataFrame, marks: DataFrame) -> DataFrame:
    """(source_id, boundary_key, jurisdiction) from the assignment's course or matter."""
    return sources.select("source_id").join(marks.where("bounded"), "source_id").select("source_id", "boundary_key", "jurisdiction")


def output_spec(sources: DataFrame, marks: DataFrame) -> DataFrame:
    """What the assignment asks for: kind of output, question, and whether only the packet may be used."""
    scope = F.when(F.col("packet_only"), "supplied packet only").otherwise("supplied packet")
    asked = sources.select("source_id").join(marks.where("asks"), "source_id")
    return asked.select("source_id", F.coalesce("output", F.lit("document")).alias("kind"), "question", scope.alias("source_scope"))


def reuse_library(mapped: DataFrame, accepted: DataFrame, boundary: DataFrame) -> DataFrame:
    """Reviewed propositions, each within the boundary of its run: (boundary_key, proposition_id, text)."""
    reviewed = mapped.join(accepted.select(F.col("target_id").alias("proposition_id")), "proposition_id", "left_semi")
    key = boundary.agg(F.min("boundary_key").alias("boundary_key")).where("boundary_key is not null")
    return reviewed.join(F.broadcast(key), F.lit(True)).select("boundary_key", "proposition_id", "text").distinct()


def boundary_folder(key: Column) -> Column:
    """A boundary as the name of a folder."""
    return F.concat(F.lit("b"), F.substring(F.sha2(key, 256), 1, 16))


def reviewed(mapped: DataFrame, accepted: DataFrame, key: str | None) -> DataFrame:
    """The run's reviewed propositions as later runs may reuse them: boundary_key, proposition_id, text, passage, quote_hash."""
    own = mapped.join(accepted.select(F.col("target_id").alias("proposition_id")), "proposition_id", "left_semi").where(F.lit(key is not None))
    return own.select(F.lit(key).cast("string").alias("boundary_key"), "proposition_id", "text", "passage", "quote_hash").distinct()


def reusable(own: DataFrame, earlier: DataFrame, passages: DataFrame) -> DataFrame:
    """Own and earlier reviewed propositions of one boundary with their state.

    An earlier one is reusable if the packet has its passage word for word, void if the passage changed, absent if the packet hasn't got
    it; one that the run has reviewed itself counts as own.
    """
    here = passages.select(F.col("passage_id").alias("passage"), "quote_hash").distinct()
    rest = earlier.select(*own.columns).distinct().join(own, "proposition_id", "left_anti")
    same = rest.join(here.withColumn("same", F.lit(True)), ["passage", "quote_hash"], "left").join(here.select("passage").distinct().withColumn("there", F.lit(True)), "passage", "left")
    state = F.when(F.col("same"), "reusable").when(F.col("there"), "void").otherwise("absent")
    return own.withColumn("state", F.lit("own")).unionByName(same.withColumn("state", state).select(*own.columns, "state"))
