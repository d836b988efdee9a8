"""Terms, numbers, dates, states and paragraphs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to tell sources apart.
STOPWORDS = ("the", "and", "for", "that", "this", "with", "from", "are", "was", "were", "has", "have", "had", "not", "but", "its", "their", "which", "upon", "into", "than", "then", "will", "may", "can", "our", "your", "they", "been", "being", "any", "all", "per")
LEAST_TERM = 3
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
ISO_DATE = r"\b(\d{4}-\d{2}-\d{2})\b"
LONG_DATE = rf"\b((?:{MONTHS}) \d{{1,2}}, \d{{4}})\b"
MONTH_YEAR = rf"\b((?:{MONTHS}) \d{{4}})\b"
CITE = r"\[[^\]]*\]"
NUMBER = r"\$?([0-9][0-9,]*(?:\.[0-9]+)?)(?: ?(%|percent|thousand|million|billion))?"


def terms(text: Column) -> Column:
    """Different terms of a text: runs of letters and digits in lower case, of three or more, without stop words. Null has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[\p{{L}}\p{{N}}]{{{LEAST_TERM},}}"), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in STOPWORDS]))


def without_dates(text: Column) -> Column:
    """The text without dates and bracketed cites, whose digits say nothing about amounts."""
    for pattern in (CITE, ISO_DATE, LONG_DATE, MONTH_YEAR):
        text = F.regexp_replace(text, pattern, " ")
    return text


def canonical_number(digits: Column, unit: Column) -> Column:
    """One spelling for an amount: no commas or idle zeros, scale words applied, percent kept as a unit. Digits too long for a decimal stay as they are."""
    plain = F.replace(digits, F.lit(","), F.lit(""))
    value = plain.try_cast("decimal(27,6)")
    scale = F.when(unit == "thousand", F.lit(1_000)).when(unit == "million", F.lit(1_000_000)).when(unit == "billion", F.lit(1_000_000_000)).otherwise(F.lit(1))
    scaled = F.regexp_replace((value * scale.cast("decimal(10,0)")).cast("decimal(37,6)").cast("string"), r"\.?0+$", "")
    whole = F.regexp_replace((value * scale.cast("decimal(10,0)")).cast("decimal(37,6)").cast("string"), r"\.0+$", "")
    text = F.coalesce(F.when(whole.contains("."), scaled).otherwise(whole), plain)
    return F.concat(text, F.when(unit.isin("%", "percent"), F.lit("%")).otherwise(F.lit("")))


def numbers(text: Column) -> Column:
    """Different canonical numbers of a text, dates and cites aside. Null has none."""
    some = F.coalesce(text, F.lit(""))
    plain = F.when(some.rlike("[0-9]"), without_dates(some)).otherwise(F.lit(""))  # most texts have no digit, which is quickly seen
    digits, units = (F.regexp_extract_all(plain, F.lit(NUMBER), F.lit(k)) for k in (1, 2))
    return F.array_distinct(F.transform(F.arrays_zip(digits.alias("d"), units.alias("u")), lambda x: canonical_number(x["d"], x["u"])))


def number_bearing(text: Column) -> Column:
    return F.coalesce(text.rlike("[0-9]"), F.lit(False))


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def name_date(name: Column) -> Column:
    return _some(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1))


def date_phrase(text: Column) -> Column:
    """The first date after a phrase that dates a source, or null."""
    return _some(F.regexp_extract(text, r"(?i)(?:data as of|filed|compiled|source date:?|as of) (\d{4}-\d{2}-\d{2})", 1))


def any_date(text: Column) -> Column:
    return _some(F.regexp_extract(text, ISO_DATE, 1))


def heads_dates(text: Column) -> Column:
    """Whether a text's first line names a column of dates."""
    return text.rlike(r"\A[^\n]*(?:as_of|date)")


def first_date(*found: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date") for c in found])


def source_date(name: Column, text: Column) -> Column:
    """The date of a source: in its name, then after a date phrase in its body, then in a column of dates."""
    return first_date(name_date(name), date_phrase(text), F.when(heads_dates(text), any_date(text)))


#: States that a file name or a status line can give.
STATES = ("final", "draft", "old", "raw", "archive")


def stem(name: Column) -> Column:
    """The name without folder, extension, date and state, by which versions of a file are told to belong together."""
    base = F.regexp_replace(F.regexp_replace(F.lower(name), r"^.*/", ""), r"\.[a-z0-9]+$", "")
    return F.regexp_replace(F.regexp_replace(base, r"^\d{4}-\d{2}-\d{2}-", ""), rf"[-_ ](?:{'|'.join(STATES)})$", "")


def name_state(name: Column) -> Column:
    """The state at the end of a file's name, or null."""
    return F.nullif(F.regexp_extract(F.lower(name), rf"[-_ ]({'|'.join(STATES)})(?:[-_ ][a-z]+)?\.[a-z0-9]+$", 1), F.lit(""))


def status_line(text: Column) -> Column:
    """The state that the first status line gives, or null."""
    return _some(F.lower(F.regexp_extract(text, rf"(?im)^Status: *({'|'.join(STATES)})\b", 1)))


def paragraphs(text: Column) -> Column:
    """The blocks between blank lines, headings counted, trimmed and without empty ones; null has none."""
    blocks = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n[ \t\r]*\n"), F.trim)
    return F.filter(F.transform(blocks, lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")


def lines(text: Column) -> Column:
    """The lines that aren't empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x != "")


def heading_level(block: Column) -> Column:
    """How many marks a Markdown heading has; 0 for other blocks."""
    return F.length(F.regexp_extract(block, r"^(#{1,6})\s+\S", 1))


def passage_id(name: Column, paragraph: Column, page: Column | None = None) -> Column:
    """The id of a file's paragraph; of a page's, with the page before it. A file below the packet's folder has its path in the id."""
    base = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    plain = F.format_string("passage_%s_p%04d", base, paragraph)
    return plain if page is None else F.when(page.isNull(), plain).otherwise(F.format_string("passage_%s_p%04d-%04d", base, page, paragraph))


def content_id(kind: str, *parts: Column) -> Column:
    """An id made of the content that it names."""
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts]), 256), 1, 16))
