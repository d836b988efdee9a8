"""Amounts that evidence contradicts: money and percentages of one subject, by value and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# An amount of money or in scale words, or a percentage.
AMOUNT = r"(\$?)([0-9][0-9,]*(?:\.[0-9]+)?)(?: ?(%|percent|thousand|million|billion))?"
#: Terms that a claim and its evidence must share to be about one subject, and how far apart two amounts of one thing can be.
LEAST_SHARED, FACTOR = 3, 2.0


def amounts(text: Column) -> Column:
    """The amounts of a text that have a unit, as structs (kind, value, said); dates, cites and bare counts aside."""
    plain = X.without_dates(F.coalesce(text, F.lit("")))
    marks, digits, units = (F.regexp_extract_all(plain, F.lit(AMOUNT), F.lit(k)) for k in (1, 2, 3))

    def one(x):
        kind = F.when(x["u"].isin("%", "percent"), "percent").when((x["m"] == "$") | (x["u"] != ""), "amount")
        number = X.canonical_number(x["d"], x["u"])
        return F.struct(kind.alias("kind"), F.regexp_replace(number, "%$", "").try_cast("decimal(38,6)").alias("value"), F.concat(x["m"], number).alias("said"))

    found = F.transform(F.arrays_zip(marks.alias("m"), digits.alias("d"), units.alias("u")), one)
    return F.filter(found, lambda a: a["kind"].isNotNull() & (a["value"] > 0))


def said_date(text: Column) -> Column:
    """The first date that a text names, as 2006-03-31 or March 31, 2006."""
    iso = F.try_to_timestamp(F.nullif(F.regexp_extract(text, X.ISO_DATE, 1), F.lit("")), F.lit("yyyy-MM-dd"))
    long = F.try_to_timestamp(F.nullif(F.regexp_extract(text, X.LONG_DATE, 1), F.lit("")), F.lit("MMMM d, yyyy"))
    return F.coalesce(iso, long).cast("date")


def contradicted(claims: DataFrame, evidence: DataFrame, pairs: DataFrame) -> DataFrame:
    """(claim_id, evidence_id, amount, other, relation): amounts of claims (claim_id, text) that evidence (evidence_id, text) on the same subject gives otherwise.

    ``pairs`` (claim_id, evidence_id, term_overlap) say what meets, such as suggestions or support; a pair is about one subject if it shares
    LEAST_SHARED terms. An amount is contradicted if the evidence has amounts of its kind, none equal, and the nearest by ratio is within FACTOR:
    others are of something else. ``other`` is that nearest one, of two as near the smaller. Evidence that names an earlier date than the claim says nothing
    about it; of a later date, the relation is ``outdated``, else ``contradicted``. Null texts have no amounts.
    """
    a = claims.select("claim_id", F.explode(amounts(F.col("text"))).alias("a"), said_date(F.col("text")).alias("day"))
    b = evidence.select("evidence_id", amounts(F.col("text")).alias("b"), said_date(F.col("text")).alias("later"))
    met = pairs.where(F.col("term_overlap") >= LEAST_SHARED).select("claim_id", "evidence_id").distinct().join(a, "claim_id").join(b, "evidence_id")
    met = met.where("later is null or day is null or later >= day").withColumn("same", F.filter("b", lambda x: x["kind"] == F.col("a.kind")))
    ratio = lambda x: F.greatest(x["value"].cast("double") / F.col("a.value").cast("double"), F.col("a.value").cast("double") / x["value"].cast("double"))
    near = F.array_min(F.transform("same", lambda x: F.struct(ratio(x).alias("ratio"), x["value"].alias("value"), x["said"].alias("said"))))
    met = met.where(~F.exists("same", lambda x: x["value"] == F.col("a.value"))).withColumn("near", near).where(F.col("near.ratio") <= FACTOR)
    relation = F.when(F.col("later") > F.col("day"), "outdated").otherwise("contradicted")
    return met.select("claim_id", "evidence_id", F.col("a.said").alias("amount"), F.col("near.said").alias("other"), relation.alias("relation")).distinct()
