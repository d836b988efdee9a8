"""Advisory links between claims and evidence: shared terms and numbers, source status and anchors make a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut

# What a source's status is worth, in hundredths.
STATUS_WEIGHT = {"final": 100, "raw": 80, "unclear": 50, "draft": 40, "archive": 30, "old": 20}
#: Parts of a confidence, in hundredths.
TERM_PART, NUMBER_PART, STATUS_PART, ANCHOR_PART = 60, 20, 15, 5
TOP = 3


def exploded(df: DataFrame, column: str) -> DataFrame:
    """A row for each element of the array in ``column`` that isn't null, under the same name.

    Rows without elements are dropped after the arrays are taken apart: an inner explode has the optimiser filter by the array's size first, for
    which it works the array out from the text a second time.
    """
    return df.withColumn(column, F.explode_outer(column)).where(F.col(column).isNotNull())


def overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, column: str, name: str, unique: bool = False) -> DataFrame:
    """(left_id, right_id, name): how many elements of the arrays in ``column`` two rows share, where they share any.

    An inverted index: both sides are exploded and joined on the element. With ``unique``, no id has two rows; then a pair of which either has one
    element alone is met once at most, and is in no grouping.
    """
    sides = [df.select(i, F.array_distinct(column).alias("_e")) for df, i in ((left, left_id), (right, right_id))]
    met = lambda a, b: exploded(a, "_e").join(exploded(b, "_e"), "_e")
    counted = lambda rows: rows.groupBy(left_id, right_id).agg(F.count("*").alias(name))
    if not unique:
        return counted(met(*sides))
    size = F.size(F.array_compact("_e"))
    (one, many), (right_one, right_many) = ((x.where(size == 1), x.where(size > 1)) for x in sides)
    once = met(one, sides[1]).unionByName(met(many, right_one)).select(left_id, right_id, F.lit(1).cast("long").alias(name))
    return once.unionByName(counted(met(many, right_many)))


def status_weight(status: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS_WEIGHT.items() for x in kv])[status], F.lit(STATUS_WEIGHT["unclear"]))


def standing(status: Column, anchored: Column) -> Column:
    """What a piece of evidence is worth by itself."""
    return (status_weight(status) * STATUS_PART + F.when(anchored, F.lit(ANCHOR_PART * 100)).otherwise(F.lit(0))).cast("long")


def confidence(shared: Column, n_claim: Column, n_evidence: Column, shared_numbers: Column, n_numbers: Column, standing: Column) -> Column:
    """In ten-thousandths, in whole numbers: shares of terms in common and of the claim's numbers found, status, and an anchor."""
    terms = F.floor(shared * TERM_PART * 100 / (n_claim + n_evidence - shared))
    numbers = F.when(n_numbers > 0, F.floor(shared_numbers * NUMBER_PART * 100 / n_numbers)).otherwise(F.lit(0))
    return (terms + numbers + standing).cast("long")


#: Postings of evidence that a claim reads before its bound is known; numbers that more evidence has are only counted, never joined.
REACH, HOT = 32, 1000


def _elements(df: DataFrame, *keep: str) -> DataFrame:
    """(*keep, term, e): the row's different terms and numbers, with whether they are terms. Null arrays have none.

    What an element is follows from its place in one plain array of both; an array of structs costs about as much again as finding the terms.
    """
    terms, numbers = (F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))) for c in ("terms", "numbers"))
    rows = df.select(*keep, F.size(terms).alias("_n"), F.concat(terms, numbers).alias("_all"))
    return rows.select(*keep, "_n", F.posexplode_outer("_all").alias("_at", "e")).where("_at is not null").select(*keep, (F.col("_at") < F.col("_n")).alias("term"), "e")


def _same(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """left and right joined where they have the same element, and the same in the columns ``on``."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in ("term", "e", *on)})
    same = F.col("e").eqNullSafe(F.col("_e"))
    for c in ("term", *on):
        same = same & (F.col(c) == F.col(f"_{c}"))
    return left.join(right, same).drop("_term", "_e", *[f"_{c}" for c in on])


def by_rarity(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each claim (claim_id, claim_source, n_claim, n_numbers) with those of its terms and numbers that some evidence has, as arrays of (df, e), the
    rare ones first; df is in how much evidence."""
    frequency = _elements(evidence).groupBy("term", "e").agg(F.count("*").alias("df"))
    a = claims.select("claim_id", F.col("source_id").alias("claim_source"), F.size("terms").alias("n_claim"), F.size("numbers").alias("n_numbers"), "terms", "numbers")
    met = _same(_elements(a, "claim_id", "claim_source", "n_claim", "n_numbers"), frequency)
    of = lambda term: F.sort_array(F.collect_list(F.when(F.col("term") == term, F.struct("df", "e"))))
    return met.groupBy("claim_id", "claim_source", "n_claim", "n_numbers").agg(of(True).alias("terms"), of(False).alias("numbers"))


def _met(wanted: DataFrame, evidence: DataFrame, on: list[str]) -> DataFrame:
    """(claim_id, evidence_id, ..., met, met_numbers): evidence that shares one of a claim's ``first`` rarest terms or a number that isn't hot; how many.

    ``on`` has standing where a claim wants different numbers of terms for evidence of different standing.
    """
    plain = lambda c: F.transform(c, lambda x: x["e"])
    rare, cold = F.slice("terms", 1, F.col("first")), F.filter("numbers", lambda x: x["df"] <= HOT)
    wanted = _elements(wanted.select("claim_id", "claim_source", *on, plain(rare).alias("terms"), plain(cold).alias("numbers")), "claim_id", "claim_source", *on)
    pairs = _same(wanted, _elements(evidence, "evidence_id", "source_id", *on), *on).where("claim_source <> source_id")
    return pairs.groupBy("claim_id", "evidence_id", *on).agg(F.count_if(F.col("term")).alias("met"), F.count_if(~F.col("term")).alias("met_numbers"))


def suggest(claims: DataFrame, evidence: DataFrame, k: int = TOP, reach: int = REACH) -> DataFrame:
    """The k best suggestions for each claim. They are advice: nothing but an audited decision makes support of them.

    A threshold algorithm. A claim first meets the evidence that shares its rarest terms, about ``reach`` of it. The k-th best confidence that
    this proves is a bound: evidence that shares none but r of the claim's most frequent terms can reach no more than r / n_claim of the
    part of terms, all of the claim's hot numbers, and its own standing (status and anchor, 12 values at most). So many frequent terms as
    can't lift evidence of a standing to the bound are in no join with it; it is met by the others. Of what a claim has met, only what could still
    reach the bound is held against it in full. Nothing is left out: a claim with a low bound joins more of its terms.
    """
    evidence = evidence.withColumn("standing", standing(F.col("status"), F.col("anchor").isNotNull()))
    sizes = evidence.select("evidence_id", "source_id", F.size("terms").alias("n_evidence"), "status", F.col("anchor").isNotNull().alias("anchored"), F.col("standing").alias("_standing"))
    scored = lambda pairs, terms, numbers: pairs.join(sizes, "evidence_id").withColumn("confidence", confidence(terms, F.col("n_claim"), F.col("n_evidence"), numbers, F.col("n_numbers"), F.col("_standing")))
    best = lambda *order: Window.partitionBy("claim_id").orderBy(*order)
    ordered = cut(by_rarity(claims, evidence))
    reading = F.aggregate("terms", F.struct(F.lit(0).cast("long").alias("df"), F.lit(0).alias("n")), lambda s, x: F.struct((s["df"] + x["df"]).alias("df"), F.when((s["df"] + x["df"] <= reach) | (s["df"] == 0), s["n"] + 1).otherwise(s["n"]).alias("n")))["n"]
    least = _met(ordered.withColumn("first", reading), evidence, []).where("met > 0").join(ordered.select("claim_id", "n_claim", "n_numbers"), "claim_id")
    least = scored(least, F.col("met"), F.col("met_numbers"))
    bound = least.withColumn("rank", F.row_number().over(best(F.desc("confidence")))).where(F.col("rank") == k).select("claim_id", F.col("confidence").alias("bound"))
    hot = F.size(F.filter("numbers", lambda x: x["df"] > HOT))
    bounded = ordered.join(bound, "claim_id", "left").withColumn("hot", hot).join(F.broadcast(evidence.select("standing").distinct()))  # 12 rows at most
    spare = F.col("bound") - F.col("standing") - F.when(F.col("hot") > 0, F.floor(F.col("hot") * NUMBER_PART * 100 / F.col("n_numbers"))).otherwise(0)
    # r terms give floor(r * 6000 / n_claim) at most, which is less than spare if r is less than spare * n_claim / 6000.
    idle = F.greatest(F.lit(0), F.ceil(F.coalesce(spare, F.lit(0)) * F.col("n_claim") / (TERM_PART * 100)) - 1)
    bounded = bounded.withColumn("idle", F.least(F.size("terms").cast("long"), idle)).withColumn("first", (F.size("terms") - F.col("idle")).cast("int"))
    lists = bounded.select("claim_id", "standing", "n_claim", "n_numbers", "bound", "idle", "hot")
    most = scored(_met(bounded, evidence, ["standing"]).join(lists, ["claim_id", "standing"]), F.least(F.col("met") + F.col("idle"), F.col("n_claim"), F.col("n_evidence")), F.least(F.col("met_numbers") + F.col("hot"), F.col("n_numbers")))
    kept = cut(most.where("bound is null or confidence >= bound").select("claim_id", "evidence_id", "n_claim", "n_numbers", "met", "met_numbers", (F.col("idle") + F.col("hot") == 0).alias("full")))
    plain = lambda c: F.transform(c, lambda x: x["e"])
    part = kept.where("not full").drop("met", "met_numbers").join(ordered.select("claim_id", plain("terms").alias("a"), plain("numbers").alias("an")), "claim_id")
    part = part.join(evidence.select("evidence_id", F.col("terms").alias("b"), F.col("numbers").alias("bn")), "evidence_id")
    both = lambda x, y: F.coalesce(F.size(F.array_intersect(x, y)), F.lit(0)).cast("long")
    counted = part.select("claim_id", "evidence_id", "n_claim", "n_numbers", both("a", "b").alias("met"), both("an", "bn").alias("met_numbers"))
    counted = counted.unionByName(kept.where("full").drop("full")).where("met > 0").withColumnsRenamed({"met": "term_overlap", "met_numbers": "number_overlap"})
    s = scored(counted, F.col("term_overlap"), F.col("number_overlap"))
    s = s.withColumn("rank", F.row_number().over(best(F.desc("confidence"), "evidence_id"))).where(F.col("rank") <= k)
    basis = F.format_string("%d terms, %d numbers, status %s", "term_overlap", "number_overlap", "status")
    return s.select("claim_id", "evidence_id", "source_id", "term_overlap", "number_overlap", status_weight(F.col("status")).alias("status_factor"), "anchored", "confidence", "rank", basis.alias("basis"))
