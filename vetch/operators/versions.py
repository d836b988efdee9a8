"""What became of the passages between two versions of a packet, and which approvals that voids.

Files are paired by name, then by equal content, then by shared passages. Passages of a pair are aligned along the longest run that rises in
both versions; what was approved on a passage that changed or went is void.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut

CHANGES = ("kept", "moved", "changed", "removed", "new")


def places(evidence: DataFrame) -> DataFrame:
    """(name, place, hash, evidence_id) of evidence, each file's snippets numbered in the order in which they stand."""
    at = Window.partitionBy("name").orderBy(F.col("anchor.page").asc_nulls_first(), F.col("anchor.sheet").asc_nulls_first(), "anchor.ordinal", "anchor.kind", "evidence_id")
    text = F.col("hash") if "hash" in evidence.columns else F.sha2("text", 256)
    return evidence.select("name", F.row_number().over(at).cast("long").alias("place"), text.alias("hash"), "evidence_id")


def _set(passages: DataFrame, names: DataFrame) -> DataFrame:
    return passages.join(names, "name", "left_semi").select("name", "hash").distinct()


def _similar(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_name, new_name, shared) of files of which either shares half its different passages with the other or more, from sets (name, hash).

    Two such files share one of their rarest passages: of n, the n - ceil(n / 2) + 1 first by how many files have them. So a passage that
    all files have is in a join only for files made of such.
    """
    common = old.select("hash").unionAll(new.select("hash")).groupBy("hash").agg(F.count("*").alias("files"))

    def sized(side: DataFrame) -> DataFrame:
        rare = Window.partitionBy("name").orderBy("files", "hash")
        rows = side.join(common, "hash").withColumn("r", F.row_number().over(rare)).withColumn("n", F.count("*").over(Window.partitionBy("name")))
        return rows.where("r <= n - ceil(n / 2) + 1").select("name", "hash", "n")

    a, b = (sized(side).select(F.col("name").alias(f"{s}_name"), "hash", F.col("n").alias(f"{s}_n")) for side, s in ((old, "old"), (new, "new")))
    met = a.join(b, "hash").where("least(old_n, new_n) >= greatest(old_n, new_n) / 2").select("old_name", "new_name", "old_n", "new_n").distinct()
    both = met.join(old.withColumnRenamed("name", "old_name"), "old_name").join(new.withColumnRenamed("name", "new_name"), ["new_name", "hash"])
    return both.groupBy("old_name", "new_name", "old_n", "new_n").agg(F.count("*").alias("shared")).where("2 * shared >= greatest(old_n, new_n)").select("old_name", "new_name", "shared")


def paired(old_files: DataFrame, new_files: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_name, new_name, how) from files (name, sha256) and passages (name, hash): how is same name, same content or shared passages.

    Of files without a namesake, those of one content are paired in the order of their names; of what is left, two files are a pair if
    each is the other's best by shared passages, then by name.
    """
    twins = old_files.select("name").join(new_files.select("name"), "name").distinct()
    pairs = twins.select(F.col("name").alias("old_name"), F.col("name").alias("new_name"), F.lit("same name").alias("how"))

    def alone(files: DataFrame, s: str) -> DataFrame:
        left = files.select("name", "sha256").distinct().join(twins, "name", "left_anti")
        return left.withColumn("k", F.row_number().over(Window.partitionBy("sha256").orderBy("name"))).withColumnRenamed("name", f"{s}_name")

    a, b = cut(alone(old_files, "old")), cut(alone(new_files, "new"))
    equal = a.join(b, ["sha256", "k"]).select("old_name", "new_name", F.lit("same content").alias("how"))
    rest = [side.join(equal, f"{s}_name", "left_anti").select(F.col(f"{s}_name").alias("name")) for side, s in ((a, "old"), (b, "new"))]
    near = cut(_similar(*(cut(_set(p, r)) for p, r in zip((old, new), rest))))
    best = lambda s, t: F.row_number().over(Window.partitionBy(f"{s}_name").orderBy(F.desc("shared"), f"{t}_name")) == 1
    near = near.withColumn("of_old", best("old", "new")).withColumn("of_new", best("new", "old")).where("of_old and of_new")
    return cut(pairs.unionByName(equal).unionByName(near.select("old_name", "new_name", F.lit("shared passages").alias("how"))))


def rising(blocks: pd.DataFrame) -> pd.DataFrame:
    """The blocks (a, b, n) of a heaviest run that rises in a and b; of equally heavy ones the one whose every block comes first in a."""
    blocks = blocks.sort_values("a", ignore_index=True)

    def weights(rows) -> list[int]:
        """The heaviest run that ends with each row: ends holds rising b, best the rising weights up to them."""
        ends, best, out = [], [], []
        for b, n in rows:
            at = bisect_left(ends, b)
            w = n + (best[at - 1] if at else 0)
            out.append(w)
            stop = at
            while stop < len(ends) and best[stop] <= w:
                stop += 1
            if not at or best[at - 1] < w:
                ends[at:stop], best[at:stop] = [b], [w]
        return out

    n = blocks["n"].tolist()
    up = weights(zip(blocks["b"].tolist(), n))
    down = weights(zip((-blocks["b"]).tolist()[::-1], n[::-1]))[::-1]
    most, reached, keep = max(up, default=0), 0, []
    for u, d, w in zip(up, down, n):  # a block on a heaviest run that begins where the last kept one ends
        keep.append(u + d - w == most and u - w == reached)
        reached = u if keep[-1] else reached
    return blocks[keep]


def aligned(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_name, new_name, change, old_place, new_place) of all passages (name, place, hash) of two versions; change as in CHANGES.

    The k-th of equal passages is the k-th of the other version. Passages that follow each other in both versions are a block; blocks
    on a heaviest rising run are kept, others moved. Between two kept passages the k-th old passage without an equal is the k-th new one,
    changed. Windows go by file, and what one task holds of a file are its blocks: as many as there were moves and edits, not passages.
    Passages of files without a partner are removed or new; repeated rows would be passages of their own, so places must differ.
    """
    def of(side: DataFrame, s: str) -> DataFrame:
        names = pairs.select("old_name", "new_name").withColumn("name", F.col(f"{s}_name"))
        return side.select("name", F.col("place").alias(f"{s}_place"), "hash").join(names, "name").drop("name")

    pair = ["old_name", "new_name"]
    by = Window.partitionBy(*pair)
    nth = lambda side, s: side.withColumn("k", F.row_number().over(Window.partitionBy(*pair, "hash").orderBy(f"{s}_place")))
    rows = nth(of(old, "old"), "old").join(nth(of(new, "new"), "new"), [*pair, "hash", "k"], "full").drop("hash", "k")
    rows = cut(rows)  # read six times

    both = rows.where("old_place is not null and new_place is not null")
    ranked = both.withColumn("b", F.row_number().over(by.orderBy("new_place"))).withColumn("a", F.row_number().over(by.orderBy("old_place")))
    begins = F.coalesce(F.col("b") - F.lag("b").over(by.orderBy("a")) != 1, F.lit(True))
    ranked = ranked.withColumn("block", F.sum(begins.cast("long")).over(by.orderBy("a").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = cut(ranked)
    blocks = ranked.groupBy(*pair, "block").agg(F.min("a").cast("long").alias("a"), F.min("b").cast("long").alias("b"), F.count("*").alias("n"))
    blocks = cut(blocks)
    many = blocks.join(blocks.where("block = 2").select(*pair), pair, "left_semi")
    on_run = many.groupBy(*pair).applyInPandas(lambda g: rising(g)[[*pair, "block"]], "old_name string, new_name string, block long")
    one = blocks.join(blocks.where("block = 2").select(*pair), pair, "left_anti").select(*pair, "block")
    run = on_run.unionByName(one).withColumn("kept", F.lit(True))
    matched = ranked.join(run, [*pair, "block"], "left").select(*pair, "old_place", "new_place", F.coalesce("kept", F.lit(False)).alias("kept"))
    matched = cut(matched)

    def gaps(s: str, t: str) -> DataFrame:
        """Passages without an equal: how many kept ones stand before them and how many others of that gap."""
        alone = rows.where(f"{t}_place is null").select(*pair, f"{s}_place", F.lit(0).alias("kept"), F.lit(True).alias("alone"))
        known = matched.select(*pair, f"{s}_place", F.col("kept").cast("int").alias("kept"), F.lit(False).alias("alone"))
        gap = F.sum("kept").over(by.orderBy(f"{s}_place").rowsBetween(Window.unboundedPreceding, 0))
        out = alone.unionByName(known).withColumn("gap", gap).where("alone")
        return out.withColumn("k", F.row_number().over(Window.partitionBy(*pair, "gap").orderBy(f"{s}_place"))).select(*pair, "gap", "k", f"{s}_place")

    edited = gaps("old", "new").join(gaps("new", "old"), [*pair, "gap", "k"], "full")
    said = F.when(F.col("new_place").isNull(), "removed").when(F.col("old_place").isNull(), "new").otherwise("changed")
    cols = [*pair, "change", "old_place", "new_place"]
    out = matched.withColumn("change", F.when(F.col("kept"), "kept").otherwise("moved")).select(cols).unionByName(edited.withColumn("change", said).select(cols))
    none, nowhere = F.lit(None).cast("string"), F.lit(None).cast("long")
    gone = old.join(pairs.select(F.col("old_name").alias("name")), "name", "left_anti").select(F.col("name").alias("old_name"), none.alias("new_name"), F.lit("removed").alias("change"), F.col("place").alias("old_place"), nowhere.alias("new_place"))
    came = new.join(pairs.select(F.col("new_name").alias("name")), "name", "left_anti").select(none.alias("old_name"), F.col("name").alias("new_name"), F.lit("new").alias("change"), nowhere.alias("old_place"), F.col("place").alias("new_place"))
    return out.unionByName(gone).unionByName(came)


def approvals(changes: DataFrame, old: DataFrame, approved: DataFrame) -> DataFrame:
    """approved (evidence_id, ...) with what became of the evidence: old_name, old_place, new_name, new_place, change and void.

    A passage that only moved says what it said; its approval stands, though no run takes it over by itself.
    """
    at = old.select(F.col("name").alias("old_name"), F.col("place").alias("old_place"), "evidence_id")
    found = approved.join(at, "evidence_id").join(changes.where("old_place is not null"), ["old_name", "old_place"])
    return found.withColumn("void", F.col("change").isin("changed", "removed"))
